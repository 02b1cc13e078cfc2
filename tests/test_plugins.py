"""Plug-ins and helpers: pair scorer (M7), translator (F29), language id (F28)."""

import pandas as pd
import pytest

from vetline.operators.clean import clean_reviews
from vetline.operators.language import TrigramLanguageModel
from vetline.operators.relevancy import relevancy


def test_scorer_plugin_calibrates(spark):
    def _raw_scores(texts: pd.Series, descs: pd.Series) -> pd.Series:
        # stand-in for a cross-encoder: shared-word count minus one
        return pd.Series([len(set(t.lower().split()) & set(d.lower().split())) - 1.0 for t, d in zip(texts, descs)])

    df = spark.createDataFrame([("a", "fresh sushi here", "fresh sushi bar"), ("b", "app crash", "park")],
                               "review_id string, text string, description string")
    got = {r["review_id"]: (r["relevancy"], r["relevancy_backend"])
           for r in relevancy(df, scorer=_raw_scores).collect()}
    # raw scores 1.0 and -1.0: one is outside [0, 1], so both go through the sigmoid
    assert got["a"][0] == pytest.approx(1 / (1 + 2.718281828459045 ** -1.0))
    assert got["b"][0] == pytest.approx(1 / (1 + 2.718281828459045 ** 1.0))
    assert got["a"][1] == "scorer"
    fallback = relevancy(df).collect()
    assert all(r["relevancy_backend"] == "tfidf" for r in fallback)


def test_clean_with_language_and_translator(spark):
    train = spark.createDataFrame(
        [(i, t, lang) for i, (t, lang) in enumerate(
            [("the cat is on the table and the dog is in the house", "en"),
             ("this is the best place in the city with the nicest people", "en"),
             ("le chat est sur la table et le chien est dans la maison", "fr"),
             ("c'est le meilleur endroit de la ville avec les gens les plus sympas", "fr")])],
        "doc_id long, text string, lang string")
    model = TrigramLanguageModel.fit(train)
    reviews = spark.createDataFrame(
        [("r1", "The dog is in the house"), ("r2", "Le chien est dans la maison &amp; le chat"), ("r3", "  ")],
        "review_id string, text string")

    def upper_translate(texts: pd.Series, langs: pd.Series) -> pd.Series:
        assert set(langs) == {"fr"}
        return texts.str.upper()

    out = {r["review_id"]: r for r in clean_reviews(reviews, model, translate=upper_translate).collect()}
    assert out["r1"]["lang"] == "en" and out["r1"]["text_model"] == "The dog is in the house"
    assert out["r2"]["lang"] == "fr" and out["r2"]["text"] == "Le chien est dans la maison & le chat"
    assert out["r2"]["text_model"] == "LE CHIEN EST DANS LA MAISON & LE CHAT"
    assert out["r3"]["lang"] == "unknown" and out["r3"]["text"] == ""


def test_language_by_join_equals_broadcast(spark, monkeypatch):
    from vetline.operators import language

    monkeypatch.setattr(language, "GROUP_ROWS", 7)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    odd = spark.createDataFrame([(-1, None, None), (-2, None, "  "), (-3, "en", "ab"), (-4, "xx", "日本語😀 テスト")], docs.schema)
    model = TrigramLanguageModel.fit(docs.unionAll(odd))
    more = docs.unionAll(docs).unionAll(odd)
    small = sorted(map(tuple, model.predict(more).select("doc_id", "lang_pred").collect()))
    wide = model.predict(more, small=10)
    assert sorted(map(tuple, wide.select("doc_id", "lang_pred").collect())) == small
    assert wide.columns == [*more.columns, "lang_pred"]
    plan = wide._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "SortMergeJoin" in plan or "Join" in plan


def test_translation_sends_each_text_once(spark, tmp_path):
    from vetline.operators.clean import translated

    path = str(tmp_path / "table")
    sent = spark.sparkContext.accumulator(0)

    def shout(texts: pd.Series, langs: pd.Series) -> pd.Series:
        sent.add(len(texts))
        return pd.Series([None if t == "rien" else f"{lang}:{t.upper()}" for t, lang in zip(texts, langs)])

    rows = [("fr", "bonjour"), ("fr", "bonjour"), ("de", "bonjour"), ("en", "hello"), ("unknown", "x"), (None, "y"), ("fr", " "),
            ("fr", None), ("fr", "rien")]
    first = spark.createDataFrame(rows, "lang string, text string")
    want = sorted([("fr:BONJOUR",), ("fr:BONJOUR",), ("de:BONJOUR",), ("hello",), ("x",), ("y",), (" ",), (None,), ("rien",)], key=str)
    assert sorted(map(tuple, translated(first, shout, path).select("text_model").collect()), key=str) == want
    assert sent.value == 3
    second = first.unionAll(spark.createDataFrame([("fr", "merci")], first.schema))
    assert translated(second, shout, path).count() == 10 and sent.value == 4
    assert sorted(map(tuple, translated(first, shout).select("text_model").collect()), key=str) == want
    assert translated(first.limit(0), shout).count() == 0


def test_scorer_gets_each_pair_once_and_is_made_once(spark):
    from vetline.operators.relevancy import score_pairs

    made, sent = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make():
        made.add(1)

        def score(texts, descs):
            sent.add(len(texts))
            assert (texts.str.len() + descs.str.len()).is_monotonic_increasing
            return texts.str.len() - 2.0 * descs.str.len()
        return score

    rows = [("a", "xy", "z"), ("b", "xy", "z"), ("c", None, "zz"), ("d", "", "zz"), ("e", "x", "yz")] * 30
    df = spark.createDataFrame(rows, "review_id string, text string, description string")
    got = {(r.review_id, r.relevancy) for r in score_pairs(df, make_scorer=make).collect()}
    assert got == {("a", 0.0), ("b", 0.0), ("c", -4.0), ("d", -4.0), ("e", -3.0)}
    assert sent.value == 3 and 1 <= made.value <= 4
    with pytest.raises(ValueError):
        score_pairs(df)


@pytest.fixture(scope="module")
def keyed_texts(spark):
    """Narrow rows (repeated and null keys) and what adds their texts; key 2 has
    two texts, one of them twice."""
    texts = spark.createDataFrame([(1, "one"), (2, "two"), (2, "zwei"), (2, "two"), (4, "one")], "k long, text string")
    rows = spark.createDataFrame([(i, k, lang, f"d{i % 2}") for i, (k, lang) in enumerate(
        [(1, "fr"), (2, "de"), (2, "de"), (3, "fr"), (None, None), (4, "fr"), (1, "en")] * 3)],
        "n long, k long, lang string, description string")
    return rows, lambda r: r.join(texts, "k", "left")


def test_pairs_without_texts_score_as_pairs_with_texts(spark, keyed_texts):
    from vetline.operators.relevancy import score_pairs

    rows, add = keyed_texts
    sent = spark.sparkContext.accumulator(0)

    def score(texts, descs):
        sent.add(len(texts))
        return texts.str.len() * 2.0 - 3.0 + descs.str[1].astype(float)

    for f, kw in ((score_pairs, {}), (relevancy, {})):
        want = f(add(rows), scorer=score).select("n", "relevancy").collect()
        before = sent.value
        got = f(rows, scorer=score, texts=add, **kw)
        assert sorted(got.select("n", "relevancy").collect()) == sorted(want)
        # 'one', 'two', 'zwei' and the empty text, each with two descriptions
        assert sent.value - before == 8 and "text" not in got.columns


def test_rows_without_texts_are_translated_as_rows_with_texts(spark, keyed_texts, tmp_path):
    from vetline.operators.clean import text_key, translated
    from pyspark.sql import functions as F

    rows, add = keyed_texts
    sent = spark.sparkContext.accumulator(0)

    def shout(texts, langs):
        sent.add(len(texts))
        return langs + ":" + texts.str.upper()

    want = translated(add(rows), shout, key="digest")
    held = want.where("digest is not null").withColumn("same", F.col("digest") == text_key(F.col("text"), F.col("lang")))
    assert held.where("not same").isEmpty() and not held.isEmpty()
    before = sent.value
    got = translated(rows, shout, str(tmp_path / "t"), texts=add, key="digest")
    order = lambda df: sorted(map(tuple, df.select("n", "digest", "text_model").collect()), key=str)
    assert order(got) == order(want) and sent.value - before == 3 and "text" not in got.columns
    assert order(translated(rows, shout, str(tmp_path / "t"), texts=add, key="digest")) == order(want) and sent.value - before == 3


def test_batches_by_length_send_neighbours_once():
    from vetline.operators.partitioning import by_length

    batches = [pd.DataFrame({"k": list("aabb"), "t": ["xxx", "xxx", "y", "y"]}), pd.DataFrame({"k": list("bc"), "t": ["y", "zz"]}),
               pd.DataFrame({"k": ["c"], "t": ["zz"]})]
    one = [list(b["t"]) for b in by_length(iter(batches), "k", ["t"])]
    assert one == [["y", "zz"], ["xxx"]]
    assert [list(b["t"]) for b in by_length(iter(batches), "k", ["t"], limit=1)] == [["y", "xxx"], ["zz"]]
    assert not list(by_length(iter([]), "k", ["t"]))
