"""Row-level text features on own texts with values worked out by hand."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vetline.operators.features import add_row_features
from vetline.functions import patterns as P
from vetline.functions.rules import weak_labels
from vetline.functions import text as X

# Own texts; expected values worked out by hand from the stated rules.
ROWS = [
    ("a", "Buy now at http://offers.example/x or WWW, 50 % off!", "Ola Berg"),
    ("b", "I did not go. Menu and table were fine, damn.", "qRt55zz"),
    ("c", "sooooo good :) 😀", "Hirsch Schmidt"),
    ("d", "", ""),
    ("e", None, None),
    ("f", "abab", "EEEEE7777"),
    ("g", "很好 <b>ok</b>", "王伟"),
]
EXPECTED = {
    "a": {"char_len": 52, "word_len": 9, "url_count": 1, "has_url": True, "promo_terms": True, "never_been_cues": False,
          "emoji_count": 0, "repeat_ratio": 0.0, "profanity_count": 0, "experiential_score": 0.0, "caps_ratio": 4 / 34,
          "nonword_ratio": 8 / 52},
    "b": {"char_len": 45, "word_len": 10, "url_count": 0, "promo_terms": False, "never_been_cues": True,
          "profanity_count": 1, "experiential_score": 0.5, "caps_ratio": 2 / 33, "nonword_ratio": 3 / 45},
    "c": {"char_len": 16, "word_len": 4, "emoji_count": 1, "repeat_ratio": 1.0, "caps_ratio": 0.0, "nonword_ratio": 3 / 16},
    "d": {"char_len": 0, "word_len": 0, "caps_ratio": 0.0, "nonword_ratio": 0.0, "char_entropy": 0.0, "text_norm": ""},
    "e": {"char_len": 0, "word_len": 0, "repeat_ratio": 0.0, "char_entropy": 0.0, "text_norm": "", "profanity_count": 0},
    "f": {"char_len": 4, "char_entropy": 1.0, "text_norm": "abab"},
    "g": {"char_len": 12, "emoji_count": 2, "text_norm": "很好 ok"},
}
GIBBERISH = {"a": 0.0, "b": 0.6000000000000001, "c": 0.6000000000000001, "d": 1.0, "e": 1.0, "f": 0.2, "g": 0.4}
WEAK = {"a": ["Advertisement/Promo"], "b": ["Rant (Likely Non-Visitor)"], "c": ["Spam/Low-quality"]}


@pytest.fixture(scope="module")
def feats(spark):
    df = spark.createDataFrame(ROWS, "review_id string, text string, user_name string")
    out = add_row_features(df).withColumn("weak", weak_labels("text"))
    return {r["review_id"]: r for r in out.collect()}


def test_row_features(feats):
    for rid, expected in EXPECTED.items():
        for k, v in expected.items():
            want = pytest.approx(v, abs=1e-12) if isinstance(v, float) else v
            assert feats[rid][k] == want, (rid, k, feats[rid][k], v)


def test_entropy_of_repeated_halves(spark):
    rows = [("ab" * 5000,), ("a" * 100,), ("abcd",), (None,), ("😀é",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(X.char_entropy("t")).collect()]
    assert got == pytest.approx([1.0, 0.0, 2.0, 0.0, 1.0])


def test_gibberish_goldens_exact(feats):
    for rid, v in GIBBERISH.items():
        assert feats[rid]["user_name_gibberish"] == v, rid
    assert feats["b"]["user_name_suspicious"] and not feats["f"]["user_name_suspicious"]


def test_weak_labels(feats):
    for rid, _, _ in ROWS:
        assert feats[rid]["weak"] == WEAK.get(rid, []), rid


def test_missing_user_name_column_scores_zero(spark):
    df = spark.createDataFrame([("a", "text")], "review_id string, text string")
    r = add_row_features(df).collect()[0]
    assert r["user_name_gibberish"] == 0.0 and r["user_name_suspicious"] is False


def test_normalize_text_cases(spark):
    cases = {
        "A &amp; B &lt;b&gt;x&lt;/b&gt;": "A & B x",
        "<i\n>kept": "<i >kept",
        "a b": "a b",
        "ﬁne": "fine",
        "  plain   ascii <b>tag</b> ": "plain ascii tag",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", X.normalize_text("t").alias("n")).collect()}
    for k, v in cases.items():
        assert got[k] == v, repr(k)


def test_folded_letters_of_case_insensitive_rules(spark):
    texts = ["big ſale", "DıSCOUNT", "İ DID NOT GO", "I neverſ been", "Never Been", "10 %　OFF", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    t = F.col("text")
    plain = df.select("i", t.rlike(P.promo_pattern()).alias("p"), t.rlike(P.never_been_pattern()).alias("n"))
    got = df.select("i", X.promo_terms("text").alias("p"), X.never_been_cues("text").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert [r.p for r in got.orderBy("i").collect()] == [True, True, False, False, False, True, False]


def test_normalised_words_and_entropy_in_slices(spark, monkeypatch):
    texts = ["a\u0085b\u001cc  d ", "x &lt;b&gt; <i>y</i>\n<not\na tag> ﬁne", "", None, "　 ", "\U0001f600\U0001f600 ab" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", X.word_len("text").alias("w"), X.text_norm("text").alias("n")).orderBy("i").collect()
    assert [r.w for r in rows] == [len((t or "").split()) for t in texts]
    assert rows[0].n == "a b c d" and rows[1].n == "x y <not a tag> fine" and rows[4].n == ""
    plan = df.select(X.text_norm("text"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan  # one pass in an Arrow batch
    array = pa.array(texts * 3)
    whole = X._entropy_udf.func(array).to_pylist()
    monkeypatch.setattr(X, "SLICE_CHARS", 100)
    assert X._entropy_udf.func(array).to_pylist() == whole
    monkeypatch.setattr(X, "TABLE_CELLS", 0)
    assert X._entropy_udf.func(array).to_pylist() == whole


def test_row_slices_bound_what_a_task_holds():
    sizes = np.array([3, 0, 9, 1, 1, 20, 0])
    cuts = list(X.row_slices(sizes, 5))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(len(sizes)))
    assert all(sizes[a:b].sum() <= 5 or b - a == 1 for a, b in cuts)
    assert list(X.row_slices(np.zeros(0, int), 5)) == []


def test_screens_agree_with_their_patterns(spark):
    """Terms in every case and with the letters outside ASCII that a
    case-insensitive pattern takes for theirs; lone parts of terms."""
    from pyspark.sql import functions as F
    from vetline.functions import patterns as P
    from vetline.functions import text as X

    words = ["Discount", "dİscount", "dıscount", "diſcount", "PROMO", "couPon", "DEAL", "ſale", "SALE", "50% OFF", "50% off", "off 50%",
             "dm\tme", "DM ME", "me dm", "DMme", "buy now", "Buy Now", "buy  now", "", "x", "ordK", "http://a", "HTTP://a", "https://",
             "://a", "www.a", "www. a", "www.", "http://　"]
    df = spark.createDataFrame([(f"{a} pre {w} {b}",) for w in words for a in ("", "ſ") for b in ("", "K.")] + [(None,)], "t string")
    t = F.coalesce("t", F.lit(""))
    got = df.select("t", X.promo_terms("t").alias("p"), t.rlike(P.promo_pattern()).alias("p0"),
                    X.has_url("t").alias("u"), t.rlike(P.url_pattern()).alias("u0")).collect()
    assert [r for r in got if r.p != r.p0 or r.u != r.u0] == [] and {r.p for r in got} == {r.u for r in got} == {True, False}


def test_counts_and_literals_of_whole_slices(monkeypatch):
    """Characters of all lengths, runs that reach into the next text, texts over
    one piece, nulls and a part of an array against one text at a time."""
    import random
    import re
    import unicodedata

    from vetline.functions import scan

    def counts(t):
        kinds = [unicodedata.category(c) for c in t]
        return {"letters": sum(k[0] == "L" for k in kinds), "uppers": kinds.count("Lu"), "words": len(t.split()),
                "nonwords": sum(k[0] not in "LN" and not c.isspace() for c, k in zip(t, kinds)),
                "emojis": sum(ord(c) > 10000 for c in t), "repeats": bool(re.search("([^\n])\\1{4}", t))}

    def bits(t):
        return -1 if re.search("[İıſK]", t) else sum(1 << i for i, x in enumerate(X._LITERALS) if x in t.lower())

    rng = random.Random(5)
    parts = ["a", "B", "é", "É", " ", "\n", "　", "\x85", "\U0001f600", "中", "aaaa", "中中中中", "\n\n\n\n\n",
             "٣", "_", "de", "al", "We went", "ord", "K", "50 %", *X._LITERALS]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(600)] + ["ab " * 40_000, "éA" * 40_000, "", None]
    for limit in (1 << 19, 40):
        monkeypatch.setattr(scan, "SLICE_BYTES", limit)
        assert scan.char_counts(pa.array(texts)).to_pylist() == [counts(t or "") for t in texts]
        assert scan.literal_bits(pa.array(texts), X._NEEDLES).to_pylist() == [bits(t or "") for t in texts]
    assert scan.char_counts(pa.array(texts).slice(9, 50)).to_pylist() == [counts(t) for t in texts[9:59]]
    assert not len(scan.char_counts(pa.array([], pa.string()))) and not len(scan.literal_bits(pa.array([], pa.string()), X._NEEDLES))


def test_features_of_a_text_share_two_passes(spark):
    """No pattern counts characters, whatever number of features asks for them."""
    df = spark.createDataFrame([("a", "text")], "review_id string, text string")
    t = X.safe_text("text")
    out = df.select(X.caps_ratio(t), X.nonword_ratio(t), X.emoji_count(t), X.word_len(t), X.repeat_ratio(t), X.promo_terms(t),
                    X.never_been_cues(t), X.experiential_score(t), X.profanity_count(t, ("damn", "hell")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    evaluated = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(evaluated) == 1 and evaluated[0].count("_char_counts(") == evaluated[0].count("_literal_bits(") == 1
    assert "regexp_replace" not in plan


def test_cues_and_profanity_agree_with_their_patterns(spark):
    texts = ["We WENT there", "İ ordered", "checKİng in", "online", "a line.", "hello", "HELL no", "dımn damn-damn", "shell's hell'",
             "check in", "Orİdered", "menuK menu", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low, words = F.lower(F.coalesce("t", F.lit(""))), ("damn", "hell")
    cues = sum((low.rlike(p).cast("int") for p in P.experiential_patterns()), F.lit(0))
    tokens = F.filter(F.regexp_extract_all(low, F.lit("[A-Za-z']+"), 0), lambda x: x.isin(*words))
    for got in (X.profanity_count("t", words), X.profanity_count("t", ("damn", "hell", "gosh"))):
        rows = df.select("t", got.alias("n"), F.size(tokens).alias("n0"), X.experiential_score("t").alias("e"),
                         F.least(F.lit(1.0), cues / F.lit(4.0)).alias("e0")).collect()
        assert [r for r in rows if r.n != r.n0 or r.e != r.e0] == [] and {r.n for r in rows} >= {0, 1, 2}
