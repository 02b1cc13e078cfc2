"""Burst and duplicate windows: FIXTURES edge cases and brute force."""

import datetime as dt
import random

from vetline.operators.windows import dup_across_places, user_burst_24h

T0 = dt.datetime(2024, 6, 1, 12, 0, 0)


def _burst(spark, rows, **kw):
    df = spark.createDataFrame(rows, "rid string, user_id string, dt timestamp_ntz")
    return {r["rid"]: r["user_burst_24h"] for r in user_burst_24h(df, **kw).collect()}


def test_burst_edges(spark):
    h = dt.timedelta(hours=1)
    rows = [("a", "u", T0), ("b", "u", T0 + 24 * h), ("c", "u", T0 + 24 * h), ("d", "u", None),
            ("e", None, T0), ("f", None, T0 + 5 * h), ("g", "z", None)]
    for bucket in (24, 6, 1):
        got = _burst(spark, rows, bucket_minutes=bucket * 60)
        assert got == {"a": 1, "b": 3, "c": 3, "d": 1, "e": 1, "f": 2, "g": 0}, bucket


def test_burst_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        u = rnd.choice(["u1", "u2", "u3", None])
        t = None if rnd.random() < 0.1 else T0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 5))
        rows.append((f"r{i}", u, t))
    exp = {}
    for rid, u, t in rows:
        group = [x for x in rows if x[1] == u]
        if all(x[2] is None for x in group):
            exp[rid] = 0
        elif t is None:
            exp[rid] = 1
        else:
            exp[rid] = sum(1 for x in group if x[2] is not None and t - dt.timedelta(hours=24) <= x[2] <= t)
    for bucket in (24, 3):
        assert _burst(spark, rows, bucket_minutes=bucket * 60) == exp
    assert _burst(spark, rows, bucket_minutes=45) == exp
    # a tiny row budget forces fine buckets
    assert _burst(spark, rows, bucket_minutes="auto", max_partition_rows=20) == exp


def test_auto_bucket_refines_for_hot_user(spark):
    from vetline.operators.windows import choose_bucket_minutes

    rows = [(f"h{i}", "hot", T0 + dt.timedelta(seconds=7 * i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "rid string, user_id string, dt timestamp_ntz")
    assert choose_bucket_minutes(df, max_rows=10_000_000) == 1440
    fine = choose_bucket_minutes(df, max_rows=200)
    # one row every 7 s: 15-minute buckets hold 129 rows (> 100), 10-minute ones 86
    assert fine == 10


def test_no_user_column_gives_zero(spark):
    df = spark.createDataFrame([("a", T0)], "rid string, dt timestamp_ntz")
    assert user_burst_24h(df).collect()[0]["user_burst_24h"] == 0


def test_dup_across_places(spark):
    rows = [("1", "u", "ok", "p1"), ("2", "u", "ok", "p2"), ("3", None, "ok", "p1"), ("4", None, "ok", "p2"),
            ("5", "v", "same", "p1"), ("6", "v", "same", "p1"), ("7", "w", "x", None), ("8", "w", "x", "p1")]
    df = spark.createDataFrame(rows, "rid string, user_id string, text_norm string, place_id string")
    got = {r["rid"]: r["dup_across_places"] for r in dup_across_places(df).collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False, "5": False, "6": False, "7": False, "8": False}


def test_absent_user_column_is_not_one_anonymous_user(spark):
    from vetline.plans.screen import screen_features

    rows = [(str(i), f"p{i}", "n", "c", "x", "same text", "2024-06-01") for i in range(7)]
    df = spark.createDataFrame(rows, "review_id string, place_id string, place_name string, place_category string, "
                                     "city string, text string, created_at string")
    out = screen_features(df).collect()
    assert {(r.user_burst_24h, r.dup_across_places) for r in out} == {(0, False)}
    for column in ("created_at", "text"):
        if column != "text":
            assert screen_features(df.drop(column)).count() == 7


def test_repeated_review_ids_do_not_multiply(spark):
    from vetline.plans.screen import screen_reviews

    rows = [("a", "p1", "n", "c", "x", f"text number {i}", "2024-06-01", "u") for i in range(4)]
    df = spark.createDataFrame(rows, "review_id string, place_id string, place_name string, place_category string, "
                                     "city string, text string, created_at string, user_id string")
    images = spark.createDataFrame([("a", 0.9), ("a", 0.7)], "review_id string, image_relevancy double")
    out = screen_reviews(df, image_scores=images).collect()
    assert len(out) == 4 and {r.user_burst_24h for r in out} == {4} and {round(r.image_relevancy, 6) for r in out} == {0.8}


def test_screening_moves_no_text_to_its_place(spark):
    """Rows without texts give the features of rows with them, places that are
    missing or there twice included, and no exchange stands above their texts."""
    from pyspark.sql import functions as F
    from vetline.plans import screen as SC

    keys = spark.createDataFrame([(i, f"r{i % 4}", None if i == 5 else f"p{i % 3}", "n", "c", "x", f"u{i % 2}", "2024-06-01", 1.0, 2.0) for i in range(9)],
                                 "k long, review_id string, place_id string, place_name string, place_category string, city string, "
                                 "user_id string, created_at string, user_lat double, user_lon double")
    texts = spark.createDataFrame([(i, f"Text {i % 2} damn") for i in range(8)], "k long, text string")
    places = spark.createDataFrame([("p0", "P", "cafe", "Y", "long text", 1.0, 2.0), ("p1", "Q", None, "Y", "other", 3.0, 4.0),
                                    ("p1", "R", None, "Y", "other", 5.0, 6.0)],
                                   "place_id string, place_name string, place_category string, city string, description string, "
                                   "place_lat double, place_lon double")
    seen = []

    def add(rows):
        seen.append(rows)
        return rows.join(texts, "k", "left")

    cols = ["k", "review_id", "place_name", "distance_km", "dup_across_places", "user_burst_24h", "profanity_count", "char_entropy"]
    order = lambda df: sorted(map(str, df.select(*cols).collect()))
    for lexicon in (None, spark.createDataFrame([("text",), ("damn",), ("damn",), (None,)], "word string")):
        want = order(SC.screen_features(add(keys), places, lexicon=lexicon))
        got = SC.screen_features(keys, places, lexicon=lexicon, add_texts=add)
        assert order(got) == want and len(want) == 12
        assert {"place_lat", "distance_km"} & set(seen[-1].columns) == {"place_lat"} and "description" not in seen[-1].columns
    stored = SC.row_features(keys, places, texts=("place_desc",), add_texts=add)
    assert stored.where("place_desc like '%long text'").count() == 3
    assert got.agg(F.max("profanity_count")).first()[0] == 3  # a word that is there twice counts twice


def test_a_lexicon_of_any_size_counts_alike(spark, monkeypatch):
    from vetline.operators import features as FE

    df = spark.createDataFrame([(1, "Damn it's it's"), (2, None), (3, "shell")], "k long, text string")
    words = spark.createDataFrame([("damn",), ("it's",), ("it's",), (None,), ("hell",)], "word string")
    joined = dict(map(tuple, FE.profanity_count_join(df, "k", words).collect()))
    assert joined == {1: 5} and FE.profanity_counts(words) is not None
    assert {r.k: r.n for r in df.select("k", FE.profanity_counts(words).alias("n")).collect()} == {1: 5, 2: 0, 3: 0}
    monkeypatch.setattr(FE, "LEXICON_WORDS", 2)
    assert FE.profanity_counts(words) is None
