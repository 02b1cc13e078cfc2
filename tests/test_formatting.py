"""Meta-token strings, exact two-place rounding and model replies."""

import random

from pyspark.sql import functions as F

from vetline.functions.formatting import meta_tokens, parse_reply, plain_double, two_places


def test_meta_tokens(spark):
    rows = [(True, 64, 0.045, 0, 0.6000000000000001, 0, 1, False, 4.562293, 0, 444.5),
            (False, 0, 0.125, 7, 1.0, 2, 5, True, 0.335, 2, None), (None, None, None, None, None, None, None, None, None, None, 0.0005)]
    schema = ("has_url boolean, char_len int, caps_ratio double, emoji_count int, user_name_gibberish double, "
              "image_count int, user_burst_24h int, dup_across_places boolean, char_entropy double, "
              "profanity_count int, distance_km double")
    got = [r["m"] for r in spark.createDataFrame(rows, schema).coalesce(1).select(meta_tokens().alias("m")).collect()]
    assert got == [
        "meta: url=1 len=64 caps=0.04 emoji=0 uname_gib=0.60 imgs=0 burst24=1 dup=0 ent=4.56 prof=0 dist=444.5",
        "meta: url=0 len=0 caps=0.12 emoji=7 uname_gib=1.00 imgs=2 burst24=5 dup=1 ent=0.34 prof=2 dist=nan",
        "meta: url=0 len=0 caps=0.00 emoji=0 uname_gib=0.00 imgs=0 burst24=0 dup=0 ent=0.00 prof=0 dist=0.0005"]


def test_rounding_and_plain_form(spark):
    rng = random.Random(1)
    xs = [0.015, 0.045, 0.125, 0.335, 0.375, 1.005, 2.675, 0.0, 99.995, 123456.785]
    xs += [k / 1000 for k in range(5, 4000, 10)] + [rng.random() * 10 ** rng.randint(-6, 4) for _ in range(2000)]
    ds = [0.0005, 0.00012345, 1e-05, 1.5e-07, 0.001, 12345678.0, 123456789.25, 5.0, 1e7, 0.0]
    ds += [rng.random() * 10 ** rng.randint(-8, 9) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", two_places(F.col("x")).alias("s"))
    assert [r.x for r in df.collect() if r.s != f"{r.x:.2f}"] == []
    df = spark.createDataFrame([(x,) for x in ds], "x double").select("x", plain_double(F.col("x")).alias("s"))
    assert [(r.x, r.s) for r in df.collect() if r.s != repr(r.x)] == []


def test_bad_replies_are_null(spark):
    rows = [("garbage",), ("[1]",), (None,), ('{"labels":["None"],"relevance":0.5}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "r string").coalesce(1).select(parse_reply("r")).collect()]
    assert got[:3] == [None] * 3 and got[3].labels == ["None"] and got[3].relevance == 0.5
