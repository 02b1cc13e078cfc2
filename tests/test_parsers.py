"""Parsers and small scalars: FIXTURES.md §3 edge tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vetline.functions.pics import parse_pics
from vetline.functions.rules import label_coerce, label_coerce_string
from vetline.functions.timegeo import haversine_km, parse_dt
from vetline.operators.relevancy import calibrate
from vetline.sources.readers import lenient_json


def test_parse_pics(spark):
    cases = {'["u1",2,"u3"]': ["u1", "u3"], "[1,2]": [], "[]": [], "": [], "   ": [], '{"a":1}': ['{"a":1}'],
             "null": ["null"], "a; b;;": ["a", "b"], "plain": ["plain"], " x ": ["x"]}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    got = {r["p"]: r["l"] for r in df.select("p", parse_pics("p").alias("l")).collect()}
    for k, v in cases.items():
        assert got[k] == v, repr(k)
    assert got[None] == []


def test_parse_dt(spark):
    cases = {"2024": dt.datetime(1970, 1, 1, 0, 0, 2, 24000), "1622505600000": dt.datetime(2021, 6, 1),
             "2024-06-01T10:00:00+02:00": dt.datetime(2024, 6, 1, 8), "2024-06-01": dt.datetime(2024, 6, 1),
             "2024-06-01 10:00:00Z": dt.datetime(2024, 6, 1, 10), "junk": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["d"] for r in df.select("s", parse_dt("s").alias("d")).collect()}
    assert got == cases


def test_parse_dt_ignores_session_zone(spark):
    df = spark.createDataFrame([("2024-06-01 10:00:00",), ("2024-06-01T10:00:00+02:00",)], "s string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r["d"] for r in df.select(parse_dt("s").alias("d")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [dt.datetime(2024, 6, 1, 10), dt.datetime(2024, 6, 1, 8)]


def test_label_coerce(spark):
    s = spark.createDataFrame([("Fake",), ("TRUE",), ("1",), ("real",), ("false",), ("0",), ("??",), (None,)], "l string")
    assert [r[0] for r in s.select(label_coerce_string("l")).collect()] == [1, 1, 1, 0, 0, 0, 0, 0]
    n = spark.createDataFrame([(0.6,), (0.5,), (None,)], "x double")
    assert [r[0] for r in n.select(label_coerce("x")).collect()] == [1, 0, 0]


def test_lenient_json(spark):
    lines = ['{"a":"y"}', "{'a':'x'}", "{'a':\"it's\"}", "{bad", "", "  "]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    got = df.select("l", lenient_json(F.col("l")).isNotNull().alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, True, False, False, False, False]


def test_score_calibrate(spark):
    a = spark.createDataFrame([(0.2,), (0.9,)], "score double")
    assert sorted(r[0] for r in calibrate(a).collect()) == [0.2, 0.9]
    b = spark.createDataFrame([(-1.0,), (0.5,)], "score double")
    assert sorted(round(r[0], 6) for r in calibrate(b).collect()) == [0.268941, 0.622459]


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_km("a", "b", "c", "d")).collect()]
    assert got[0] == pytest.approx(111.194927, abs=1e-6) and got[1] is None


def test_numeric_times_and_formats(spark):
    from vetline.operators.features import add_time

    for kind, value in (("double", 1622505600000.0), ("bigint", 1622505600000)):
        df = spark.createDataFrame([(value,), (None,)], f"created_at {kind}")
        assert [r["dt"] for r in add_time(df).coalesce(1).collect()] == [dt.datetime(2021, 6, 1), None]
    df = spark.createDataFrame([(-1000,)], "created_at bigint")
    assert add_time(df).first()["dt"] == dt.datetime(1969, 12, 31, 23, 59, 59)
    df = spark.createDataFrame([("June 1 2024",), ("06/01/2024",), ("junk",)], "created_at string")
    got = [r["dt"] for r in add_time(df, ("MMMM d yyyy", "MM/dd/yyyy")).coalesce(1).collect()]
    assert got == [dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 1), None]
