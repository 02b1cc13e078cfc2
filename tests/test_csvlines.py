"""Splittable CSV against Python's csv module."""

import csv
import io
import os
import random
import tempfile

import pytest

from vetline.sources import csvlines
from vetline.sources.csvlines import ends_inside, read_records
from vetline.sources.sinks import write_table


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def test_line_functions():
    cases = {'a,b': (False, True), 'a,"b': (True, False), '"': (True, False), 'a"b,c': (False, False), '"a""b",c': (False, False),
             '""': (False, True), '","': (False, True), 'x",y,"z': (True, True), '"a"x,"b': (True, True), '': (False, True)}
    for line, want in cases.items():
        assert (ends_inside(line, False), ends_inside(line, True)) == want, line


def _random_csv(rng, rows, end):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "text", "more, please"])
    body = []
    for i in range(rows):
        text = "".join(rng.choices(["a", "b ", ",", '"', "\n", "\r\n", "é", '""', "\n\n", '",'], k=rng.randint(0, 12)))
        body.append([str(i), text, rng.choice(["x", 'y"z', "p\nq", ""])])
        w.writerow(body[-1])
    return out.getvalue(), body


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [64, 1 << 20])
def test_against_the_csv_module(spark, monkeypatch, split, end):
    monkeypatch.setattr(csvlines, "CHUNK_BITS", 2 if split == 64 else 16)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rng, d, want = random.Random(split + len(end)), tempfile.mkdtemp(prefix="vetline-csv-"), []
        for name in ("a.csv", "b.csv", "c.csv"):
            text, body = _random_csv(rng, 60, end)
            _write(d, name, (end if name == "b.csv" else "") + text)  # a blank first line
            want += body
        df, headers = read_records(spark, d)
        assert len(headers) == 3 and df.columns == ["id", "text", "more, please"]
        got = [[c or "" for c in r] for r in df.collect()]
        assert sorted(got) == sorted(want)
        if split == 64:
            lines = csvlines.csv_lines(spark, d, True, ",")
            assert lines.select("file", "start").distinct().count() > 30
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_headers_quotes_in_values_and_an_open_quote(spark):
    d = tempfile.mkdtemp(prefix="vetline-csv-")
    _write(d, "a.csv", '\ufeffid,id,\n1,5" pipe,x\n2,"she said ""no""",y\n3\n')
    _write(d, "b.csv", 'id,`odd`\n7,"never closed\n8,z\n')
    _write(d, "c.csv", "\n\n")
    df, headers = read_records(spark, d)
    assert len(headers) == 2 and set(df.columns) == {"id0", "id1", "_c2", "id", "`odd`"}
    rows = {(r["id0"], r["id1"], r["_c2"]) for r in df.collect() if r["id0"]}
    assert rows == {("1", '5" pipe', "x"), ("2", 'she said "no"', "y"), ("3", None, None)}
    assert df.where("id is not null").count() == 1


def test_one_file_is_read_by_many_tasks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        d = tempfile.mkdtemp(prefix="vetline-csv-")
        with open(os.path.join(d, "a.csv"), "w") as f:
            f.write("id,text\n" + "".join(f'{i},"line one\nline ""two"" of {i}"\n' for i in range(40_000)))
        df, _ = read_records(spark, d)
        assert df.count() == 40_000 and df.where("text like 'line one%'").count() == 40_000
        assert csvlines.csv_lines(spark, d, True, ",").rdd.getNumPartitions() >= 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_round_trip_through_the_sink(spark):
    rows = [(1, 'a "quoted" one', ["x", "y"]), (2, "two\nlines, and\r\nmore", []), (3, "", None), (4, None, ["z"]), (5, " ends \n", None)]
    d = tempfile.mkdtemp(prefix="vetline-csv-")
    write_table(spark.createDataFrame(rows, "id int, text string, tags array<string>"), f"{d}/t", "csv")
    df, _ = read_records(spark, f"{d}/t")
    got = {int(r.id): (r.text, r.tags) for r in df.collect()}
    assert got == {1: ('a "quoted" one', '["x","y"]'), 2: ("two\nlines, and\r\nmore", "[]"), 3: ("", None), 4: (None, '["z"]'), 5: (" ends \n", None)}


def test_no_line_is_stored_or_exchanged(spark, monkeypatch, tmp_path):
    """Only the ends of records that reach over a byte range's end are; gzip files
    give the same rows."""
    rows = [(str(i), f'long "line" {"x" * 200}\nand\n"{i}' if i % 3 else "short", "a,b") for i in range(300)]
    df = spark.createDataFrame(rows, "id string, text string, more string").coalesce(1)
    write_table(df, f"{tmp_path}/plain", "csv")
    write_table(df, f"{tmp_path}/small", "csv", compression="gzip")
    assert all(f.endswith(".csv.gz") for f in os.listdir(f"{tmp_path}/small") if f.startswith("part-"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    kept = []
    monkeypatch.setattr(csvlines, "stored_rows", lambda rows, f=csvlines.stored_rows: kept.append(f(rows)) or kept[-1])
    try:
        for name in ("plain", "small"):
            got, headers = read_records(spark, f"{tmp_path}/{name}")
            assert sorted(map(tuple, got.collect())) == sorted(rows) and len(headers) == 1
        ranges = csvlines.csv_lines(spark, f"{tmp_path}/plain", True, ",").select("file", "start").distinct().count()
        assert ranges > 8 and kept[0].count() <= 3 * ranges and kept[1].count() < ranges
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[1].split("Union")[0].split("Scan text")[0]
        back, _ = read_records(spark, f"{tmp_path}/plain")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        with pytest.raises(Exception, match="byte ranges of"):
            back.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
