"""CSV with embedded newlines, read by as many tasks as the bytes ask for.

A quoted newline means that a record boundary depends on everything before it in
the file, which is why a multi-line reader gives a file to one task. Here files
are read as lines, which split anywhere, and the quoting state is carried over
instead: every byte range is a function of the state it starts in (inside quotes
or not), and there are only four such functions: stay, swap, always in, always
out. Swaps add up and a constant range cuts the sum off, so the state before each
range is a running sum over one row per range. With it a task walks its lines and
puts records together where they stand; no line is stored or exchanged but the
ends of records that reach from one range into another. Spark's ``from_csv``
parses the records.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetline.session import ship_package, stored_rows

# Binary logarithm of the records that a task hands on at once.
CHUNK_BITS = 12
_CLOSING = re.compile(r'(?:[^"]+|"")*+"')


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a line that starts inside (outside) a quoted field ends in one.
    A quote opens a field only as its first character; what follows a closing
    quote up to the separator belongs to the field."""
    at = 0
    while True:
        if not inside and not line.startswith('"', at):
            at = line.find(sep, at)
        else:
            closed = _CLOSING.match(line, at if inside else at + 1)
            if closed is None:
                return True
            at = line.find(sep, closed.end())
        if at < 0:
            return False
        at, inside = at + 1, False


def csv_lines(spark: SparkSession, paths: str | list[str], recursive: bool, sep: str) -> DataFrame:
    """The lines in order: ``file``, ``start`` and ``length`` of the byte range,
    ``opens`` (a quote may open a field of it), ``value``."""
    ship_package(spark)
    value = F.col("value")
    return spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive).text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
        (value.startswith('"') | value.contains(sep + '"')).alias("opens"), "value")


Range = tuple[str, int, int]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Range, pa.Array, pa.Array]]:
    """``opens`` and ``value`` of neighbouring lines of one byte range."""
    for batch in batches:
        if not len(batch):
            continue
        files, starts = batch.column("file"), batch.column("start").to_numpy()
        differ = (starts[1:] != starts[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(differ) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            key = files[a].as_py(), int(starts[a]), batch.column("length")[a].as_py()
            yield key, batch.column("opens").slice(a, b - a), batch.column("value").slice(a, b - a)


def range_functions(lines: DataFrame, sep: str) -> DataFrame:
    """``file``, ``start``, ``length`` and the state behind a range that starts
    outside (``out``) or inside quotes (``inn``)."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind: dict[Range, list[bool]] = {}
        for key, _, values in _runs(batches):
            state = behind.setdefault(key, [False, True])
            for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                out = ends_inside(line, state[0], sep)
                state[:] = out, out if state[0] == state[1] else ends_inside(line, state[1], sep)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in behind], pa.string()), *(pa.array([k[i] for k in behind], pa.int64()) for i in (1, 2)),
             *(pa.array([s[i] for s in behind.values()], pa.bool_()) for i in (0, 1))], names=["file", "start", "length", "out", "inn"])

    return lines.mapInArrow(told, "file string, start long, length long, out boolean, inn boolean")


def opened_ranges(functions: DataFrame) -> dict[Range, bool]:
    """Whether a byte range starts inside quotes; one row per range is gathered."""
    along = Window.partitionBy("file").orderBy("start")
    upto, earlier = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    swaps = (F.col("out") & ~F.col("inn")).cast("int")
    summed = functions.withColumn("swaps", swaps).withColumn("sum", F.sum("swaps").over(upto))
    held = summed.withColumn("held", F.when(F.col("out") == F.col("inn"), F.col("out").cast("int") + F.col("sum")))
    state = F.coalesce(F.last("held", ignorenulls=True).over(earlier), F.lit(0)) + F.col("sum") - F.col("swaps")
    return {(r.file, r.start, r.length): bool(r.state) for r in held.select("file", "start", "length", (state % 2).alias("state")).collect()}


COMPLETE, OPEN, CARRIED = 0, 1, 2
Record = tuple[Range, int, int, str]


def _walk(batches: Iterator[pa.RecordBatch], opened: dict[Range, bool], sep: str) -> Iterator[Record | None]:
    """Records of every byte range: range, number of the first line, kind, text. A
    record that reaches into a range is CARRIED there and OPEN where it starts.
    None where what has been told may be handed on."""
    last, n, held, begun, kind = None, 0, None, 0, COMPLETE
    for key, opens, values in _runs(batches):
        if key != last:
            if held:
                yield last, begun, kind, "\n".join(held)
            if key not in opened:
                raise ValueError(f"the byte ranges of {key[0]} have changed since they were looked at: read it again")
            last, n, begun, kind = key, 0, 0, CARRIED
            held = [] if opened[key] else None
        for may, line in zip(opens.to_pylist(), values.to_pylist()):
            if held is None:
                if may and ends_inside(line, False, sep):
                    held, begun, kind = [line], n, OPEN
                else:
                    yield key, n, COMPLETE, line
            else:
                held.append(line)
                if '"' in line and not ends_inside(line, True, sep):
                    yield key, begun, COMPLETE if kind == OPEN else CARRIED, "\n".join(held)
                    held = None
            n += 1
        yield None
    if held:
        yield last, begun, kind, "\n".join(held)


def _clean(record: str) -> str:
    """Without the end of a carriage return and newline."""
    return record.removesuffix("\r")


def _told(lines: DataFrame, opened: dict[Range, bool], sep: str, choose: Callable[[Iterator[Record | None]], Iterator[Record | None]]) -> DataFrame:
    """``file``, ``start``, ``nth`` (line of the range), ``kind`` and ``record`` of
    the records that ``choose`` lets pass."""
    held = lines.sparkSession.sparkContext.broadcast(opened)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[Record] = []
        for row in choose(_walk(batches, held.value, sep)):
            if row is not None:
                rows.append(row)
            if len(rows) >> CHUNK_BITS or (row is None and rows):
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return lines.mapInArrow(run, "file string, start long, nth long, kind int, record string")


def _batch(rows: list[Record]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())], names=["file", "start", "nth", "kind", "record"])


def _ends_and_firsts(rows: Iterator[Record | None]) -> Iterator[Record | None]:
    """What reaches over a range's end, and each range's first record that is not blank."""
    seen = None
    for row in rows:
        if row is None or row[2] != COMPLETE:
            yield row
        elif row[0] != seen and _clean(row[3]).strip(" "):
            seen = row[0]
            yield (*row[:3], _clean(row[3]))


def spanning_records(ends: DataFrame) -> DataFrame:
    """Records of several ranges, put together from their OPEN and CARRIED parts
    (two rows of a range at most); an opening quote that nothing closes takes the
    rest of its file."""
    along = Window.partitionBy("file").orderBy("start", "nth").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("kind") == OPEN, F.struct("start", "nth")), ignorenulls=True).over(along)
    parts = ends.where(F.col("kind") != COMPLETE).select("file", own.alias("own"), F.struct("start", "nth", "record").alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["record"]), "\n")
    return parts.groupBy("file", "own").agg(F.regexp_replace(joined, "\r\\z", "").alias("record")).where(F.trim("record") != "").select(
        "file", "own.start", "own.nth", "record")


def _names(header: str, sep: str) -> list[str]:
    """Column names of a header; an empty or repeated one gets its place."""
    names = next(csv.reader([header.lstrip("﻿")], delimiter=sep), [])
    return [n if n and names.count(n) == 1 else f"{n or '_c'}{i}" for i, n in enumerate(names)]


def unreadable(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that cannot be read to their end, found by halving the list."""
    try:
        spark.read.text(paths).select(F.sum(F.length("value"))).collect()
        return []
    except (PySparkException, Py4JJavaError):
        if len(paths) == 1:
            return paths
        half = len(paths) // 2
        return unreadable(spark, paths[:half]) + unreadable(spark, paths[half:])


def read_records(spark: SparkSession, paths: str | list[str], recursive: bool = True, sep: str = ",") -> tuple[DataFrame | None, dict[str, str]]:
    """The files' rows, all columns text, combined by column name (missing ones
    NULL), and each file's header (one row per file is gathered). Files without
    any record do not count. The files are read three times: for their quotes,
    for records over a range's end and first ones, and for the rows."""
    lines = csv_lines(spark, paths, recursive, sep)
    opened = opened_ranges(range_functions(lines, sep))
    ends = stored_rows(_told(lines, opened, sep, _ends_and_firsts))
    spanning = stored_rows(spanning_records(ends))
    candidates = ends.where(F.col("kind") == COMPLETE).select("file", "start", "nth", "record").unionByName(spanning)
    first = candidates.groupBy("file").agg(F.min(F.struct("start", "nth", "record")).alias("first")).collect()
    headers = {r.file: r.first.record for r in first}
    places = {r.file: (r.first.start, r.first.nth) for r in first}
    if not headers:
        return None, headers

    def rows(told: Iterator[Record | None]) -> Iterator[Record | None]:
        for row in told:
            if row is None:
                yield row
            elif row[2] == COMPLETE and (row[0][1], row[1]) != places.get(row[0][0]):
                record = _clean(row[3])
                if record.strip(" "):
                    yield (*row[:3], record)

    heads = spark.createDataFrame([(f, *at) for f, at in places.items()], "file string, start long, nth long")
    body = _told(lines, opened, sep, rows).select("file", "record").unionByName(
        spanning.join(heads, ["file", "start", "nth"], "left_anti").select("file", "record"))
    by_header: dict[str, list[str]] = {}
    for file, header in headers.items():
        by_header.setdefault(header.lstrip("\ufeff"), []).append(file)
    # a field without anything is NULL, a quoted empty one is the empty text
    options = {"escape": '"', "sep": sep, "multiLine": "true", "mode": "PERMISSIVE", "nullValue": "\0"}
    parsed, columns = [], {}
    for i, (header, files) in enumerate(sorted(by_header.items())):
        names = _names(header, sep)
        ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        mine = F.col("record") if len(by_header) == 1 else F.when(F.col("file").isin(files), F.col("record"))
        parsed.append(F.from_csv(mine, ddl, options).alias(f"row{i}"))
        for n in names:
            columns.setdefault(n, []).append(F.col(f"row{i}").getField(n))
    # a row of another header is NULL
    return body.select(*parsed).select(*[F.coalesce(*c).alias(n) for n, c in columns.items()]), headers
