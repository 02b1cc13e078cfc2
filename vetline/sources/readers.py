"""Readers: review/place CSVs, lenient JSON lines, CSV folders, lexicons."""

from __future__ import annotations

import re
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.functions.users import trim_ws
from vetline.sources.csvlines import read_records, unreadable
from vetline.sources.files import entries, exists
from vetline.schema import PLACE_SCHEMA, REVIEW_SCHEMA


def read_csv(spark: SparkSession, path: str | list[str], schema=None, recursive: bool = True) -> DataFrame:
    """RFC-4180 CSV with header, doubled quotes and embedded newlines, every
    column text unless ``schema`` names types. A large file is read by many
    tasks (:mod:`vetline.sources.csvlines`); gzip is read by one and spread
    behind it. Blank lines are left out; without any record there are no
    columns but those of ``schema``."""
    out, _ = read_records(spark, path, recursive)
    if out is None:
        out = spark.createDataFrame([], schema or "struct<>")
    return out if schema is None else _typed(out, schema)


def _typed(raw: DataFrame, schema) -> DataFrame:
    """``raw`` with the columns of ``schema`` in their types; those that the
    file lacks are typed NULLs."""
    return raw.withColumns({
        f.name: F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)
        for f in schema.fields})


def read_reviews_csv(spark: SparkSession, path: str) -> DataFrame:
    """Unified review CSV. Columns are matched by header name; missing
    columns become typed NULLs."""
    return _typed(read_csv(spark, path), REVIEW_SCHEMA)


def read_places_csv(spark: SparkSession, path: str) -> DataFrame:
    return _typed(read_csv(spark, path), PLACE_SCHEMA)


def lenient_json(line: Column) -> Column:
    """Parse a JSON line as VARIANT; on failure retry with every ``'``
    replaced by ``"``; NULL when both fail or the line is blank."""
    s = trim_ws(line)
    first = F.try_parse_json(s)
    second = F.try_parse_json(F.translate(s, "'", '"'))
    return F.when(s == "", F.lit(None)).otherwise(F.coalesce(first, second))


def read_json_lines(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One VARIANT ``obj`` per parsable line of every file under ``path``
    (any nesting depth, ``.gz`` included); bad and blank lines dropped."""
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    return lines.select(lenient_json(F.col("value")).alias("obj")).where(F.col("obj").isNotNull())


def read_csv_folder(spark: SparkSession, folder: str,
                    skip_words: tuple[str, ...] = ("train", "val", "test")) -> tuple[DataFrame | None, list[str]]:
    """Every CSV (also ``.csv.gz``) directly in ``folder`` whose name contains
    none of ``skip_words``, combined by column name (missing columns NULL,
    duplicates kept), and the names of the files left out because they cannot be
    read to their end or hold no record.

    All files are read in one job; only if that fails are the broken ones
    searched, by halving, and the others read again."""
    files = {e.path: e.name for e in entries(spark, folder)
             if not e.is_dir and re.search(r"\.csv(\.gz)?$", e.name) and not any(w in e.name for w in skip_words)}
    skipped: list[str] = []
    try:
        out, headers = read_records(spark, list(files), False) if files else (None, {})
    except (PySparkException, Py4JJavaError):
        broken = unreadable(spark, list(files))
        if not broken:
            raise
        skipped = [files.pop(f) for f in broken]
        out, headers = read_records(spark, list(files), False) if files else (None, {})
    held = {h.rpartition("/")[2] for h in headers}
    skipped += [name for name in files.values() if not held & {name, quote(name)}]
    return out, sorted(skipped)


def read_lexicon(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(word) of a one-word-per-line file on any file system: lower-cased,
    trimmed, non-empty, distinct. None (the built-in list) without a path or
    when nothing is there."""
    if not path or not exists(spark, path):
        return None
    return (spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
            .where(F.col("word") != "").distinct())


def largest_csv(spark: SparkSession, folder: str) -> str | None:
    """Path of the largest ``*.csv`` directly in ``folder`` (file listing
    only: the binaryFile source does not read content that is not selected)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .option("recursiveFileLookup", False).load(folder).select("path", "length"))
    top = files.orderBy(F.col("length").desc(), F.col("path")).limit(1).collect()
    return top[0]["path"] if top else None
