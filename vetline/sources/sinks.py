"""Sinks: split tables, converted tables, prediction records."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.session import materialize

FILE_BYTES = 128 << 20
# Partition values for which a task may hold a file open.
OPEN_FILES = 8


def _csv_safe(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs are written as JSON text in CSV."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out = out.withColumn(f.name, F.to_json(F.col(f.name)))
    return out


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes: its texts and nested values as JSON, 8 bytes for
    every other column."""
    sizes = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) if isinstance(f.dataType, T.StringType)
             else F.coalesce(F.octet_length(F.to_json(F.col(f.name))), F.lit(0))
             if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.lit(8) for f in df.schema.fields]
    return sum(sizes, F.lit(0)).cast("long")


def sizes_in_place(df: DataFrame, partition_by: list[str]) -> DataFrame:
    """Stored: of every partition value and task of ``df``, the ``rows`` and ``bytes``
    that the task holds of the value (columns ``_vs_0``, ... for the value)."""
    names = [F.col(c).alias(f"_vs_{i}") for i, c in enumerate(partition_by)]
    sized = df.select(*names, F.spark_partition_id().alias("_vs_task"), row_bytes(df).alias("_vs_bytes"))
    return materialize(sized.groupBy(*[f"_vs_{i}" for i in range(len(partition_by))], "_vs_task").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_vs_bytes").alias("bytes")))


def rows_per_file(sizes: DataFrame, file_bytes: int) -> int | None:
    """Rows that a file may have if every task writes what it holds, in files of at
    most about twice ``file_bytes``; None if that makes files of less than an
    eighth of ``file_bytes`` or a task holds more than ``OPEN_FILES`` values."""
    total = sizes.agg(F.sum("bytes").alias("bytes"), F.max(F.col("bytes") / F.col("rows")).alias("row")).first()
    if not total.bytes:
        return None
    most = max(1, int(2 * file_bytes / total.row))
    files = sizes.agg(F.sum(F.ceil(F.col("rows") / most))).first()[0]
    values = sizes.groupBy("_vs_task").count().agg(F.max("count")).first()[0]
    return most if 8 * total.bytes >= files * file_bytes and values <= OPEN_FILES else None


def spread_by_size(df: DataFrame, partition_by: list[str], file_bytes: int, sizes: DataFrame | None = None) -> DataFrame:
    """Rows dealt so that a task holds about ``file_bytes`` of one partition
    value: as many shares as the value's measured bytes ask for, so that a value
    with a third of all rows is many tasks and a small one is one file."""
    names = [f"_vs_{i}" for i in range(len(partition_by))]
    sizes = sizes_in_place(df, partition_by) if sizes is None else sizes
    shares = sizes.groupBy(*names).agg(F.ceil(F.sum("bytes") / file_bytes).cast("long").alias("_vs_shares"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(partition_by, names)]
    dealt = df.join(shares, reduce(lambda a, b: a & b, same)).drop(*names)
    share = F.pmod(F.monotonically_increasing_id(), F.greatest("_vs_shares", F.lit(1)))
    return dealt.withColumn("_vs_share", share).repartition(*partition_by, "_vs_share").drop("_vs_share", "_vs_shares")


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Writers keep a file open for each of so many partition values, so that a
    task need not order its rows by value."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    old = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite", file_bytes: int = FILE_BYTES, compression: str | None = None) -> None:
    """Write ``df``. With ``partition_by`` each value gets files of about
    ``file_bytes`` (``df`` is read twice), and "overwrite" replaces only the
    values that ``df`` holds; rows are moved only where the tasks hold too little
    of a value. ``compression`` as Spark's writers name it."""
    df = _csv_safe(df) if fmt == "csv" else df
    most = None
    if partition_by:
        sizes = sizes_in_place(df, partition_by)
        most = rows_per_file(sizes, file_bytes)
        df = df if most else spread_by_size(df, partition_by, file_bytes, sizes)
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    if most:
        w = w.option("maxRecordsPerFile", most).option("parquet.block.size", FILE_BYTES // 4)
    with _open_files(df.sparkSession, OPEN_FILES) if most else nullcontext():
        if fmt == "csv":
            # white space at the ends of a value belongs to it
            w.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        elif fmt == "json":
            w.json(path)
        else:
            w.parquet(path)


def write_splits(df_with_split: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None) -> None:
    """One folder per split (``split=train|val|test``), files of bounded size."""
    write_table(df_with_split, path, fmt, partition_by=["split"], compression=compression)


def write_predictions(preds: DataFrame, path: str, fmt: str = "json", compression: str | None = None) -> None:
    write_table(preds, path, fmt, compression=compression)
