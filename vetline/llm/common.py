"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.session import checkpoint_dir, drop_exchanges  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    lineage ends at files that every executor sees."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_uri(folder: str) -> str:
    """A Hadoop folder as the URI that Arrow's file systems know."""
    return re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", folder))


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder of the shared store, for use in tasks."""
    if re.match(r"\w+:", folder):
        return fs.FileSystem.from_uri(store_uri(folder))
    return fs.LocalFileSystem(), folder
