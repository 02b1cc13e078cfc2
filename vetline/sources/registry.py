"""Committed run folders: a run is there as a whole or not at all.

The parts of a run are written to a hidden folder beside it, then a manifest
lists every file with its length and SHA-256, and last the folder takes its
name in one rename. A writer that dies leaves a hidden folder that no reader
looks at. A run counts as committed if it has a manifest and each listed file
is there in its length (stores that copy instead of renaming can break half-way).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.sources.files import delete, entries, exists, rename

MANIFEST = "_manifest"


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of every file below ``path`` but the manifest's;
    ``file`` is the path below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    name = path.rstrip("/").rpartition("/")[2]
    below = F.substring_index("path", f"/{name}/", -1)
    return files.select(below.alias("file"), "length", F.sha2("content", 256).alias("sha256")).where(
        ~F.col("file").startswith(f"{MANIFEST}/"))


@contextmanager
def committed(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write the run's Parquet tables to; on success it becomes
    ``path``, replacing an earlier run of that name."""
    parent, _, name = path.rstrip("/").rpartition("/")
    staged = f"{parent}/_staged-{name}-{uuid.uuid4().hex}"
    try:
        yield staged
        _digests(spark, staged).coalesce(1).write.json(f"{staged}/{MANIFEST}")
    except BaseException:
        delete(spark, staged)
        raise
    if exists(spark, path):
        delete(spark, path)
    rename(spark, staged, path)


def manifest(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """File -> (length, sha256) of a run; empty without a manifest. A run has a
    few files of bounded size."""
    if not exists(spark, f"{path}/{MANIFEST}/_SUCCESS"):
        return {}
    rows = spark.read.schema("file string, length long, sha256 string").json(f"{path}/{MANIFEST}").collect()
    return {r.file: (r.length, r.sha256) for r in rows}


def is_committed(spark: SparkSession, path: str) -> bool:
    listed = manifest(spark, path)
    lengths: dict[str, dict[str, int]] = {}
    for file in listed:
        folder = file.rpartition("/")[0]
        if folder not in lengths:
            lengths[folder] = {e.name: e.length for e in entries(spark, f"{path}/{folder}")}
    return bool(listed) and all(lengths[f.rpartition("/")[0]].get(f.rpartition("/")[2]) == n for f, (n, _) in listed.items())


def verify(spark: SparkSession, path: str) -> None:
    """Raise unless every listed file is there with its digest."""
    listed = manifest(spark, path)
    if not listed:
        raise ValueError(f"{path} holds no committed run")
    found = {r.file: (r.length, r.sha256) for r in _digests(spark, path).collect()}
    wrong = sorted(f for f in listed if found.get(f) != listed[f])
    if wrong:
        raise ValueError(f"{path}: missing or changed: {', '.join(wrong)}")


def runs(spark: SparkSession, folder: str) -> list[str]:
    """Committed runs in ``folder``, by name."""
    return [e.path for e in entries(spark, folder) if e.is_dir and not e.name.startswith(("_", ".")) and is_committed(spark, e.path)]


def newest(spark: SparkSession, folder: str) -> str | None:
    """The committed run that is last by name."""
    for e in reversed(entries(spark, folder)):
        if e.is_dir and not e.name.startswith(("_", ".")) and is_committed(spark, e.path):
            return e.path
    return None
