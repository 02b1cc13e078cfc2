"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings every job relies on: AQE (runtime re-planning, skew-join
# splitting, partition coalescing), Arrow batches for the pandas UDFs, no UI.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # checkpoint files go when the driver no longer holds their DataFrame
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "vetline", shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session that names none (tests) gets a private folder under
    the system temp directory; on a cluster the setting must come from the
    deployment so every executor sees the same folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="vetline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage before a DataFrame feeds several branches: written to the
    shared checkpoint folder, it survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_rows(df: DataFrame) -> DataFrame:
    """:func:`materialize` for rows with texts: a compressed Parquet table below
    the same folder, of which later steps read only the columns they need. The
    exchange files of its making go."""
    path = scratch_dir(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    drop_exchanges(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_exchanges(spark: SparkSession) -> None:
    """Have Spark remove the exchange files of queries that nothing refers to
    any more. It does so when the driver collects garbage, which a driver that
    only plans large jobs may not do for hours: twice, as what the first round
    finds still holds the exchanges."""
    collect = spark.sparkContext._jvm.System.gc
    collect()
    time.sleep(0.1)
    collect()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vetline`` importable on every executor (the pandas UDFs live in
    it): zip the package once per SparkContext and ``addPyFile`` it, the
    programmatic form of ``--py-files``."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="vetline-pyfiles-", dir=os.environ.get("TMPDIR", "/tmp"))
    path = os.path.join(out_dir, "vetline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
