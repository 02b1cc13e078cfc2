"""Places of rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetline.llm.common import stored

# monotonically_increasing_id() is the partition above bit 33 and a count below.
PARTITION_BITS = 33


def ranked(df: DataFrame, group: str, order: list[str], pos: str, total: str) -> DataFrame:
    """``df`` with each row's place ``pos`` (from 0) by ``order`` (nulls first)
    in its ``group`` and the group's row count ``total``, both long.

    ``group`` must not be null. A range shuffle on group and order spreads even
    one huge group over many tasks; the stored result numbers its rows, and what
    stands before a partition's part of a group is added up from one row per
    partition and group. Ties in ``order`` get distinct places."""
    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = stored(ordered.withColumn("__mid", F.monotonically_increasing_id()), "sorted")
    kept = kept.withColumn("__part", F.shiftright("__mid", PARTITION_BITS))
    runs = kept.groupBy(group, "__part").agg(F.min("__mid").alias("__low"), F.count("*").alias("__n"))
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    placed = runs.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("__low")).alias("__shift"),
                         F.sum("__n").over(whole).alias(total))
    return (kept.join(placed, [group, "__part"]).withColumn(pos, F.col("__mid") + F.col("__shift"))
            .drop("__mid", "__part", "__shift"))
