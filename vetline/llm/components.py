"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (long ``a``, ``b``) to (``node``, ``root``): the smallest node
    reachable, for every node on a link.

    Each round hangs every node's root under the smallest root beside it and
    then shortens the paths by pointer jumping, so rounds grow with the
    logarithm of a component's diameter. Every round is a stored table."""
    both = links.select("a", "b").filter("a <> b").distinct()
    both = stored(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "roots")
    while True:
        # smallest root among the neighbours, offered to the node and its root
        beside = (both.join(state.select(F.col("node").alias("b"), "root"), "b")
                  .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low")))
        seen = stored(state.join(beside, "node").select("node", "root", F.least("root", "low").alias("low")), "beside")
        hang = seen.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hung"))
        step = seen.join(hang, "node", "left").select("node", "root", F.least("low", "hung").alias("up"))
        step = stored(step, "step")
        jump = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
        new = step.join(jump, "up", "left").select("node", "root", F.least("up", "top").alias("new"))
        new = stored(new, "roots")
        moved = new.filter("new <> root").limit(1).count()
        state = new.select("node", F.col("new").alias("root"))
        if not moved:
            return state
