"""Evaluation: binary metrics of two "fake" strategies and label means.

Confusion counts are one global aggregate (partial aggregation on every
partition, one row at the end); the two strategies come out as two rows.
Precision/recall/F1 use zero_division = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.config import LABEL_KEYS


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def strategies(threshold: float = 0.5) -> dict[str, Column]:
    """spam_only: p_spam >= t; any_violation: max of the four >= t."""
    return {
        "spam_only": F.col("p_spam") >= threshold,
        "any_violation": F.greatest(*[F.col(f"p_{k}") for k in LABEL_KEYS]) >= threshold,
    }


def binary_metrics(df: DataFrame, truth_col: str = "is_fake", threshold: float = 0.5) -> DataFrame:
    """(strategy, accuracy, precision, recall, f1, tp, fp, fn, tn)."""
    y = F.col(truth_col) == 1
    aggs = []
    for name, pred in strategies(threshold).items():
        p = F.coalesce(pred, F.lit(False))
        aggs += [F.count_if(p & y).alias(f"{name}_tp"), F.count_if(p & ~y).alias(f"{name}_fp"),
                 F.count_if(~p & y).alias(f"{name}_fn"), F.count_if(~p & ~y).alias(f"{name}_tn")]
    counts = df.agg(*aggs)
    rows = None
    for name in strategies(threshold):
        tp, fp, fn, tn = (F.col(f"{name}_{x}") for x in ("tp", "fp", "fn", "tn"))
        prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
        one = counts.select(
            F.lit(name).alias("strategy"),
            _div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
            prec.alias("precision"), rec.alias("recall"),
            F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"),
            tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def label_means(df: DataFrame) -> DataFrame:
    """Mean probability per label (one row)."""
    return df.agg(*[F.avg(f"p_{k}").alias(f"mean_p_{k}") for k in LABEL_KEYS])
