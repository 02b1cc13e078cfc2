"""Place lookups, place descriptions, prediction records and their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.config import LABEL_KEYS, LABELS, RATIONALE

PLACE_ATTRS = ("place_name", "place_category", "city")


def place_description(name: Column | str = "place_name", category: Column | str = "place_category",
                      city: Column | str = "city", desc: Column | str = "description") -> Column:
    """``name — category, city. description`` with missing parts as ''."""
    def s(c):
        c = F.col(c) if isinstance(c, str) else c
        return F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(s(name), F.lit(" — "), s(category), F.lit(", "), s(city), F.lit(". "), s(desc))


def enrich_place(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """reviews LEFT JOIN places on place_id. Place attributes prefer the place
    table and fall back to the review's own values, then ''. Duplicate
    place_ids multiply rows (plain relational semantics). AQE picks a
    broadcast at run time when the place side turns out small."""
    pcols = [c for c in places.columns if c != "place_id"]
    p = places.select("place_id", *[F.col(c).alias(f"_pl_{c}") for c in pcols])
    out = reviews.join(p, "place_id", "left")
    for c in pcols:
        if c in reviews.columns:
            fallback = [F.col(c)] + ([F.lit("")] if c in PLACE_ATTRS or c == "description" else [])
            out = out.withColumn(c, F.coalesce(F.col(f"_pl_{c}"), *fallback))
        else:
            default = [F.lit("")] if c == "description" else []
            out = out.withColumn(c, F.coalesce(F.col(f"_pl_{c}"), *default))
    return out.drop(*[f"_pl_{c}" for c in pcols])


def eval_pairs(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """(review, place description) pairs for reviews whose place exists."""
    p = places.select("place_id", place_description().alias("place_desc"))
    return reviews.join(p, "place_id", "inner")


def prob_columns() -> list[str]:
    return [f"p_{k}" for k in LABEL_KEYS]


def confidences(prob_cols: list[str] | None = None) -> Column:
    cols = prob_cols or prob_columns()
    return F.map_from_arrays(F.array(*[F.lit(x) for x in LABELS]), F.array(*[F.col(c).cast("double") for c in cols]))


def prediction_records(df: DataFrame) -> DataFrame:
    """The prediction record of every review (fixed column set)."""
    return df.select(
        "review_id",
        F.col("labels"),
        confidences().alias("confidences"),
        F.col("relevancy").cast("double").alias("relevancy"),
        F.col("image_relevancy").cast("double").alias("image_relevancy"),
        F.col("user_name_gibberish").cast("double").alias("user_name_gibberish"),
        F.col("user_burst_24h").cast("int").alias("user_burst_24h"),
        F.col("dup_across_places").cast("boolean").alias("dup_across_places"),
        F.col("char_entropy").cast("double").alias("char_entropy"),
        F.col("profanity_count").cast("int").alias("profanity_count"),
        F.col("distance_km").cast("double").alias("distance_km"),
        F.lit(RATIONALE).alias("rationale"),
    )


def filter_label(preds: DataFrame, label: str) -> DataFrame:
    """Keep predictions carrying ``label``; "(all)" keeps everything."""
    if label == "(all)":
        return preds
    return preds.where(F.array_contains("labels", label))


def max_confidence(col: str = "confidences") -> Column:
    return F.array_max(F.map_values(F.col(col)))


def filter_confidence(preds: DataFrame, minimum: float) -> DataFrame:
    return preds.where(max_confidence() >= F.lit(float(minimum)))


def shown_counts(preds: DataFrame, label: str, minimum: float) -> DataFrame:
    """One row: how many predictions pass both filters, out of how many."""
    lab = F.lit(True) if label == "(all)" else F.array_contains("labels", label)
    mask = lab & (max_confidence() >= F.lit(float(minimum)))
    return preds.agg(F.count_if(mask).alias("shown"), F.count(F.lit(1)).alias("total"))
