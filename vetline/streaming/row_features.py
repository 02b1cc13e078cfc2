"""Row-level review features on a stream.

Only features that are functions of their own row are offered: bursts,
duplicates and batch-fitted relevancy need all reviews of a user or corpus and
belong to batch screening.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from vetline.operators.features import add_row_features, add_weak_labels
from vetline.schema import ensure_columns


def stream_row_features(stream: DataFrame) -> DataFrame:
    """A streaming (or batch) review frame with row features and weak labels;
    absent user names and ids stay absent."""
    absent = tuple(c for c in ("user_name", "user_id") if c not in stream.columns)
    return add_weak_labels(add_row_features(ensure_columns(stream, keep_absent=absent)))
