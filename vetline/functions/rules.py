"""Rule scores, weak labels and label coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetline.config import AD, RANT, SPAM
from vetline.functions import text as X


def weak_labels(col: Column | str) -> Column:
    """url and promo -> Ad; never-been -> Rant; repeated chars -> Spam,
    in canonical label order."""
    return labels_of_rules(X.has_url(col), X.promo_terms(col), X.never_been_cues(col), X.repeat_ratio(col))


def labels_of_rules(has_url: Column, promo: Column, never_been: Column, repeat: Column) -> Column:
    """Weak labels from rule columns that are already computed."""
    labs = F.array(F.when(has_url & promo, F.lit(AD)), F.when(never_been, F.lit(RANT)), F.when(repeat > 0.0, F.lit(SPAM)))
    return F.filter(labs, lambda x: x.isNotNull())


def ordered_labels(flags: list[tuple[str, Column]]) -> Column:
    """Array of the label names whose flag is true, in the given order."""
    arr = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in flags])
    return F.filter(arr, lambda x: x.isNotNull())


def label_coerce(col: Column | str) -> Column:
    """Label column -> 0/1. Strings: fake/true/1 -> 1, real/false/0 -> 0,
    anything else 0 (after lower + strip). Numbers: > 0.5."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("double") > 0.5, F.lit(False)).cast("int")


def label_coerce_string(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    from vetline.functions.users import trim_ws

    v = F.lower(trim_ws(c.cast("string")))
    # Accepted spellings for the fake (1) class.
    return F.when(v.isin("fake", "true", "1"), F.lit(1)).otherwise(F.lit(0))
