"""User-name gibberish score as one CASE expression.

The partial scores are added in a fixed order (0.4, 0.2, 0.2, 0.2) because
the float sums decide the 0.6 / 0.8 thresholds: 0.4 + 0.2 is
0.6000000000000001 while 0.4 + 0.2 + 0.2 is exactly 0.8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetline.functions import patterns as P


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_ws(col: Column) -> Column:
    """``str.strip()``: Spark's ``trim`` only removes U+0020."""
    ws = P.ws_class()
    return F.regexp_replace(col, f"^{ws}+|{ws}+$", "")


def gibberish_name(col: Column | str) -> Column:
    n = trim_ws(F.coalesce(_c(col), F.lit("")))
    n_len = F.length(n)
    core = F.regexp_replace(n, "[^\\p{L}]", "")
    core_len = F.length(core)
    vowels = F.regexp_count(F.lower(core), F.lit("[aeiou]"))
    digits = F.regexp_count(n, F.lit(f"[{P.digit_body()}]"))
    nonalpha = F.regexp_count(n, F.lit(P.nonword_pattern()))
    long_run = core.rlike(f"(?iu)[{P.CONSONANTS}]{{5,}}").cast("int")

    def part(cond: Column, w: float) -> Column:
        return F.when(cond, F.lit(w)).otherwise(F.lit(0.0))

    score = (
        ((F.lit(0.0) + part(vowels / F.greatest(F.lit(1), core_len) < 0.2, 0.4))
         + part(digits / F.greatest(F.lit(1), n_len) > 0.3, 0.2))
        + part(nonalpha / F.greatest(F.lit(1), n_len) > 0.2, 0.2)
    ) + F.lit(0.2) * long_run
    return (
        F.when((n_len <= 1) | (core_len == 0), F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    )
