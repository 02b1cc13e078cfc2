"""Per-row text scalars as Spark Column expressions.

Normalisation needs HTML unescaping and NFKC, which have no JVM builtin; Shannon
entropy is several times faster in an Arrow batch than as an explode/groupBy.
Counts of characters and searches for the rules' literals go over whole slices
of a batch (:mod:`vetline.functions.scan`), once for all features of a row;
patterns run in the JVM, and only on texts that hold one of their literals.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.config import DEFAULT_PROFANITY
from vetline.functions import patterns as P
from vetline.functions import scan
from vetline.functions.scan import row_slices


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_text(col: Column | str) -> Column:
    """NULL text behaves as the empty string everywhere."""
    return F.coalesce(_c(col), F.lit(""))


# --------------------------------------------------------------------------
# Normalisation: html-unescape -> strip tags -> NFKC -> trim -> collapse ws.

_TAG = re.compile("<[^>\n]*>")


@F.arrow_udf(T.StringType())
def _normalized(texts: pa.Array) -> pa.Array:
    """One pass per text; ``str.split`` parts at what ``str.isspace`` names."""
    return pa.array([None if t is None else " ".join(unicodedata.normalize("NFKC", _TAG.sub(" ", html.unescape(t))).split())
                     for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(t: Column) -> Column:
    """Compatibility composition; ASCII texts, which have no other form, stay in
    the JVM."""
    needs = F.octet_length(t) > F.length(t)
    return F.when(needs, _nfkc(F.when(needs, t))).otherwise(t)


def collapse_ws(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, P.ws_excess(), " "))


def strip_tags(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), P.tag_pattern(), " ")


def normalize_text(col: Column | str, lower: bool = False) -> Column:
    """``normalize_text`` (and ``text_norm`` when ``lower``)."""
    t = _normalized(safe_text(col))
    return F.lower(t) if lower else t


def text_norm(col: Column | str) -> Column:
    return normalize_text(col, lower=True)


# --------------------------------------------------------------------------
# Counting features (all on the raw text, NULL -> "").

def char_len(col: Column | str) -> Column:
    return F.length(safe_text(col))


@F.arrow_udf(scan.COUNTS)
def _char_counts(texts: pa.Array) -> pa.Array:
    return scan.char_counts(texts)


def _counted(col: Column | str, name: str) -> Column:
    """One of ``scan.COUNTS``; features of one text share the pass."""
    return _char_counts(safe_text(col))[name]


# What the rules' patterns ask for: a match holds one of these, lower-cased.
_PLAIN_PROMO = tuple(x for x in P.PROMO_TERMS if "\\s" not in x)
_PARTED_PROMO = tuple(x.split("\\s*")[0] for x in P.PROMO_TERMS if "\\s" in x)
_CUE_HEADS = tuple(x.split("(")[0] for x in P.EXPERIENTIAL_CUES)
_LITERALS = tuple(dict.fromkeys(_PLAIN_PROMO + _PARTED_PROMO + P.NEVER_BEEN_PHRASES + _CUE_HEADS + DEFAULT_PROFANITY))
_NEEDLES = tuple(x.encode() for x in _LITERALS)


@F.arrow_udf(T.LongType())
def _literal_bits(texts: pa.Array) -> pa.Array:
    return scan.literal_bits(texts, _NEEDLES)


def _holds(t: Column, literals: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of some :data:`_LITERALS`, as each
    match of a case-insensitive pattern with them does; a text with a letter
    outside ASCII that such a pattern takes for i, k or s counts as a hit."""
    mask = sum(1 << _LITERALS.index(x) for x in set(literals))
    return _literal_bits(t).bitwiseAND(F.lit(mask)) != 0


def word_len(col: Column | str) -> Column:
    """Runs of characters that are no white space (``str.isspace``)."""
    return _counted(col, "words")


def url_count(col: Column | str) -> Column:
    t = safe_text(col)
    return F.when(_may_have_url(t), F.regexp_count(t, F.lit(P.url_pattern()))).otherwise(F.lit(0))


def _may_have_url(t: Column) -> Column:
    return t.contains("://") | t.contains("www.")


def has_url(col: Column | str) -> Column:
    t = safe_text(col)
    return _may_have_url(t) & t.rlike(P.url_pattern())


def caps_ratio(col: Column | str) -> Column:
    letters = _counted(col, "letters")
    return F.when(letters == 0, F.lit(0.0)).otherwise(_counted(col, "uppers") / letters)


def emoji_count(col: Column | str) -> Column:
    return _counted(col, "emojis")


def repeat_ratio(col: Column | str) -> Column:
    """1.0 when some character (not a newline) repeats 5+ times in a row."""
    return F.when(_counted(col, "repeats"), F.lit(1.0)).otherwise(F.lit(0.0))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often it is read."""
    return F.transform(F.array(value), body)[0]


def _any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def promo_terms(col: Column | str) -> Column:
    """A term without white space in it is a plain substring of the lower-cased
    text; the pattern, which is slow, looks only for the others and at texts with
    letters outside ASCII that it takes for i, k or s."""
    t = safe_text(col)
    bits = _literal_bits(t)
    return ((bits >= 0) & _holds(t, _PLAIN_PROMO)) | (
        _holds(t, _PARTED_PROMO) & (t.rlike(P.promo_pattern()) | ((bits < 0) & _any_of([F.lower(t).contains(x) for x in _PLAIN_PROMO]))))


def never_been_cues(col: Column | str) -> Column:
    t = safe_text(col)
    return _holds(t, P.NEVER_BEEN_PHRASES) & t.rlike(P.never_been_pattern())


def nonword_ratio(col: Column | str) -> Column:
    return _counted(col, "nonwords") / F.greatest(F.lit(1), F.length(safe_text(col)))


def profanity_count(col: Column | str, words: tuple[str, ...]) -> Column:
    """Tokens ``[A-Za-z']+`` of the lower-cased text found in ``words``.
    ``words`` is a small in-plan literal; lexicons that are tables go through
    :func:`vetline.operators.features.profanity_counts`."""
    if not words:
        return F.lit(0)
    lex, t = F.array(*[F.lit(w) for w in words]), safe_text(col)

    def count(low: Column) -> Column:
        toks = F.regexp_extract_all(low, F.lit("[A-Za-z']+"), 0)
        return F.size(F.filter(toks, lambda x: F.array_contains(lex, x)))

    # a text without any word as a substring has none as a token
    if set(words) <= set(_LITERALS):
        return F.when(_holds(t, words), count(F.lower(t))).otherwise(0)
    return _once(F.lower(t), lambda low: F.when(_any_of([low.contains(w) for w in words]), count(low)).otherwise(0))


def experiential_score(col: Column | str) -> Column:
    """Each cue is first screened with a plain substring test on its leading
    literal (a match is impossible without it), so the regex runs only on
    the few rows that contain the literal."""
    t = safe_text(col)
    hits = reduce(lambda a, b: a + b, [
        F.when(_holds(t, (head,)), F.lower(t).rlike(pat)).otherwise(F.lit(False)).cast("int")
        for head, pat in zip(_CUE_HEADS, P.experiential_patterns())])
    return F.least(F.lit(1.0), hits / F.lit(4.0))


# --------------------------------------------------------------------------
# Shannon entropy over code points.

# Code points, and cells of a (row, code point) table, that a slice of a batch
# may have.
SLICE_CHARS, TABLE_CELLS = 1 << 20, 1 << 22


def text_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _entropies(texts: pa.Array, sizes: np.ndarray) -> np.ndarray:
    points = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), "<u4")
    rows = np.repeat(np.arange(len(texts)), sizes)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    kinds = int(seen.sum())
    if len(texts) * kinds <= TABLE_CELLS:
        counts = np.bincount(rows * kinds + (np.cumsum(seen) - 1)[points], minlength=len(texts) * kinds)
        cells = np.flatnonzero(counts)
        row, counts = cells // max(kinds, 1), counts[cells]
    else:
        pairs, counts = np.unique(rows << 21 | points, return_counts=True)
        row = pairs >> 21
    share = counts / sizes[row]
    return np.bincount(row, weights=-share * np.log2(share), minlength=len(texts))


@F.arrow_udf(T.DoubleType())
def _entropy_udf(texts: pa.Array) -> pa.Array:
    """Entropy of a slice at once: one table of its rows and code points."""
    sizes = text_sizes(texts)
    parts = [_entropies(texts.slice(a, b - a), sizes[a:b]) for a, b in row_slices(sizes, SLICE_CHARS)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0))


def char_entropy(col: Column | str) -> Column:
    t = safe_text(col)
    return _entropy_udf(t)
