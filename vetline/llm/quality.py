"""Repetition quality rules: rolling n-gram hashes and duplicated lines.

Every document is judged on its own whole text inside one narrow Arrow stage
(no shuffle). Words are maximal runs of bytes other than space and 0x09-0x0D
of the UTF-8 text. Word ids are exact (a dictionary per document); windows of
several lengths are hashed by a rolling polynomial over mixed word ids, and a
window is *duplicated* when its hash occurs at an earlier position too.
Coverage is measured in characters: the share of word characters that lie
inside some duplicated window of length n (n = 5..10), inside the most frequent
window (n = 2..4) and inside duplicated lines.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vetline.llm.common import table
from vetline.session import ship_package

# Shares of word characters, as published.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20
# Labelled clean documents of 60 to 100 words hold one line twice. One repeat
# of FREE_WORDS words is free, of a share that falls with the text's length;
# in a text of up to SHORT_WORDS words one repeated line does not count.
FREE_WORDS, MOST_FREE, SHORT_WORDS = 10, 0.10, 100
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True

OUT_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_share double, dup_line_char_share double, "
    + "".join(f"top_{n}gram_char_share double, " for n in TOP_LIMITS)
    + "".join(f"dup_{n}gram_char_share double, " for n in DUP_LIMITS)
    + "base_failed boolean, repetitive boolean, kept boolean")
FIELDS = [tuple(f.split()) for f in OUT_FIELDS.split(", ")]


def _mix(ids: np.ndarray) -> np.ndarray:
    """Spread small integers over 64 bits (xor-shift-multiply finaliser)."""
    x = ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the ``total`` words inside windows ``[s, s + n)``."""
    step = np.zeros(total + 1, np.int64)
    step[starts] += 1
    step[starts + n] -= 1
    return np.cumsum(step)[:total] > 0


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, first-of-group flags and group sizes of equal keys; stable, so
    the first row of each group is its earliest position."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.concatenate(([True], k[1:] != k[:-1]))
    size = np.diff(np.append(np.flatnonzero(first), len(k)))
    return order, first, size


def _lines(raw: bytes) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, and the word
    characters of the latter."""
    seen: set[bytes] = set()
    n_lines = dup = dup_chars = 0
    for line in raw.split(b"\n"):
        if not line or line.isspace():
            continue
        n_lines += 1
        if line in seen:
            dup += 1
            dup_chars += len(b"".join(line.split()).decode())
        else:
            seen.add(line)
    return n_lines, dup, dup_chars


def measure(text: str | None) -> dict:
    """All figures of one text; a null text has no words and fails the base."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    # exact word ids: the position of the word's first occurrence
    ids = np.fromiter(map({}.setdefault, words, itertools.count()), np.int64, n)
    buf = np.frombuffer(raw, np.uint8)
    gap = (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    char_count = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    chars = char_count[edge[1::2]] - char_count[edge[::2]]
    word_chars = int(chars.sum())
    total = max(word_chars, 1)
    n_lines, dup_lines, dup_line_chars = _lines(raw)
    out = {
        "n_words": n, "word_chars": word_chars, "n_symbols": int(np.count_nonzero(_IS_SYMBOL[buf])),
        "n_dup_lines": dup_lines, "n_repeat_words": 0,
        "dup_line_share": dup_lines / n_lines if n_lines else 0.0,
        "dup_line_char_share": dup_line_chars / total,
        **{f"top_{k}gram_char_share": 0.0 for k in TOP_LIMITS},
        **{f"dup_{k}gram_char_share": 0.0 for k in DUP_LIMITS},
    }

    # A window of k + 1 words can repeat only where its first k words do, so
    # each length looks only at the positions that the one before left over.
    char_sum = np.concatenate(([0], np.cumsum(chars)))
    mixed = _mix(ids)
    live, rolling = np.arange(n), mixed
    for k in range(2, max(DUP_LIMITS) + 1):
        fits = live + k <= n
        live = live[fits]
        if not len(live):
            break
        rolling = rolling[fits] * _BASE + mixed[live + k - 1]
        order, first, size = _groups(rolling)
        again = np.repeat(size > 1, size)
        if k in TOP_LIMITS:
            most = int(size.max())
            if most > 1:
                heads = live[order[first][size == most]]
                span = int((char_sum[heads + k] - char_sum[heads]).max())
                out[f"top_{k}gram_char_share"] = min(1.0, most * span / total)
        if k in DUP_LIMITS:
            later = live[order[~first]]
            out[f"dup_{k}gram_char_share"] = float(chars[_covered(later, k, n)].sum()) / total
        pick = np.sort(order[again])
        if k == 2:
            # exact three-word windows for the base rule
            out["n_repeat_words"] = _repeated_triples(ids, live[pick], n)
        live, rolling = live[pick], rolling[pick]

    out["base_failed"] = n < MIN_WORDS or 100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n
    free = min(MOST_FREE, FREE_WORDS / max(n, 1))
    out["repetitive"] = (
        (out["dup_line_share"] > LINE_LIMIT and (dup_lines > 1 or n > SHORT_WORDS))
        or out["dup_line_char_share"] > LINE_CHAR_LIMIT + free
        or any(out[f"top_{k}gram_char_share"] > lim + free for k, lim in TOP_LIMITS.items())
        or any(out[f"dup_{k}gram_char_share"] > lim + free for k, lim in DUP_LIMITS.items()))
    out["kept"] = not (out["base_failed"] or out["repetitive"])
    return out


def _repeated_triples(ids: np.ndarray, starts: np.ndarray, n: int) -> int:
    """Words inside three-word windows found at least twice; compared by word
    ids, not by hash. ``starts`` hold every window whose first pair repeats."""
    starts = starts[starts + 3 <= n]
    if not len(starts):
        return 0
    pair = np.unique(ids[starts] * n + ids[starts + 1], return_inverse=True)[1]
    order, _, size = _groups(pair * n + ids[starts + 2])
    return int(_covered(starts[order[np.repeat(size > 1, size)]], 3, n).sum())


def repetition_quality(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default ``doc_id``) plus the repetition figures.

    Null and empty texts have zero counts, fail the base rule and are not
    kept. Repeated rows give repeated results; other input columns, also ones
    named like an output, are dropped unless named in ``keep``."""
    ship_package(docs.sparkSession)
    keep = keep or ["doc_id"]
    slim = docs.select(*keep, docs[text_col].alias("__text"))
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(len(keep))]
            arrays = [batch.column(i) for i in range(len(keep))]
            arrays += [pa.array([r[f] for r in rows], kinds[kind]) for f, kind in FIELDS]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(f for f, _ in FIELDS)])

    kept_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(judge, f"{kept_fields}, {OUT_FIELDS}")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(table(spark, sf_dir, "documents"))
