"""Counts and literal searches over whole slices of a batch, on its UTF-8 bytes.

A text's characters are told by one table look-up a byte; only the characters
outside ASCII are decoded, all of a slice at once. Literals are searched in the
slice and not in every text of it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from vetline.functions import patterns as P

LETTER, UPPER, NONWORD, SPACE, EMOJI = 1, 2, 4, 8, 16
# Bytes that are looked at in one array, and that are added up in one field.
SLICE_BYTES, PIECE = 1 << 19, 1 << 15
# First code point that counts as an emoji (see ``patterns.emoji_pattern``).
FIRST_EMOJI = 0x2711


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Bits of every code point, after the classes of :mod:`patterns`."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        word, space = kind[0] in "LN", c < 0x3001 and ch.isspace()
        out[c] = (LETTER * (kind[0] == "L") | UPPER * (kind == "Lu") | NONWORD * (not word and not space)
                  | SPACE * space | EMOJI * (c >= FIRST_EMOJI))
    return out


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of ASCII bytes: three 16-bit fields (letter, upper, nonword) and whether
    it is a space; nothing of the others."""
    kinds = np.append(classes()[:128], np.zeros(128, np.uint8))
    fields = sum(((kinds & bit) > 0).astype(np.uint64) << np.uint64(16 * i) for i, bit in enumerate((LETTER, UPPER, NONWORD)))
    return fields, (kinds & SPACE) > 0


def row_slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows (begin, end) whose ``sizes`` add up to about ``limit``,
    a row at least: what a task holds of a batch does not follow its texts."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield begin, end
        begin = end


def byte_slices(texts: pa.Array, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets (one more than rows, the first 0) of neighbouring texts,
    about ``limit`` bytes at a time; NULL is the empty text."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + (limit or SLICE_BYTES), "right")) - 1)
        yield raw[ends[begin]:ends[end]], ends[begin:end + 1] - ends[begin]
        begin = end


def _beyond_ascii(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, code point and length of every character outside ASCII."""
    at = np.flatnonzero(raw >= 0xC0)
    if not len(at):
        return at, at, at
    padded = np.append(raw, np.zeros(3, np.uint8))
    b = [padded[at + i].astype(np.int64) for i in range(4)]
    size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
    low = [x & 0x3F for x in b]
    point = np.where(size == 2, (b[0] & 0x1F) << 6 | low[1], np.where(
        size == 3, (b[0] & 0x0F) << 12 | low[1] << 6 | low[2], (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]))
    return at, np.minimum(point, 0x10FFFF), size


def _runs_of_five(raw: np.ndarray, offsets: np.ndarray, at: np.ndarray, point: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows in which a character other than a newline stands five times in a row."""
    def first_of_five(same: np.ndarray) -> np.ndarray:
        return np.flatnonzero(same[:-3] & same[1:-2] & same[2:-1] & same[3:]) if len(same) > 3 else np.zeros(0, np.int64)

    plain = first_of_five((raw[1:] == raw[:-1]) & (raw[1:] < 0x80) & (raw[1:] != 0x0A))
    wide = first_of_five((point[1:] == point[:-1]) & (at[1:] == at[:-1] + size[:-1]))
    out = np.zeros(len(offsets) - 1, bool)
    for begin, end in ((plain, plain + 4), (at[wide], at[wide + 4]) if len(wide) else (wide, wide)):
        rows = np.searchsorted(offsets, begin, "right") - 1
        out[rows[rows == np.searchsorted(offsets, end, "right") - 1]] = True
    return out


def _counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    fields, spaces = _byte_tables()
    n = len(offsets) - 1
    at, point, size = _beyond_ascii(raw)
    kind, row = classes()[point], np.searchsorted(offsets, at, "right") - 1
    space = spaces[raw]
    for i in range(3):
        wide = at[((kind & SPACE) > 0) & (size > i)] + i
        space[wide[wide < len(raw)]] = True
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts = offsets[:-1][filled]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[starts] = ~space[starts]
    # long texts are added up in pieces, so that no field runs over
    cuts = np.union1d(starts, np.arange(0, len(raw), PIECE))
    out = np.zeros((4, n), np.int64)
    if len(cuts):
        sums = np.add.reduceat(fields[raw] + (begins.astype(np.uint64) << np.uint64(48)), cuts)
        of = np.searchsorted(offsets, cuts, "right") - 1
        for i in range(4):
            out[i] = np.bincount(of, weights=(sums >> np.uint64(16 * i)) & np.uint64(0xFFFF), minlength=n)
    for i, bit in enumerate((LETTER, UPPER, NONWORD)):
        out[i] += np.bincount(row[(kind & bit) > 0], minlength=n)
    emoji = np.bincount(row[(kind & EMOJI) > 0], minlength=n)
    return (*out, emoji, _runs_of_five(raw, offsets, at, point, size))


COUNTS = T.StructType([*[T.StructField(k, T.IntegerType()) for k in ("letters", "uppers", "nonwords", "words", "emojis")],
                       T.StructField("repeats", T.BooleanType())])


def char_counts(texts: pa.Array) -> pa.Array:
    """:data:`COUNTS` of every text: letters, upper-case ones, characters that are
    neither of a word nor white space, runs without white space, emoji, and
    whether a character (no newline) repeats five times in a row."""
    parts = [_counts(*s) for s in byte_slices(texts)]
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
    *counts, repeats = columns
    return pa.StructArray.from_arrays([*[pa.array(c.astype(np.int32)) for c in counts], pa.array(repeats)], COUNTS.names)


_FOLDED = tuple(c.encode() for c in P.FOLDED_TO_ASCII)


@lru_cache(maxsize=8)
def _heads(needles: tuple[bytes, ...]) -> tuple[np.ndarray, np.uint32]:
    """Whether four bytes may begin a needle, by the upper half of their product
    with a number."""
    table, factor = np.zeros(1 << 16, bool), np.uint32(0x9E3779B1)
    codes = np.array([int.from_bytes(x[:4], "little") for x in needles if len(x) >= 4], np.uint32)
    table[(codes * factor) >> np.uint32(16)] = True
    return table, factor


def literal_bits(texts: pa.Array, needles: tuple[bytes, ...]) -> pa.Array:
    """One bit per lower-case ASCII literal that the lower-cased text holds; -1 for
    a text with a letter outside ASCII whose lower or folded case is an ASCII one.

    Four bytes tell where a literal may begin; the rest is compared only there."""
    (heads, factor), parts = _heads(needles), [np.zeros(0, np.int64)]
    most = max([4, *map(len, needles + _FOLDED)])
    for raw, offsets in byte_slices(texts):
        n, bits = len(raw), np.zeros(len(offsets) - 1, np.int64)
        padded = raw.tobytes().lower() + bytes(most)
        low, four = np.frombuffer(padded, np.uint8), np.ndarray(n, "<u4", padded, strides=(1,))
        at = np.flatnonzero(heads[(four * factor) >> np.uint32(16)])
        found = four[at]

        def rows(places: np.ndarray, needle: bytes, known: int) -> np.ndarray:
            for k in range(known, len(needle)):
                places = places[low[places + k] == needle[k]]
            row = np.searchsorted(offsets, places, "right") - 1
            return row[places + len(needle) <= offsets[row + 1]]

        for i, needle in enumerate(needles):
            begins = at[found == int.from_bytes(needle[:4], "little")] if len(needle) >= 4 else np.flatnonzero(low[:n] == needle[0])
            held = np.zeros(len(bits), bool)
            held[rows(begins, needle, 4 if len(needle) >= 4 else 1)] = True
            bits[held] |= 1 << i
        for letter in _FOLDED:
            bits[rows(np.flatnonzero(low[:n] == letter[0]), letter, 1)] = -1
        parts.append(bits)
    return pa.array(np.concatenate(parts))
