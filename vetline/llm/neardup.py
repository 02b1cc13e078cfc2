"""Near-duplicate documents by SetSketch registers.

A register is the truncated logarithm of the smallest of exponentially
distributed hashes of a document's shingles; the sketch of a union is the
register-wise maximum, and equal registers follow the Jaccard similarity. Equal
shingle sets are one class. Class sketches are cut into bands of registers;
classes that share a band are candidates; a candidate pair survives if a joint
likelihood over all registers and the set sizes does not rule out the
threshold, and is a link when the full sets confirm it. Components of links
are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.llm.common import stored, table
from vetline.llm.components import components
from vetline.llm.shingles import finalise, shingle_set
from vetline.session import ship_package

SHINGLE_WORDS, PERCENT = 4, 80
# A pair at the threshold shares no band with probability
# (1 - 0.8 ** BAND_ROWS) ** BANDS, under 6e-6, and 6e-9 at 0.85.
BANDS, BAND_ROWS = 40, 6
REGISTERS = BANDS * BAND_ROWS
# Sketch parameters: base of the logarithm, rate of the exponentials, top register.
BASE, RATE, TOP = 1.02, 20.0, 65_535
# A pair goes on unless its best likelihood at or above the threshold is below
# the best overall by this much (a chance of about e ** -20).
SLACK = 20.0

_SEEDS = np.random.default_rng(20201231).integers(0, 2**63, (2, REGISTERS), dtype=np.uint64)
_FACTORS = (_SEEDS[1] << np.uint64(1)) | np.uint64(1)
_CHUNK = 2048
# Members of one block of a bucket, and shingles of one matrix product.
BLOCK, _COLUMNS = 128, 16_384


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set of 64-bit shingle hashes."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        x = (shingles[None, i:i + _CHUNK] ^ _SEEDS[0][:, None]) * _FACTORS[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, x.min(axis=1), out=low)
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(exponential) / math.log(BASE)), 0, TOP).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 201)


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sketches (rows of ``a`` and ``b``) of sets of ``na`` and
    ``nb`` elements may have a Jaccard similarity of ``percent`` or more."""
    fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1.0 - u
    # similarities a pair of this size ratio can have, as a grid of its own
    grid = _GRID[None, :] * (np.minimum(u, v) / np.maximum(u, v))
    gap = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / math.log(BASE)
    up, down = gap(u - v * grid), gap(v - u * grid)
    rest = np.clip(1.0 - up - down, 1e-12, 1.0)
    likely = (more * np.log(np.clip(up, 1e-12, 1.0)) + less * np.log(np.clip(down, 1e-12, 1.0)) + same * np.log(rest))
    far = np.where(grid >= percent / 100.0 - 0.005, likely, -np.inf).max(axis=1)
    return fits & (far >= likely.max(axis=1) - SLACK)


def sketches(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the shingle set and its
    registers (both null for an empty set)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, regs = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "regs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, regs binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, cls): one row per band of each class."""
    odd = (np.arange(REGISTERS, dtype=np.uint64).reshape(BANDS, BAND_ROWS) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, BANDS, BAND_ROWS).astype(np.uint64)
            parts = finalise(regs[:, :, 0] * odd[:, 0] + np.arange(BANDS, dtype=np.uint64))
            for r in range(1, BAND_ROWS):
                parts = finalise(parts ^ (regs[:, :, r] * odd[:, r]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))],
                names=["key", "cls"])

    return classes.select("cls", "regs").mapInArrow(run, "key long, cls long")


def _two_sided(pairs: DataFrame, side: DataFrame, cols: list[str]) -> DataFrame:
    left = side.select(F.col("cls").alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = side.select(F.col("cls").alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return pairs.select("a", "b").join(left, "a").join(right, "b")


def likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) that size and likelihood leave over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            col = lambda c: batch.column(c)
            regs = [np.frombuffer(b"".join(col(c).to_pylist()), "<u2").reshape(n, REGISTERS) for c in ("regs_a", "regs_b")]
            ok = may_reach(*regs, col("n_a").to_numpy().astype(float), col("n_b").to_numpy().astype(float), percent)
            yield pa.RecordBatch.from_arrays([col("a"), col("b")], names=["a", "b"]).filter(pa.array(ok))

    return _two_sided(pairs, classes, ["n", "regs"]).select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(
        run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold: a, b, common, total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b"))):
                a, b = a.as_py(), b.as_py()
                if b != last:
                    last, held = b, shingle_set(tb.as_py(), k)
                mine = shingle_set(ta.as_py(), k)
                common = len(np.intersect1d(mine, held, assume_unique=True))
                total = len(mine) + len(held) - common
                if total and 100 * common >= percent * total:
                    out.append((a, b, common, total))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["a", "b", "common", "total"])

    return _two_sided(pairs, texts, ["text"]).select("a", "b", "text_a", "text_b").mapInArrow(
        run, "a long, b long, common long, total long")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of shingle sets: products of
    0/1 matrices over the shingles that both sides have, in column chunks."""
    out = np.zeros((len(left), len(right)), np.int64)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for i in range(0, len(shared), _COLUMNS):
        part, sides = shared[i:i + _COLUMNS], []
        for sets in (left, right):
            m = np.zeros((len(sets), len(part)), np.float32)
            for row, s in zip(m, sets):
                at = np.searchsorted(part, s)
                at[at == len(part)] = 0
                row[at[part[at] == s]] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def links_within(members: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links (a, b, common, total) between members (``key``, ``cls``, ``root``,
    ``text``) of a bucket with different roots.

    A bucket is cut into blocks of about ``block`` members, and a task compares
    two blocks of full sets at a time, so that neither a task nor a row holds a
    whole bucket and no pair becomes a row before it is a link."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    placed = members.join(sizes, "key").withColumn("block", F.pmod(F.hash("cls"), F.ceil(F.col("size") / block).cast("int")))
    blocks = stored(placed.groupBy("key", "block").agg(F.collect_list(F.struct("cls", "root", "text")).alias("held")), "blocks")
    one = blocks.select("key", F.col("block").alias("i"), F.col("held").alias("left"))
    other = blocks.select("key", F.col("block").alias("j"), F.col("held").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}

        def opened(held) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            rows = held.as_py()
            for r in rows:
                if r["cls"] not in memo:
                    if len(memo) > 4 * BLOCK:
                        memo.clear()
                    memo[r["cls"]] = shingle_set(r["text"], k)
            sets = [memo[r["cls"]] if r["cls"] in memo else shingle_set(r["text"], k) for r in rows]
            return np.array([r["cls"] for r in rows]), np.array([r["root"] for r in rows]), sets

        for batch in batches:
            found = [np.zeros((0, 4), np.int64)]
            for left, right in zip(batch.column(0), batch.column(1)):
                (ca, ra, sa), (cb, rb, sb) = opened(left), opened(right)
                common = _common(sa, sb)
                total = np.array([len(s) for s in sa])[:, None] + np.array([len(s) for s in sb])[None, :] - common
                x, y = np.nonzero((100 * common >= percent * total) & (ra[:, None] != rb[None, :]))
                found.append(np.stack([np.maximum(ca[x], cb[y]), np.minimum(ca[x], cb[y]), common[x, y], total[x, y]], axis=1))
            flat = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, i]) for i in range(4)], names=["a", "b", "common", "total"])

    both = one.join(other, "key").filter("i <= j").select("left", "right")
    return both.mapInArrow(run, "a long, b long, common long, total long").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept, n_links (links
    found with the document's class).

    No pair inside a bucket goes unseen, and none is looked at that an earlier
    step settled: each class is first compared with one representative that it
    shares most bands with, then with the representatives of all its buckets,
    and last the members of every bucket that still holds several components
    are compared in blocks of full sets. Documents without words, or null, are groups of
    their own; equal sets are one class and are never paired. Rows without a
    doc_id stay unlinked with a null component and are kept. Rows that repeat a
    doc_id are one node. Other input columns are not read."""
    drawn = stored(sketches(docs, k), "sketches")
    classes = stored(drawn.filter("doc_id is not null and digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("cls"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "classes")
    keys = stored(band_keys(classes), "bands")
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("cls").alias("rep")).filter("members > 1")
    buckets = stored(keys.join(shared.select("key", "rep"), "key"), "buckets")
    involved = buckets.select("cls").distinct()
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("cls"), "text").join(involved, "cls"), "texts")
    sides = stored(classes.select("cls", "n", "regs").join(involved, "cls"), "sides")

    def settle(pairs: DataFrame) -> DataFrame:
        pairs = stored(likely_pairs(pairs, sides, percent), "likely")
        return stored(confirmed(pairs, texts, k, percent), "confirmed")

    stars = stored(buckets.filter("cls <> rep").groupBy(F.col("cls").alias("a"), F.col("rep").alias("b")).agg(
        F.count("*").alias("bands")), "stars")
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("bands", (-F.col("b")).alias("low"))).alias("b"))
    links = settle(best)
    roots = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    def joined(pairs: DataFrame) -> None:
        nonlocal links, roots
        more = settle(pairs)
        if not more.isEmpty():
            links = links.unionAll(more)
            roots = components(links)

    joined(apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti")))
    placed = buckets.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        "key", "cls", "rep", F.coalesce("root", "cls").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
    more = stored(links_within(placed.join(mixed, "key").select("key", "cls", "root").join(texts, "cls"), k, percent), "within")
    if not more.isEmpty():
        links = links.unionAll(more)
        roots = components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    placed = stored(classes.select("digest", "cls").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
                    .join(degree, "cls", "left").select("digest", F.coalesce("root", "cls").alias("root"), "n_links"), "placed")
    return (drawn.select("doc_id", "n_shingles", "digest").join(placed, "digest", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
                    F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
