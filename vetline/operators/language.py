"""Language identification as a Spark job.

A character-trigram naive-Bayes profile is learned from documents with a
known language and applied row by row: score(doc, lang) = log prior(lang) +
sum over trigrams of count * log p(trigram | lang), with add-one smoothing
over the trigram vocabulary. Whole texts are used. A trigram is three code
points of the lower-cased text, packed into one long.

Learning counts trigrams inside each Arrow batch and shuffles one row per
(language, trigram) of a batch. The profile stays a table: rows are stored in
groups of ``GROUP_ROWS``, each group sends its distinct trigrams to a join with
the profile, and what it gets back, the part of the profile that its own texts
need, scores them. The shuffles carry one row per distinct trigram of a group
and every text once, whatever the size of the profile, and the driver gathers
one row per language. A common trigram meets as many rows as there are groups,
and so does every other common one, so no key stands out.

A profile of at most ``SMALL_PROFILE`` rows is broadcast instead, and scoring is
then narrow. Both ways add up the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.functions.text import SLICE_CHARS, row_slices, text_sizes
from vetline.session import materialize, ship_package, stored_rows

# Rows of (language, trigram) that may be broadcast: 24 bytes each.
SMALL_PROFILE = 500_000
GROUP_ROWS = 4096


def batch_trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and packed trigram of every three neighbouring code points."""
    points = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), sizes)
    if len(points) < 3:
        return rows[:0], points[:0]
    inside = rows[2:] == rows[:-2]
    packed = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    return rows[2:][inside], packed[inside]


def trigram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, tri, c) over documents with a language."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for a, b in row_slices(text_sizes(batch.column(1)), SLICE_CHARS):
                rows, tri = batch_trigrams(batch.column(1).slice(a, b - a))
                lang = codes[a:b][rows]
                for code, name in enumerate(coded.dictionary):
                    values, counts = np.unique(tri[lang == code], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(name, len(values)), pa.array(values), pa.array(counts.astype(np.int64))], names=["lang", "tri", "c"])

    slim = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return slim.mapInArrow(count, "lang string, tri long, c long").groupBy("lang", "tri").agg(F.sum("c").alias("c"))


def dense_profile(tri: np.ndarray, code: np.ndarray, delta: np.ndarray, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted trigrams and their log probabilities above the unseen one by
    language; a last row of zeros stands for all others."""
    known, at = np.unique(tri, return_inverse=True)
    table = np.zeros((len(known) + 1, langs))
    table[at, code] = delta
    return known, table


def language_scores(texts: pa.Array, known: np.ndarray, table: np.ndarray, prior: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """Score of every text in every language."""
    parts = [_slice_scores(texts.slice(a, b - a), known, table, prior, unseen) for a, b in row_slices(text_sizes(texts), SLICE_CHARS)]
    return np.concatenate(parts) if parts else np.zeros((0, table.shape[1]))


def _slice_scores(texts: pa.Array, known: np.ndarray, table: np.ndarray, prior: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    row, seen = batch_trigrams(texts)
    at = np.searchsorted(known, seen)
    at[at == len(known)] = 0
    at = np.where(known[at] == seen, at, len(known)) if len(known) else np.zeros(len(seen), np.int64)
    sums = [np.bincount(row, weights=table[at, k], minlength=len(texts)) for k in range(table.shape[1])]
    return np.stack(sums, axis=1) + prior + np.bincount(row, minlength=len(texts))[:, None] * unseen


class TrigramLanguageModel:
    """``profile`` (lang, tri, lp_delta) and ``langs`` (lang, prior, unseen),
    both stored tables."""

    def __init__(self, profile: DataFrame, langs: DataFrame):
        self.profile = profile
        self.langs = langs

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text", lang_col: str = "lang"):
        counts = materialize(trigram_counts(docs, text_col, lang_col))
        vocab = counts.select(F.count_distinct("tri")).scalar()
        totals = counts.groupBy("lang").agg(F.sum("c").alias("total"))
        labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"))
        n_docs = labelled.select(F.count(F.lit(1))).scalar()
        langs = (labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(totals, "lang", "left")
                 .select("lang", F.log(F.col("n") / n_docs).alias("prior"),
                         (-F.log(F.coalesce(F.col("total"), F.lit(0)) + vocab)).alias("unseen")))
        # log p(tri | lang) - log p(unseen | lang) = ln(c + 1)
        profile = counts.select("lang", "tri", F.log(F.col("c") + 1.0).alias("lp_delta"))
        return cls(profile, materialize(langs))

    def save(self, path: str) -> None:
        self.profile.write.mode("overwrite").parquet(f"{path}/profile")
        self.langs.write.mode("overwrite").parquet(f"{path}/langs")

    @classmethod
    def load(cls, spark, path: str):
        return cls(spark.read.parquet(f"{path}/profile"), spark.read.parquet(f"{path}/langs"))

    def predict(self, df: DataFrame, text_col: str = "text", out: str = "lang_pred", small: int = SMALL_PROFILE) -> DataFrame:
        """Adds ``out``: the best language, the first by name on a tie; blank
        or NULL text, and texts under three characters, give "unknown". A
        profile of more than ``small`` rows is joined, not broadcast."""
        spark = df.sparkSession
        ship_package(spark)
        # one row per labelled language, as many as the caller's labels name
        langs = [(r.lang, r.prior, r.unseen) for r in self.langs.orderBy("lang").collect()]
        if not langs:
            return df.withColumn(out, F.lit("unknown"))
        names = [r[0] for r in langs]
        prior, unseen = (np.array([r[i] for r in langs]) for i in (1, 2))
        code = (F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1).cast("int")
        profile = self.profile.select("tri", code.alias("code"), "lp_delta")
        text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
        known = (F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "") & (F.length(text_col) >= 3)
        head = profile.limit(small + 1)
        if head.count() <= small:
            rows = spark.sparkContext.broadcast([tuple(r) for r in head.collect()])
            best = _narrow_best(rows, prior, unseen, names)(text)
            return df.withColumn(out, F.when(known, best).otherwise(F.lit("unknown")))
        kept = stored_rows(df.withColumn("_vl_row", F.monotonically_increasing_id()))
        slim = kept.where(known).select("_vl_row", text.alias("text"))
        best = joined_best(slim, profile, prior, unseen, names)
        return kept.join(best, "_vl_row", "left").withColumn(out, F.coalesce("_vl_best", F.lit("unknown"))).drop("_vl_row", "_vl_best")


def _narrow_best(rows: Broadcast, prior: np.ndarray, unseen: np.ndarray, names: list[str]):
    """UDF: a lower-cased text's best language under a broadcast profile."""
    held: list = []

    @F.arrow_udf(T.StringType())
    def best(texts: pa.Array) -> pa.Array:
        if not held:
            tri, code, delta = (np.array(c) for c in zip(*rows.value)) if rows.value else (np.zeros(0, np.int64),) * 3
            held.append(dense_profile(tri.astype(np.int64), code.astype(np.int64), delta, len(names)))
        return pa.array(names).take(pa.array(language_scores(texts, *held[0], prior, unseen).argmax(axis=1)))

    return best


def joined_best(rows: DataFrame, profile: DataFrame, prior: np.ndarray, unseen: np.ndarray, names: list[str]) -> DataFrame:
    """(``_vl_row``, lower-cased ``text``) to (``_vl_row``, ``_vl_best``) by a join
    of each group's distinct trigrams with ``profile`` (tri, code, lp_delta)."""
    grouped = rows.withColumn("_vl_group", F.floor(F.col("_vl_row") / GROUP_ROWS).cast("long"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy()
            for g in np.unique(groups):
                mine = np.zeros(0, np.int64)
                texts = batch.column(1).filter(pa.array(groups == g))
                for a, b in row_slices(text_sizes(texts), SLICE_CHARS):
                    mine = np.union1d(mine, batch_trigrams(texts.slice(a, b - a))[1])
                yield pa.RecordBatch.from_arrays([pa.repeat(int(g), len(mine)), pa.array(mine)], names=["_vl_group", "tri"])

    def score(texts: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({"_vl_row": [], "_vl_best": []})
        # a group that came in two batches may have asked twice
        known, table = dense_profile(part["tri"].to_numpy(np.int64), part["code"].to_numpy(np.int64), part["lp_delta"].to_numpy(), len(names))
        scores = language_scores(pa.array(texts["text"].tolist(), pa.string()), known, table, prior, unseen)
        return pd.DataFrame({"_vl_row": texts["_vl_row"], "_vl_best": np.array(names, object)[scores.argmax(axis=1)]})

    asked = grouped.select("_vl_group", "text").mapInArrow(wanted, "_vl_group long, tri long")
    found = asked.join(profile, "tri").select("_vl_group", "tri", "code", "lp_delta")
    return grouped.groupBy("_vl_group").cogroup(found.groupBy("_vl_group")).applyInPandas(score, "_vl_row long, _vl_best string")
