"""Cleaning: normalised text, language and the model-input text.

``translate`` is a plug-in: a batch function (texts, langs) -> texts that
the caller provides (for example a translation model loaded once per Python
worker). Without one, ``text_model`` equals the cleaned text. Translations are
kept in a table by the digest of (text, language): every distinct text is sent
once, and with ``table_path`` later batches send only what is new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.functions.text import normalize_text
from vetline.operators.language import TrigramLanguageModel
from vetline.operators.partitioning import by_length
from vetline.session import materialize, ship_package, stored_rows
from vetline.sources.files import exists

Translator = Callable[[pd.Series, pd.Series], pd.Series]
TABLE = "digest string, translated string"


def text_key(text: Column, lang: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", lang, text), 256)


def translation_table(spark: SparkSession, path: str) -> DataFrame:
    """What an earlier run has translated; empty where nothing is."""
    return spark.read.schema(TABLE).parquet(path) if exists(spark, path) else spark.createDataFrame([], TABLE)


def new_translations(asked: DataFrame, known: DataFrame, translate: Translator,
                     texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``asked`` (digest, text, lang) to (digest, translated) of every distinct
    digest that ``known`` lacks.

    Copies are combined before the shuffle. Each task sends its texts in windows
    ordered by length, so that a batch holds texts of about one length; a NULL
    translation keeps the text. With ``texts``, ``asked`` has other columns beside
    its digest, to which ``texts`` adds digest, text and lang of their texts."""
    if texts is None:
        one = asked.groupBy("digest").agg(F.first("text").alias("text"), F.first("lang").alias("lang"))
    else:
        row = F.struct(*[c for c in asked.columns if c != "digest"])
        one = asked.groupBy("digest").agg(F.first(row).alias("_r")).select("digest", "_r.*")
    fresh = one.join(known.select("digest"), "digest", "left_anti")
    if texts is not None:
        fresh = texts(fresh)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in by_length(batches, "digest", ["text"]):
            got = pd.Series(list(translate(b["text"], b["lang"])), index=b.index, dtype="object")
            yield pd.DataFrame({"digest": b["digest"], "translated": got.where(got.notna(), b["text"])})

    return fresh.mapInPandas(send, TABLE)


def translated(df: DataFrame, translate: Translator, table_path: str | None = None, text_col: str = "text",
               lang_col: str = "lang", out: str = "text_model", texts: Callable[[DataFrame], DataFrame] | None = None,
               key: str | None = None) -> DataFrame:
    """Adds ``out``: the translation where the language is known and not English
    and the text is not blank, else the text. The new translations are stored
    before they are used, appended to ``table_path`` if given: a run that breaks
    off later has them already.

    With ``texts``, ``df`` lacks its texts and ``texts`` adds them to its rows, or
    to some: no text of it is stored or exchanged, and the result lacks them too.
    ``key`` names a column for the digest under which a translation is kept (NULL
    where there is none)."""
    spark = df.sparkSession
    ship_package(spark)
    needs = ~F.coalesce(F.col(lang_col), F.lit("unknown")).isin("en", "unknown") & (F.trim(text_col) != "")
    digest = F.when(needs, text_key(F.col(text_col), F.col(lang_col)))
    known = translation_table(spark, table_path) if table_path else spark.createDataFrame([], TABLE)
    if texts is None:
        full = keyed = df.withColumn("_vc_digest", digest)
        asked = keyed.where(F.col("_vc_digest").isNotNull()).select(
            F.col("_vc_digest").alias("digest"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        fresh = new_translations(asked, known, translate)
    else:
        full = texts(df).withColumn("_vc_digest", digest)
        keyed = stored_rows(full.where(F.col("_vc_digest").isNotNull()).select(*df.columns, "_vc_digest"))

        def fetch(rows: DataFrame) -> DataFrame:
            # a row that brings several texts sends the one that it stands for
            return texts(rows).where(F.col("digest") == digest).select(
                "digest", F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

        fresh = new_translations(keyed.withColumnRenamed("_vc_digest", "digest"), known, translate, fetch)
    if table_path:
        fresh.write.mode("append").parquet(table_path)
        table = translation_table(spark, table_path)
    else:
        table = materialize(fresh)
    # rows without a translation stay where they are
    table = table.groupBy(F.col("digest").alias("_vc_digest")).agg(F.first("translated").alias("_vc_text"))
    plain = full.where(F.col("_vc_digest").isNull()).withColumn(out, F.col(text_col)).select(*keyed.columns, out)
    told = keyed.where(F.col("_vc_digest").isNotNull()).join(table, "_vc_digest").withColumn(out, F.col("_vc_text")).drop("_vc_text")
    done = plain.unionByName(told)
    return done.drop("_vc_digest") if key is None else done.withColumnRenamed("_vc_digest", key)


def clean_reviews(df: DataFrame, lang_model: TrigramLanguageModel | None = None, translate: Translator | None = None,
                  table_path: str | None = None) -> DataFrame:
    """text <- normalize_text(text); lang from ``lang_model`` ("unknown" for
    blank text or without a model); text_model = translation or text. With a
    translator the cleaned rows are stored once, as they are read three times."""
    out = df.withColumn("text", normalize_text("text"))
    if lang_model is not None:
        out = lang_model.predict(out, text_col="text", out="lang")
    else:
        out = out.withColumn("lang", F.lit("unknown"))
    if translate is None:
        return out.withColumn("text_model", F.col("text"))
    return translated(materialize(out), translate, table_path)
