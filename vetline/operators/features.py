"""Row-level review features (no shuffle): one wide projection.

``add_row_features`` is narrow: every column is a function of its own row,
so Spark fuses it into the scan's stage. The window features (burst, cross-
place duplicates) live in :mod:`vetline.operators.windows`.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.config import DEFAULT_PROFANITY
from vetline.functions import text as X
from vetline.functions.pics import parse_pics
from vetline.functions.rules import labels_of_rules, weak_labels
from vetline.functions.timegeo import epoch_ms_dt, haversine_km, parse_dt
from vetline.functions.users import gibberish_name


def text_feature_columns(text_col: str = "text", lexicon: tuple[str, ...] = DEFAULT_PROFANITY) -> dict[str, Column]:
    t = X.safe_text(text_col)
    return {
        "text_norm": X.text_norm(t),
        "char_len": X.char_len(t),
        "word_len": X.word_len(t),
        "url_count": X.url_count(t),
        "has_url": X.has_url(t),
        "caps_ratio": X.caps_ratio(t),
        "emoji_count": X.emoji_count(t),
        "repeat_ratio": X.repeat_ratio(t),
        "promo_terms": X.promo_terms(t),
        "never_been_cues": X.never_been_cues(t),
        "nonword_ratio": X.nonword_ratio(t),
        "char_entropy": X.char_entropy(t),
        "profanity_count": X.profanity_count(t, lexicon),
        "experiential_score": X.experiential_score(t),
    }


def add_text_features(df: DataFrame, text_col: str = "text",
                      lexicon: tuple[str, ...] = DEFAULT_PROFANITY) -> DataFrame:
    return df.withColumns(text_feature_columns(text_col, lexicon))


def add_user_features(df: DataFrame) -> DataFrame:
    """Gibberish score of ``user_name``; when the column is absent the score
    is 0.0 (NULL names score 1.0, as an empty name does)."""
    if "user_name" in df.columns:
        g = gibberish_name("user_name")
        return df.withColumns({"user_name_gibberish": g, "user_name_suspicious": g >= 0.6})
    return df.withColumns({"user_name_gibberish": F.lit(0.0), "user_name_suspicious": F.lit(False)})


def add_pic_features(df: DataFrame) -> DataFrame:
    pics = parse_pics("pics") if "pics" in df.columns else F.array().cast("array<string>")
    return df.withColumn("pics_list", pics).withColumn("image_count", F.size("pics_list"))


def add_time(df: DataFrame, formats: tuple[str, ...] = ()) -> DataFrame:
    """``dt`` from ``created_at``: numbers are epoch milliseconds, text is
    parsed (with ``formats`` as a last resort); absent column -> NULL."""
    if "created_at" not in df.columns:
        return df.withColumn("dt", F.lit(None).cast("timestamp_ntz"))
    numeric = isinstance(df.schema["created_at"].dataType, T.NumericType)
    return df.withColumn("dt", epoch_ms_dt("created_at") if numeric else parse_dt("created_at", formats))


def add_distance(df: DataFrame) -> DataFrame:
    cols = ("user_lat", "user_lon", "place_lat", "place_lon")
    if all(c in df.columns for c in cols):
        return df.withColumn("distance_km", haversine_km(*cols))
    return df.withColumn("distance_km", F.lit(None).cast("double"))


def add_row_features(df: DataFrame, text_col: str = "text",
                     lexicon: tuple[str, ...] = DEFAULT_PROFANITY, date_formats: tuple[str, ...] = ()) -> DataFrame:
    """All per-row features of a review table (text, user name, pictures,
    parsed time, distance). Optional inputs that are missing get defaults."""
    df = add_text_features(df, text_col, lexicon)
    df = add_user_features(df)
    df = add_pic_features(df)
    df = add_time(df, date_formats)
    return add_distance(df)


def add_weak_labels(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``weak_labels``, from the rule columns where they are there already."""
    rules = ("has_url", "promo_terms", "never_been_cues", "repeat_ratio")
    if all(c in df.columns for c in rules):
        return df.withColumn("weak_labels", labels_of_rules(*[F.col(c) for c in rules]))
    return df.withColumn("weak_labels", weak_labels(text_col))


# Words of a lexicon that every worker may hold.
LEXICON_WORDS = 1_000_000
_TOKEN = re.compile("[A-Za-z']+")


def profanity_counts(lexicon: DataFrame, text_col: str = "text") -> Column | None:
    """``profanity_count`` of a row under a lexicon table (``word``): the words
    are gathered (their number is checked), so that no token leaves its row. None
    for a lexicon of more than :data:`LEXICON_WORDS` words, which
    :func:`profanity_count_join` takes. A word that the table has twice counts twice."""
    words = lexicon.where(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n")).limit(LEXICON_WORDS + 1).toArrow()
    if words.num_rows > LEXICON_WORDS:
        return None
    held = lexicon.sparkSession.sparkContext.broadcast(dict(zip(words["word"].to_pylist(), words["n"].to_pylist())))

    @F.arrow_udf(T.IntegerType())
    def counted(texts: pa.Array) -> pa.Array:
        times = held.value.get
        return pa.array([sum(times(w, 0) for w in _TOKEN.findall(t.as_py())) for t in texts], pa.int32())

    return counted(F.lower(X.safe_text(text_col)))


def profanity_count_join(df: DataFrame, key: str, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, profanity_count) under a lexicon table (``word``) of any size:
    explode tokens and join with the lexicon.
    Rows without a hit are absent. ``key`` must be unique."""
    toks = df.select(key, F.explode(F.regexp_extract_all(F.lower(X.safe_text(text_col)),
                                                         F.lit("[A-Za-z']+"), 0)).alias("word"))
    return toks.join(lexicon.select("word"), "word").groupBy(key).agg(F.count("*").cast("int").alias("profanity_count"))
