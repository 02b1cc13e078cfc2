"""End-to-end batch screening: features -> probabilities -> relevancy ->
image relevance -> decision -> prediction records, as one Spark job graph.

Stage boundaries: row-level features run in the scan stage (the Arrow UDFs
included) and are stored once with a row number made there, because ids of
reviews may repeat. Reviews that come without their texts meet their places
first, so that no join moves a text. Probabilities and relevancy are functions of the stored
row. Everything behind them works on narrow frames: bursts on (row, user,
time), duplicates on (row, user, text digest, place), and their small results
meet the features without texts on the row number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.config import LABEL_KEYS, LABELS, RELEVANCY_VOCAB, ScreenConfig
from vetline.operators import features as FE
from vetline.operators import windows as W
from vetline.operators.lookup import enrich_place, place_description, prediction_records
from vetline.operators.policy import decision_layer
from vetline.operators.relevancy import relevancy
from vetline.schema import ensure_columns, require_columns
from vetline.session import ship_package, stored_rows

ROW = "_row"
LONG_TEXTS = ("text", "text_norm", "description", "place_desc", "user_name", "pics", "pics_list")


def rule_probabilities(df: DataFrame, labels_col: str = "weak_labels") -> DataFrame:
    """Probabilities from the weak labels: 1.0 when the rule fires, else 0.0
    (the model-free variant of screening)."""
    return df.withColumns({
        f"p_{k}": F.array_contains(F.col(labels_col), lab).cast("double")
        for k, lab in zip(LABEL_KEYS, LABELS)
    })


def row_features(reviews: DataFrame, places: DataFrame | None = None, cfg: ScreenConfig = ScreenConfig(),
                 lexicon: DataFrame | None = None, texts: tuple[str, ...] = LONG_TEXTS,
                 add_texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Stored table of all row-level features with a unique ``_row``; of the
    long texts those in ``texts``. ``lexicon`` (``word``) replaces the built-in
    profanity list. With ``add_texts``, ``reviews`` lacks ``text`` and
    ``add_texts`` adds it to its rows, after the places have joined."""
    if add_texts is None:
        require_columns(reviews)
    ship_package(reviews.sparkSession)
    absent = [c for c in ("user_name", "user_id") if c not in reviews.columns]
    unread = [c for c in LONG_TEXTS if c not in texts]
    df = reviews
    if places is not None:
        df = enrich_place(df, places.drop("description") if "place_desc" in unread and "description" in unread else places)
    if add_texts is not None:
        df = require_columns(add_texts(df))
    df = ensure_columns(df, keep_absent=tuple(absent))
    if "description" not in df.columns:
        df = df.withColumn("description", F.lit(""))
    df = FE.add_row_features(df, date_formats=cfg.date_formats)
    df = FE.add_weak_labels(df).withColumns({"place_desc": place_description(), ROW: F.monotonically_increasing_id()})
    if "user_id" not in absent:  # duplicates are those of a user
        df = df.withColumn("text_digest", W.text_digest())
    if lexicon is None:
        return stored_rows(df.drop(*unread))
    counts = FE.profanity_counts(lexicon)
    if counts is not None:
        return stored_rows(df.withColumn("profanity_count", counts).drop(*unread))
    df = stored_rows(df.drop(*[c for c in unread if c != "text"]))
    hits = FE.profanity_count_join(df, ROW, lexicon)
    return stored_rows(df.drop("profanity_count", *unread).join(hits, ROW, "left").withColumn(
        "profanity_count", F.coalesce("profanity_count", F.lit(0))))


def with_user_windows(narrow: DataFrame, stored: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """``narrow`` (rows of ``stored`` without its texts) with burst and
    duplicate features."""
    user = [c for c in ("user_id",) if c in stored.columns]
    if not user:
        return narrow.withColumns({"user_burst_24h": F.lit(0), "dup_across_places": F.lit(False)})
    burst = W.user_burst_24h(stored.select(ROW, *user, "dt"), bucket_minutes=cfg.burst_bucket_minutes)
    dup = W.dup_across_places(stored.select(ROW, *user, "text_digest", "place_id"), digest_col="text_digest")
    return narrow.join(burst.select(ROW, "user_burst_24h"), ROW).join(dup.select(ROW, "dup_across_places"), ROW)


def screen_features(reviews: DataFrame, places: DataFrame | None = None, cfg: ScreenConfig = ScreenConfig(),
                    lexicon: DataFrame | None = None, add_texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Reviews with every feature the decision layer reads but relevancies;
    long texts are left out (``add_texts`` as in :func:`row_features`)."""
    stored = row_features(reviews, places, cfg, lexicon, texts=(), add_texts=add_texts)
    return with_user_windows(stored.drop(*LONG_TEXTS), stored, cfg)


def screen_reviews(reviews: DataFrame, places: DataFrame | None = None, cfg: ScreenConfig = ScreenConfig(),
                   probabilities: Callable[[DataFrame], DataFrame] | None = None, image_scores: DataFrame | None = None,
                   image_key: str = "review_id", scorer=None, lexicon: DataFrame | None = None,
                   relevancy_vocab: int = RELEVANCY_VOCAB, records: bool = True,
                   add_texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Screen a review table; one output row per review row.

    ``probabilities`` maps a feature DataFrame to one with ``p_ad, p_irr,
    p_rant, p_spam`` (e.g. :meth:`MultiLabelModel.transform`); default is
    :func:`rule_probabilities`. ``scorer`` replaces TF-IDF relevancy (see
    :func:`vetline.operators.relevancy.relevancy`). ``image_scores`` is an
    optional (``image_key``, image_relevancy) table, the mean taken where a key
    repeats. ``lexicon`` is a table of profane words. ``add_texts`` as in
    :func:`row_features`."""
    # a model may read any text, the rules and relevancy only these
    texts = LONG_TEXTS if probabilities else ("text", "place_desc")
    stored = row_features(reviews, places, cfg, lexicon, texts, add_texts)
    df = (probabilities or rule_probabilities)(stored)
    df = relevancy(df, "text", "place_desc", scorer, relevancy_vocab)
    df = with_user_windows(df.drop(*LONG_TEXTS), stored, cfg)
    if image_scores is not None:
        scores = image_scores.groupBy(F.col(image_key).alias("_image_key")).agg(F.avg("image_relevancy").alias("image_relevancy"))
        df = df.join(scores, F.col(image_key) == F.col("_image_key"), "left").drop("_image_key")
    else:
        df = df.withColumn("image_relevancy", F.lit(None).cast("double"))
    df = decision_layer(df, cfg)
    return prediction_records(df) if records else df


__all__ = ["screen_reviews", "screen_features", "row_features", "rule_probabilities"]
