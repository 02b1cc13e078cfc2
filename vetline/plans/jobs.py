"""Batch jobs: prepare (clean + split), train, evaluate, screen-to-sink.

Each job reads with :mod:`vetline.sources`, composes operators, and writes
with :mod:`vetline.sources.sinks`; nothing is collected to the driver except
bounded model parameters and the one-row metric tables that are returned.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.config import RELEVANCY_VOCAB, ScreenConfig, SplitConfig
from vetline.operators import features as FE
from vetline.operators.clean import clean_reviews
from vetline.operators.evaluate import binary_metrics, label_means
from vetline.operators.language import TrigramLanguageModel
from vetline.operators.lookup import enrich_place, place_description
from vetline.operators.multilabel import MultiLabelModel, latest_model_dir
from vetline.operators.split import assign_split, place_split
from vetline.operators.tfidf import relevancy_scores
from vetline.plans.screen import screen_reviews
from vetline.sources import sinks
from vetline.sources.files import exists
from vetline.sources.readers import read_csv_folder
from vetline.session import ship_package, stored_rows


def train_language(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang") -> TrigramLanguageModel:
    """Learn the language profile of labelled documents and save it."""
    model = TrigramLanguageModel.fit(docs, text_col, lang_col)
    model.save(path)
    return model


def prepare(spark: SparkSession, in_dir: str, out_dir: str, lang_path: str | None = None,
            cfg: SplitConfig = SplitConfig(), fmt: str = "parquet") -> DataFrame:
    """Union the converted CSVs of ``in_dir``, clean them, add features,
    split by place and write one folder per split. ``lang_path`` is a saved
    language model (:func:`train_language`); without one ``lang`` is "unknown"."""
    ship_package(spark)
    df, _ = read_csv_folder(spark, in_dir)
    if df is None:
        raise FileNotFoundError(f"nothing to prepare in {in_dir}")
    lang_model = TrigramLanguageModel.load(spark, lang_path) if lang_path else None
    df = FE.add_row_features(clean_reviews(df, lang_model))
    df = stored_rows(df)
    out = assign_split(df, place_split(df, cfg=cfg))
    sinks.write_splits(out, out_dir, fmt)
    return out


def train(df: DataFrame, models_dir: str, run_name: str = "baseline", places: DataFrame | None = None,
          cfg: ScreenConfig = ScreenConfig()) -> MultiLabelModel:
    """Weak labels on the training text, fit, save under models_dir/run with
    the thresholds and the relevancy of a few training reviews as JSON."""
    ship_package(df.sparkSession)
    model = MultiLabelModel.fit(FE.add_weak_labels(df))
    path = f"{models_dir}/multilabel_{run_name}"
    model.save(path)
    thresholds = df.sparkSession.createDataFrame([asdict(cfg.thresholds)])
    sinks.write_table(thresholds, f"{path}/thresholds", "json")
    sinks.write_table(relevancy_sample(df, places), f"{path}/relevancy_sample", "json")
    return model


def train_or_load(spark: SparkSession, models_dir: str | None, fallback: DataFrame) -> MultiLabelModel:
    """Newest saved model of any file system, else one trained on ``fallback``."""
    newest = latest_model_dir(spark, models_dir) if models_dir and exists(spark, models_dir) else None
    return MultiLabelModel.load(newest) if newest else MultiLabelModel.fit(FE.add_weak_labels(fallback))


def evaluate(labelled: DataFrame, model: MultiLabelModel, lang_model: TrigramLanguageModel | None = None):
    """(metrics, label means) of ``model`` on a set with ``is_fake``."""
    if "is_fake" not in labelled.columns:
        raise ValueError("the set to evaluate on has no is_fake column")
    ship_package(labelled.sparkSession)
    scored = model.transform(FE.add_row_features(clean_reviews(labelled, lang_model)))
    scored = stored_rows(scored)
    return binary_metrics(scored), label_means(scored)


def screen_to_sink(reviews: DataFrame, places: DataFrame | None, out_path: str,
                   model: MultiLabelModel | None = None, cfg: ScreenConfig = ScreenConfig(), fmt: str = "json",
                   **options) -> DataFrame:
    """Screen and write prediction records (arrays/maps as JSON in CSV);
    ``options`` go to :func:`screen_reviews` (scorer, lexicon, image scores)."""
    preds = screen_reviews(reviews, places, cfg, probabilities=model.transform if model else None, **options)
    sinks.write_predictions(preds, out_path, fmt)
    return preds


def relevancy_sample(train_df: DataFrame, places: DataFrame | None, n: int = 10,
                     order: tuple[str, ...] = ("review_id", "text")) -> DataFrame:
    """Relevancy of the first ``n`` training reviews (in ``order``) to their
    place; places that are missing give an all-empty description."""
    # the last of the first n is found without the other columns, so that only
    # rows up to it (ties included) bring their texts to the joins behind
    head = train_df.orderBy(*order).limit(n)
    last = train_df.select(*order).orderBy(*order).limit(n).orderBy(*[F.col(c).desc() for c in order]).first()
    if last is not None:
        bound = F.struct(*[F.lit(v).cast(train_df.schema[c].dataType).alias(c) for c, v in zip(order, last)])
        head = train_df.where(F.struct(*order) <= bound).orderBy(*order).limit(n)
    if places is not None:
        head = enrich_place(head.drop(*[c for c in ("description",) if c in head.columns]), places)
    if "description" not in head.columns:
        head = head.withColumn("description", F.lit(""))
    pairs = head.select("review_id", "text", place_description().alias("place_desc"))
    return relevancy_scores(stored_rows(pairs), "review_id", "text", "place_desc", RELEVANCY_VOCAB)


__all__ = ["train_language", "prepare", "train", "train_or_load", "evaluate", "screen_to_sink", "relevancy_sample"]
