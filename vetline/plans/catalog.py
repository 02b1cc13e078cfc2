"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver's tables under ``sf_dir`` (or views Spark
derives from them) in full. Array outputs are rendered as ``|``-joined
strings and doubles are rounded to 6 places on both sides so the driver's
value hash compares like with like.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.config import (
    CLASSIFIER_VOCAB, DEFAULT_PROFANITY, LABEL_KEYS, LABELS, RATIONALE, RELEVANCY_VOCAB, SPAM, SplitConfig,
)
from vetline.schema import REQUIRED
from vetline.functions import formatting as FMT
from vetline.functions import rules as RU
from vetline.functions import patterns as P
from vetline.functions import text as X
from vetline.functions.pics import parse_pics
from vetline.functions.rules import weak_labels
from vetline.functions.timegeo import haversine_km, parse_dt
from vetline.functions.users import gibberish_name
from vetline.functions import terms as TM
from vetline.operators import clean as CL
from vetline.operators import evaluate as EV
from vetline.operators import features as FE
from vetline.operators import image as IM
from vetline.operators import language as LG
from vetline.operators import multilabel as ML
from vetline.operators import lookup as LK
from vetline.operators import policy as PO
from vetline.operators import relevancy as RL
from vetline.operators import split as S
from vetline.operators import tfidf as TF
from vetline.session import materialize, scratch_dir, stored_rows
from vetline.sources import converters as CV
from vetline.sources import readers as RD
from vetline.sources import sinks as SK
from vetline.operators import windows as W
from vetline.plans import oracle as O
from vetline.plans import jobs as JB
from vetline.plans import screen as SC
from vetline.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def big(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def sql(select: str, ctes: str = "") -> str:
    return V.with_views("duckdb", ctes, select)


# ---------------------------------------------------------------- row scalars

@register("weak_labels", lambda: sql(f"SELECT review_id, {O.weak_labels(O.txt())} AS labels FROM rv",
                                     f"rv AS ({O.with_chars()})"))
def q_weak_labels(spark: SparkSession, sf: str) -> DataFrame:
    return V.reviews(spark, sf).select("review_id", joined(weak_labels("text")).alias("labels"))


def _text_features_sql() -> str:
    t = O.txt()
    return sql(f"""SELECT review_id,
  CAST(length({t}) AS BIGINT) AS char_len,
  {O.regexp_count(t, P.non_ws_run())} AS word_len,
  {O.url_count(t)} AS url_count,
  {O.has_url(t)} AS has_url,
  {O.r6(O.caps_ratio(t))} AS caps_ratio,
  {O.regexp_count(t, P.emoji_pattern())} AS emoji_count,
  {O.repeat_ratio()} AS repeat_ratio,
  {O.promo(t)} AS promo_terms,
  {O.never_been(t)} AS never_been_cues,
  {O.r6(O.nonword_ratio(t))} AS nonword_ratio,
  {O.profanity(t, DEFAULT_PROFANITY)} AS profanity_count,
  {O.r6(O.experiential(t))} AS experiential_score
FROM rv""", f"rv AS ({O.with_chars()})")


@register("text_features", _text_features_sql)
def q_text_features(spark: SparkSession, sf: str) -> DataFrame:
    t = X.safe_text("text")
    return V.reviews(spark, sf).select(
        "review_id",
        big(X.char_len(t)).alias("char_len"),
        big(X.word_len(t)).alias("word_len"),
        big(X.url_count(t)).alias("url_count"),
        X.has_url(t).alias("has_url"),
        r6(X.caps_ratio(t)).alias("caps_ratio"),
        big(X.emoji_count(t)).alias("emoji_count"),
        X.repeat_ratio(t).alias("repeat_ratio"),
        X.promo_terms(t).alias("promo_terms"),
        X.never_been_cues(t).alias("never_been_cues"),
        r6(X.nonword_ratio(t)).alias("nonword_ratio"),
        big(X.profanity_count(t, DEFAULT_PROFANITY)).alias("profanity_count"),
        r6(X.experiential_score(t)).alias("experiential_score"),
    )


@register("url_features", lambda: sql(
    f"SELECT page_id, {O.url_count(O.txt('html'))} AS url_count, {O.has_url(O.txt('html'))} AS has_url FROM pages"))
def q_url_features(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.load(spark, sf, "pages")
    return pages.select("page_id", big(X.url_count("html")).alias("url_count"), X.has_url("html").alias("has_url"))


@register("strip_tags", lambda: sql(
    f"SELECT page_id, {O.collapse_ws(O.strip_tags(O.txt('html')))} AS stripped FROM pages"))
def q_strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.load(spark, sf, "pages")
    return pages.select("page_id", X.collapse_ws(X.strip_tags(X.safe_text("html"))).alias("stripped"))


@register("text_norm", lambda: sql(f"SELECT review_id, {O.text_norm(O.txt())} AS text_norm FROM reviews"))
def q_text_norm(spark: SparkSession, sf: str) -> DataFrame:
    return V.reviews(spark, sf).select("review_id", X.text_norm("text").alias("text_norm"))


def _entropy_sql() -> str:
    return sql(
        """SELECT r.review_id, round(coalesce(e.h, 0.0), 6) AS char_entropy
FROM reviews r LEFT JOIN (
  SELECT row_no, 0.0 - sum((n / tot) * log2(n / tot)) AS h
  FROM (SELECT row_no, ch, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY row_no)::DOUBLE AS tot
        FROM (SELECT row_no, unnest(string_split(text, '')) AS ch FROM reviews WHERE coalesce(text, '') <> '')
        GROUP BY row_no, ch)
  GROUP BY row_no) e ON e.row_no = r.row_no""")


@register("char_entropy", _entropy_sql)
def q_char_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return V.reviews(spark, sf).select("review_id", r6(X.char_entropy("text")).alias("char_entropy"))


@register("username_features", lambda: sql(
    f"SELECT review_id, {O.r6(O.gibberish('user_name'))} AS user_name_gibberish, "
    f"{O.gibberish('user_name')} >= 0.6::DOUBLE AS user_name_suspicious FROM reviews"))
def q_username_features(spark: SparkSession, sf: str) -> DataFrame:
    g = gibberish_name("user_name")
    return V.reviews(spark, sf).select(
        "review_id", r6(g).alias("user_name_gibberish"), (g >= 0.6).alias("user_name_suspicious"))


@register("parse_pics", lambda: sql(
    f"SELECT review_id, array_to_string({O.parse_pics('pics')}, '|') AS pics_list, "
    f"CAST(len({O.parse_pics('pics')}) AS BIGINT) AS image_count FROM reviews"))
def q_parse_pics(spark: SparkSession, sf: str) -> DataFrame:
    p = parse_pics("pics")
    return V.reviews(spark, sf).select("review_id", joined(p).alias("pics_list"), big(F.size(p)).alias("image_count"))


@register("parse_dt", lambda: sql(f"SELECT review_id, created_at, {O.parse_dt('created_at')} AS dt FROM reviews"))
def q_parse_dt(spark: SparkSession, sf: str) -> DataFrame:
    return V.reviews(spark, sf).select("review_id", "created_at", parse_dt("created_at").alias("dt"))


@register("haversine", lambda: sql(
    "SELECT r.review_id, "
    + O.r6(O.haversine("r.user_lat", "r.user_lon", "p.place_lat", "p.place_lon"))
    + " AS distance_km FROM reviews r LEFT JOIN places p ON p.place_id = r.place_id"))
def q_haversine(spark: SparkSession, sf: str) -> DataFrame:
    r = V.reviews(spark, sf)
    p = V.places(spark, sf).select("place_id", "place_lat", "place_lon")
    return r.join(p, "place_id", "left").select(
        "review_id", r6(haversine_km("user_lat", "user_lon", "place_lat", "place_lon")).alias("distance_km"))


# ------------------------------------------------------------------ windows

_BURST_CASE = (
    "CAST(CASE WHEN count({t}) OVER (PARTITION BY {u}) = 0 THEN 0 WHEN {t} IS NULL THEN 1 "
    "ELSE count({t}) OVER (PARTITION BY {u} ORDER BY {t} RANGE BETWEEN INTERVAL 24 HOURS PRECEDING "
    "AND CURRENT ROW) END AS BIGINT)"
)


@register("user_burst_24h", lambda: sql(
    f"SELECT event_id, {_BURST_CASE.format(t='ts', u='user_id')} AS user_burst_24h FROM events"))
def q_user_burst_24h(spark: SparkSession, sf: str) -> DataFrame:
    ev = V.load(spark, sf, "events").select("event_id", "user_id", "ts")
    return W.user_burst_24h(ev, "user_id", "ts").select("event_id", big("user_burst_24h").alias("user_burst_24h"))


@register("review_burst_24h", lambda: sql(
    f"SELECT review_id, {_BURST_CASE.format(t='dt', u='user_id')} AS user_burst_24h FROM rd",
    f"rd AS (SELECT review_id, user_id, {O.parse_dt('created_at')} AS dt FROM reviews)"))
def q_review_burst_24h(spark: SparkSession, sf: str) -> DataFrame:
    r = V.reviews(spark, sf).select("review_id", "user_id", parse_dt("created_at").alias("dt"))
    return W.user_burst_24h(r).select("review_id", big("user_burst_24h").alias("user_burst_24h"))


def _norm_reviews_spark(spark: SparkSession, sf: str) -> DataFrame:
    r = V.reviews(spark, sf)
    return r.withColumn("text_norm", X.text_norm("text"))


_NORM_CTE = f"rn AS (SELECT *, {{tn}} AS text_norm FROM reviews)"


def _norm_cte() -> str:
    return _NORM_CTE.format(tn=O.text_norm(O.txt()))


@register("dup_across_places", lambda: sql(
    "SELECT r.review_id, coalesce(g.n > 1, false) AS dup_across_places FROM rn r LEFT JOIN "
    "(SELECT user_id, text_norm, count(DISTINCT place_id) AS n FROM rn WHERE user_id IS NOT NULL "
    "GROUP BY user_id, text_norm) g ON g.user_id = r.user_id AND g.text_norm = r.text_norm", _norm_cte()))
def q_dup_across_places(spark: SparkSession, sf: str) -> DataFrame:
    return W.review_dup_flags(V.reviews(spark, sf), X.text_norm("text"), ["review_id"])


@register("dup_groups", lambda: sql(
    "SELECT user_id, sha256(text_norm) AS text_digest, count(DISTINCT place_id) AS n_places, count(*) AS n_rows FROM rn "
    "WHERE user_id IS NOT NULL GROUP BY user_id, text_norm", _norm_cte()))
def q_dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = W.dup_place_groups(_norm_reviews_spark(spark, sf))
    return g.select("user_id", "text_digest", big("n_places").alias("n_places"), big("n_rows").alias("n_rows"))


_SPLIT_CTES = (
    "pl AS (SELECT DISTINCT place_id FROM reviews WHERE place_id IS NOT NULL), "
    "rk AS (SELECT place_id, row_number() OVER (ORDER BY md5(concat('42:', place_id)), place_id) AS rank, "
    "count(*) OVER () AS n FROM pl), "
    "sp AS (SELECT place_id, CAST(rank AS BIGINT) AS rank, CASE "
    "WHEN rank <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'test' "
    "WHEN rank <= greatest(1, floor(n * 0.1::DOUBLE)) + greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' "
    "ELSE 'train' END AS split FROM rk)"
)


@register("place_split", lambda: sql("SELECT place_id, rank, split FROM sp", _SPLIT_CTES))
def q_place_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.place_split(V.reviews(spark, sf))


@register("split_reviews", lambda: sql(
    "SELECT r.review_id, sp.split FROM reviews r JOIN sp ON sp.place_id = r.place_id", _SPLIT_CTES))
def q_split_reviews(spark: SparkSession, sf: str) -> DataFrame:
    r = V.reviews(spark, sf)
    return S.assign_split(r, S.place_split(r)).select("review_id", "split")


# ----------------------------------------------------------- terms, TF-IDF

@register("ngrams", lambda: sql(
    f"SELECT review_id, CAST(len(toks) AS BIGINT) AS n_unigrams, CAST(greatest(len(toks) - 1, 0) AS BIGINT) AS n_bigrams, "
    f"md5(array_to_string({O.terms_list('toks')}, chr(31))) AS terms_md5 FROM rt",
    f"rt AS (SELECT review_id, {O.tokens('text')} AS toks FROM reviews)"))
def q_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    r = TM.with_digest(V.reviews(spark, sf), "text")
    return r.select("review_id", F.col("n_tokens").alias("n_unigrams"),
                    F.greatest(F.col("n_tokens") - 1, F.lit(0)).cast("long").alias("n_bigrams"), "terms_md5")


_REVIEW_TERMS = (f"rt AS (SELECT row_no, {{toks}} AS toks FROM reviews), "
                 f"a AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest({{terms}}) AS term FROM rt) "
                 f"GROUP BY row_no, term)")


def _review_terms_cte() -> str:
    return _REVIEW_TERMS.format(toks=O.tokens("text"), terms=O.terms_list("toks"))


@register("idf", lambda: sql(
    "SELECT term, CAST(count(*) AS BIGINT) AS df, "
    "round(ln((1.0 + (SELECT count(*) FROM reviews)) / (1.0 + count(*))) + 1.0, 6) AS idf FROM a GROUP BY term",
    _review_terms_cte()))
def q_idf(spark: SparkSession, sf: str) -> DataFrame:
    t = TF.idf_table(V.reviews(spark, sf), ["text"])
    return t.select("term", big("df").alias("df"), r6("idf").alias("idf"))


@register("top_terms", lambda: sql(
    "SELECT term, CAST(sum(tf) AS BIGINT) AS ttf FROM a GROUP BY term ORDER BY ttf DESC, term ASC LIMIT 20000",
    _review_terms_cte()))
def q_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    top = TF.top_terms(TF.term_stats(V.reviews(spark, sf), ["text"]), CLASSIFIER_VOCAB)
    return top.select("term", big("ttf").alias("ttf"))


def _texts(spark: SparkSession, sf: str):
    return lambda keys: V.with_texts(spark, sf, keys)


def _screen_features_spark(spark: SparkSession, sf: str, lexicon: DataFrame | None = None) -> DataFrame:
    """The reviews meet their places before their texts."""
    return SC.screen_features(V.review_keys(spark, sf), V.places(spark, sf), lexicon=lexicon, add_texts=_texts(spark, sf))


def _eval_pairs_spark(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs meet before the texts of the reviews join them, and are stored
    without those: either pass over the pairs fetches them."""
    pairs = LK.eval_pairs(V.review_keys(spark, sf), V.places(spark, sf)).select("review_id", "row_no", *V.TEXT_KEYS, "place_desc")
    return V.with_texts(spark, sf, stored_rows(pairs))


_EVAL_PAIRS = ("pairs AS (SELECT r.row_no, r.review_id, coalesce(r.text, '') AS t, {desc} AS d FROM reviews r "
               "JOIN places p ON p.place_id = r.place_id)")


def _eval_pairs_cte() -> str:
    return _EVAL_PAIRS.format(desc=O.place_desc("p.place_name", "p.place_category", "p.city", "p.description"))


@register("eval_pairs", lambda: sql("SELECT review_id, d AS place_desc FROM pairs", _eval_pairs_cte()))
def q_eval_pairs(spark: SparkSession, sf: str) -> DataFrame:
    # nothing reads the texts of the reviews, so their rows are there before the descriptions
    return LK.eval_pairs(V.reviews(spark, sf), V.places(spark, sf)).select("review_id", "place_desc")


@register("place_description", lambda: sql(
    f"SELECT place_id, {O.place_desc('place_name', 'place_category', 'city', 'description')} AS place_desc FROM places"))
def q_place_description(spark: SparkSession, sf: str) -> DataFrame:
    return V.places(spark, sf).select("place_id", LK.place_description().alias("place_desc"))


@register("enrich_place", lambda: sql(
    "SELECT r.review_id, coalesce(p.place_name, r.place_name, '') AS place_name, "
    "coalesce(p.place_category, r.place_category, '') AS place_category, coalesce(p.city, r.city, '') AS city, "
    "coalesce(p.description, '') AS description, p.place_lat, p.place_lon "
    "FROM reviews r LEFT JOIN places p ON p.place_id = r.place_id"))
def q_enrich_place(spark: SparkSession, sf: str) -> DataFrame:
    e = LK.enrich_place(V.reviews(spark, sf), V.places(spark, sf))
    return e.select("review_id", "place_name", "place_category", "city", "description", "place_lat", "place_lon")


@register("relevancy_tfidf", lambda: sql(
    "SELECT review_id, round(relevancy, 6) AS relevancy FROM rel",
    _eval_pairs_cte() + "," + O.relevancy_ctes("pairs")))
def q_relevancy_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _eval_pairs_spark(spark, sf).select("review_id", "text", "place_desc")
    scored = TF.tfidf_relevancy(pairs, "text", "place_desc", RELEVANCY_VOCAB)
    return scored.select("review_id", r6("relevancy").alias("relevancy"))


@register("mean_relevancy", lambda: sql(
    "SELECT round(avg(relevancy), 6) AS mean_relevancy, count(*) AS n_pairs FROM rel",
    _eval_pairs_cte() + "," + O.relevancy_ctes("pairs")))
def q_mean_relevancy(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _eval_pairs_spark(spark, sf).select("review_id", "text", "place_desc")
    scored = TF.tfidf_relevancy(pairs, "text", "place_desc", RELEVANCY_VOCAB)
    return scored.agg(r6(F.avg("relevancy")).alias("mean_relevancy"), F.count(F.lit(1)).alias("n_pairs"))


@register("score_calibrate", lambda: sql(
    "SELECT event_id, round(CASE WHEN (SELECT min(s) FROM sc) < 0.0 OR (SELECT max(s) FROM sc) > 1.0 "
    "THEN 1.0 / (1.0 + exp(-s)) ELSE s END, 6) AS score FROM sc",
    "sc AS (SELECT event_id, (value - 25.0) / 10.0 AS s FROM events)"))
def q_score_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    ev = V.load(spark, sf, "events").select("event_id", ((F.col("value") - 25.0) / 10.0).alias("score"))
    return RL.calibrate(ev, "score").select("event_id", r6("score").alias("score"))


# ---------------------------------------------------------- images, decision

def _image_scores_spark(spark: SparkSession, sf: str) -> DataFrame:
    """(row_no, review_id, image_relevancy) of every review row."""
    r = V.reviews(spark, sf).select("row_no", "review_id", F.expr("if(place_id IS NULL, NULL, pk)").alias("place_no"),
                                    F.size(parse_pics("pics")).alias("image_count"))
    emb = V.load(spark, sf, "embeddings")
    n = emb.select(F.count(F.lit(1))).scalar()
    scores = IM.image_text_relevance(IM.synthetic_image_rows(r, n, place_col="place_no"), emb, "row_no")
    return r.select("row_no", "review_id").join(scores, "row_no", "left")


_IMAGE_CTES = (
    "ic AS (SELECT row_no, CASE WHEN place_id IS NOT NULL THEN pk END AS place_no, len({pics}) AS image_count FROM reviews), "
    "ik AS (SELECT row_no, place_no, unnest(range(0, least(image_count, 5))) AS k FROM ic), "
    "nv AS (SELECT count(*) AS n FROM embeddings), "
    "iv AS (SELECT ik.row_no, ie.embedding::DOUBLE[] AS a, te.embedding::DOUBLE[] AS b FROM ik "
    "JOIN embeddings ie ON ie.vec_id = ((ik.row_no * 5 + ik.k) % (SELECT n FROM nv) + (SELECT n FROM nv)) % (SELECT n FROM nv) "
    "JOIN embeddings te ON te.vec_id = ik.place_no % (SELECT n FROM nv)), "
    "img AS (SELECT row_no, avg((list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * "
    "sqrt(list_inner_product(b, b))) + 1.0) / 2.0) AS image_relevancy FROM iv GROUP BY row_no)"
)


def _image_ctes() -> str:
    return _IMAGE_CTES.format(pics=O.parse_pics("pics"))


@register("image_text_relevance", lambda: sql(
    "SELECT r.review_id, round(img.image_relevancy, 6) AS image_relevancy FROM reviews r "
    "LEFT JOIN img ON img.row_no = r.row_no", _image_ctes()))
def q_image_text_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return _image_scores_spark(spark, sf).select("review_id", r6("image_relevancy").alias("image_relevancy"))


def _features_ctes(with_rel: bool, with_img: bool) -> str:
    """DuckDB feature table ``fx`` with every decision input."""
    t = O.txt()
    desc = O.place_desc("coalesce(p.place_name, r.place_name)", "coalesce(p.place_category, r.place_category)",
                        "coalesce(p.city, r.city)", "p.description")
    parts = [
        f"rn AS (SELECT r.*, p.place_lat, p.place_lon, {desc} AS place_desc, "
        f"string_split({t}, '') AS chars FROM reviews r LEFT JOIN places p ON p.place_id = r.place_id)",
        "ent AS (SELECT row_no, 0.0 - sum((n / tot) * log2(n / tot)) AS h FROM (SELECT row_no, ch, count(*)::DOUBLE AS n, "
        "sum(count(*)) OVER (PARTITION BY row_no)::DOUBLE AS tot FROM (SELECT row_no, unnest(chars) AS ch FROM rn) "
        "GROUP BY row_no, ch) GROUP BY row_no)",
        f"f0 AS (SELECT rn.row_no, rn.review_id, rn.user_id, rn.place_id, coalesce(rn.text, '') AS t, rn.place_desc AS d, "
        f"{O.text_norm(t)} AS text_norm, {O.parse_dt('rn.created_at')} AS dt, "
        f"CASE WHEN {O.has_url(t)} AND {O.promo(t)} THEN 1.0 ELSE 0.0 END AS p_ad, 0.0::DOUBLE AS p_irr, "
        f"CASE WHEN {O.never_been(t)} THEN 1.0 ELSE 0.0 END AS p_rant, "
        f"CASE WHEN {O.repeat_flag('rn.chars')} THEN 1.0 ELSE 0.0 END AS p_spam, "
        f"{O.never_been(t)} AS never_been_cues, {O.experiential(t)} AS experiential_score, "
        f"{O.profanity(t, DEFAULT_PROFANITY)} AS profanity_count, {O.gibberish('rn.user_name')} AS user_name_gibberish, "
        f"coalesce(ent.h, 0.0) AS char_entropy, "
        f"{O.haversine('rn.user_lat', 'rn.user_lon', 'rn.place_lat', 'rn.place_lon')} AS distance_km "
        f"FROM rn LEFT JOIN ent ON ent.row_no = rn.row_no)",
        f"f1 AS (SELECT f0.*, {_BURST_CASE.format(t='dt', u='user_id')} AS user_burst_24h FROM f0)",
        "dg AS (SELECT user_id, text_norm, count(DISTINCT place_id) AS n FROM f0 WHERE user_id IS NOT NULL "
        "GROUP BY user_id, text_norm)",
        "pairs AS (SELECT row_no, review_id, t, d FROM f0)",
    ]
    body = ", ".join(parts)
    if with_rel:
        body += "," + O.relevancy_ctes("pairs")
    if with_img:
        body += ", " + _image_ctes()
    rel = "rel.relevancy" if with_rel else "1.0::DOUBLE"
    img = "img.image_relevancy" if with_img else "NULL::DOUBLE"
    body += (f", fx AS (SELECT f1.*, coalesce(dg.n > 1, false) AS dup_across_places, {rel} AS relevancy, "
             f"{img} AS image_relevancy FROM f1 LEFT JOIN dg ON dg.user_id = f1.user_id AND dg.text_norm = f1.text_norm"
             + (" LEFT JOIN rel ON rel.row_no = f1.row_no" if with_rel else "")
             + (" LEFT JOIN img ON img.row_no = f1.row_no" if with_img else "") + ")")
    return body


_DECISION_COLS = ("review_id", "labels", "user_burst_24h", "dup_across_places", "profanity_count",
                  "user_name_gibberish", "char_entropy", "distance_km", "relevancy", "image_relevancy")


def _decision_select() -> str:
    return (f"SELECT review_id, {O.decision_labels()} AS labels, CAST(user_burst_24h AS BIGINT) AS user_burst_24h, "
            "dup_across_places, CAST(profanity_count AS BIGINT) AS profanity_count, "
            "round(user_name_gibberish, 6) AS user_name_gibberish, round(char_entropy, 6) AS char_entropy, "
            "round(distance_km, 6) AS distance_km, round(relevancy, 6) AS relevancy, "
            "round(image_relevancy, 6) AS image_relevancy FROM fx")


def _decision_out(df: DataFrame) -> DataFrame:
    return df.select(
        "review_id", joined(F.col("labels")).alias("labels"), big("user_burst_24h").alias("user_burst_24h"),
        "dup_across_places", big("profanity_count").alias("profanity_count"),
        r6("user_name_gibberish").alias("user_name_gibberish"), r6("char_entropy").alias("char_entropy"),
        r6("distance_km").alias("distance_km"), r6("relevancy").alias("relevancy"),
        r6("image_relevancy").alias("image_relevancy"))


@register("decision_layer", lambda: sql(_decision_select(), _features_ctes(False, False)))
def q_decision_layer(spark: SparkSession, sf: str) -> DataFrame:
    feats = _screen_features_spark(spark, sf)
    df = SC.rule_probabilities(feats).withColumn("relevancy", F.lit(1.0)).withColumn(
        "image_relevancy", F.lit(None).cast("double"))
    return _decision_out(PO.decision_layer(df))


@register("screen_reviews", lambda: sql(_decision_select(), _features_ctes(True, True)))
def q_screen_reviews(spark: SparkSession, sf: str) -> DataFrame:
    preds = SC.screen_reviews(V.review_keys(spark, sf), V.places(spark, sf), image_scores=_image_scores_spark(spark, sf),
                              image_key="row_no", records=False, add_texts=_texts(spark, sf))
    return _decision_out(preds)


def _minimal_ctes() -> str:
    """The decision inputs of reviews with the six required columns only."""
    t = O.txt()
    return (f"rn AS (SELECT row_no, review_id, {t} AS t, string_split({t}, '') AS chars FROM reviews), "
            "ent AS (SELECT row_no, 0.0 - sum((n / tot) * log2(n / tot)) AS h FROM (SELECT row_no, ch, count(*)::DOUBLE AS n, "
            "sum(count(*)) OVER (PARTITION BY row_no)::DOUBLE AS tot FROM (SELECT row_no, unnest(chars) AS ch FROM rn) "
            "GROUP BY row_no, ch) GROUP BY row_no), "
            f"fx AS (SELECT rn.review_id, CASE WHEN {O.has_url('t')} AND {O.promo('t')} THEN 1.0 ELSE 0.0 END AS p_ad, "
            f"0.0::DOUBLE AS p_irr, CASE WHEN {O.never_been('t')} THEN 1.0 ELSE 0.0 END AS p_rant, "
            f"CASE WHEN {O.repeat_flag('chars')} THEN 1.0 ELSE 0.0 END AS p_spam, {O.never_been('t')} AS never_been_cues, "
            f"{O.experiential('t')} AS experiential_score, {O.profanity('t', DEFAULT_PROFANITY)} AS profanity_count, "
            "0.0::DOUBLE AS user_name_gibberish, coalesce(ent.h, 0.0) AS char_entropy, NULL::DOUBLE AS distance_km, "
            "0 AS user_burst_24h, false AS dup_across_places, 1.0::DOUBLE AS relevancy, NULL::DOUBLE AS image_relevancy "
            "FROM rn LEFT JOIN ent ON ent.row_no = rn.row_no)")


@register("screen_minimal", lambda: sql(_decision_select(), _minimal_ctes()))
def q_screen_minimal(spark: SparkSession, sf: str) -> DataFrame:
    """Optional columns (user, time, pictures, coordinates) are absent."""
    feats = SC.screen_features(V.reviews(spark, sf).select(*REQUIRED))
    df = SC.rule_probabilities(feats).withColumns({"relevancy": F.lit(1.0), "image_relevancy": F.lit(None).cast("double")})
    return _decision_out(PO.decision_layer(df))


@register("prediction_records", lambda: sql(
    "SELECT review_id, labels, " + ", ".join(f"CAST(p_{k} AS DOUBLE) AS p_{k}" for k in LABEL_KEYS) + ", "
    f"{O.q(RATIONALE)} AS rationale FROM pr", _pred_ctes()))
def q_prediction_records(spark: SparkSession, sf: str) -> DataFrame:
    """The full record; the lexicon is the built-in word list as a table."""
    words = spark.createDataFrame([(w,) for w in DEFAULT_PROFANITY], "word string")
    feats = _screen_features_spark(spark, sf, words)
    df = SC.rule_probabilities(feats).withColumns({"relevancy": F.lit(1.0), "image_relevancy": F.lit(None).cast("double")})
    rec = LK.prediction_records(PO.decision_layer(df))
    return rec.select("review_id", joined(F.col("labels")).alias("labels"),
                      *[F.col("confidences")[lab].alias(f"p_{k}") for k, lab in zip(LABEL_KEYS, LABELS)], "rationale")


# ------------------------------------------------- prediction records, filters

def _rule_predictions(spark: SparkSession, sf: str) -> DataFrame:
    feats = _screen_features_spark(spark, sf)
    df = SC.rule_probabilities(feats).withColumn("relevancy", F.lit(1.0)).withColumn(
        "image_relevancy", F.lit(None).cast("double"))
    return LK.prediction_records(PO.decision_layer(df))


_PRED_CTE = "pr AS (SELECT review_id, p_ad, p_irr, p_rant, p_spam, {labels} AS labels FROM fx)"


def _pred_ctes() -> str:
    return _features_ctes(False, False) + ", " + _PRED_CTE.format(labels=O.decision_labels())


@register("filter_label", lambda: sql(
    f"SELECT review_id, labels FROM pr WHERE list_contains(string_split(labels, '|'), {O.q(SPAM)})", _pred_ctes()))
def q_filter_label(spark: SparkSession, sf: str) -> DataFrame:
    preds = LK.filter_label(_rule_predictions(spark, sf), SPAM)
    return preds.select("review_id", joined(F.col("labels")).alias("labels"))


@register("filter_confidence", lambda: sql(
    "SELECT review_id, labels FROM pr WHERE greatest(p_ad, p_irr, p_rant, p_spam) >= 0.5", _pred_ctes()))
def q_filter_confidence(spark: SparkSession, sf: str) -> DataFrame:
    preds = LK.filter_confidence(_rule_predictions(spark, sf), 0.5)
    return preds.select("review_id", joined(F.col("labels")).alias("labels"))


@register("shown_counts", lambda: sql(
    f"SELECT count(*) FILTER (WHERE list_contains(string_split(labels, '|'), {O.q(SPAM)}) AND "
    "greatest(p_ad, p_irr, p_rant, p_spam) >= 0.5) AS shown, count(*) AS total FROM pr", _pred_ctes()))
def q_shown_counts(spark: SparkSession, sf: str) -> DataFrame:
    return LK.shown_counts(_rule_predictions(spark, sf), SPAM, 0.5)


def _meta_oracle() -> str:
    def two(x: str) -> str:
        return f"printf('%.2f', {x})"
    return sql(
        f"SELECT f.review_id, concat('meta: url=', CAST({O.has_url('f.t')} AS INTEGER), ' len=', length(f.t), ' caps=', "
        f"{two(O.caps_ratio('f.t'))}, ' emoji=', {O.regexp_count('f.t', P.emoji_pattern())}, ' uname_gib=', "
        f"{two('f.user_name_gibberish')}, ' imgs=', len({O.parse_pics('r.pics')}), ' burst24=', f.user_burst_24h, ' dup=', "
        f"CAST(f.dup_across_places AS INTEGER), ' ent=', {two('f.char_entropy')}, ' prof=', f.profanity_count, ' dist=', "
        "coalesce(CAST(round(f.distance_km, 6) AS VARCHAR), 'nan')) AS meta FROM fx f JOIN reviews r ON r.row_no = f.row_no",
        _features_ctes(False, False))


@register("meta_tokens", _meta_oracle)
def q_meta_tokens(spark: SparkSession, sf: str) -> DataFrame:
    feats = _screen_features_spark(spark, sf)
    # sines differ in their last bit between engines, so distances are rounded
    feats = feats.withColumn("distance_km", F.round("distance_km", 6))
    return feats.select("review_id", FMT.meta_tokens().alias("meta"))


# -------------------------------------------------- labels, converters, I/O

_LABEL_STRINGS = ("CASE l.doc_id % 8 WHEN 0 THEN 'Fake' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'real' "
                  "WHEN 4 THEN ' false ' WHEN 5 THEN '0' WHEN 6 THEN '??' ELSE NULL END")
_LABEL_INPUT = (f"SELECT l.doc_id, {_LABEL_STRINGS} AS s, CAST(l.quality AS DOUBLE) * 0.6 + "
                "CAST(l.toxic AS DOUBLE) * 0.3 AS x FROM labels l")


@register("label_coerce", lambda: sql(
    f"SELECT doc_id, CASE WHEN lower({O.trim_ws('s')}) IN ('fake', 'true', '1') THEN 1 ELSE 0 END AS from_string, "
    "CASE WHEN coalesce(x > 0.5, false) THEN 1 ELSE 0 END AS from_number FROM lc", f"lc AS ({_LABEL_INPUT})"))
def q_label_coerce(spark: SparkSession, sf: str) -> DataFrame:
    V.register_tables(spark, sf, ("labels",))
    lc = spark.sql(_LABEL_INPUT)
    return lc.select("doc_id", RU.label_coerce_string("s").alias("from_string"),
                     RU.label_coerce("x").alias("from_number"))


# Deterministic breakage of events.props: single quotes, garbage, blanks.
_BROKEN_PROPS = (
    "CASE event_id % 6 WHEN 0 THEN props "
    "WHEN 1 THEN replace(props, '\"', '''') "
    "WHEN 2 THEN concat('{bad', props) "
    "WHEN 3 THEN '   ' "
    "WHEN 4 THEN concat('{''a'':\"it''s\", ', substr(props, 2)) "
    "ELSE concat(' ', props, ' ') END"
)


def _lenient_oracle() -> str:
    t = O.trim_ws("l")
    return sql(
        "SELECT event_id, CAST(json_extract(j, '$.k') AS BIGINT) AS k FROM (SELECT event_id, CASE "
        f"WHEN {t} = '' THEN NULL WHEN json_valid({t}) THEN {t} "
        f"WHEN json_valid(replace({t}, '''', '\"')) THEN replace({t}, '''', '\"') END AS j "
        f"FROM (SELECT event_id, {_BROKEN_PROPS} AS l FROM events)) WHERE j IS NOT NULL")


@register("lenient_json", _lenient_oracle)
def q_lenient_json(spark: SparkSession, sf: str) -> DataFrame:
    V.register_tables(spark, sf, ("events",))
    lines = spark.sql(f"SELECT event_id, {_BROKEN_PROPS} AS l FROM events")
    parsed = lines.select("event_id", RD.lenient_json(F.col("l")).alias("obj")).where(F.col("obj").isNotNull())
    return parsed.select("event_id", F.try_variant_get("obj", "$.k", "bigint").alias("k"))


_GENERIC_SQL = ("SELECT concat('b', CAST(c.c_custkey AS STRING)) AS business_id, c.c_name AS business_name, "
                "c.c_mktsegment AS rating_category, n.n_name AS city, concat(c.c_name, ' ', c.c_mktsegment) AS text, "
                "CAST(c.c_acctbal AS STRING) AS rating, CASE c.c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' "
                "ELSE concat('http://img/', CAST(c.c_custkey AS STRING)) END AS photo "
                "FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")


def _generic_oracle() -> str:
    return sql(
        "SELECT concat('kaggle_', business_id) AS review_id, business_id AS place_id, business_name AS place_name, "
        "rating_category AS place_category, city, text, rating, '' AS created_at, '' AS user_id, '' AS user_name, "
        f"CASE WHEN photo IS NOT NULL AND {O.trim_ws('photo')} <> '' THEN to_json([photo])::VARCHAR ELSE '[]' END AS pics "
        "FROM g", f"g AS ({_GENERIC_SQL})")


@register("convert_generic", _generic_oracle)
def q_convert_generic(spark: SparkSession, sf: str) -> DataFrame:
    V.register_tables(spark, sf, ("customer", "nation"))
    return CV.convert_generic(spark.sql(_GENERIC_SQL), id_col="business_id")


_LABELLED_SQL = "SELECT d.doc_id, d.text, l.toxic AS fake FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


@register("convert_labelled", lambda: sql(
    "SELECT concat('gmrpl_', CAST(doc_id AS STRING)) AS review_id, coalesce(text, '') AS text, "
    "CAST(CASE WHEN fake > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS is_fake FROM lb", f"lb AS ({_LABELLED_SQL})"))
def q_convert_labelled(spark: SparkSession, sf: str) -> DataFrame:
    V.register_tables(spark, sf, ("labels", "documents"))
    return CV.convert_labelled(spark.sql(_LABELLED_SQL), id_col="doc_id").select("review_id", "text", "is_fake")


@register("union_sources", lambda: sql(
    "SELECT concat('kaggle_', business_id) AS review_id, business_id AS place_id, text, CAST(NULL AS INTEGER) AS is_fake "
    "FROM g UNION ALL SELECT concat('gmrpl_', CAST(doc_id AS STRING)), '', coalesce(text, ''), "
    "CAST(CASE WHEN fake > 0.5 THEN 1 ELSE 0 END AS INTEGER) FROM lb",
    f"g AS ({_GENERIC_SQL}), lb AS ({_LABELLED_SQL})"))
def q_union_sources(spark: SparkSession, sf: str) -> DataFrame:
    V.register_tables(spark, sf, ("customer", "nation", "labels", "documents"))
    g = CV.convert_generic(spark.sql(_GENERIC_SQL), id_col="business_id")
    lb = CV.convert_labelled(spark.sql(_LABELLED_SQL), id_col="doc_id")
    return CV.union_sources([g, lb]).select("review_id", "place_id", "text", "is_fake")


def _prompt_oracle() -> str:
    place = O.place_desc("place_name", "place_category", "city", "NULL")
    return sql(
        f"SELECT review_id, replace(replace(replace({O.q(FMT.PROMPT_TEMPLATE)}, '{{place}}', {place}), "
        f"'{{images}}', to_json({O.parse_pics('pics')})::VARCHAR), '{{text}}', coalesce(text, '')) AS prompt FROM reviews")


@register("prompt_render", _prompt_oracle)
def q_prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    r = V.reviews(spark, sf)
    place = LK.place_description("place_name", "place_category", "city", F.lit(None).cast("string"))
    return r.select("review_id", FMT.render_prompt(place, "text", F.to_json(parse_pics("pics"))).alias("prompt"))


# ------------------------------------------------------- model, evaluation

def _label_matrix_oracle() -> str:
    cols = ", ".join(
        f"CASE WHEN list_contains(string_split({O.weak_labels(O.txt())}, '|'), {O.q(lab)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_{k}"
        for k, lab in zip(LABEL_KEYS, LABELS))
    return sql(f"SELECT review_id, {cols} FROM rv", f"rv AS ({O.with_chars()})")


@register("label_matrix", _label_matrix_oracle)
def q_label_matrix(spark: SparkSession, sf: str) -> DataFrame:
    r = FE.add_weak_labels(V.reviews(spark, sf))
    return ML.label_matrix(r).select("review_id", *[f"y_{k}" for k in LABEL_KEYS])


@register("multilabel_fit_predict")
def q_multilabel_fit_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the train split (place-disjoint, 0.2/0.2), predict every review. The
    reviews meet their split before their texts."""
    keys = V.review_keys(spark, sf)
    train = S.assign_split(keys, S.place_split(keys, cfg=SplitConfig(0.2, 0.2, 42))).where(F.col("split") == "train")
    train = V.with_texts(spark, sf, train.select("review_id", "row_no", *V.TEXT_KEYS))
    out = ML.MultiLabelModel.fit(FE.add_weak_labels(train)).transform(V.reviews(spark, sf))
    return out.select("review_id", *[r6(f"p_{k}").alias(f"p_{k}") for k in LABEL_KEYS],
                      joined(F.col("pred_labels")).alias("pred_labels"))


# probabilities given by an expression over the events
_PROBS = ("SELECT event_id, 1.0 / (1.0 + exp(25.0 - value)) AS p_ad, 1.0 / (1.0 + exp(value / 10.0 - 3.0)) AS p_irr, "
          "CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.25 END AS p_rant, 1.0 / (1.0 + exp(2.0 - value / 20.0)) AS p_spam FROM events")


@register("probability_labels", lambda: sql(
    "SELECT event_id, concat_ws('|', " + ", ".join(
        f"CASE WHEN p_{k} >= 0.5 THEN {O.q(lab)} END" for k, lab in zip(LABEL_KEYS, LABELS)) + ") AS labels FROM pb",
    f"pb AS ({_PROBS})"))
def q_probability_labels(spark: SparkSession, sf: str) -> DataFrame:
    V.register_tables(spark, sf, ("events",))
    return spark.sql(_PROBS).select("event_id", joined(ML.labels_at(0.5)).alias("labels"))


@register("label_means", lambda: sql(
    "SELECT " + ", ".join(f"round(avg(p_{k}), 6) AS mean_p_{k}" for k in LABEL_KEYS) + " FROM pb", f"pb AS ({_PROBS})"))
def q_label_means(spark: SparkSession, sf: str) -> DataFrame:
    V.register_tables(spark, sf, ("events",))
    means = EV.label_means(spark.sql(_PROBS))
    return means.select(*[r6(f"mean_p_{k}").alias(f"mean_p_{k}") for k in LABEL_KEYS])


_MCAULEY = ("SELECT event_id, concat('{\"gmap_id\":\"g', CAST(event_id % 50 AS STRING), '\",\"user_id\":', "
            "CASE event_id % 4 WHEN 0 THEN '\"000\"' WHEN 1 THEN '0' WHEN 2 THEN 'null' ELSE concat('\"u', CAST(user_id AS STRING), '\"') END, "
            "',\"text\":', CASE event_id % 5 WHEN 0 THEN '\"0\"' WHEN 1 THEN '\"\"' WHEN 2 THEN 'false' WHEN 3 THEN '[]' ELSE '\"fine\"' END, "
            "',\"rating\":', CAST(event_id % 6 AS STRING), ',\"time\":', CAST(event_id * 1000 AS STRING), '}') AS l FROM events")


@register("convert_mcauley", lambda: sql(
    "SELECT event_id, concat_ws('_', p, u, CASE WHEN event_id = 0 THEN '' ELSE CAST(event_id * 1000 AS VARCHAR) END) AS review_id, "
    "u AS user_id, CASE event_id % 5 WHEN 0 THEN '0' WHEN 4 THEN 'fine' ELSE '' END AS text, "
    "CASE WHEN event_id % 6 = 0 THEN '' ELSE CAST(event_id % 6 AS VARCHAR) END AS rating FROM (SELECT event_id, "
    "concat('g', event_id % 50) AS p, CASE event_id % 4 WHEN 0 THEN '000' WHEN 3 THEN concat('u', user_id) ELSE '' END AS u FROM events)"))
def q_convert_mcauley(spark: SparkSession, sf: str) -> DataFrame:
    V.register_tables(spark, sf, ("events",))
    objs = spark.sql(_MCAULEY).select("event_id", RD.lenient_json(F.col("l")).alias("obj"))
    rows = CV.convert_mcauley(objs, extra=("event_id",))
    return rows.select("event_id", "review_id", "user_id", "text", "rating")


_REPLIES = ("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('{\"labels\":[\"None\"],\"relevance\":0.', CAST(doc_id % 9 AS STRING), "
            "',\"language\":\"', lang, '\"}') WHEN 1 THEN 'no reply' WHEN 2 THEN '[1]' WHEN 3 THEN '{}' ELSE NULL END AS reply FROM documents")


@register("parse_reply", lambda: sql(
    "SELECT doc_id, doc_id % 5 IN (0, 3) AS valid, CASE WHEN doc_id % 5 = 0 THEN 'None' END AS labels, "
    "CASE WHEN doc_id % 5 = 0 THEN round((doc_id % 9) / 10.0, 6) END AS relevance, "
    "CASE WHEN doc_id % 5 = 0 THEN lang END AS language FROM documents"))
def q_parse_reply(spark: SparkSession, sf: str) -> DataFrame:
    V.register_tables(spark, sf, ("documents",))
    reply = spark.sql(_REPLIES).select("doc_id", FMT.parse_reply("reply").alias("r"))
    return reply.select("doc_id", F.col("r").isNotNull().alias("valid"), joined(F.col("r.labels")).alias("labels"),
                        r6("r.relevance").alias("relevance"), F.col("r.language").alias("language"))


def _metrics_oracle() -> str:
    t = O.txt()
    body = (f"rv AS ({O.with_chars()}), "
            "pl AS (SELECT r.review_id, CAST(l.toxic AS INTEGER) AS is_fake, "
            f"CASE WHEN {O.has_url(t)} AND {O.promo(t)} THEN 1.0 ELSE 0.0 END AS p_ad, 0.0 AS p_irr, "
            f"CASE WHEN {O.never_been(t)} THEN 1.0 ELSE 0.0 END AS p_rant, "
            f"CASE WHEN {O.repeat_flag('chars')} THEN 1.0 ELSE 0.0 END AS p_spam "
            "FROM rv r JOIN labels l ON l.doc_id = r.doc_id), "
            "pp AS (SELECT 'spam_only' AS strategy, is_fake = 1 AS y, p_spam >= 0.5 AS p FROM pl UNION ALL "
            "SELECT 'any_violation', is_fake = 1, greatest(p_ad, p_irr, p_rant, p_spam) >= 0.5 FROM pl), "
            "cm AS (SELECT strategy, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, "
            "count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn "
            "FROM pp GROUP BY strategy), "
            "mx AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec, "
            "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rec FROM cm)")
    return sql("SELECT strategy, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(prec, 6) AS precision, "
               "round(rec, 6) AS recall, "
               "round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 6) AS f1, "
               "tp, fp, fn, tn FROM mx", body)


@register("binary_metrics", _metrics_oracle)
def q_binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = FE.add_weak_labels(V.reviews(spark, sf))
    lab = V.load(spark, sf, "labels").select("doc_id", F.col("toxic").cast("int").alias("is_fake"))
    scored = SC.rule_probabilities(r).join(lab, "doc_id")
    m = EV.binary_metrics(scored)
    return m.select("strategy", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
                    *[big(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


# every fifth of the digest space is held out of the language profile
_HELD_OUT = "md5(CAST(doc_id AS STRING)) < '33'"

_LANG_CTES = f"""docs AS (SELECT doc_id, lang, text FROM documents UNION ALL
  SELECT -1 - doc_id, lang, concat('a😀bc ', text, ' 😀😀x') FROM documents),
dt AS (SELECT doc_id, lang, string_split(lower(coalesce(text, '')), '') AS c, trim(coalesce(text, '')) = '' AS blank,
  {_HELD_OUT} AS held_out FROM docs),
tri AS (SELECT doc_id, tri, count(*) AS cnt FROM (SELECT doc_id,
  unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS tri FROM dt)
  GROUP BY doc_id, tri),
lab AS (SELECT doc_id, lang FROM dt WHERE lang IS NOT NULL AND NOT held_out),
cnts AS (SELECT l.lang, t.tri, sum(t.cnt) AS c FROM tri t JOIN lab l ON l.doc_id = t.doc_id GROUP BY l.lang, t.tri),
tot AS (SELECT lang, sum(c) AS total FROM cnts GROUP BY lang),
lg AS (SELECT p.lang, ln(p.n / (SELECT count(*) FROM lab)) AS prior,
  -ln(coalesce(t.total, 0) + (SELECT count(DISTINCT tri) FROM cnts)) AS unseen
  FROM (SELECT lang, count(*) AS n FROM lab GROUP BY lang) p LEFT JOIN tot t ON t.lang = p.lang),
ntri AS (SELECT doc_id, sum(cnt) AS n FROM tri GROUP BY doc_id),
delta AS (SELECT t.doc_id, c.lang, sum(t.cnt * ln(c.c + 1.0)) AS d FROM tri t JOIN cnts c ON c.tri = t.tri
  GROUP BY t.doc_id, c.lang),
sc AS (SELECT nt.doc_id, lg.lang, lg.prior + nt.n * lg.unseen + coalesce(delta.d, 0.0) AS s FROM ntri nt CROSS JOIN lg
  LEFT JOIN delta ON delta.doc_id = nt.doc_id AND delta.lang = lg.lang),
best AS (SELECT doc_id, lang FROM (SELECT doc_id, lang,
  row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang ASC) AS rn FROM sc) WHERE rn = 1)"""


@register("language_id", lambda: sql(
    "SELECT d.doc_id, d.lang, d.held_out, CASE WHEN d.blank THEN 'unknown' ELSE coalesce(b.lang, 'unknown') END AS lang_pred "
    "FROM dt d LEFT JOIN best b ON b.doc_id = d.doc_id", _LANG_CTES))
def q_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, and once more with emoji around it; the profile is
    learned without the held-out rows, so their predictions tell."""
    docs = V.load(spark, sf, "documents").select("doc_id", "lang", "text")
    more = docs.select((-1 - F.col("doc_id")).alias("doc_id"), "lang", F.concat(F.lit("a😀bc "), "text", F.lit(" 😀😀x")).alias("text"))
    docs = docs.unionAll(more).withColumn("held_out", F.expr(_HELD_OUT)).repartition("doc_id")
    model = LG.TrigramLanguageModel.fit(docs.where(~F.col("held_out")))
    return model.predict(docs).select("doc_id", "lang", "held_out", "lang_pred")


@register("train_sample_relevancy", lambda: sql(
    "SELECT review_id, round(relevancy, 6) AS relevancy FROM rel",
    _SPLIT_CTES + ", hd AS (SELECT r.* FROM reviews r JOIN sp ON sp.place_id = r.place_id AND sp.split = 'train' "
    "ORDER BY r.review_id, r.row_no LIMIT 10), "
    "pairs AS (SELECT hd.row_no, hd.review_id, coalesce(hd.text, '') AS t, "
    + O.place_desc("coalesce(p.place_name, hd.place_name, '')", "coalesce(p.place_category, hd.place_category, '')",
                   "coalesce(p.city, hd.city, '')", "coalesce(p.description, '')")
    + " AS d FROM hd LEFT JOIN places p ON p.place_id = hd.place_id)," + O.relevancy_ctes("pairs")))
def q_train_sample_relevancy(spark: SparkSession, sf: str) -> DataFrame:
    r = V.reviews(spark, sf)
    train = S.assign_split(r, S.place_split(r)).where(F.col("split") == "train")
    out = JB.relevancy_sample(train, V.places(spark, sf), 10, ("review_id", "row_no"))
    return out.select("review_id", r6("relevancy").alias("relevancy"))


# ------------------------------------------------ sources, sinks, models, plug-ins

@register("csv_round_trip", lambda: sql(
    "SELECT r.review_id, r.place_id, r.place_name, r.text, r.rating, r.created_at, r.user_id, r.pics FROM rq r",
    "rq AS (SELECT review_id, place_id, place_name, text || CASE abs(row_no) % 3 WHEN 0 THEN ' \"said\"' "
    "WHEN 1 THEN concat(chr(10), '\",', chr(10), 'x\"') ELSE '' END AS text, rating, created_at, user_id, pics FROM reviews)"))
def q_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews with more quotes and newlines, written as CSV and read back."""
    r = V.reviews(spark, sf).withColumn("text", F.expr(
        "concat(text, CASE abs(row_no) % 3 WHEN 0 THEN ' \"said\"' WHEN 1 THEN '\\n\",\\nx\"' ELSE '' END)"))
    path = scratch_dir(spark, "reviews-csv")
    cols = ["review_id", "place_id", "place_name", "text", "rating", "created_at", "user_id", "pics"]
    SK.write_table(r.select(*cols), path, "csv", compression="gzip")
    return RD.read_reviews_csv(spark, path).select(*cols)


@register("places_csv_round_trip", lambda: sql(
    "SELECT place_id, place_name, place_category, city, description, place_lat, place_lon FROM places"))
def q_places_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["place_id", "place_name", "place_category", "city", "description", "place_lat", "place_lon"]
    path = scratch_dir(spark, "places-csv")
    SK.write_table(V.places(spark, sf).select(*cols), path, "csv")
    back = RD.read_places_csv(spark, path)
    return back.select(*[F.col(c).cast("double" if c in ("place_lat", "place_lon") else "string").alias(c) for c in cols])


@register("split_sink", lambda: sql(
    "SELECT r.row_no, r.review_id, r.text, sp.split FROM reviews r JOIN sp ON sp.place_id = r.place_id", _SPLIT_CTES))
def q_split_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Splits written in files of bounded size, one split once more, and read back.
    The reviews meet their split before their texts, which no step stores."""
    r = V.review_keys(spark, sf)
    keys = stored_rows(S.assign_split(r, S.place_split(r)).select("row_no", "review_id", *V.TEXT_KEYS, "split"))
    out = V.with_texts(spark, sf, keys).select("row_no", "review_id", "text", "split")
    path = scratch_dir(spark, "splits")
    SK.write_splits(out, path, compression="zstd")
    SK.write_splits(out.where("split = 'val'"), path, compression="zstd")  # replaces that split only
    return spark.read.parquet(path).select("row_no", "review_id", "text", "split")


@register("prediction_sink", lambda: sql(
    "SELECT review_id, CASE WHEN labels = '' THEN '[]' ELSE concat('[\"', replace(labels, '|', '\",\"'), '\"]') END AS labels, "
    + ", ".join(f"CAST(p_{k} AS DOUBLE) AS p_{k}" for k in LABEL_KEYS) + f", {O.q(RATIONALE)} AS rationale FROM pr", _pred_ctes()))
def q_prediction_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction records through the CSV sink: lists and maps come back as JSON."""
    path = scratch_dir(spark, "predictions")
    SK.write_predictions(_rule_predictions(spark, sf), path, "csv", compression="gzip")
    back = RD.read_csv(spark, path)
    conf = F.from_json("confidences", "map<string,double>")
    return back.select("review_id", "labels", *[conf[lab].alias(f"p_{k}") for k, lab in zip(LABEL_KEYS, LABELS)], "rationale")


_COPIES = ("SELECT doc_id % 50 AS k, lang, source FROM documents UNION ALL SELECT doc_id, lang, source FROM documents "
           "UNION ALL SELECT 7 AS k, 'a \"q\"' AS lang, NULL AS source FROM documents WHERE doc_id % 3 = 0")
_ROW_JSON = ("concat('{', concat_ws(',', '\"k\":' || CAST(k AS VARCHAR), '\"lang\":' || CAST(to_json(lang) AS VARCHAR), "
             "'\"source\":' || CAST(to_json(source) AS VARCHAR)), '}')")


@register("content_ids", lambda: sql(
    "SELECT concat('doc_', h, CASE WHEN n > 1 THEN concat('-', CAST(n AS VARCHAR)) ELSE '' END) AS row_id, k, lang, source "
    "FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY k) AS n FROM (SELECT *, md5(j) AS h FROM jt))",
    f"ct AS ({_COPIES}), jt AS (SELECT *, {_ROW_JSON} AS j FROM ct)"))
def q_content_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Content ids of rows that repeat, one of them in a third of the table."""
    V.register_tables(spark, sf, ("documents",))
    return CV.content_ids(spark.sql(_COPIES.replace("'a \"q\"'", "'a \\\"q\\\"'")), "doc_", "row_id").select("row_id", "k", "lang", "source")


# Compatibility characters and what NFKC makes of them.
_NFKC = {"\uff34\uff45": "Te", "\ufb01": "fi", "\u2460": "1", "e\u0301": "\u00e9", "\uff76\uff9e": "\u30ac", "\u212b": "\u00c5",
         "\u00bd": "1\u20442", "\u1112\u1161\u11ab": "\ud55c", "\u2002": " ", "\u03d2\u0301": "\u038e", "\u0958": "\u0915\u093c"}


def _nfkc_text(parts: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(parts))
    return f"concat(text, ' ', CASE doc_id % {len(parts) + 2} {cases} ELSE '\u00e9\u4e2d\u6587 \U0001f600' END, ' ', lang)"


@register("nfkc", lambda: f"SELECT doc_id, md5({_nfkc_text(list(_NFKC.values()))}) AS nfkc_md5 FROM documents")
def q_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts with a compatibility character of some script appended."""
    V.register_tables(spark, sf, ("documents",))
    docs = spark.sql(f"SELECT doc_id, {_nfkc_text(list(_NFKC))} AS text FROM documents")
    return docs.select("doc_id", F.md5(X.nfkc(F.col("text"))).alias("nfkc_md5"))


_TRANSLATED = "CASE WHEN lang NOT IN ('en', 'unknown') AND trim(text) <> '' THEN concat('[', lang, '] ', replace(text, 'e', '(e)')) ELSE text END"


@register("translated_reviews", lambda: sql(
    f"SELECT row_no, md5({_TRANSLATED}) AS text_md5, first_run FROM rt",
    "rl AS (SELECT r.row_no, r.text, d.lang FROM reviews r LEFT JOIN documents d ON d.doc_id = r.doc_id), "
    "rt AS (SELECT row_no, text, lang, CASE WHEN lang NOT IN ('en', 'unknown') AND trim(text) <> '' "
    "THEN bool_or(row_no % 2 = 0) OVER (PARTITION BY lang, text) END AS first_run FROM rl)"))
def q_translated_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the reviews are translated in one run, all in a second one that
    sends only what the first has not; ``first_run`` tells which run sent it."""
    docs = V.load(spark, sf, "documents").select(F.col("doc_id").alias("lang_key"), "lang")
    keys = V.review_keys(spark, sf).select("row_no", *V.TEXT_KEYS, F.expr("if(extra, doc_id, doc_key)").alias("lang_key"))
    r = stored_rows(keys.join(docs, "lang_key", "left").drop("lang_key"))
    path = scratch_dir(spark, "translations")
    texts = _texts(spark, sf)

    def translate(texts, langs):
        return "[" + langs + "] " + texts.str.replace("e", "(e)")

    CL.translated(r.where("row_no % 2 = 0"), translate, path, texts=texts).write.format("noop").mode("overwrite").save()
    known = materialize(CL.translation_table(spark, path).select("digest", F.lit(True).alias("early")).distinct())
    out = CL.translated(r, translate, path, texts=texts, key="digest").select("row_no", "digest", F.md5("text_model").alias("text_md5"))
    return (out.join(known, "digest", "left")
            .select("row_no", "text_md5", F.when(F.col("digest").isNotNull(), F.coalesce("early", F.lit(False))).alias("first_run")))


@register("scorer_relevancy", lambda: sql(
    "SELECT row_no, round(1.0 / (1.0 + exp(-s)), 6) AS relevancy FROM sc",
    _EVAL_PAIRS.format(desc=O.place_desc("p.place_name", "p.place_category", "p.city", "p.description")) + ", "
    "sc AS (SELECT row_no, ((length(t) * 7 + length(d) * 3) % 101) / 10.0::DOUBLE - 3.0::DOUBLE AS s FROM pairs)"))
def q_scorer_relevancy(spark: SparkSession, sf: str) -> DataFrame:
    """A pair scorer made in the worker; its scores lie outside [0, 1], so the
    batch is calibrated."""
    def make():
        return lambda texts, descs: ((texts.str.len() * 7 + descs.str.len() * 3) % 101) / 10.0 - 3.0

    def texts(keys: DataFrame) -> DataFrame:
        return V.with_texts(spark, sf, LK.eval_pairs(keys, V.places(spark, sf)))

    keys = V.review_keys(spark, sf).select("row_no", *V.TEXT_KEYS, "place_id")
    scored = RL.relevancy(keys, "text", "place_desc", make_scorer=make, texts=texts)
    return scored.select("row_no", r6("relevancy").alias("relevancy"))


_DOC_TERMS = (f"rt AS (SELECT doc_id AS row_no, {{toks}} AS toks FROM documents), "
              "a AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest({terms}) AS term FROM rt) GROUP BY row_no, term), "
              "v AS (SELECT term, count(*) AS df, sum(tf) AS ttf FROM a GROUP BY term ORDER BY ttf DESC, term ASC LIMIT 20000), "
              "w AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS code, "
              "ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM v), "
              "x AS (SELECT a.row_no, w.term, w.code, a.tf * w.idf AS x FROM a JOIN w ON w.term = a.term), "
              "u AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY row_no)) AS wt FROM x)")


def _doc_terms() -> str:
    return _DOC_TERMS.format(toks=O.tokens("text"), terms=O.terms_list("toks"))


def _doc_vocabulary(spark: SparkSession, sf: str):
    docs = V.load(spark, sf, "documents")
    return docs, *TF.gathered_vocabulary(materialize(TF.fit_vocabulary(docs, "text", CLASSIFIER_VOCAB)), CLASSIFIER_VOCAB)


@register("tfidf_vectors", lambda: sql(
    "SELECT rt.row_no AS doc_id, CAST(count(u.code) AS BIGINT) AS n_terms, round(coalesce(sum(wt), 0.0), 5) AS weight_sum, "
    "round(coalesce(max(wt), 0.0), 5) AS weight_max, CAST(coalesce(sum(code), 0) AS BIGINT) AS code_sum, "
    "round(coalesce(sum(wt * (code % 97)), 0.0), 4) AS weighted_codes "
    "FROM rt LEFT JOIN u ON u.row_no = rt.row_no GROUP BY rt.row_no", _doc_terms()))
def q_tfidf_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Unit TF-IDF vectors of all documents over the 20,000 most frequent terms."""
    docs, terms, idf = _doc_vocabulary(spark, sf)
    v = docs.select("doc_id", TF.vector_column("text", terms, idf).alias("v")).select("doc_id", "v.*")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return v.select(
        "doc_id", big(F.size("codes")).alias("n_terms"), F.round(total("weights"), 5).alias("weight_sum"),
        F.round(F.coalesce(F.array_max("weights"), F.lit(0.0)), 5).alias("weight_max"),
        F.aggregate("codes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("code_sum"),
        F.round(total(F.zip_with("weights", "codes", lambda w, c: w * (c % 97))), 4).alias("weighted_codes"))


_GIVEN = {"ad": "(code % 13 - 6) * 4.0", "irr": "(code % 7 - 3) * 2.0", "rant": "(code % 29 - 14) * 1.5"}


@register("model_round_trip", lambda: sql(
    "SELECT doc_id, " + ", ".join(f"round(p_{k}, 6) AS p_{k}" for k in LABEL_KEYS) + " FROM pb",
    _doc_terms() + ", pb AS (SELECT rt.row_no AS doc_id, "
    + ", ".join(f"1.0 / (1.0 + exp(-(coalesce(sum(wt * ({w})), 0.0) + 0.25))) AS p_{k}" for k, w in _GIVEN.items())
    + ", 1.0::DOUBLE AS p_spam FROM rt LEFT JOIN u ON u.row_no = rt.row_no GROUP BY rt.row_no)"))
def q_model_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A model with given weights saved as the middle one of three runs, of which
    the last was never committed; the newest committed one scores all documents."""
    docs, terms, idf = _doc_vocabulary(spark, sf)
    code = np.arange(len(terms))
    weights = np.zeros((len(terms) + 1, len(LABEL_KEYS)))
    for j, m, h, f in ((0, 13, 6, 4.0), (1, 7, 3, 2.0), (2, 29, 14, 1.5)):
        weights[:-1, j], weights[-1, j] = (code % m - h) * f, 0.25
    constants = {"ad": None, "irr": None, "rant": None, "spam": 1.0}
    folder = scratch_dir(spark, "models")
    ML.MultiLabelModel(terms, idf, weights * 0, constants).save(f"{folder}/multilabel_a")
    ML.MultiLabelModel(terms, idf, weights, constants).save(f"{folder}/multilabel_b")
    docs.select("doc_id").write.parquet(f"{folder}/multilabel_c/weights")
    model = ML.MultiLabelModel.load(ML.latest_model_dir(spark, folder))
    return model.transform(docs).select("doc_id", *[r6(f"p_{k}").alias(f"p_{k}") for k in LABEL_KEYS])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLES.items()}


FLAGSHIP = "screen_reviews"
