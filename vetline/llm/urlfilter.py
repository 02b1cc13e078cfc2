"""URL filter: host and path rules, then boosted trees on lexical features.

A rule names a host (with its subdomains) and a path prefix; the longest rule
that fits decides. URLs without a rule are judged by gradient-boosted trees on
lexical features alone: lengths, path depth, digit share, character entropy,
parameter counts, punctuation and smoothed block rates of the host's last one,
two and three labels. Only column expressions and the JVM's tree learner run.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.llm.common import ascii_lower, stored, table

# (rule, verdict): host, slash, path prefix.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# The trees learn from at most this many distinct labelled URLs, drawn by hash.
MAX_TRAIN_ROWS = 20_000
# Larger tables of suffix rates are not broadcast; each of their suffixes is
# dealt over so many tasks.
MAX_BROADCAST_BYTES, SALTS = 8 << 20, 16
TREES, DEPTH = 12, 4
# Weight of the overall block rate in a suffix's rate.
PRIOR_ROWS = 20.0
SUFFIX_LABELS = (1, 2, 3)

LEXICAL = ["url_length", "host_length", "path_length", "host_labels", "depth", "digit_share", "entropy",
           "n_params", "query_length", "n_hyphens", "n_underscores", "longest_label", "has_fragment", "has_extension"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (first of the list among equals) and its verdict."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, said in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + prefix))
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(said)).otherwise(verdict)
    return text, verdict


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path`` and the :data:`LEXICAL` columns."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = url_parts(F.col(url_col))
    n = F.length(url).cast("double")
    some = F.greatest(n, F.lit(1.0))
    each = F.array_distinct(F.split(url, ""))
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / some
    entropy = F.aggregate(each, F.lit(0.0), lambda acc, c: acc - F.when(
        share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return df.withColumns({"host": host, "path": path}).withColumns({
        "url_length": n, "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "host_labels": F.size(labels).cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
        "digit_share": _count(url, "[0-9]") / some, "entropy": entropy,
        "n_params": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
        "query_length": F.length(query).cast("double"), "n_hyphens": _count(F.col("host"), "-"),
        "n_underscores": _count(url, "_"),
        "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]+$").cast("double")})


def suffix_rates(labelled: DataFrame) -> list:
    """Overall share of blocked rows, then one table per suffix length: suffix,
    smoothed share of blocked rows. All of ``labelled`` (``host``, ``label``,
    ``n`` rows) counts."""
    hosts = stored(labelled.groupBy("host").agg(F.sum(F.col("label") * F.col("n")).alias("blocked"), F.sum("n").alias("n")), "url-hosts")
    overall = hosts.agg((F.sum("blocked") / F.sum("n")).alias("m")).first().m
    overall = 0.5 if overall is None else overall
    out = []
    for k in SUFFIX_LABELS:
        rate = (F.sum("blocked") + PRIOR_ROWS * overall) / (F.sum("n") + PRIOR_ROWS)
        out.append(stored(hosts.groupBy(suffix(F.col("host"), k).alias(f"suffix_{k}")).agg(rate.alias(f"rate_{k}")), "url-rates"))
    return [overall, *out]


def _with_rates(df: DataFrame, rates: list, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    overall, *tables = rates
    for k, rate in zip(SUFFIX_LABELS, tables):
        df = df.withColumn(f"suffix_{k}", suffix(F.col("host"), k))
        size = rate.agg(F.sum(F.octet_length(f"suffix_{k}") + 64).alias("bytes")).first().bytes or 0
        if size <= max_bytes:
            df = df.join(F.broadcast(rate), f"suffix_{k}", "left")
        else:
            # rows of one suffix are dealt over SALTS tasks
            salted = rate.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            df = df.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
            df = df.join(salted.hint("shuffle_merge"), [f"suffix_{k}", "salt"], "left").drop("salt")
        df = df.withColumn(f"rate_{k}", F.coalesce(f"rate_{k}", F.lit(overall))).drop(f"suffix_{k}")
    return df


class UrlClassifier:
    """Boosted trees with the suffix statistics they were trained on; without
    both labels in the sample the verdict is the only label seen, or allow."""

    def __init__(self, rates: list, model: GBTClassificationModel | None, constant: float):
        self.rates, self.model, self.constant = rates, model, constant

    def block_score(self, features: DataFrame) -> DataFrame:
        """``features`` with ``block_score`` (0..1)."""
        if self.model is None:
            return features.withColumn("block_score", F.lit(self.constant))
        cols = features.columns
        rated = _assembler().transform(_with_rates(features, self.rates))
        scored = self.model.transform(rated)
        from pyspark.ml.functions import vector_to_array

        return scored.select(*cols, vector_to_array("probability")[1].alias("block_score"))


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=LEXICAL + [f"rate_{k}" for k in SUFFIX_LABELS], outputCol="features")


def training_sample(urls: DataFrame, max_rows: int, url_col: str = "url") -> DataFrame:
    """At most ``max_rows`` of the distinct rows ``urls``, those with the
    smallest hashes of URL and label."""
    n = urls.count()
    if n <= max_rows:
        return urls
    steps = 1_000_000
    draw = F.xxhash64(url_col, "label")
    some = urls.filter(F.pmod(draw, F.lit(steps)) < int(steps * (1.1 * max_rows + 100) / n) + 1)
    return some.orderBy(F.pmod(draw, F.lit(steps)), draw, url_col, "label").limit(max_rows)


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS, url_col: str = "url", seed: int = 7) -> UrlClassifier:
    """Fit on ``url_col``, ``label`` (1 block, 0 allow) rows.

    The suffix statistics count every row. The trees are fitted on at most
    ``max_rows`` distinct URLs (with their label), each with the weight of its
    rows. Rows without a label or a URL are left out."""
    usable = labelled.filter(F.col("label").isNotNull() & F.col(url_col).isNotNull()).select(url_col, F.col("label").cast("double"))
    urls = stored(usable.groupBy(url_col, "label").agg(F.count("*").cast("double").alias("n")), "url-labels")
    rates = suffix_rates(urls.withColumn("host", url_parts(F.col(url_col))[0]))
    sample = stored(lexical_features(training_sample(urls, max_rows, url_col), url_col).repartition(8), "url-sample")
    kinds = {r.label for r in sample.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return UrlClassifier(rates, None, kinds.pop() if kinds else 0.0)
    rows = _assembler().transform(_with_rates(sample, rates)).select("features", "label", "n")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=0.8, weightCol="n").fit(rows)
    return UrlClassifier(rates, model, 0.0)


def judge(pages: DataFrame, rules: list[tuple[str, str]], classifier: UrlClassifier, url_col: str = "url",
          keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict, block_score.

    Null and malformed URLs have an empty host and path and no rule; the trees
    judge them like any other. Repeated rows give repeated results; other
    columns of the input are not read, so clashing names cannot meet."""
    slim = pages.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], F.col(url_col).alias("url"))
    scored = classifier.block_score(lexical_features(slim))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return scored.select(
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")


def rule_labels(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """Labelled URLs: those that a rule decides."""
    host, path = url_parts(F.col(url_col))
    verdict = rule_for(host, path, rules)[1]
    return pages.select(F.col(url_col).alias("url"), F.when(verdict == "block", 1.0).when(verdict == "allow", 0.0).alias("label"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, RULES, train(rule_labels(pages, RULES)))
