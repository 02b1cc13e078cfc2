"""Benchmark decontamination by a distributed positional inverted index.

Words of the corpus that matter to the test items are counted; each window of
an item (ten words, or the whole of a shorter item) is anchored at the two
rarest of its words that occur; postings of those words (document, position, and for the rarest
ones the words around it) are stored; and the offset-adjusted lists of the two
anchors are intersected before the phrase is compared word by word. Everything
is DataFrame expressions: two passes over the corpus text (count, post), and
joins whose rows are postings of rare words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetline.llm.common import LOWER, UPPER, ascii_lower, stored, table

WINDOW = 10
# Words around an anchor that may shift in a proximity match, and the share of
# a window's words that must stand near its rarest word.
SLOP, NEAR_SHARE = 2, 0.8
# Rows of one block of test terms that is broadcast (two longs and flags each,
# under 64 MB); more terms take more passes over the corpus.
BLOCK_TERMS = 1_000_000
# Postings of one term that one task may meet; the lists of more frequent terms
# are dealt over several tasks by document.
LIST_ROWS = 200_000

# Words before lower-casing A-Z: the word pattern with A-Z added. It names what
# a word has, the most frequent first, which the JVM matches several times faster
# than the same class as what a word lacks.
_WORDS = r"[a-z0-9A-Z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))


def term(word: Column) -> Column:
    """Join key of a word. Full lower-casing is fast and never parts words that
    are equal after lower-casing A-Z; the phrase comparison settles the rest."""
    return F.xxhash64(F.lower(word))


def _lowered(ws: Column) -> Column:
    return F.split(ascii_lower(F.array_join(ws, " ")), " ")


def _blocks(terms: DataFrame, block: int) -> list[DataFrame]:
    """``terms`` (with a long ``key``) in hash blocks of bounded size."""
    n = max(1, -(-terms.count() // block))
    return [terms.filter(F.pmod("key", F.lit(n)) == i) for i in range(n)] if n > 1 else [terms]


def item_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per item word: item row ``iid``, item_id, ``words``, ``at``,
    ``size`` (words of a window), key. Items without words have no rows."""
    items = (bench.select("item_id", words(F.col("text")).alias("raw")).filter(F.size("raw") > 0)
             .select(F.monotonically_increasing_id().alias("iid"), "item_id", "raw", _lowered(F.col("raw")).alias("words"),
                     F.least(F.size("raw"), F.lit(window)).alias("size")))
    return stored(items.select("iid", "item_id", "words", "size", F.posexplode("raw").alias("at", "word"))
                  .select("iid", "item_id", "words", "size", "at", term(F.col("word")).alias("key")), "bench")


def term_counts(docs: DataFrame, keys: DataFrame, text_col: str = "text", block: int = BLOCK_TERMS) -> DataFrame:
    """Corpus occurrences of each test term that occurs."""
    tokens = docs.select(F.explode(words(F.col(text_col))).alias("w")).select(term(F.col("w")).alias("key"))
    parts = [tokens.join(F.broadcast(b), "key", "left_semi") for b in _blocks(keys, block)]
    return reduce(DataFrame.unionAll, parts).groupBy("key").count()


def anchored_windows(item_words: DataFrame, counts: DataFrame, near_share: float = NEAR_SHARE) -> DataFrame:
    """Windows that can match, with the item positions of their rarest
    occurring word (``p1``) and of the next rarest (``p2``; ``p1`` again where
    there is no other), the first one of equally rare words, the keys there and
    the tasks (``d1``, ``d2``) that their lists are dealt over. Windows with
    words that the corpus lacks match nearby only, as long as enough of their
    words are left."""
    counted = item_words.join(counts, "key", "left").select(
        "iid", "at", "key", "size", F.size("words").alias("n"), F.coalesce("count", F.lit(0)).alias("count"))
    spread = counted.withColumn("start", F.explode(F.sequence(
        F.greatest(F.col("at") - F.col("size") + 1, F.lit(0)), F.least(F.col("at"), F.col("n") - F.col("size")))))
    ranked = spread.groupBy("iid", "start", "size").agg(
        F.sort_array(F.collect_list(F.when(F.col("count") > 0, F.struct("count", "at", "key")))).alias("by"),
        F.size(F.collect_set("key")).alias("different"))
    able = ranked.filter((F.size("by") > 0) & (F.size("by") >= F.ceil(F.col("different") * near_share)))
    first, second = F.col("by")[0], F.when(F.size("by") > 1, F.col("by")[1]).otherwise(F.col("by")[0])
    deal = lambda anchor: F.ceil(anchor["count"] / LIST_ROWS).cast("int")
    return able.select(
        "iid", "start", "size", first["at"].alias("p1"), first["key"].alias("k1"), deal(first).alias("d1"),
        second["at"].alias("p2"), second["key"].alias("k2"), deal(second).alias("d2"))


def build_postings(docs: DataFrame, anchors: DataFrame, reach: int, text_col: str = "text",
                   doc_cols: tuple[str, ...] = ("doc_id",), block: int = BLOCK_TERMS) -> DataFrame:
    """The stored index: for every document a head row (position 0 or none)
    with its word count, and a posting per occurrence of an anchor term
    (``key``, ``first``, ``deal``: tasks of its list) with its ``part`` of the
    list; those of ``first`` anchors carry the lower-cased words up to
    ``reach`` around."""
    blocks = _blocks(anchors, block)
    rows = docs.select(*doc_cols, F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    if len(blocks) > 1:
        rows = stored(rows, "rows")  # the row number is the same in every pass
    rows = rows.select(*doc_cols, "rid", words(F.col("text")).alias("ws"))
    spread = rows.select(*doc_cols, "rid", "ws", F.posexplode_outer("ws").alias("pos", "w"))
    spread = spread.withColumn("key", term(F.col("w")))
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    parts = []
    for i, b in enumerate(blocks):
        hit = spread.join(F.broadcast(b), "key", "left")
        head = F.coalesce(F.col("pos"), F.lit(0)) == (0 if i == 0 else -1)
        parts.append(hit.filter(head | F.col("first").isNotNull()).select(
            *doc_cols, "rid", head.alias("head"), F.when(head, F.coalesce(F.size("ws"), F.lit(0))).cast("long").alias("n_words"),
            F.when(F.col("first").isNotNull(), F.col("key")).alias("key"), "first",
            F.pmod(F.xxhash64("rid"), F.col("deal")).cast("int").alias("part"), "pos", low.alias("low"),
            F.when(F.col("first"), _lowered(F.slice("ws", low + 1, F.col("pos") - low + reach + 1))).alias("around")))
    return stored(reduce(DataFrame.unionAll, parts), "postings")


def phrase_matches(postings: DataFrame, item_words: DataFrame, windows: DataFrame, slop: int = SLOP,
                   near_share: float = NEAR_SHARE) -> DataFrame:
    """Rows (rid, item_id, start, size, exact): ``start`` is the document word
    where an exact window begins; a proximity match (exact false) has both
    anchors up to ``slop`` words off and at least ``near_share`` of the
    window's different words among those up to a window's length around the
    rarest one."""
    parts = lambda d: F.explode(F.sequence(F.lit(0), F.col(d) - 1)).alias("part")
    items = item_words.filter("at = 0").select("iid", "item_id", "words")
    pairs = windows.groupBy("iid", "p1", "k1", "d1", "p2", "size").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    pairs = pairs.select("iid", "p1", "p2", "size", "starts", F.col("k1").alias("key"), parts("d1"))
    first = (postings.filter("first").join(pairs, ["key", "part"])
             .withColumn("diag", F.col("pos") - F.col("p1"))
             .select("rid", "iid", "p1", "p2", "size", "starts", "diag", "low", "around"))
    second = (postings.filter("key is not null")
              .join(windows.select("iid", "p2", "k2", "d2").distinct().select("iid", "p2", F.col("k2").alias("key"), parts("d2")),
                    ["key", "part"])
              .select("rid", "iid", "p2", (F.col("pos") - F.col("p2")).alias("diag2")))
    shifted = first.filter("p1 <> p2").withColumn("off", F.explode(F.array(*[F.lit(i) for i in range(-slop, slop + 1)])))
    shifted = shifted.withColumn("diag2", F.col("diag") + F.col("off"))
    both = shifted.join(second, ["rid", "iid", "p2", "diag2"]).select(*first.columns, "off")
    both = both.unionByName(first.filter("p1 = p2").withColumn("off", F.lit(0)))
    judged = both.join(items, "iid")
    same = F.filter("starts", lambda s: (s + F.col("diag") >= F.col("low")) & (
        F.slice("around", F.greatest(s + F.col("diag") - F.col("low"), F.lit(0)) + 1, F.col("size"))
        == F.slice("words", s + 1, F.col("size"))))
    near = F.filter("starts", lambda s: F.size(F.array_intersect("around", F.slice("words", s + 1, F.col("size"))))
                    >= F.ceil(F.size(F.array_distinct(F.slice("words", s + 1, F.col("size")))) * near_share))
    begins = lambda c: F.transform(c, lambda s: s + F.col("diag"))
    none = F.array().cast("array<int>")
    found = judged.select("rid", "item_id", "size", begins(F.when(F.col("off") == 0, same).otherwise(none)).alias("same"),
                          begins(near).alias("near"))
    exact = found.select("rid", "item_id", F.explode("same").alias("start"), "size", F.lit(True).alias("exact"))
    loose = found.filter("size(same) = 0").select(
        "rid", "item_id", F.explode("near").alias("start"), "size", F.lit(False).alias("exact"))
    return exact.unionAll(loose)


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = SLOP,
                  doc_cols: tuple[str, ...] = ("doc_id",), block: int = BLOCK_TERMS) -> DataFrame:
    """Per document row: ``doc_cols``, n_words, n_hit, n_items, items_sha256,
    contaminated, n_near_items (items with a proximity match only).

    Null and empty texts have no words and no hits. Repeated rows are judged
    one by one; a null item_id makes hits but is not listed. An empty corpus
    gives no rows, an empty benchmark gives clean rows. Other columns of either
    input are not read."""
    item_words = item_windows(bench, window)
    counts = stored(term_counts(docs, item_words.select("key").distinct(), block=block), "term-counts")
    windows = stored(anchored_windows(item_words, counts), "windows")
    anchors = windows.select(F.col("k1").alias("key"), F.lit(True).alias("first"), F.col("d1").alias("deal")).unionAll(
        windows.select("k2", F.lit(False), "d2")).groupBy("key").agg(F.max("first").alias("first"), F.max("deal").alias("deal"))
    postings = build_postings(docs, stored(anchors, "anchors"), window - 1, doc_cols=doc_cols, block=block)
    found = stored(phrase_matches(postings, item_words, windows, slop), "matches")
    exact = found.filter("exact")
    hits = (exact.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos"))
            .distinct().groupBy("rid").agg(F.count("*").alias("n_hit")))
    per_item = found.groupBy("rid", "item_id").agg(F.max("exact").alias("exact"))
    items = per_item.groupBy("rid").agg(
        F.count(F.when(F.col("exact"), F.col("item_id"))).alias("n_items"),
        F.count(F.when(~F.col("exact"), F.col("item_id"))).alias("n_near_items"),
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("ids"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return (postings.filter("head").select(*doc_cols, "rid", "n_words")
            .join(hits, "rid", "left").join(items, "rid", "left")
            .select(*doc_cols, "n_words", zero("n_hit").alias("n_hit"), zero("n_items").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
                    (zero("n_hit") > 0).alias("contaminated"), zero("n_near_items").alias("n_near_items")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size,
         array_to_string(list_slice(w, s, s + least(len(w), {WINDOW}) - 1), ' ') AS phrase
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - {WINDOW} + 1))) AS s) WHERE len(w) > 0),
grams AS (
  SELECT doc_id, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS phrase
  FROM d, (SELECT DISTINCT size FROM win) AS sizes,
       LATERAL (SELECT unnest(generate_series(1, len(w) - size + 1)) AS s) WHERE len(w) >= size),
found AS (SELECT g.doc_id, g.s, g.size, win.item_id FROM grams g JOIN win USING (size, phrase)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id),
tokens AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
counts AS (SELECT lower(word) AS k, count(*) AS n FROM tokens GROUP BY 1),
rows AS (SELECT row_number() OVER () AS iid, item_id, w, least(len(w), {WINDOW}) AS size FROM b WHERE len(w) > 0),
spots AS (
  SELECT iid, s, p, lower(w[p]) AS k
  FROM rows, LATERAL (SELECT unnest(generate_series(1, len(w) - size + 1)) AS s),
       LATERAL (SELECT unnest(generate_series(s, s + size - 1)) AS p)),
ranked AS (
  SELECT iid, s, p, k, row_number() OVER (PARTITION BY iid, s ORDER BY n, p) AS r, count(*) OVER (PARTITION BY iid, s) AS of
  FROM spots JOIN counts USING (k)),
anchors AS (
  SELECT a.iid, a.s, a.p AS p1, a.k AS k1, c.p AS p2, c.k AS k2
  FROM ranked a JOIN ranked c ON a.iid = c.iid AND a.s = c.s AND a.r = 1 AND c.r = least(2, c.of)),
places AS (SELECT doc_id, lower(word) AS k, p FROM tokens WHERE lower(word) IN (SELECT k1 FROM anchors UNION SELECT k2 FROM anchors)),
met AS (
  SELECT DISTINCT x.doc_id, a.iid, a.s, x.p AS spot
  FROM anchors a JOIN places x ON x.k = a.k1
  JOIN places y ON y.k = a.k2 AND y.doc_id = x.doc_id AND abs((y.p - a.p2) - (x.p - a.p1)) <= {SLOP}
                AND (a.p1 <> a.p2 OR x.p = y.p)),
nearby AS (
  SELECT DISTINCT met.doc_id, CAST(rows.item_id AS VARCHAR) AS id
  FROM met JOIN rows USING (iid) JOIN d USING (doc_id)
  WHERE len(list_intersect(list_slice(d.w, greatest(spot - {WINDOW - 1}, 1), spot + {WINDOW - 1}),
                           list_slice(rows.w, s, s + size - 1)))
        >= ceil(len(list_distinct(list_slice(rows.w, s, s + size - 1))) * {NEAR_SHARE}) AND item_id IS NOT NULL),
near_items AS (
  SELECT doc_id, count(*) AS n_near FROM (
    SELECT * FROM nearby EXCEPT SELECT doc_id, CAST(item_id AS VARCHAR) FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""
