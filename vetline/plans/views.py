"""Review-domain views over the driver's tables, in Spark SQL and DuckDB.

The raw tables hold none of the screening cues, so the review queries read
two derived views:

* ``places``  - every ``part`` row is a place; its description is the part
  name and type plus the *whole* text of the document whose id equals the
  part key (when there is one).
* ``reviews`` - every ``events`` row is a review: its user and time, the
  whole text of one document (``event_id`` modulo the document count) with a
  cue appended by ``event_id % 9`` so every rule has positives and negatives,
  and one of all places. ``row_no`` tells the rows apart. Every ``nation`` row
  adds a review with the text 'ok', '' or NULL that repeats a ``review_id``.

No table is filtered and no text is cut. The SQL is rendered for either
engine; only the epoch-millisecond expression differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_EPOCH_MS = {
    "spark": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {x})",
    "duckdb": "(epoch_us({x}) // 1000)",
}

_PLACES = """
places AS (
  SELECT concat('p', CAST(p.p_partkey AS STRING)) AS place_id,
         p.p_name AS place_name, p.p_type AS place_category, p.p_brand AS city,
         concat(p.p_name, ' ', p.p_type, '. ', coalesce(dp.text, '')) AS description,
         CAST((p.p_partkey * 7) % 170 - 85 AS DOUBLE) AS place_lat,
         CAST((p.p_partkey * 13) % 360 - 180 AS DOUBLE) AS place_lon
  FROM part p LEFT JOIN documents dp ON dp.doc_id = p.p_partkey
)"""

# Columns of a review but its text and document, from ``b`` (its events or
# nation row) and ``p`` (its place).
_REVIEW_HEAD = """concat('r', CAST(b.review_no AS STRING)) AS review_id, b.row_no, b.doc_id, b.pk,
    CASE WHEN b.row_no % 23 = 22 THEN NULL ELSE concat('p', CAST(b.pk AS STRING)) END AS place_id,
    p.p_name AS place_name, p.p_type AS place_category, p.p_brand AS city, {text}
    CAST(b.row_no % 5 + 1 AS DOUBLE) AS rating,
    CASE abs(b.row_no) % 4
      WHEN 0 THEN CAST({epoch_ms_ts} AS STRING)
      WHEN 1 THEN CAST(b.ts AS STRING)
      WHEN 2 THEN concat(CAST(b.ts AS STRING), '+02:00')
      ELSE CASE WHEN b.row_no % 8 = 3 THEN 'yesterday' ELSE NULL END END AS created_at,
    CASE WHEN b.row_no % 10 = 9 THEN NULL ELSE concat('u', CAST(b.user_id AS STRING)) END AS user_id,
    CASE abs(b.row_no) % 7 WHEN 0 THEN 'Ola Berg' WHEN 1 THEN 'qRt55zz' WHEN 2 THEN 'Hirsch Schmidt'
      WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'EEEEE7777' ELSE b.c_name END AS user_name,
    CASE abs(b.row_no) % 5 WHEN 0 THEN '[]' WHEN 1 THEN '["http://a/1","http://a/2"]'
      WHEN 2 THEN 'http://a/1; http://a/2;' WHEN 3 THEN '' ELSE '{{"k":1}}' END AS pics,
    CASE WHEN b.row_no % 6 = 5 THEN NULL ELSE CAST((b.pk * 7) % 170 - 85 AS DOUBLE)
      + CASE WHEN b.row_no % 3 = 0 THEN 0.1 ELSE 4.0 END END AS user_lat,
    CAST((b.pk * 13) % 360 - 180 AS DOUBLE) AS user_lon"""

_CUED_TEXT = """CASE {key} % 9
        WHEN 1 THEN concat(d.text, ' See http://offers.example/x for a coupon!')
        WHEN 2 THEN concat(d.text, ' I did not go but people say it is awful.')
        WHEN 3 THEN concat(d.text, ' sooooooo nice!!!!!!')
        WHEN 4 THEN concat(d.text, ' I ordered from the menu and we were seated near the parking.')
        WHEN 5 THEN concat(d.text, ' damn stupid place, what the hell')
        WHEN 6 THEN concat(d.text, ' 很好 😀😀')
        WHEN 7 THEN concat(d.text, ' buy now www.offers.example $$$$$$')
        WHEN 8 THEN concat(d.text, ' A &amp; B &lt;b&gt;bold&lt;/b&gt; <i>tag</i>')
        ELSE d.text END"""

_NATION_ROWS = """SELECT -1 - n.n_nationkey, n.n_nationkey, n.n_nationkey,
      CASE n.n_nationkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN '' ELSE NULL END,
      n.n_regionkey, e.ts, n.n_name, n.n_nationkey % {n_parts}
    FROM nation n LEFT JOIN events e ON e.event_id = n.n_nationkey"""

_REVIEWS = f"""
reviews AS (
  SELECT {_REVIEW_HEAD.replace("{text}", "b.text,")}
  FROM (
    SELECT e.event_id AS row_no, e.event_id AS review_no, d.doc_id,
      {_CUED_TEXT.replace("{key}", "e.event_id")} AS text,
      e.user_id, e.ts, c.c_name, e.event_id % {{n_parts}} AS pk
    FROM events e
    LEFT JOIN documents d ON d.doc_id = e.event_id % {{n_docs}}
    LEFT JOIN customer c ON c.c_custkey = e.user_id
    UNION ALL
    {_NATION_ROWS}
  ) b
  LEFT JOIN part p ON p.p_partkey = b.pk
)"""

# The same rows for Spark in two steps: everything but the documents first, and
# the texts last, so that no join or exchange moves a text.
_SLIM_REVIEWS = f"""
  SELECT {_REVIEW_HEAD.replace("{text}", "b.own_text, b.doc_key, b.extra,")}
  FROM (
    SELECT e.event_id AS row_no, e.event_id AS review_no, CAST(NULL AS BIGINT) AS doc_id,
      CAST(NULL AS STRING) AS own_text, e.user_id, e.ts, c.c_name, e.event_id % {{n_parts}} AS pk,
      e.event_id % {{n_docs}} AS doc_key, false AS extra
    FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
    UNION ALL
    SELECT *, NULL, true FROM ({_NATION_ROWS})
  ) b
  LEFT JOIN part p ON p.p_partkey = b.pk"""

_TEXT_COLUMNS = {
    "doc_id": "CASE WHEN s.extra THEN s.doc_id ELSE d.doc_id END AS doc_id",
    "text": f"CASE WHEN s.extra THEN s.own_text ELSE {_CUED_TEXT.replace('{key}', 's.row_no')} END AS text",
}
_COLUMNS = ("review_id row_no doc_id pk place_id place_name place_category city text rating created_at user_id "
            "user_name pics user_lat user_lon").split()


def view_ctes(dialect: str, n_docs: int | str = "(SELECT count(*) FROM documents)",
              n_parts: int | str = "(SELECT count(*) FROM part)") -> str:
    """``places AS (...), reviews AS (...)`` for a WITH clause; the two row
    counts as numbers or as subqueries."""
    reviews = _REVIEWS.format(epoch_ms_ts=_EPOCH_MS[dialect].format(x="b.ts"), n_docs=n_docs, n_parts=n_parts)
    return _PLACES.strip() + ",\n" + reviews.strip()


def with_views(dialect: str, body_ctes: str = "", select: str = "", **counts: int) -> str:
    """Full statement: ``WITH places, reviews[, body_ctes] select``."""
    ctes = view_ctes(dialect, **counts)
    if body_ctes.strip():
        ctes += ",\n" + body_ctes.strip()
    return f"WITH {ctes}\n{select}"


def register_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | list[str] = TABLES) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Reviews a task holds before their texts join, at most.
TASK_REVIEWS = 200_000
# What a review needs beside its ``row_no`` for its text.
TEXT_KEYS = ["own_text", "doc_key", "extra"]


def review_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``reviews`` without their documents: ``TEXT_KEYS`` stand for
    the texts, that :func:`with_texts` adds after other joins and exchanges."""
    register_tables(spark, sf_dir, ("part", "events", "customer", "documents", "nation"))
    counts = {"n_docs": load(spark, sf_dir, "documents").count(), "n_parts": load(spark, sf_dir, "part").count()}
    return spark.sql(_SLIM_REVIEWS.format(epoch_ms_ts=_EPOCH_MS["spark"].format(x="b.ts"), **counts))


def with_texts(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """Adds ``text`` to rows with ``row_no`` and ``TEXT_KEYS`` (and completes
    ``doc_id`` where it is there)."""
    register_tables(spark, sf_dir, ("documents",))
    # the rows are dealt while they are short, by the key that the join needs; a few
    # tasks a core even out long texts, and more would each count the same terms again
    tasks = max(3 * spark.sparkContext.defaultParallelism, load(spark, sf_dir, "events").count() // TASK_REVIEWS)
    columns = ", ".join(_TEXT_COLUMNS.get(c, f"s.`{c}`") for c in [*keys.columns, "text"])
    return spark.sql(f"SELECT {columns} FROM {{slim}} s LEFT JOIN documents d ON d.doc_id = s.doc_key",
                     slim=keys.repartition(tasks, "doc_key"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_texts(spark, sf_dir, review_keys(spark, sf_dir)).select(*_COLUMNS)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the statement names the tables of both views
    register_tables(spark, sf_dir, ("part", "events", "customer", "documents", "nation"))
    return spark.sql(with_views("spark", select="SELECT * FROM places"))
