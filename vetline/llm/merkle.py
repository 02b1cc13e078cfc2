"""Merkle manifest of a table: one tree per group, one tree over the groups.

Leaves get their places by a distributed rank, so a group may hold most of the
table. Each level is a slot pivot: conditional aggregates spread the children of
a parent into ``FANOUT`` columns; the concatenated columns hash to the parent,
and the columns before and behind a child's own slot are its siblings. Levels
are stored tables, each a ``FANOUT``-th of the one below. On the way down every
node joins its parent's row once, so a leaf ends up with its whole proof: the
siblings before and behind it for every level up to the root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.llm.common import ascii_lower, stored, table
from vetline.llm.ordering import ranked

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
GROUP, ORDER = "source", "doc_id"

_PATH = "array<struct<before:string,behind:string>>"


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def encoded(c: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its UTF-8 byte count,
    a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return digest(F.concat(*map(encoded, values)))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings, bottom level first, lead to."""
    return F.aggregate(path, leaf, lambda node, level: digest(F.concat(level["before"], node, level["behind"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, bottom level first, left to right."""
    return digest(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["behind"])), ""))


def _slots(fanout: int) -> list[str]:
    return [f"slot_{i}" for i in range(fanout)]


def _siblings(fanout: int, own: Column) -> Column:
    """The slot columns before and behind ``own``."""
    before = F.concat_ws("", *[F.when(own > i, F.col(s)) for i, s in enumerate(_slots(fanout))])
    behind = F.concat_ws("", *[F.when(own < i, F.col(s)) for i, s in enumerate(_slots(fanout))])
    return F.struct(before.alias("before"), behind.alias("behind"))


def grow(nodes: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, list[DataFrame]]:
    """``nodes`` (``tree``, ``pos`` from 0, ``hash``, ``n`` nodes in the tree) to
    the roots (``tree``, ``root``) and the pivoted levels, bottom first. A level
    row is a parent: ``tree``, ``pos``, its slots, ``hash`` and ``n`` parents in
    the tree. A tree of one node is its own root."""
    slots, levels, roots = _slots(fanout), [], []
    while True:
        roots.append(nodes.filter("n = 1").select("tree", F.col("hash").alias("root")))
        rising = nodes.filter("n > 1")
        if rising.isEmpty():
            return reduce(DataFrame.unionByName, roots), levels
        own = F.pmod("pos", F.lit(fanout))
        pivot = rising.groupBy("tree", F.floor(F.col("pos") / fanout).cast("long").alias("pos")).agg(
            *[F.max(F.when(own == i, F.col("hash"))).alias(s) for i, s in enumerate(slots)],
            F.ceil(F.max("n") / fanout).cast("long").alias("n"))
        levels.append(stored(pivot.withColumn("hash", digest(F.concat_ws("", *slots))), "level"))
        nodes = levels[-1]


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` with ``path`` (siblings of every level, bottom first) and the
    columns of ``tops``: one row per ``tree`` with ``path`` above its root."""
    told = [c for c in tops.columns if c not in ("tree", "path")]
    above = None  # (tree, pos, path, told) of the nodes of the level at hand
    for level in reversed(levels):
        final = level.filter("n = 1").join(tops, "tree")
        inner = level.filter("n > 1")
        known = final if above is None else final.unionByName(inner.join(above, ["tree", "pos"]))
        if level is levels[0]:
            above = known
            break
        slot = F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("slot")
        spread = known.select("*", slot).filter(F.array(*_slots(fanout))[F.col("slot")].isNotNull())
        above = stored(spread.select(
            "tree", (F.col("pos") * fanout + F.col("slot")).alias("pos"),
            F.concat(F.array(_siblings(fanout, F.col("slot"))), "path").alias("path"), *told), "paths")
    alone = leaves.filter("n = 1").join(tops, "tree")
    if above is None:
        return alone
    parents = above.select("tree", F.col("pos").alias("__parent"), "path", *told, *_slots(fanout))
    below = leaves.filter("n > 1").withColumn("__parent", F.floor(F.col("pos") / fanout).cast("long"))
    found = below.join(parents, ["tree", "__parent"]).withColumn(
        "path", F.concat(F.array(_siblings(fanout, F.pmod("pos", F.lit(fanout)))), "path"))
    return alone.unionByName(found.select(alone.columns))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, group: str = GROUP, order: str = ORDER, text: str = "text",
             tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per input row: ``order`` column, ``leaf``, ``tampered`` (the leaf
    that the altered row has; null where nothing changes), ``subroot``, ``root``
    and ``path``.

    Leaves stand in their group by ``order``, nulls first, rows that repeat it
    by leaf (equal rows are equal leaves, so nothing is left open); groups stand
    by their UTF-8 bytes, null first. ``tampered`` says which rows are altered:
    A-Z of ``text`` lower-cased. Columns other than ``fields`` are not read, so
    clashing names cannot meet; an empty table has an empty manifest."""
    values = {f: F.col(f) for f in fields}
    altered = leaf_digest([ascii_lower(values[f]) if f == text else values[f] for f in fields])
    read = docs.select(values[order].alias("id"), values[group].alias("group"), encoded(values[group]).alias("tree"),
                       leaf_digest(list(values.values())).alias("hash"),
                       F.when(tampered, altered).alias("tampered") if tampered is not None
                       else F.lit(None).cast("string").alias("tampered"))
    leaves = stored(ranked(stored(read, "leaves"), "tree", ["id", "hash"], "pos", "n"), "ranked")
    roots, levels = grow(leaves, fanout)

    # The groups' roots are the leaves of the tree over the groups.
    names = leaves.groupBy("tree").agg(F.first("group").alias("group"))
    subroots = stored(roots.join(names, "tree").select(
        F.lit("all").alias("tree"), F.col("tree").alias("of"), "group", F.col("root").alias("hash")), "subroots")
    subroots = stored(ranked(subroots, "tree", ["group"], "pos", "n"), "ranked")
    top, upper = grow(subroots, fanout)
    peak = stored(top.select("tree", "root", F.array().cast(_PATH).alias("path")), "root")
    tops = stored(descend(subroots, upper, peak, fanout).select(
        F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", "path"), "tops")
    return descend(leaves, levels, tops, fanout).select(
        F.col("id").alias(order), F.col("hash").alias("leaf"), "tampered", "subroot", "root", "path")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = manifest(table(spark, sf_dir, "documents"), tampered=changed)
    root = folded(F.col("path"), F.coalesce("tampered", "leaf"))
    return (rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                        root.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


# crc32 bit by bit (reflected polynomial 0xEDB88320), the trees as recursive
# levels, proofs as a second recursion from the leaves up.
OP12_SQL = """
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, source, concat_ws('',
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'),
      coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    4294967295 - list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(
        range(8 * length(doc_id::VARCHAR)),
        lambda k: CASE WHEN k % 8 = 0 THEN ord(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1))::BIGINT ELSE 0::BIGINT END)),
      lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) >> 1, 3988292384::BIGINT) ELSE xor(c, b) >> 1 END) AS crc
  FROM documents
), leaves AS MATERIALIZED (
  SELECT doc_id, source, leaf, CASE WHEN crc % 5 = 0 THEN changed ELSE leaf END AS used,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
          sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) AS changed FROM docs)
), tree AS (
  SELECT source, 0 AS lvl, pos, leaf AS hash, n FROM leaves
  UNION ALL
  SELECT source, any_value(lvl) + 1, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM tree WHERE n > 1 GROUP BY source, pos // 16
), subs AS MATERIALIZED (
  SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS lvl, pos, hash, n FROM subs
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM top WHERE n > 1 GROUP BY pos // 16
), nodes AS MATERIALIZED (
  SELECT t.source, t.lvl, t.pos, t.pos // 16 AS run, t.hash, t.n,
    coalesce(string_agg(t.hash, '') OVER before_it, '') AS before,
    coalesce(string_agg(t.hash, '') OVER behind_it, '') AS behind
  FROM tree t
  WINDOW before_it AS (PARTITION BY source, lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         behind_it AS (PARTITION BY source, lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), peaks AS MATERIALIZED (
  SELECT lvl, pos, hash, n,
    coalesce(string_agg(hash, '') OVER before_it, '') AS before,
    coalesce(string_agg(hash, '') OVER behind_it, '') AS behind
  FROM top
  WINDOW before_it AS (PARTITION BY lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         behind_it AS (PARTITION BY lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), rise AS (
  SELECT source, pos AS leaf_pos, 0 AS lvl, pos, used AS node, '' AS proof, n FROM leaves
  UNION ALL
  SELECT r.source, r.leaf_pos, r.lvl + 1, r.pos // 16, sha256(x.before || r.node || x.behind),
    r.proof || x.before || x.behind, (r.n + 15) // 16
  FROM rise r JOIN nodes x ON x.source IS NOT DISTINCT FROM r.source AND x.lvl = r.lvl AND x.pos = r.pos
  WHERE r.n > 1
), climb AS (
  SELECT r.source, r.leaf_pos, 0 AS lvl, s.pos, r.node, r.proof, s.n
  FROM rise r JOIN subs s ON s.source IS NOT DISTINCT FROM r.source WHERE r.n = 1
  UNION ALL
  SELECT c.source, c.leaf_pos, c.lvl + 1, c.pos // 16, sha256(x.before || c.node || x.behind),
    c.proof || x.before || x.behind, (c.n + 15) // 16
  FROM climb c JOIN peaks x ON x.lvl = c.lvl AND x.pos = c.pos
  WHERE c.n > 1
)
SELECT l.doc_id, l.leaf, s.hash AS subroot, p.hash AS root, sha256(c.proof) AS proof_sha256,
  c.node AS folded_root, c.node = p.hash AS verified
FROM leaves l
JOIN subs s ON s.source IS NOT DISTINCT FROM l.source
JOIN climb c ON c.source IS NOT DISTINCT FROM l.source AND c.leaf_pos = l.pos AND c.n = 1
JOIN top p ON p.n = 1
"""
