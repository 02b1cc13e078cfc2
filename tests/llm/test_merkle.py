import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from vetline.llm.merkle import OP12_SQL, folded, manifest, op12_merkle_manifest
from vetline.llm.ordering import ranked

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(hashes, at, fanout):
    """Root of a list of digests and the (before, behind) pairs above one of them."""
    path = []
    while len(hashes) > 1:
        start = at // fanout * fanout
        path.append(("".join(hashes[start:at]), "".join(hashes[at + 1:start + fanout])))
        hashes = [h(*hashes[i:i + fanout]) for i in range(0, len(hashes), fanout)]
        at //= fanout
    return hashes[0], path


def brute(rows, fanout=16):
    groups = {}
    for r in rows:
        leaf = h(*map(encoded, r))
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        used = h(*map(encoded, (*r[:4], lowered(r[4])))) if changed else leaf
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0, leaf), used))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots = []
    for name in names:
        groups[name].sort()
        subroots.append(climb([g[0][2] for g in groups[name]], 0, fanout)[0])
    out = []
    for i, name in enumerate(names):
        root, top = climb(subroots, i, fanout)
        hashes = [g[0][2] for g in groups[name]]
        for at, ((has, doc_id, leaf), used) in enumerate(groups[name]):
            path = climb(hashes, at, fanout)[1] + top
            node = used
            for before, behind in path:
                node = h(before, node, behind)
            out.append((doc_id if has else None, leaf, subroots[i], root, h(*[x for p in path for x in p]), node, node == root))
    return sorted(out, key=str)


def of(df):
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()], key=str)


def rows_of(counts, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            i += 1
            rows.append((i, source, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(["Ab", "x", "", None, "Ébène B"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("counts", [
    {"a": 1}, {"a": 16}, {"a": 17}, {"a": 300, None: 33, "": 2, "é": 1, "z": 16}, {f"s{i}": 1 + i % 18 for i in range(40)}])
def test_query_against_brute_force(spark, tmp_path, counts):
    rows = rows_of(counts)
    rows += [(None, *r[1:]) for r in rows[:2]] + rows[:3]
    if len(counts) == 1 and counts["a"] == 1:
        rows = rows[:1]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", tree string, pos int").write.parquet(f"{tmp_path}/documents.parquet")
    assert of(op12_merkle_manifest(spark, str(tmp_path))) == brute(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert of(op12_merkle_manifest(spark, str(tmp_path))) == []


def test_very_long_text(spark, tmp_path):
    rows = [(1, "a", "en", 1, "Long " * 300_000), (2, "a", "en", 1, "b")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert of(op12_merkle_manifest(spark, str(tmp_path))) == brute(rows)


def test_untampered_rows_verify_with_another_fanout(spark):
    docs = spark.createDataFrame(rows_of({"a": 30, "b": 7}), SCHEMA)
    rows = manifest(docs, fanout=3).withColumn("again", folded(F.col("path"), F.col("leaf"))).collect()
    assert len(rows) == 37 and all(r.again == r.root and r.tampered is None for r in rows)


def test_ranked_spreads_one_group(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.expr("pmod(id * 7919, 5000)").alias("v"))
    got = ranked(df, "g", ["v"], "pos", "n").collect()
    assert all(r.pos == r.v and r.n == 5000 for r in got) and len(got) == 5000


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(OP12_SQL).fetchall(), key=str)
    assert of(op12_merkle_manifest(spark, sf)) == want
