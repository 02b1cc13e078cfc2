import hashlib

import pytest

from vetline.llm.sharding import SHARD_NAMES, TABLE_SIZE, fill_table, op4_sharding, placement, sharded, write_sharded


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def plain_fill(shards, size):
    """Whole preference lists, scanned from the front at every turn."""
    prefs = [[(number(f"start:{s}") + k * (number(f"step:{s}") % (size - 1) + 1)) % size for k in range(size)] for s in shards]
    owner, turn = {}, 0
    while len(owner) < size:
        i = turn % len(shards)
        owner[next(slot for slot in prefs[i] if slot not in owner)] = i
        turn += 1
    return [owner[s] for s in range(size)]


def test_table():
    assert fill_table([f"s{i}" for i in range(7)], 211) == plain_fill([f"s{i}" for i in range(7)], 211)
    table = fill_table(SHARD_NAMES)
    shares = [table.count(i) for i in range(len(SHARD_NAMES))]
    assert max(shares) - min(shares) <= 1 and sum(shares) == TABLE_SIZE
    fewer = fill_table(SHARD_NAMES[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(SHARD_NAMES) - 1)
    assert moved < 0.05 * TABLE_SIZE
    for bad in (["a", "a"], []):
        with pytest.raises(ValueError):
            fill_table(bad, 11)
    with pytest.raises(ValueError):
        fill_table(["a"], 12)


def test_placement(spark, tmp_path):
    rows = [(i, "x" * i, "clash") for i in range(50)] + [(None, None, None), (7, "again", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    table = fill_table(["a", "b", "c"], 101)
    out = placement(df, "doc_id", ["a", "b", "c"], 101)
    assert out.columns == ["doc_id", "text", "slot", "shard"] and out.count() == 52
    for r in out.collect():
        slot = number("" if r.doc_id is None else str(r.doc_id)) % 101
        assert (r.slot, r.shard) == (slot, "abc"[table[slot]])
    assert placement(df.limit(0), "doc_id", ["a"], 101).count() == 0
    write_sharded(df, "doc_id", ["a", "b", "c"], str(tmp_path / "out"), 101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 52


def test_query_reads_what_it_wrote(spark, tmp_path):
    rows = [(i, f"text {i}", "s") for i in range(300)] + [(7, "again", "hot")] * 200 + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(repr, sharded(df, "doc_id", SHARD_NAMES).collect())) == sorted(map(repr, placement(df, "doc_id", SHARD_NAMES).collect()))
    df.write.parquet(str(tmp_path / "a/documents.parquet"))
    out = op4_sharding(spark, str(tmp_path / "a"))
    want = placement(df.select("doc_id", "source"), "doc_id", SHARD_NAMES)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    assert out.inputFiles() and all("/shard=shard-" in f for f in out.inputFiles())
    df.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert op4_sharding(spark, str(tmp_path / "b")).count() == 0
