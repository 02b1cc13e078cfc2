import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vetline.llm import conversations as C
from vetline.llm.conversations import block_step, damaged, op13_conversation_repair, repair, repaired_rows, step, times

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256().hexdigest()
GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def prefix_ok(initials):
    return any(GRAMMAR.fullmatch(initials + tail) for tail in ("", "a", "ua"))


def cheapest(rows, faults):
    """Uniform-cost search over audits; the state is what has been written, as
    far as the pattern needs it, told by trying the pattern itself."""
    memo = lambda s: (s[:1] == "s", len(s.lstrip("s")) % 2, bool(s))
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, made = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, "\n".join(made)
        if (i, memo(initials)) in seen:
            continue
        seen.add((i, memo(initials)))
        moves = [(5, "I", i, r[0], (f"{r}:",)) for r in ("user", "assistant")]
        if i < len(rows):
            _, _, role, text = rows[i]
            moves.append((2, "D", i + 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    moves.append((extra, "K", i + 1, role[0], (f"{role}:{text}",)))
                moves += [(1 + extra, "R", i + 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
        for more, name, to, written, lines in moves:
            if prefix_ok(initials + written):
                heapq.heappush(heap, (cost + more, audit + name, to, initials + written, made + lines))


def brute(rows):
    out = {}
    hurt = brute_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, seen = [], set()
        for r in mine:
            bare = r[3].strip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if r[2:] in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add(r[2:])
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, text = cheapest(mine, faults)
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def of(df):
    rows = df.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def made_up(n, seed, most=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "Äh"])
            text = rng.choice(["Hi.", "Ok!", "Why? ", "cut", "cut,\n", "", "  \t", None, f"Text {turn}.", f"Other {turn}", "é…"])
            rows.append((conv if conv % 17 else None, rng.choice([turn, turn, turn + rng.randint(0, 4), None]), role, text))
    rng.shuffle(rows)
    return rows


def test_steps_are_a_shortest_path():
    for symbol in range(12):
        s = step(symbol)
        assert (times(s, times(s, s)) == block_step([symbol] * 3)).all()
    rng = random.Random(1)
    for _ in range(50):
        seq = [rng.randrange(12) for _ in range(rng.randint(1, 12))]
        whole = step(seq[0])
        for x in seq[1:]:
            whole = times(whole, step(x))
        assert (block_step(seq) == whole).all()
        right = np.array([0, 10, 5, 0])
        for i, cost in enumerate(C.costs(seq, right)):
            assert cost == (times(block_step(seq[i:]), right) if i < len(seq) else right).tolist()


@pytest.mark.parametrize("bits", [12, 1])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    rows = made_up(150, 3)
    rows += rows[:20]
    spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA + ", conv string, mid int").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert of(op13_conversation_repair(spark, str(tmp_path))) == brute(rows)


def test_one_huge_conversation_lies_in_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BITS", 6)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b!", f"{t}.", "cut"])) for t in range(1500)]
    rows += [(2, t, "user", "x.") for t in range(700)] + [(3, 0, "user", "long " * 300_000 + ".")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert of(op13_conversation_repair(spark, str(tmp_path))) == brute(rows)


def test_repaired_rows_follow_the_pattern(spark):
    messages = spark.createDataFrame(made_up(60, 5), SCHEMA)
    rows, _, _, made = repair(damaged(messages))
    found = {}
    for r in sorted(repaired_rows(rows, made).collect(), key=lambda r: (r.mid, r["at"])):
        found[r.conv] = found.get(r.conv, "") + r.role[0]
    assert found and all(GRAMMAR.fullmatch(v) for v in found.values())


def test_empty_table_and_a_conversation_that_is_dropped(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert of(op13_conversation_repair(spark, f"{tmp_path}/a")) == {}
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert of(op13_conversation_repair(spark, f"{tmp_path}/b")) == {gone: (0, 0, 0, 0, 0, 0, "", EMPTY)}


def test_sql_agrees_with_brute_force():
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    rows = made_up(60, 8) + made_up(10, 9)
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in con.execute(C.OP13_SQL).fetchall()} == brute(rows)


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert of(op13_conversation_repair(spark, sf)) == brute(rows)
