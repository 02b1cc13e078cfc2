import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from vetline.llm import packing
from vetline.llm.packing import (CAPACITY, VOCABULARY, ByteLevelEncoder, best_fit, op11_best_fit_packing, pack,
                                 packed_documents, piece_lengths, sequences)

PATH = P.path(VOCABULARY)


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(known):
    own = ByteLevelEncoder(open(PATH, encoding="utf-8").read())
    assert own.plain
    random.seed(5)
    parts = ["a", "The", "'s", "'S", "'", "\n", " ", "  ", "é", "日本", "1", "22", "²", "!", "***", "\x1c", "\x85", "\xa0",
             "　", "ß", "×", "😀", "’s", "\r\n", "\t", "<|endoftext|>", "<|", "|>", "\xad", "\x7f", "don't", "é"]
    for _ in range(6000):
        text = "".join(random.choices(parts, k=random.randint(0, 10)))
        got = np.frombuffer(own.encode(text), own.kind).tolist()
        assert got == known.encode(text, add_special_tokens=False).ids, repr(text)


def test_another_file_goes_through_the_library():
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["normalizer"] = {"type": "Lowercase"}
    other = Tokenizer.from_str(json.dumps(spec))
    own = ByteLevelEncoder(json.dumps(spec))
    assert not own.plain
    for text in ("Word Two", "ABC def\n", ""):
        assert np.frombuffer(own.encode(text), own.kind).tolist() == other.encode(text, add_special_tokens=False).ids


def test_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BYTES", 2_000)
    own = ByteLevelEncoder(open(PATH, encoding="utf-8").read())
    for i in range(200):
        own.encode(f"word{i} " + "x" * 2_000)
    assert own.parts.held <= 2_000 and all(len(k) <= packing.MEMO_KEY for k in own.parts | own.parts.old)
    assert 0 < len(own.parts) + len(own.parts.old) < 30


def test_piece_lengths():
    assert piece_lengths(1, 4) == [1] and piece_lengths(4, 4) == [4]
    assert piece_lengths(5, 4) == [1, 4] and piece_lengths(8, 4) == [4, 4] and piece_lengths(11, 4) == [3, 4, 4]


def brute_best_fit(lengths, capacity):
    bins = []
    for size in sorted(lengths, reverse=True):
        rooms = [capacity - sum(b) for b in bins]
        fitting = [r for r in rooms if r >= size]
        if fitting:
            bins[rooms.index(min(fitting))].append(size)
        else:
            bins.append([size])
    return sorted(sorted(b) for b in bins)


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 60, 300):
        lengths = rng.integers(1, 31, n)
        opener, offset, used = best_fit(lengths, 32)
        own = {}
        for i in np.argsort(offset, kind="stable"):
            got = own.setdefault(opener[i], [])
            assert sum(got) == offset[i]
            got.append(int(lengths[i]))
        assert all(sum(b) == used[o] <= 32 for o, b in own.items())
        # Which of several equally full bins takes an item is open.
        assert len(own) == len(brute_best_fit(lengths.tolist(), 32))


def held(rows, capacity):
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.setdefault(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] += r.length
    assert max(bins.values(), default=0) <= capacity
    return bins


@pytest.mark.parametrize("kind", ["mixed", "large", "small", "halves"])
def test_rounds_keep_every_item_and_lose_no_merge(spark, kind):
    rng = np.random.default_rng(7)
    sizes = {"mixed": rng.integers(1, 101, 3000), "large": rng.integers(55, 101, 3000),
             "small": rng.integers(1, 9, 3000), "halves": np.full(3001, 50)}[kind]
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "uid long, length long")
    got = items.join(pack(items, 100, node_items=500, fanout=2), "uid").collect()
    assert sorted((r.uid, r.length) for r in got) == list(enumerate(sizes.tolist()))
    bins = held(got, 100)
    # No two sequences left could be one.
    low = sorted(bins.values())[:2]
    assert sum(low) > 100
    whole = len(best_fit(sizes, 100)[0]) and len(set(best_fit(sizes, 100)[0].tolist()))
    assert len(bins) <= whole * 1.02 + 1


def test_documents_against_brute_force(spark, known, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 3_000)
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["the", "Wört", "of", "12", "naïve", "***", "日本"], k=rng.randint(1, 900))) for _ in range(60)]
    texts += [None, "", "a", "a", "long " * 5000, "x" * 100_000, "a\n\n b  c"]
    rows = [(i if i % 9 else None, t, "clash", i) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string, length long")
    packed = packed_documents(docs, PATH)
    got = packed.collect()
    want = []
    for doc_id, text, _, _ in rows:
        ids = known.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for i, n in enumerate(piece_lengths(len(ids), CAPACITY)):
            want.append((doc_id, i, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())))
            at += n
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    bins = held(got, CAPACITY)
    assert len(bins) <= -(-sum(w[3] for w in want) // CAPACITY) + 2
    pieces = {r.uid: bytes(r.ids) for r in got}
    for s in sequences(packed).collect():
        assert bytes(s.ids) == b"".join(pieces[u] for u in s.uids) and len(s.ids) == 2 * s.n_tokens == 2 * bins[s.sequence_id]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packed_documents(docs, PATH).collect() == []


def test_query_covers_every_document(spark):
    sf = "/root/testdata/sf0.001"
    got = op11_best_fit_packing(spark, sf).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    bins = held(got, CAPACITY)
    assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // CAPACITY) + 1
