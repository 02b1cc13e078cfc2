import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vetline.llm import tokenfile
from vetline.llm.common import scratch
from vetline.llm.tokenfile import (VOCABULARY, WordEncoder, build_hash, build_index, find_slots, lookup,
                                   op3_token_shards, read_documents, write_shards)

PATH = P.path(VOCABULARY)


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(known):
    own = WordEncoder(open(PATH, encoding="utf-8").read())
    random.seed(3)
    parts = ["a", "The", "'S", "'", "\n", " ", "é", "É", "é", "日本", "1", "22", "!", "\x1c", "\x85", "ΑΣ", "İ",
             "ß", "×", "÷", "😀", "’s", "\r\n", "<|endoftext|>", "<|", "|>", "­", "\x7f", "don't", "ÀÉ'Ll"]
    for _ in range(4000):
        text = "".join(random.choices(parts, k=random.randint(0, 9)))
        got = np.frombuffer(own.encode(text.encode()), own.kind).tolist()
        assert got == known.encode(text, add_special_tokens=False).ids, repr(text)


def test_texts_are_encoded_together(known, monkeypatch):
    """Chunks of many texts are looked up once for a slice, whatever its bounds
    and however often the memo is cleared."""
    monkeypatch.setattr(tokenfile, "SLICE_BYTES", 300)
    monkeypatch.setattr(tokenfile, "MEMO_ENTRIES", 20)
    own = WordEncoder(open(PATH, encoding="utf-8").read())
    random.seed(5)
    blanks = [" ", "\n", "\t\t", "\r\n", "\x0b", "\x0c ", "\x1c", "\x85", "\xa0"]
    words = ["a", "The", "don't", "É", "日本", "12", "!?", "<|endoftext|>", "straße", "İ", "x-y"] + [f"w{i}q" for i in range(60)]
    texts = [None, "", " ", "\n\x0b"] + ["".join(random.choice(words) + random.choice(blanks) for _ in range(random.randint(0, 40))) for _ in range(200)]
    texts += [random.choice(blanks) + t for t in texts[-50:]]
    column = pa.array([t if t is None else t.encode() for t in texts], pa.binary())
    asked = []
    chunks = own._chunks
    monkeypatch.setattr(own, "_chunks", lambda raw: asked.extend([len(raw), len(set(raw))]) or chunks(raw))
    for part in (column, column.slice(3, 100)):
        for text, ids in zip(part.to_pylist(), own.encode_all(part), strict=True):
            assert np.frombuffer(ids, own.kind).tolist() == known.encode((text or b"").decode(), add_special_tokens=False).ids, repr(text)
    assert asked[::2] == asked[1::2] and max(asked) <= 300


def test_another_file_goes_through_the_library():
    spec = open(PATH, encoding="utf-8").read()
    assert WordEncoder(spec).known
    parsed = json.loads(spec)
    parsed["normalizer"]["normalizers"] = parsed["normalizer"]["normalizers"][:2]
    other = json.dumps(parsed)
    whole, own = Tokenizer.from_str(other), WordEncoder(other)
    assert not own.known
    for text in ("Word Two", "ABC def\n  x", "", "don't É"):
        got = np.frombuffer(own.encode(text.encode()), own.kind).tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        a, b = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        sizes, flat, slots = build_hash(a, b)
        assert sorted(slots.tolist()) == list(range(n))
        assert (find_slots(sizes, flat, a, b) == slots).all()


def brute(rows, known):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = known.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, known, tmp_path):
    rows = [(i * 7 % 101, f"Document number {i}, with wörds!") for i in range(101)]
    rows += [(3, "a copy"), (3, "a copy"), (None, "no key"), (500, None), (501, ""), (502, "long " * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    path = str(tmp_path / "t")
    df.write.parquet(f"{path}/documents.parquet")
    got = sorted((tuple(r) for r in op3_token_shards(spark, path).collect()), key=lambda r: r[1])
    assert got == brute(rows, known)


def test_unknown_keys_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    folder = scratch(spark, "t")
    entries = write_shards(df, folder, PATH)
    index = build_index(entries, folder)
    keys = spark.createDataFrame([(1, 0), (77, 0), (2, 5)], "key long, copy long")
    found = {(r.key, r.copy): r.n_tokens for r in lookup(keys, index).collect()}
    assert found == {(1, 0): 2, (77, 0): None, (2, 5): None}
    folder = scratch(spark, "t")
    entries = write_shards(df.limit(0), folder, PATH)
    index = build_index(entries, folder)
    assert read_documents(lookup(keys, index), entries, folder).count() == 0


def test_unseen_ascii_words_need_no_pattern(monkeypatch):
    """Unseen chunks take most of the time: letters are one pre-token as they
    stand, and patterns are asked only for the other chunks."""
    encoder = WordEncoder(open(PATH, encoding="utf-8").read())
    asked = []

    class Seen:
        def __init__(self, pattern):
            self.pattern = pattern

        def __getattr__(self, name):
            return lambda text: asked.append(text) or getattr(self.pattern, name)(text)

    monkeypatch.setattr(tokenfile, "_PLAIN", Seen(tokenfile._PLAIN))
    monkeypatch.setattr(tokenfile, "_PRETOKEN", Seen(tokenfile._PRETOKEN))
    text = "Plain WORDS stay plain, don't they? x1 Größe \x01odd\x7f plain"
    got = np.frombuffer(encoder.encode(text.encode()), encoder.kind).tolist()
    assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert not {"Plain", "WORDS", "stay", "words", "plain"} & set(asked)
    assert {"Größe", "\x01odd\x7f"} <= set(asked)
