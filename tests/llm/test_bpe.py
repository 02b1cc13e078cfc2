import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from vetline.llm.bpe import VOCABULARY, ByteBpe, byte_bpe, load_ranks, serialise

PATH = P.path(VOCABULARY)


@pytest.fixture(scope="module")
def codecs():
    ranks = load_ranks(PATH)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return known, ByteBpe(serialise(ranks), P.PATTERN)


PARTS = ["a", "the", "'s", "'", "\n", " ", "  ", "\t", "\xa0", "é", "日本", "1", "22", "!", "\x1c", "\x85",
         "😀", "​", "’s", "Á", "\r\n", " \n", "word word", "<|endoftext|>"]


def test_same_ids_as_tiktoken(codecs):
    known, own = codecs
    random.seed(1)
    for _ in range(5000):
        text = "".join(random.choices(PARTS, k=random.randint(0, 9)))
        ids = own.encode(text).tolist()
        assert ids == known.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_gaps_in_ranks_are_refused():
    with pytest.raises(ValueError):
        serialise({b"a": 0, b"b": 2})


def test_vocabulary_with_an_unreachable_piece():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = ByteBpe(serialise(ranks), P.PATTERN)
    for text in ("abc", " abc", "abc abc abcabc"):
        assert own.encode(text).tolist() == known.encode_ordinary(text)


def test_documents(spark, codecs):
    known, _ = codecs
    rows = [(1, "Some text.\nMore  text", "a"), (2, None, "b"), (3, "", None), (4, "x" * 300_000, "d"),
            (5, "wörd " * 50_000, "e"), (5, "wörd " * 50_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = byte_bpe(df, PATH, outputs=("token_ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert len(out) == len(rows)
    for r in out:
        ids = known.encode_ordinary(texts[r.doc_id])
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == texts[r.doc_id].encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert byte_bpe(df.limit(0), PATH).count() == 0
