"""Byte-level BPE by a sentencepiece model written straight from a rank file.

``serialise`` writes the protobuf of a sentencepiece BPE model whose pieces are
the byte strings of the vocabulary, each byte ``b`` shown as the character
``chr(256 + b)`` and each piece scored by its negative rank, with identity
normalisation and no dummy prefix. sentencepiece merges the best scored
neighbours first, that is the lowest rank, leftmost on ties: the merges of a
rank-based byte BPE. Texts are cut into pre-tokens by the vocabulary's pattern,
each pre-token is encoded on its own, and ids are decoded by the inverse byte
mapping. One narrow Arrow stage does it; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from vetline.llm.common import table
from vetline.session import ship_package

VOCABULARY = "byte_bpe_50k.tiktoken"
# Chunks of text whose ids a worker remembers; the memo is emptied beyond it.
MEMO_ENTRIES = 300_000
_SHOWN = {b: 256 + b for b in range(256)}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def shown(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_SHOWN)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """Model protobuf; piece 0 is the unknown piece, rank ``r`` is piece ``r + 1``."""
    # Fixed values, field numbers of sentencepiece's public model format:
    # ModelProto pieces 1, trainer_spec 2, normalizer_spec 3; piece 1, score 2,
    # type 3 (normal 1, unknown 2); model_type 3 (BPE 2), vocab_size 4,
    # unk/bos/eos/pad ids 40-43; name 1, add_dummy_prefix 3,
    # remove_extra_whitespaces 4, escape_whitespaces 5.
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    unknown = _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)
    out = [_block(1, unknown)]
    for rank, piece in enumerate(by_rank):
        out.append(_block(1, _block(1, shown(piece).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)))
    out.append(_block(2, _number(3, 2) + _number(4, len(by_rank) + 1) + _number(40, 0)
                      + _number(41, -1) + _number(42, -1) + _number(43, -1)))
    out.append(_block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder over one serialised vocabulary."""

    def __init__(self, model: bytes, pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pretokens = regex.compile(pattern).findall
        back = {256 + b: b for b in range(256)}
        self.pieces = [self.sp.id_to_piece(i + 1).translate(back).encode("latin-1")
                       for i in range(self.sp.get_piece_size() - 1)]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        # A pre-token that is a piece as it stands is that piece, even where
        # the merges would not lead to it (usually there is none such).
        reached = self.sp.encode([shown(p) for p in self.pieces], num_threads=1)
        self.fixed = {p: [i + 1] for i, (p, ids) in enumerate(zip(self.pieces, reached)) if ids != [i + 1]}
        self.feed = self._packed(["\n"])[0]
        self.starts: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def _packed(self, tokens: list[str]) -> list[bytes]:
        """Model ids (rank + 1) of each pre-token, little-endian 32 bits."""
        raw = [t.encode() for t in tokens]
        ids = self.sp.encode([shown(r) for r in raw], num_threads=1) if raw else []
        if self.fixed:
            ids = [self.fixed.get(r, i) for r, i in zip(raw, ids)]
        return [struct.pack(f"<{len(i)}I", *i) for i in ids]

    def _learn(self, memo: dict[str, bytes], chunks: set[str], lead: str) -> None:
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        new = list(chunks.difference(memo))
        cut = [self.pretokens(lead + c) for c in new]
        ids = iter(self._packed(list(itertools.chain.from_iterable(cut))))
        for c, tokens in zip(new, cut):
            memo[c] = b"".join(itertools.islice(ids, len(tokens)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text.

        Where every gap between non-space characters is one space or one line
        feed, the pattern always cuts there (a space starts the next pre-token,
        a line feed stands alone), so such chunks are encoded once per worker
        and remembered; any other text goes through the pattern as a whole."""
        if text.replace("\n", " ").split(" ") != text.split():
            packed = self._packed(self.pretokens(text))
        else:
            lines = [line.split(" ") for line in text.split("\n")]
            self._learn(self.starts, {line[0] for line in lines}, "")
            self._learn(self.inner, {c for line in lines for c in itertools.islice(line, 1, None)}, " ")
            packed = []
            for i, line in enumerate(lines):
                if i:
                    packed.append(self.feed)
                packed.append(self.starts[line[0]])
                packed.extend(map(self.inner.__getitem__, itertools.islice(line, 1, None)))
        return np.frombuffer(b"".join(packed), "<u4") - np.uint32(1)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_LOADED: dict[str, ByteBpe] = {}


def _loaded(model: bytes, pattern: str) -> ByteBpe:
    """The worker's codec for this model; a reused worker keeps its memo."""
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(model, pattern)
    return _LOADED[key]


# Output columns: SQL type, and the value from (codec, id list).
OUTPUTS: dict[str, tuple[str, pa.DataType, Callable[[ByteBpe, list[int]], object]]] = {
    "token_ids": ("array<int>", pa.list_(pa.int32()), lambda c, ids: ids),
    "decoded": ("binary", pa.binary(), lambda c, ids: c.decode(ids)),
    "n_tokens": ("long", pa.int64(), lambda c, ids: len(ids)),
    "ids_sha256": ("string", pa.string(), lambda c, ids: hashlib.sha256(
        " ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda c, ids: hashlib.sha256(c.decode(ids)).hexdigest()),
}


def byte_bpe(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN,
             text_col: str = "text", keep: list[str] | None = None,
             outputs: tuple[str, ...] = ("token_ids", "decoded")) -> DataFrame:
    """Encode each whole text and decode the ids again.

    ``vocabulary`` is the path of a rank file on the driver; its model travels
    as one broadcast bounded by the vocabulary. ``outputs`` picks from
    :data:`OUTPUTS`. Null text counts as empty: no ids, empty bytes. Repeated
    rows give repeated results; input columns outside ``keep`` are dropped, so
    clashing names cannot meet."""
    spark = docs.sparkSession
    ship_package(spark)
    keep = keep or ["doc_id"]
    model = spark.sparkContext.broadcast(serialise(load_ranks(vocabulary)))
    slim = docs.select(*keep, docs[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _loaded(model.value, pattern)
        for batch in batches:
            made: list[list] = [[] for _ in outputs]
            for value in batch.column(len(keep)):
                ids = codec.encode(value.as_py() or "").tolist()
                for column, name in zip(made, outputs):
                    column.append(OUTPUTS[name][2](codec, ids))
            arrays = [batch.column(i) for i in range(len(keep))]
            arrays += [pa.array(v, OUTPUTS[n][1]) for v, n in zip(made, outputs)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *outputs])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    return slim.mapInArrow(run, ", ".join(fields + [f"{n} {OUTPUTS[n][0]}" for n in outputs]))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                    outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
