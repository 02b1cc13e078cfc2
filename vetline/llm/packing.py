"""Best-fit packing of documents into sequences of bounded length.

Texts become ids by a byte-level tokenizers file and are cut into pieces of at
most ``capacity`` tokens. Pieces then go through hierarchical residual packing:

* full pieces are sequences on their own and never travel;
* the others are dealt by hash into nodes of about ``NODE_ITEMS`` pieces, and
  every node packs its own by best fit, longest first;
* nearly full bins are final at once. A node hands on only its bin of at most
  half the capacity (best fit never leaves two) and its emptiest other bins,
  as many as bins of the former kind can still reach it further up;
* ``FANOUT`` nodes at a time merge, and the bins they hand on are the items of
  the next best-fit round, until one node is left.

Two bins of more than half the capacity never fit together, so every later
merge needs a small bin: a node sees at most ``FANOUT`` of those a round, and
each takes at most one larger bin. What a node keeps for later rounds is
therefore bounded, and no merge is lost by the bins it lets go.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.llm.common import stored, table
from vetline.session import ship_package

VOCABULARY, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024
NODE_ITEMS, FANOUT = 65_536, 8
MEMO_BYTES, MEMO_KEY = 48 << 20, 48
SLICE_BYTES = 4 << 20


# ---- ids --------------------------------------------------------------------

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Texts of printable ASCII, Latin-1 letters, spaces and line feeds only: there
# the classes of letters, digits and white space are the same in every library.
_PLAIN = re.compile(f"[ \n!-~{_LETTERS}]*")
_PRETOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_GAP = re.compile(r"(?= \S)")


def _byte_characters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the
    other bytes follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Packed ids by string; computed where missing. Two generations of at most
    ``MEMO_BYTES`` each: a full one becomes the old one, and what is asked for
    again comes back from there. Long strings, which hardly come again, are not
    kept."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.held, self.old = compute, 0, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.compute(part)
        if len(part) <= MEMO_KEY:
            self.held += 200 + 2 * len(part) + len(ids)
            if self.held > MEMO_BYTES:
                self.old = dict(self)
                self.clear()
                self.held = 200
            self[part] = ids
        return ids


class ByteLevelEncoder:
    """Ids of whole texts by a tokenizers file.

    If the file is a plain byte-level BPE (no normaliser, the usual pattern, no
    special options), plain texts are cut by the pattern here and each distinct
    pre-token goes to the library's model once; other texts are cut before each
    space that a visible character follows, where the pattern always cuts, and
    those chunks go through the library's whole pipeline. With any other file
    every text goes through the library as a whole."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        top = max(self.tokenizer.get_vocab().values())
        self.code = "H" if top < 1 << 16 else "I"
        self.kind = np.dtype(f"<{self.code}")
        self.shown = _byte_characters()
        parsed = json.loads(spec)
        self.special = [t["content"] for t in parsed.get("added_tokens") or []]
        self.plain = self._is_plain(parsed)
        self.parts, self.chunks = _Memo(self._part), _Memo(self._whole)

    @staticmethod
    def _is_plain(parsed: dict) -> bool:
        pre, model = parsed.get("pre_tokenizer") or {}, parsed["model"]
        post = parsed.get("post_processor") or {"type": "ByteLevel"}
        return (parsed.get("normalizer") is None and pre.get("type") == "ByteLevel" and post["type"] == "ByteLevel"
                and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                and model["type"] == "BPE" and not any(model.get(k) for k in (
                    "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
                and not parsed.get("truncation") and not parsed.get("padding")
                and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
                            for t in parsed.get("added_tokens") or []))

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _part(self, part: str) -> bytes:
        if part.isascii():
            shown = part.translate(self.shown)
        else:
            shown = part.encode().decode("latin-1").translate(self.shown)
        return self._packed([t.id for t in self.tokenizer.model.tokenize(shown)])

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Packed little-endian ids of a text."""
        if not self.plain:
            return self._whole(text)
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.parts.__getitem__, _PRETOKEN.findall(text)))
        return b"".join(map(self.chunks.__getitem__, filter(None, _GAP.split(text))))


_LOADED: dict[int, ByteLevelEncoder] = {}


def _encoder(spec: str) -> ByteLevelEncoder:
    key = zlib.crc32(spec.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteLevelEncoder(spec)
    return _LOADED[key]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE_BYTES`` in one column, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(sizes):
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: itself if it fits, else full pieces
    behind a first one that takes what is left over."""
    first = n % capacity or min(n, capacity)
    return [first] + [capacity] * ((n - first) // capacity)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """One stored row per piece: the ``keep`` columns, ``uid`` (a row number of
    the stored table), ``piece`` (from 0), ``start`` (ids of its document before
    it), ``length``, ``width`` (bytes per id), ``ids`` (packed little-endian)
    and ``ids_crc32`` (of the ids as 32-bit integers).

    Null text counts as empty: its only id is ``end_id``. Repeated rows give
    their own pieces. Input columns outside ``keep`` are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    keep = keep or ["doc_id"]
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    slim = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        end, width = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize
        uid = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in _slices(whole, len(keep))):
            of, piece, starts, lengths, ids, crcs = [], [], [], [], [], []
            for row, value in enumerate(batch.column(len(keep))):
                raw = encoder.encode(value.as_py() or "") + end
                at = 0
                for i, n in enumerate(piece_lengths(len(raw) // width, capacity)):
                    part = raw[at * width:(at + n) * width]
                    of.append(row)
                    piece.append(i)
                    starts.append(at)
                    lengths.append(n)
                    ids.append(part)
                    crcs.append(zlib.crc32(np.frombuffer(part, encoder.kind).astype("<u4")))
                    at += n
            rows = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(rows) for i in range(len(keep))), pa.array(range(uid, uid + len(of)), pa.int64()),
                 pa.array(piece, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array([width] * len(of), pa.int32()), pa.array(ids, pa.binary()), pa.array(crcs, pa.int64())],
                names=[*keep, "uid", "piece", "start", "length", "width", "ids", "ids_crc32"])
            uid += len(of)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    return stored(slim.mapInArrow(run, ", ".join(
        fields + ["uid long, piece int, start long, length long, width int, ids binary, ids_crc32 long"])), "pieces")


# ---- packing ----------------------------------------------------------------

def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: for each item the item that opened its bin, its
    offset there, and the bin's final fill. Equal lengths go in input order."""
    n = len(lengths)
    opener, offset = np.arange(n), np.zeros(n, np.int64)
    fill: dict[int, int] = {}
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            opener[i], offset[i] = bin_, fill[bin_]
        else:
            bin_, room = i, capacity
            fill[bin_] = 0
        fill[bin_] += size
        room -= size
        if room:
            if not with_room[room]:
                rooms |= 1 << room
            with_room[room].append(bin_)
    used = np.array([fill[b] for b in opener.tolist()], np.int64) if n else np.zeros(0, np.int64)
    return opener, offset, used


def handed_on(opener: np.ndarray, used: np.ndarray, capacity: int, reach: int) -> np.ndarray:
    """Openers of the bins that go to the next round: the bin of at most half the
    capacity and the ``reach`` emptiest others with room."""
    own = np.flatnonzero(opener == np.arange(len(opener)))
    own = own[used[own] < capacity]
    own = own[np.argsort(used[own], kind="stable")]
    return own[:reach + int((used[own] * 2 <= capacity).sum())]


def pack(items: DataFrame, capacity: int = CAPACITY, node_items: int = NODE_ITEMS, fanout: int = FANOUT) -> DataFrame:
    """(``uid``, ``length``) with distinct uids and lengths from 1 to
    ``capacity`` to (``uid``, ``sequence_id``, ``offset``).

    A sequence is named after the item that opened it; items of a sequence
    follow each other without gaps. The empty table gives the empty table."""
    full = items.filter(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"),
                                                            F.lit(0).cast("long").alias("offset"))
    short = items.filter(F.col("length") < capacity)
    nodes = max(1, -(-short.count() // node_items))
    levels = 0
    while fanout ** levels < nodes:
        levels += 1

    def round_of(rows: DataFrame, left: int) -> DataFrame:
        def fit(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("uid", kind="stable")
            uid, lengths = group["uid"].to_numpy(), group["length"].to_numpy()
            opener, offset, used = best_fit(lengths, capacity)
            on = np.zeros(len(uid), bool)
            if left:
                on[handed_on(opener, used, capacity, fanout * left)] = True
            return pd.DataFrame({"uid": uid, "into": uid[opener], "offset": offset, "used": used,
                                 "travels": on, "node": group["node"]})
        placed = rows.groupBy("node").applyInPandas(fit, "uid long, into long, offset long, used long, travels boolean, node long")
        return stored(placed, "packed")

    dealt = short.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(nodes)).alias("node"))
    first = round_of(dealt, levels)
    moves, state = [], first
    for left in range(levels - 1, -1, -1):
        state = round_of(state.filter("travels").select(
            "uid", F.col("used").alias("length"), F.floor(F.col("node") / fanout).cast("long").alias("node")), left)
        moves.append(state.filter("uid <> into").select(F.col("uid").alias("into"), F.col("into").alias("next"),
                                                        F.col("offset").alias("further")))
    # A bin that moved takes its items along; moves are at most one small bin
    # for each node and round.
    placed = first.select("uid", "into", "offset")
    for move in moves:
        placed = placed.join(move, "into", "left").select(
            "uid", F.coalesce("next", "into").alias("into"),
            (F.col("offset") + F.coalesce("further", F.lit(0))).alias("offset"))
    return full.unionByName(placed.withColumnRenamed("into", "sequence_id"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The pieces of :func:`tokenized_pieces` with ``sequence_id`` and ``offset``."""
    pieces = tokenized_pieces(docs, tokenizer, capacity, end_id, keep, text_col)
    return pieces.join(pack(pieces.select("uid", "length"), capacity), "uid")


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per sequence: ``sequence_id``, ``n_tokens``, ``ids`` (packed, its
    pieces in order of offset) and ``uids``. A sequence holds at most
    ``capacity`` pieces, so no group is larger than that."""
    part = F.struct("offset", "uid", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", "n_tokens", joined.alias("ids"), F.col("parts.uid").alias("uids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
