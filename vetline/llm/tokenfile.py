"""Token-id shards with a minimal perfect hash index.

Layout below one folder of the shared store:

* ``shards/ids-<shard>-<attempt>.bin``: a 16-byte header (magic, bytes per id)
  and the raw little-endian ids of consecutive documents in ascending key order;
* ``entries/``: Parquet, one row per document (shard, file, key, offset, length),
  written by the tasks that wrote the shards, so that only files of committed
  attempts are ever named;
* ``index/``: Parquet, one row per bucket of keys with a minimal perfect hash.

The hash has levels of bit arrays: a key owns the first bit that no other key of
its level maps to, and its slot is the rank of that bit. Slots hold a 32-bit
fingerprint, the shard, the offset and the length, so one keyed access costs a
few array reads and one ranged read of a shard, whatever the corpus size.
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
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.llm.common import open_store, scratch, table
from vetline.session import ship_package

MAGIC = b"IDSHARD1"
HEADER, HEADER_BYTES = "<8sII", 16
VOCABULARY, END_ID = "word_bpe_49k.json", 2
SHARD_BYTES = 32 << 20
BUCKET_KEYS = 16_384
MEMO_ENTRIES = 400_000
# Bytes of text whose chunks are numbered together.
SLICE_BYTES = 8 << 20


# ---- encoding -------------------------------------------------------------

# The parts of a tokenizers file that the short cut stands for.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "truncation": None, "padding": None,
}

# Letters, digits and marks whose normalisation and lower case are the same in
# every library: printable ASCII and the Latin-1 letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# Pre-tokens of plain chunks that stand one to a line.
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|\n|[^a-zà-öø-ÿß0-9\n]+")


def _byte_characters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the
    other bytes follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts by a tokenizers file that drops white space.

    White space always ends a pre-token and leaves no id, so a text's ids are
    those of its chunks; each distinct chunk is encoded once per worker and
    remembered. Plain chunks go to the library's model pre-token by pre-token,
    all others (and any that may hold a special token) to its whole pipeline.

    That holds for files whose normaliser and pre-tokenizer are the ones below
    (:data:`KNOWN`); with any other file every text goes to the library's
    pipeline as a whole."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        top = max(self.tokenizer.get_vocab().values())
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.shown = _byte_characters()
        parsed = json.loads(spec)
        self.known = all(parsed.get(k) == v for k, v in KNOWN.items()) and parsed["model"]["type"] == "BPE" and not any(
            parsed["model"].get(k) for k in ("dropout", "byte_fallback", "ignore_merges")) and not any(
            "<|" not in t["content"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in parsed.get("added_tokens") or [])
        self.chunks: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _learn(self, new: list[str]) -> None:
        """Remember the packed ids of pre-tokens."""
        ids, ends, tokenize = [], [], self.tokenizer.model.tokenize
        for part in new:
            shown = part if part.isascii() else "".join(map(self.shown.__getitem__, part.encode()))
            ids += [t.id for t in tokenize(shown)]
            ends.append(len(ids))
        packed, width = np.array(ids, self.kind).tobytes(), self.kind.itemsize
        for part, start, end in zip(new, [0, *ends], ends):
            self.parts[part] = packed[start * width:end * width]

    def _chunks(self, raw: list[bytes]) -> list[bytes]:
        """Packed ids of chunks without white space: the plain ones are cut into
        pre-tokens together, one to a line."""
        texts = b"\n".join(raw).decode().split("\n")
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if text and "<|" not in text and (text.isascii() and text.isprintable() or _PLAIN.fullmatch(text)):
                plain.append(i)
            elif text:
                out[i] = self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if plain:
            parts = _PRETOKEN.findall("\n".join([texts[i] for i in plain]).lower() + "\n")
            memo = self.parts
            memo["\n"] = b""
            self._learn(list(set(parts).difference(memo)))
            found = list(map(memo.__getitem__, parts))
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            ends = ends[[k for k, part in enumerate(parts) if part == "\n"]].tolist()
            packed = b"".join(found)
            for i, start, end in zip(plain, [0, *ends], ends):
                out[i] = packed[start:end]
        return out

    def _looked_up(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of different chunks."""
        memo = self.chunks
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        if len(self.parts) > MEMO_ENTRIES:
            self.parts.clear()
        found = list(map(memo.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self._chunks([words[i] for i in missing])):
            found[i] = memo[words[i]] = ids
        return found

    def _together(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of the texts: Arrow splits them at white space and numbers
        their chunks, so Python sees each different one once."""
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        if not len(chunks):
            return [b""] * len(texts)
        ids = pa.array(self._looked_up(chunks.dictionary.cast(pa.binary()).to_pylist()), pa.large_binary()).take(chunks.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        packed = memoryview(ids.buffers()[2] or b"")
        return [bytes(packed[i:j]) for i, j in zip(ends, ends[1:])]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Packed ids of each UTF-8 text; a null has none."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.known:
            for text in texts:
                yield self._packed(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids)
            return
        part = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for i, j in zip(cuts, cuts[1:]):
            yield from self._together(texts[i:j])

    def encode(self, raw: bytes) -> bytes:
        """Packed ids of a UTF-8 text."""
        return next(self.encode_all(pa.array([raw], pa.binary())))


_LOADED: dict[int, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    key = zlib.crc32(spec.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordEncoder(spec)
    return _LOADED[key]


# ---- files ----------------------------------------------------------------

def _key_hashes(*key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key from different seeds: 128 bits tell keys apart."""
    return F.xxhash64(F.lit(1), *key), F.xxhash64(F.lit(2), *key)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID,
                 key: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the ids in ascending
    key order. Returns the entries table.

    Texts are range partitioned by key once; every task streams its rows into
    one shard. Null texts count as empty (only the end id); null keys come
    first; repeated keys are all written, next to each other in text order, and
    numbered 0, 1, ... in ``copy``. Other input columns are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(key).alias("key"), F.col(text_col).cast("binary").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // shard_bytes))
    ordered = slim.repartitionByRange(shards, "key").sortWithinPartitions("key", "text")
    shard_folder = f"{folder}/shards"
    store, path = open_store(shard_folder)
    store.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        end = np.array([end_id], encoder.kind).tobytes()
        store, path = open_store(shard_folder)
        task = TaskContext.get()
        shard, name = task.partitionId(), f"ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        out, offset, last, copy = None, 0, object(), 0
        for batch in batches:
            if out is None:
                out = store.open_output_stream(f"{path}/{name}")
                out.write(struct.pack(HEADER, MAGIC, encoder.kind.itemsize, 0))
            lengths, copies = [], []
            for k, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                ids += end
                out.write(ids)
                copy = copy + 1 if k == last else 0
                last = k
                lengths.append(len(ids) // encoder.kind.itemsize)
                copies.append(copy)
            n = len(lengths)
            ends = np.cumsum(lengths, dtype=np.int64) + offset
            starts = ends - np.array(lengths, np.int64)
            offset = int(ends[-1]) if n else offset
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(copies, pa.int64()), pa.array([shard] * n, pa.int64()),
                 pa.array([name] * n), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "copy", "shard", "file", "offset", "n_tokens"])
        if out is not None:
            out.close()

    kind = slim.schema["key"].dataType.simpleString()
    entries = ordered.mapInArrow(
        write, f"key {kind}, copy long, shard long, file string, offset long, n_tokens long")
    entries.write.parquet(f"{folder}/entries")
    return spark.read.schema(entries.schema).parquet(f"{folder}/entries")


# ---- minimal perfect hash -------------------------------------------------

def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (h1 ^ (h2 * np.uint64(2 * level + 1))) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, the bits of all levels, and each key's slot. The keys'
    hash pairs must be distinct."""
    left, level, base = np.arange(len(h1)), 0, 0
    sizes, bits, owner_bit = [], [], np.zeros(len(h1), np.int64)
    while len(left):
        size = max(2 * len(left), 8)
        place = _place(h1[left], h2[left], level, size)
        alone = np.bincount(place, minlength=size) == 1
        mine = alone[place]
        owner_bit[left[mine]] = base + place[mine]
        sizes.append(size)
        bits.append(alone)
        base += size
        left = left[~mine]
        level += 1
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return sizes, flat, (np.cumsum(flat) - 1)[owner_bit]


def find_slots(sizes: list[int], flat: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has its bit."""
    rank = np.cumsum(flat) - 1
    slots, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        place = base + _place(h1[left], h2[left], level, size)
        hit = flat[place]
        slots[left[hit]] = rank[place[hit]]
        left, base = left[~hit], base + size
    return slots


def build_index(entries: DataFrame, folder: str, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per hash bucket of keys; buckets hold about ``bucket_keys`` keys
    at any corpus size because their number follows the row count."""
    spark = entries.sparkSession
    buckets = max(1, -(-entries.count() // bucket_keys))
    h1, h2 = _key_hashes(F.col("key"), F.col("copy"))
    rows = entries.select(h1.alias("h1"), h2.alias("h2"), "shard", "offset", "n_tokens").withColumn(
        "bucket", F.pmod("h1", F.lit(buckets)))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group[c].to_numpy().astype(np.uint64) for c in ("h1", "h2"))
        sizes, flat, slots = build_hash(a, b)
        order = np.argsort(slots)
        column = lambda c, kind: group[c].to_numpy()[order].astype(kind).tobytes()
        return pd.DataFrame({
            "bucket": [int(group["bucket"].iloc[0])], "buckets": [buckets], "sizes": [sizes],
            "bits": [np.packbits(flat).tobytes()], "prints": [(b[order] >> np.uint64(32)).astype("<u4").tobytes()],
            "shards": [column("shard", "<u4")], "offsets": [column("offset", "<u8")],
            "lengths": [column("n_tokens", "<u8")]})

    index = rows.groupBy("bucket").applyInPandas(
        build, "bucket long, buckets long, sizes array<long>, bits binary, prints binary, shards binary, "
               "offsets binary, lengths binary")
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """``key, copy`` rows plus shard, offset and n_tokens; null where the index
    does not hold the key (no slot, or another fingerprint)."""
    buckets = (index.select("buckets").first() or [1])[0]
    h1, h2 = _key_hashes(F.col("key"), F.col("copy"))
    asked = keys.select("key", "copy", h1.alias("h1"), h2.alias("h2"), F.pmod(h1, F.lit(buckets)).alias("bucket"))

    def find(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        a, b = (asked[c].to_numpy().astype(np.uint64) for c in ("h1", "h2"))
        shard, offset, length = (np.full(len(a), -1, np.int64) for _ in range(3))
        if len(found):
            row = found.iloc[0]
            sizes = [int(s) for s in row["sizes"]]
            flat = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
            slots = find_slots(sizes, flat, a, b)
            prints = np.frombuffer(row["prints"], "<u4")
            ok = (slots >= 0) & (prints[slots] == (b >> np.uint64(32)).astype(np.uint32))
            for target, name, kind in ((shard, "shards", "<u4"), (offset, "offsets", "<u8"), (length, "lengths", "<u8")):
                target[ok] = np.frombuffer(row[name], kind)[slots[ok]]
        out = asked[["key", "copy"]].copy()
        for name, values in (("shard", shard), ("offset", offset), ("n_tokens", length)):
            out[name] = pd.array(values, "Int64")
            out.loc[values < 0, name] = pd.NA
        return out

    kind = keys.schema["key"].dataType.simpleString()
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        find, f"key {kind}, copy long, shard long, offset long, n_tokens long")


def read_documents(found: DataFrame, entries: DataFrame, folder: str) -> DataFrame:
    """Read each located document's ids by ranged access: key, copy, ``start``
    (ids of all documents before it), n_tokens and the packed 32-bit ``ids``.

    The file names and id totals of the shards (one row per shard file) are
    the only thing the driver gathers."""
    spark = found.sparkSession
    shards = sorted(entries.groupBy("shard").agg(F.first("file").alias("file"), F.sum("n_tokens").alias("n")).collect())
    firsts, total = {}, 0
    for s in shards:
        firsts[s.shard] = (s.file, total)
        total += s.n
    names = spark.sparkContext.broadcast(firsts)
    shard_folder = f"{folder}/shards"
    ordered = found.filter("shard is not null").repartition(max(len(shards), 1), "shard").sortWithinPartitions("shard", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(shard_folder)
        at, source, width = None, None, 0
        for batch in batches:
            ids, starts = [], []
            for shard, offset, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "n_tokens"))):
                if shard != at:
                    at, source = shard, store.open_input_file(f"{path}/{names.value[shard][0]}")
                    magic, width, _ = struct.unpack(HEADER, source.read_at(HEADER_BYTES, 0))
                    if magic != MAGIC:
                        raise ValueError("not an id shard")
                raw = source.read_at(n * width, HEADER_BYTES + offset * width)
                ids.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                starts.append(names.value[shard][1] + offset)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("copy"), pa.array(starts, pa.int64()),
                 batch.column("n_tokens"), pa.array(ids, pa.binary())],
                names=["key", "copy", "start", "n_tokens", "ids"])

    kind = found.schema["key"].dataType.simpleString()
    return ordered.mapInArrow(read, f"key {kind}, copy long, start long, n_tokens long, ids binary")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "token-shards")
    entries = write_shards(docs, folder, public_tokenizers.path(VOCABULARY))
    index = build_index(entries, folder)
    keys = docs.groupBy(F.col("doc_id").alias("key")).count().select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("copy"))
    read = read_documents(lookup(keys, index), entries, folder)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
