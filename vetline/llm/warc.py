"""WARC archives: writing with revisit records, reading by boundary chains.

Writing: pages with equal payloads have one ``response`` record, the others
``revisit`` it. Every task writes its pages into archives of bounded size in
the shared store, one gzip member per record or plain.

Reading: archives are cut into blocks of bytes that tasks scan on their own.
Wherever a record's magic stands, the task tries to read a record and emits it
with the offset of its successor. Magic also stands inside payloads, so a
candidate counts only if a chain of records from the file's first byte leads to
it: each block contracts its candidates to the offset where a chain leaves the
block, pointer jumping over those exits finds the offsets at which the chain
from byte 0 enters each block, and each block keeps what its entry reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.llm.common import open_store, scratch, stored, table
from vetline.session import ship_package

ARCHIVE_BYTES, BLOCK_BYTES = 64 << 20, 8 << 20
DATE = "2024-01-01T00:00:00Z"
PLAIN_MAGIC, GZIP_MAGIC = b"WARC/1.", b"\x1f\x8b\x08"
HEADER_STEP = 1 << 16


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing --------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        shown = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)
        lines.append(f"WARC-Target-URI: {shown}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, gzip: bool = True, archive_bytes: int = ARCHIVE_BYTES,
                   payload_col: str = "html") -> DataFrame:
    """Write ``page_id``, ``url``, payload rows; returns (file, size, records).

    Of equal payloads the row with the largest page_id is the response (every
    row of that id, if rows repeat); the others revisit it. A null payload is
    empty; rows without page_id are responses of their own and never referred
    to. File names hold the task attempt, and only files of committed attempts
    are listed. Other input columns are not read."""
    ship_package(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(payload_col, F.lit("")).alias("payload")).withColumn("sum", F.sha1("payload"))
    slim = rows.select("page_id", "sum").filter("page_id is not null")
    largest = stored(slim.groupBy("sum").agg(F.max("page_id").alias("response")), "payloads")
    roles = slim.distinct().join(largest, "sum").select(
        F.col("page_id").alias("role_id"), F.col("sum").alias("role_sum"), "response")
    told = rows.join(roles, (F.col("page_id") == F.col("role_id")) & (F.col("sum") == F.col("role_sum")), "left")
    told = told.select("page_id", "url", "payload", F.col("response").alias("refers_to"))
    archive_folder = f"{folder}/archives"
    store, path = open_store(archive_folder)
    store.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(archive_folder)
        task = TaskContext.get()
        stem = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, size, n, made = None, 0, 0, []
        name = ""

        def close() -> None:
            nonlocal out, size, n
            out.close()
            made.append((name, size, n))
            out, size, n = None, 0, 0

        for batch in batches:
            for page_id, url, payload, response in zip(*(batch.column(i) for i in range(4))):
                page_id, response = page_id.as_py(), response.as_py()
                revisit = response is not None and response != page_id
                raw = record(page_id, url.as_py(), payload.as_py().encode(), response, revisit)
                if gzip:
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = packer.compress(raw) + packer.flush()
                if out is not None and size + len(raw) > archive_bytes:
                    close()
                if out is None:
                    name = f"{stem}-{len(made):04d}.warc" + (".gz" if gzip else "")
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(raw)
                size, n = size + len(raw), n + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2))],
            names=["file", "size", "records"])

    return stored(told.mapInArrow(write, "file string, size long, records long"), "archives")


# ---- reading --------------------------------------------------------------

class _Source:
    """Ranged reads of one archive through a buffer that starts at a block."""

    def __init__(self, file, size: int, start: int, length: int):
        self.file, self.size, self.start = file, size, start
        self.data = file.read_at(min(length, size - start), start)

    def get(self, offset: int, length: int) -> bytes:
        length = min(length, self.size - offset)
        at = offset - self.start
        if 0 <= at and at + length <= len(self.data):
            return self.data[at:at + length]
        return self.file.read_at(length, offset) if length > 0 else b""


def parse(raw: bytes) -> tuple[dict[str, str], int, int] | None:
    """Header fields, header length and content length of the record at the
    front of ``raw``, or None."""
    end = raw.find(b"\r\n\r\n")
    if not re.match(rb"WARC/1\.[01]\r\n", raw) or end < 0:
        return None
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", length):
        return None
    return fields, end + 4, int(length)


def _header_so_far(raw: bytes) -> bool:
    """Whether the front of ``raw`` may be an unfinished header."""
    lines = raw.split(b"\r\n")
    return re.match(rb"WARC/1\.[01]$", lines[0]) is not None and all(b":" in line for line in lines[1:-1])


def _plain_record(src: _Source, offset: int) -> tuple[int, dict[str, str], bytes] | None:
    # a header may be longer than any fixed size; what has no line of a header
    # where one is due is none
    step, raw = HEADER_STEP, src.get(offset, HEADER_STEP)
    while b"\r\n\r\n" not in raw and _header_so_far(raw) and offset + len(raw) < src.size:
        step *= 4
        raw = src.get(offset, step)
    head = parse(raw)
    if head is None:
        return None
    fields, header, length = head
    whole = header + length + 4
    if offset + whole > src.size:
        return None
    raw = src.get(offset, whole)
    return (offset + whole, fields, raw[header:-4]) if raw.endswith(b"\r\n\r\n") else None


def _gzip_record(src: _Source, offset: int) -> tuple[int, dict[str, str], bytes] | None:
    unpacker, parts, at, step = zlib.decompressobj(31), [], offset, 1 << 16
    try:
        while not unpacker.eof:
            piece = src.get(at, step)
            if not piece:
                return None
            parts.append(unpacker.decompress(piece))
            if at == offset and not parts[0].startswith(PLAIN_MAGIC[:len(parts[0])]):
                return None
            at += len(piece)
    except zlib.error:
        return None
    raw = b"".join(parts)
    head = parse(raw)
    if head is None or len(raw) != head[1] + head[2] + 4 or not raw.endswith(b"\r\n\r\n"):
        return None
    return at - len(unpacker.unused_data), head[0], raw[head[1]:-4]


def _described(fields: dict[str, str], body: bytes) -> tuple:
    """page_id, url, payload length, digest, digest_ok, type, refers_to, payload."""
    ident = lambda name: int(m.group(1)) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    http, _, payload = body.partition(b"\r\n\r\n")
    kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        return ident("warc-record-id"), fields.get("warc-target-uri"), int(m.group(1)) if m else None, said, True, kind, ident("warc-refers-to"), None
    return (ident("warc-record-id"), fields.get("warc-target-uri"), len(payload), said, digest_of(payload) == said, kind, None, payload)


FIELDS = ("page_id long, url string, payload_bytes long, payload_digest string, digest_ok boolean, record_type string, "
          "refers_to long")


def scan(archives: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES, with_payload: bool = False) -> DataFrame:
    """Candidates of every block: file, block, offset, next, exit and the
    record's fields. ``exit`` is where the chain from the candidate leaves the
    block (-1 where it breaks off inside)."""
    archive_folder = f"{folder}/archives"
    blocks = archives.select("file", "size", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(block_bytes).cast("long"))).alias("start"))
    n = max(archives.sparkSession.sparkContext.defaultParallelism, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(archive_folder)
        for batch in batches:
            for name, size, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                gz = name.endswith(".gz")
                magic, read = (GZIP_MAGIC, _gzip_record) if gz else (PLAIN_MAGIC, _plain_record)
                with store.open_input_file(f"{path}/{name}") as file:
                    src = _Source(file, size, start, block_bytes + len(magic) - 1)
                    found, at = [], src.data.find(magic)
                    while at >= 0:
                        got = read(src, start + at)
                        if got:
                            found.append((start + at, got[0], *_described(got[1], got[2])))
                        at = src.data.find(magic, at + 1)
                exits: dict[int, int] = {}
                for offset, following, *_ in reversed(found):
                    exits[offset] = following if following >= start + block_bytes or following >= size else exits.get(following, -1)
                columns = [[name] * len(found), [start // block_bytes] * len(found), [f[0] for f in found],
                           [f[1] for f in found], [exits[f[0]] for f in found], *([f[i] for f in found] for i in range(2, 9))]
                if with_payload:
                    columns.append([f[9] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = f"file string, block long, offset long, next long, exit long, {FIELDS}" + (", payload binary" if with_payload else "")
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]
    return blocks.repartition(4 * n).mapInArrow(run, schema)


def entries(candidates: DataFrame) -> DataFrame:
    """(file, offset) of every candidate at which the chain from byte 0 enters
    a block, by pointer jumping over the blocks' exits."""
    exits = candidates.filter("exit >= 0").select("file", F.col("exit").alias("offset"))
    doors = exits.unionAll(candidates.filter("offset = 0").select("file", "offset")).distinct()
    jump = stored(candidates.select("file", "offset", "exit").join(doors, ["file", "offset"]), "exits")
    reached = stored(jump.filter("offset = 0").select("file", "offset"), "reached")
    known = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        more = stored(reached.unionAll(ahead.join(jump.select("file", "offset"), ["file", "offset"])).distinct(), "reached")
        n = more.count()
        if n == known:
            return more
        reached, known = more, n
        twice = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("further"))
        jump = stored(jump.join(twice, ["file", "exit"], "left").select(
            "file", "offset", F.coalesce("further", F.lit(-1)).alias("exit")), "exits")


def read_archives(archives: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES, with_payload: bool = False) -> DataFrame:
    """The records reachable from the start of their archive: file, offset and
    the record's fields (with ``payload`` if asked). Where ``archives`` tells
    the number of ``records`` of a file, reading another number is an error."""
    ship_package(archives.sparkSession)
    found = stored(scan(archives, folder, block_bytes, with_payload), "candidates")
    doors = entries(found).select("file", F.floor(F.col("offset") / block_bytes).alias("block"), F.col("offset").alias("entry"))
    rows = found.join(doors, ["file", "block"])
    fields = [c for c in found.columns if c not in ("block", "next", "exit")]

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        following = dict(zip(group["offset"], group["next"]))
        on, at = set(), int(group["entry"].iloc[0])
        while at in following:
            on.add(at)
            at = following[at]
        return group.loc[group["offset"].isin(on), fields]

    # a group is one block of bytes of one archive, so its size is bounded
    schema = f"file string, offset long, {FIELDS}" + (", payload binary" if with_payload else "")
    out = rows.groupBy("file", "block").applyInPandas(follow, schema)
    if "records" not in archives.columns:
        return out
    out = stored(out, "records")
    wrong = archives.select("file", "records").join(out.groupBy("file").agg(F.count("*").alias("read")), "file", "left").filter(
        F.coalesce("read", F.lit(0)) != F.col("records")).limit(5).collect()
    if wrong:
        raise ValueError("records are unreadable: " + "; ".join(f"{r.file} holds {r.records}, read {r.read or 0}" for r in wrong))
    return out


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(archives, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
