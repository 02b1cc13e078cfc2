import base64
import hashlib
import random

import pytest

from vetline.llm.common import open_store, scratch
from vetline.llm.warc import op6_warc, read_archives, record, write_archives


def brute(rows):
    largest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            largest[html or ""] = max(page_id, largest.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        first = page_id is None or largest[html or ""] == page_id
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if first else "revisit", None if first else largest[html or ""]))
    return sorted(out, key=repr)


def pages():
    rng = random.Random(4)
    inner = record(77, "http://x/", b"inner payload", None, False).decode()
    rows = [(i, f"http://h/{i}", "<p>" + "".join(rng.choices("abc é\n", k=rng.randint(0, 400))) + "</p>") for i in range(120)]
    rows += [(200 + i, "http://c/", "same page") for i in range(30)]
    rows += [(300, None, None), (301, "http://e/", ""), (302, "bad\r\nurl: x", "WARC/1.0\r\n\r\n"), (303, "u", inner), (304, "u", inner * 3 + "x"),
             (305, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"), (306, "u", "long " * 60_000), (307, "u", inner),
             (None, "u", "same page"), (5, "http://h/5", rows[5][2]), (308, "é", "\x1f\x08" * 9 + "WARC/1.")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("gzip", [False, True])
def test_round_trip_rejects_magic_in_payloads(spark, gzip):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string")
    for archive_bytes, block_bytes in ((1 << 20, 1 << 12), (20_000, 777)):
        folder = scratch(spark, "warc-test")
        archives = write_archives(df.repartition(3), folder, gzip, archive_bytes)
        assert sum(r.records for r in archives.collect()) == len(rows)
        got = read_archives(archives, folder, block_bytes, with_payload=True).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
        assert all(r.digest_ok for r in got)
        texts = {r[0]: r[2] or "" for r in rows}
        assert all(bytes(r.payload).decode() == texts[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)


def test_query_and_empty(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "a/pages.parquet"))
    assert sorted(map(tuple, op6_warc(spark, str(tmp_path / "a")).collect()), key=repr) == brute(pages())
    df.limit(0).write.parquet(str(tmp_path / "b/pages.parquet"))
    assert op6_warc(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("gzip", [False, True])
def test_long_urls_stay_whole(spark, gzip):
    urls = {i: f"http://h/{'p' * n}{i}" for i, n in enumerate((5, 8_190, 8_300, 8_300, 70_000, 300_000, 70_000, 3))}
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in urls.items()], "page_id long, url string, html string")
    folder = scratch(spark, "warc-test")
    archives = write_archives(df.repartition(2), folder, gzip)
    for block_bytes in (8 << 20, 5_000):
        assert {r.page_id: r.url for r in read_archives(archives, folder, block_bytes).collect()} == urls


@pytest.mark.parametrize("gzip", [False, True])
def test_a_broken_chain_is_an_error(spark, gzip):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    folder = scratch(spark, "warc-test")
    archives = write_archives(df.coalesce(1), folder, gzip)
    store, path = open_store(f"{folder}/archives")
    name, size = archives.first().file, archives.first().size
    with store.open_input_stream(f"{path}/{name}", compression=None) as file:
        raw = bytearray(file.read())
    assert len(raw) == size
    raw[size // 2:size // 2 + 40] = bytes(40)
    with store.open_output_stream(f"{path}/{name}", compression=None) as file:
        file.write(bytes(raw))
    with pytest.raises(ValueError, match="holds 20"):
        read_archives(archives, folder).count()
