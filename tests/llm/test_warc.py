import base64
import hashlib
import struct

import pytest
import zstandard

from polylabel.llm import common, queries, warc

ROWS = [(1, "http://a/1", "<p>é</p>"), (2, None, None), (3, "http://a/3\r\nX: y", ""), (4, "u", "<p>é</p>"), (5, "u", "x" * 3_000_000),
        (6, "u", "ends\r\n\r\n"), (7, "u", "<p>é</p>"), (7, "u", "<p>é</p>"), (8, "u", "\r\n\r\nWARC/1.1"), (None, "u", "ends\r\n\r\n"),
        *[(i, f"http://b/{i}", f"<html><body>page {i % 40} of many</body></html>") for i in range(100, 200)]]
SCHEMA = "page_id bigint, url string, html string, digest string, keeper int"


def expected(rows, least=0):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == p and j is not None]
        top = max(same, default=None)
        first = len(p) < least or top == i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("rows, least", [(ROWS, 0), (ROWS, 9), ([], 0)])
def test_round_trip(spark, rows, least):
    root = common.Scratch(spark, "t").root
    archives = warc.write(table(spark, rows), root, min_bytes=least)
    got = warc.read(archives, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows, least)
    texts = {(i, (h or "").encode()) for i, _, h in rows}
    assert all(r.payload is None if r.record_type == "revisit" else (r.page_id, bytes(r.payload)) in texts for r in got)
    assert sum(r.records for r in archives.collect()) == len(rows)


def test_file_layout_and_rolling(spark, monkeypatch, tmp_path):
    fs, folder = warc._filesystem(str(tmp_path))
    a = warc.Archive(fs, f"{folder}/x.warc.zst")
    records = [warc.record(i, "u", b"<p>hello hello %d</p>" % i * 50) for i in range(400)]
    for r in records:
        a.add(r)
    assert a.close() < sum(map(len, records)) / 5
    raw = (tmp_path / "x.warc.zst").read_bytes()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and raw[8:12] == b"\x37\xa4\x30\xec"  # a real dictionary
    with fs.open_input_stream(f"{folder}/x.warc.zst", compression=None) as s:
        assert list(warc.frames(s)) == [warc.info(), *records]
    # every record is a frame of its own, readable alone
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:8 + size]))
    assert d.decompressobj().decompress(raw[8 + size:]) == warc.info()


def test_damage_is_noticed(tmp_path):
    fs, folder = warc._filesystem(str(tmp_path))
    a = warc.Archive(fs, f"{folder}/x")
    a.add(warc.record(1, "u", b"abc" * 100))
    a.close()
    (tmp_path / "y").write_bytes((tmp_path / "x").read_bytes()[:-3])
    with fs.open_input_stream(f"{folder}/y") as s, pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(s))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = queries.op6_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_archives_are_read_in_parallel(spark):
    rows = [(i, f"http://b/{i}", f"<p>page {i}</p>" * 20) for i in range(400)]
    df = table(spark, rows).repartition(16)
    archives = warc.write(df, common.Scratch(spark, "t").root)
    n = archives.count()
    got = warc.read(archives)
    parts = got.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert n >= 8 and sum(parts) == 400 and len(parts) == n and sum(map(bool, parts)) > n / 3
