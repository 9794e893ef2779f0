from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import zlib

import pytest

from opslens.llm import warc


def test_query_equals_sql(spark, duck, sf):
    got = sorted(map(tuple, warc.query(spark, sf).collect()))
    assert got == sorted(duck.sql(warc.ORACLE_SQL).project("page_id, payload_bytes, payload_digest, record_type, refers_to").fetchall())


def written(spark, rows, min_bytes=0, schema="page_id long, url string, html string"):
    path = warc.scratch_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, schema), path, min_bytes)
    return path, {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}


def test_round_trip_of_odd_rows(spark):
    big = "".join(chr(97 + i * i % 23) for i in range(9000)) * 2000  # above 16 MiB
    rows = [(1, "http://a/ b\r\nc", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "é", "ünï ✓"), (None, "n", "same"), (7, "u", "x"), (7, "u", "x")]
    _, got = written(spark, rows)
    assert [got[i]["record_type"] for i in (1, 2, 3, 4, 5, 6, None)] == ["revisit", "response", "revisit", "response", "response", "response", "revisit"]
    assert got[1]["refers_to"] == got[None]["refers_to"] == 2 and got[3]["refers_to"] == 4
    assert got[2]["payload"] == b"same" and got[5]["payload"] == big.encode() and got[1]["payload"] is None
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert got[1]["url"] == "http://a/%20b%0D%0Ac" and got[2]["url"] is None and got[6]["url"] == "é"


def test_small_payloads_are_no_revisits(spark):
    _, got = written(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], min_bytes=3)
    assert [got[i]["record_type"] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]


def test_empty_table_and_extra_columns(spark):
    path, got = written(spark, [])
    assert got == {}
    _, got = written(spark, [(1, "u", "a", 5, "t"), (2, "u", "a", 6, "t")], schema="page_id long, url string, html string, rows int, refers_to string")
    assert got[1]["refers_to"] == 2


def test_files_are_plain_gzip_members(spark):
    path, got = written(spark, [(i, f"http://x/{i}", "text " * i) for i in range(40)])
    found = 0
    for (data,) in spark.read.format("binaryFile").load(path).select("content").collect():
        data = bytes(data)
        while data:
            z = zlib.decompressobj(31)
            record = z.decompress(data)
            assert z.eof and record.startswith(b"WARC/1.1\r\n")
            data = z.unused_data
            found += 1
    assert found == len(got) == 40


def member_with_magic_inside(payload: bytes) -> bytes:
    """A member with a header field and stored data that hold the magic bytes."""
    z = zlib.compressobj(0, zlib.DEFLATED, -15)
    body = z.compress(payload) + z.flush()
    extra = warc.MAGIC * 3
    return warc.MAGIC + b"\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(payload), len(payload))


@pytest.mark.parametrize("range_bytes", [64, 333, 4096, 1 << 20])
def test_members_that_false_magic_and_ranges_tear(spark, tmp_path, range_bytes):
    records = []
    for i in range(30):
        html = f"page {i} " + "\x1f" * i + "z" * (i * 40)
        records.append(warc.record(i, f"http://x/{i}", html.encode() + warc.MAGIC * (i % 4), None, False))
    (tmp_path / "a.warc").write_bytes(b"".join(map(member_with_magic_inside, records[:20])))
    (tmp_path / "b.warc").write_bytes(b"".join(map(member_with_magic_inside, records[20:])) + warc.EMPTY)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert got == {i: f"page {i} ".encode() + b"\x1f" * i + b"z" * (i * 40) + warc.MAGIC * (i % 4) for i in range(30)}


def foreign(kind, block, *headers, length=None, newline="\r\n"):
    """A member with a record as other writers make it."""
    head = ["WARC/1.0", f"WARC-Type: {kind}" if kind else "X: y", *headers, f"Content-Length: {len(block) if length is None else length}"]
    return newline.join(head).encode() + 2 * newline.encode() + block + b"\r\n\r\n"


def gz(*records):
    return gzip.compress(b"".join(records), 6, mtime=0)


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


HTTP = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n"


def foreign_archive():
    noise = bytes(i * i % 251 for i in range(5000))
    long = gz(foreign("response", HTTP + noise * 3, "WARC-Record-ID: <urn:uuid:broken>"))
    return [
        gz(foreign("warcinfo", b"software: x\r\n", "WARC-Filename: a.warc.gz", "WARC-Record-ID: <urn:uuid:info>")),
        gz(foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "Content-Type: application/http; msgtype=request")),
        gz(foreign("response", HTTP + b"one", "WARC-Record-ID: <urn:uuid:1>", "WARC-Target-URI: http://a/1", f"WARC-Payload-Digest: sha1:{b32(b'one')}")),
        gz(foreign("response", HTTP + b"two", "warc-record-id: <urn:uuid:2>", "WARC-TARGET-URI:http://a/", "  2", "WARC-Date:2020-01-01T00:00:00Z")),
        gz(foreign("metadata", b"fetchTimeMs: 5\r\n"), foreign("response", b"HTTP/1.0 200 OK\nTransfer-Encoding: Chunked\n\n3;x\r\nabc\r\n2\r\nde\r\n0\r\n\r\n",
                                                                "WARC-Record-ID: <urn:uuid:3>", f"WARC-Payload-Digest: SHA-1:{hashlib.sha1(b'abcde').hexdigest()}", newline="\n")),
        long[:len(long) // 2],  # cut off, and more records written after it
        gz(foreign("response", HTTP + b"four", "WARC-Record-ID: <urn:uuid:4>", f"WARC-Payload-Digest: sha1:{b32(b'other')}")),
        gz(foreign("resource", b"\x00plain\xff", "WARC-Record-ID: <urn:uuid:5>", "Content-Type: image/gif")),
        gz(foreign("revisit", HTTP, "WARC-Record-ID: <urn:uuid:6>", "WARC-Refers-To: <urn:uuid:1>", f"WARC-Payload-Digest: sha1:{b32(b'one')}")),
        gz(foreign("response", HTTP + b"seven", "WARC-Record-ID: <urn:uuid:7>", length="many")),
        gz(foreign("response", HTTP + b"eight", "WARC-Record-ID: <urn:uuid:8>", length=500)),
        gz(foreign(None, b"q", "WARC-Record-ID: <urn:page:99999999999999999999>")),
        gz(foreign("response", b"", "WARC-Record-ID: <urn:page:-12>", "Content-Type: application/http")),
        gz(b"no record"), gz(b""),
        gz(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>"),
    ]


@pytest.mark.parametrize("range_bytes", [100, 1 << 20])
def test_archives_of_other_writers(spark, tmp_path, range_bytes):
    members = foreign_archive()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    flipped = bytearray(members[2])
    flipped[-6] ^= 1  # its checksum
    (tmp_path / "b.warc.gz").write_bytes(bytes(flipped) + members[3] + members[2][:-9])
    (tmp_path / "c.warc.gz").write_bytes(b"")
    (tmp_path / "d.gz").write_bytes(gzip.compress(b"nothing of the kind"))
    conf = {"spark.sql.files.maxPartitionBytes": str(range_bytes), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = warc.read_records(spark, str(tmp_path)).collect()
        pages = warc.read_archives(spark, str(tmp_path)).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    short = {r["record_id"]: r for r in rows if r["error"] is None}
    assert {k: (r["record_type"], None if r["payload"] is None else bytes(r["payload"])) for k, r in short.items() if k} == {
        "urn:uuid:info": ("warcinfo", b"software: x\r\n"), "urn:uuid:1": ("response", b"one"), "urn:uuid:2": ("response", b"two"), "urn:uuid:3": ("response", b"abcde"),
        "urn:uuid:5": ("resource", b"\x00plain\xff"), "urn:uuid:6": ("revisit", None), "urn:page:-12": ("response", b"")}
    assert short["urn:uuid:2"]["url"] == "http://a/ 2" and short["urn:uuid:2"]["date"] == "2020-01-01T00:00:00Z"
    assert short["urn:uuid:6"]["refers_to_id"] == "urn:uuid:1" and short["urn:uuid:6"]["refers_to"] is None and short["urn:uuid:6"]["payload_digest"] == b32(b"one")
    assert short["urn:page:-12"]["page_id"] == -12 and short["urn:uuid:3"]["payload_digest"] == b32(b"abcde")
    assert sorted(r["record_type"] for r in rows if r["record_id"] is None) == ["metadata", "request"]
    wrong = sorted((r["record_id"], r["error"]) for r in rows if r["error"] is not None)
    assert [k for k, _ in wrong] == ["urn:page:99999999999999999999", "urn:uuid:1", "urn:uuid:1", "urn:uuid:4", "urn:uuid:7", "urn:uuid:8", "urn:uuid:9", "urn:uuid:broken"]
    why = dict(wrong)
    assert "digest" in why["urn:uuid:4"] and why["urn:uuid:7"] == "no content length" and why["urn:uuid:8"] == "block cut short"
    assert why["urn:uuid:9"] == "header cut short" and "damaged member" in why["urn:uuid:broken"] and "damaged member" in why["urn:uuid:1"]
    assert pages == sum(r["record_type"] in warc.PAGE_TYPES for r in rows)
