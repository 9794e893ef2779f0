"""WARC archives: a writer and a splittable reader, both on Spark's own file access.

Writer. Every page becomes a gzip member of its own holding one WARC record.
Members are bytes, and the text writer puts a one-byte separator after each
row; a member ends in the top byte of its uncompressed length, which is zero
below 16 MiB. So a row is written without that last byte and the separator
NUL supplies it: the files are plain concatenations of gzip members, as any
WARC tool reads them. (A larger record is followed by an empty member, whose
last byte is zero in turn.)

Reader. The text reader deals the files out as byte ranges and cuts each range
at the gzip magic 1f 8b 08; the range in which a magic starts owns what
follows it up to the next. These are candidates only, since the three bytes
also turn up inside compressed data: a task inflates each, takes it for a
member when the stream starts with a WARC version line, and appends the next
candidates while the stream has not ended. A member that false magic split
across the end of a range leaves an unfinished head and orphaned tails; these
few are brought together per file and joined in order.

Nulls and odd rows: a null payload is empty, a null url or id is left out of
the headers and comes back null; repeated rows are written as often as they
occur; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.common import fresh, table
from opslens.session import ensure_checkpoint_dir

MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member.
EMPTY = bytes.fromhex("1f8b080000000000000303000000000000000000")
LEVEL = 6
#: Uncompressed bytes of records that a reading task hands on at once.
BATCH_BYTES = 8_000_000
RECORD_ID = "urn:page:"
_BLANK_LINE = re.compile(rb"\r?\n\r?\n")
_WHOLE_NUMBER = re.compile(r"[+-]?[0-9]{1,19}")
_HEX_NUMBER = re.compile(rb"[0-9A-Fa-f]{1,15}")

RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "payload binary, record_id string, refers_to_id string, date string, content_type string, error string")
#: The text reader takes a codec by the end of a file's name and then neither cuts
#: the file into ranges nor shows its bytes. Of the codecs it tries the nearest in
#: the order of reversed names; a pass-through one for names that no file has comes
#: between ``.gz`` and all real names, so ``.warc.gz`` files are read as they are.
AS_THEY_ARE = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"} | {
    f"{where}io.compress.passthrough.extension": ".\x01.gz" for where in ("", "org.apache.hadoop.shaded.")}  # the client's jars may be shaded
#: Types of the records that hold, or stand for, the content of a page.
PAGE_TYPES = ["response", "revisit", "resource"]
#: What became of candidates: a whole member, a damaged one, parts without the rest.
WHOLE, DAMAGED, LOOSE = range(3)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return MAGIC + b"\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _header_value(value: str) -> str:
    return "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) for b in value.encode("utf-8", "surrogatepass")).encode("latin-1").decode("utf-8", "replace")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header but no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <{RECORD_ID}{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <{RECORD_ID}{refers_to}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """``pages`` with a column (its name is returned) that holds the largest
    page_id among the pages of at least ``min_bytes`` with the same payload,
    null where there is no other. Only payloads that occur twice are joined
    back, so their table stays small where few pages repeat."""
    key, same, target = fresh(pages, "payload_key", "same_key", "refers_to")
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.withColumn(key, F.when(F.octet_length(html) >= min_bytes, F.sha2(html, 256)))
    twice = (keyed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(same))
             .agg(F.count(F.lit(1)).alias("rows"), F.max("page_id").alias(target)).where("rows > 1").drop("rows"))
    joined = keyed.join(twice, F.col(key) == F.col(same), "left")
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], F.when(~F.col("page_id").eqNullSafe(F.col(target)), F.col(target)).alias(target)), target


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) under ``path``."""
    marked, target = with_revisits(pages, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, html, refers in zip(*batch.columns, strict=True):
                data = record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers.as_py(), refers.is_valid)
                member = _member(data)
                if member[-1]:
                    member += EMPTY
                out.append(member[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = marked.select(F.col("page_id").cast("long"), "url", "html", F.col(target).cast("long")).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", "\x00").text(path)


def _salvage(part: bytes) -> bytes:
    """What can be inflated of a damaged member, to the byte."""
    z, data = zlib.decompressobj(31), bytearray()
    for i in range(0, len(part), 4096):
        before = z.copy()
        try:
            data += z.decompress(part[i:i + 4096])
        except zlib.error:
            try:
                for j in range(i, i + 4096):
                    data += before.decompress(part[j:j + 1])
            except zlib.error:
                break
    return bytes(data)


def _headers(block: bytes) -> dict[str, str]:
    """Header values by lower-case name; of repeated names the first counts."""
    out: dict[str, str] = {}
    name = ""
    for line in block.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            name = out.setdefault(name, value.strip()) and name
    return out


def _number(value: str | None) -> int | None:
    """A whole number of 64 bits, or None."""
    if value is None or not _WHOLE_NUMBER.fullmatch(value):
        return None
    n = int(value)
    return n if -(1 << 63) <= n < 1 << 63 else None


def _id(value: str | None) -> tuple[int | None, str | None]:
    """(page id if it is one of this writer's, id) of a record id."""
    if not value:
        return None, None
    value = value.strip("<> ")
    return (_number(value.removeprefix(RECORD_ID)) if value.startswith(RECORD_ID) else None), value


def _dechunked(body: bytes) -> bytes | None:
    """The body of a chunked HTTP block, None if it is no whole one."""
    out, at = bytearray(), 0
    while True:
        end = body.find(b"\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not _HEX_NUMBER.fullmatch(size):
            return None
        n = int(size, 16)
        if not n:
            return bytes(out)
        if end + 1 + n > len(body):
            return None
        out += body[end + 1:end + 1 + n]
        at = end + 1 + n + (2 if body[end + 1 + n:end + 3 + n] == b"\r\n" else 1)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digest_fits(declared: str, bodies: list[bytes]) -> bool:
    """Whether a declared digest, in base32 or hexadecimal, is that of a body; one
    of an unknown kind always is."""
    kind, _, value = declared.partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    found = [hashlib.new(kind, body, usedforsecurity=False).digest() for body in bodies]
    return any(value.upper().rstrip("=") in (base64.b32encode(d).decode().rstrip("="), d.hex().upper()) for d in found)


def parse(data: bytes, damage: str | None = None) -> Iterator[tuple]:
    """The fields of ``RECORD`` of each WARC record in the data of a member.
    ``damage`` tells what is known to be wrong with the member."""
    while data.startswith(b"WARC/"):
        blank = _BLANK_LINE.search(data)
        head, rest = (data[:blank.start()], data[blank.end():]) if blank else (data, b"")
        fields = _headers(head)
        errors = [damage] if damage else []
        size = _number(fields.get("content-length"))
        if blank is None:
            errors.append("header cut short")
        elif size is None or size < 0:
            errors.append("no content length")
            size = len(rest.rstrip(b"\r\n"))
        elif size > len(rest):
            errors.append("block cut short")
        block, data = rest[:size or 0], rest[size or 0:].lstrip(b"\r\n")
        kind = fields.get("warc-type", "").lower() or None
        if kind is None:
            errors.append("no record type")
        declared = fields.get("warc-payload-digest")
        payload, length, digest = None, None, None
        if kind in ("response", "request", "revisit") and (block.startswith(b"HTTP/") or "application/http" in fields.get("content-type", "").lower()):
            cut = _BLANK_LINE.search(block)
            http = _headers(block[:cut.start()] if cut else block)
            bodies = [block[cut.end():] if cut else b""]
            if "chunked" in http.get("transfer-encoding", "").lower():
                plain = _dechunked(bodies[0])
                bodies = bodies if plain is None else [plain, bodies[0]]
            said = _number(http.get("content-length"))
        else:
            bodies, said = [block], None
        if kind == "revisit":
            length, digest = said, declared.split(":", 1)[-1] if declared else None
        elif kind is not None:
            payload = bodies[0]
            length, digest = len(payload), _sha1(payload)
            if declared and kind in PAGE_TYPES and not _digest_fits(declared, bodies):
                errors.append("other payload than its digest")
        page, record_id = _id(fields.get("warc-record-id"))
        refers, refers_id = _id(fields.get("warc-refers-to"))
        yield (page, fields.get("warc-target-uri"), kind, refers, length, digest, payload, record_id, refers_id,
               fields.get("warc-date"), fields.get("content-type"), "; ".join(errors) or None)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_RECORD_ARROW = [_ARROW[f.split()[1]] for f in RECORD.split(", ")]
_NAMES = [f.split()[0] for f in RECORD.split(", ")]
_LOOSE = ["file", "start", "nth", "bytes"]
_LOOSE_ARROW = [pa.string(), pa.int64(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _members(parts: Iterator[tuple[tuple, bytes]]) -> Iterator[tuple[int, bytes, list[tuple[tuple, bytes]]]]:
    """From candidates in file order, each with its place (file, range, number):
    what became of them (``WHOLE``, ``DAMAGED``, ``LOOSE``), the data, the parts.
    Loose are an unfinished member at the end of a range and, before the first
    member that starts in a range, what may belong to it."""
    again: deque[tuple[tuple, bytes]] = deque()  # parts that followed a damaged member
    held: list[tuple[tuple, bytes]] = []
    begun = z = None
    data = bytearray()
    while part := again.popleft() if again else next(parts, None):
        span = part[0][:2]
        if held and held[-1][0][:2] != span:  # the range ended inside a member
            yield LOOSE, b"", held
            held = []
        if not held:
            z, data = zlib.decompressobj(31), bytearray()
        held.append(part)
        try:
            data += z.decompress(part[1])
            broken = not bytes(data[:5]) == b"WARC/"[:len(data)]
        except zlib.error:
            broken = True
        if broken:
            first = _salvage(held[0][1])
            if first.startswith(b"WARC/"):
                begun = span
                yield DAMAGED, first, held[:1]
            elif begun != span:
                yield LOOSE, b"", held[:1]
            again.extendleft(reversed(held[1:]))
            held = []
        elif z.eof:
            if data:
                begun = span
                yield WHOLE, bytes(data), held
            held = []
    if held:
        yield LOOSE, b"", held


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records (``RECORD``) of the gzip archives under ``path``, damaged ones
    with an ``error``. The byte ranges are the session's
    (``spark.sql.files.maxPartitionBytes``)."""
    raw = (spark.read.options(**AS_THEY_ARE).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("bytes")))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
        at, nth = None, 0
        for batch in batches:
            for file, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                nth = nth + 1 if (file, start) == at else 0
                at = (file, start)
                if start == 0 and nth == 0:
                    continue  # what stands before the first magic of a file
                yield (file, start, nth), MAGIC + value.as_py()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for state, data, _ in _members(candidates(batches)):
            if state != LOOSE:
                rows += parse(data, "damaged member" if state == DAMAGED else None)
                size += len(data)
                if size > BATCH_BYTES:
                    yield _batch(rows, _NAMES, _RECORD_ARROW)
                    rows, size = [], 0
        yield _batch(rows, _NAMES, _RECORD_ARROW)

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state, _, parts in _members(candidates(batches)):
            if state == LOOSE:
                yield _batch([(*where, part) for where, part in parts], _LOOSE, _LOOSE_ARROW)

    def join_loose(t):
        parts = sorted(zip(*(t.column(c).to_pylist() for c in _LOOSE), strict=True), key=lambda p: p[:3])
        one_range = (((file, 0, 0), part) for file, _, _, part in parts)
        found = []
        for state, data, rest in _members(one_range):
            if state == LOOSE:  # without its end, or no member
                data = _salvage(rest[0][1])
            found += parse(data, None if state == WHOLE else "damaged member")
        return pa.Table.from_batches([_batch(found, _NAMES, _RECORD_ARROW)])

    # the second scan returns next to nothing; keeping the records of one scan for both would write them out again
    torn = raw.mapInArrow(loose, "file string, start long, nth long, bytes binary").groupBy("file").applyInArrow(join_loose, RECORD)
    return raw.mapInArrow(whole, RECORD).unionByName(torn)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path`` that hold, or stand for, the
    content of a page (``PAGE_TYPES``)."""
    return read_records(spark, path).where(F.col("record_type").isin(PAGE_TYPES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
last AS (SELECT html, max(page_id) AS last_id FROM p GROUP BY html),
b AS (SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS hex, last_id FROM p JOIN last USING (html)),
-- base32: 32 groups of 5 bits, each read from the two bytes it touches
d AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     1 + ((('0x' || substr(hex || '0000', 1 + 2 * (i * 5 // 8)::INTEGER, 4))::INTEGER >> (11 - (i * 5 % 8))::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest
  FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM d
"""
