"""WARC archives: a writer, and a sequential reader with one gzip member per record.

The writer makes archives of about ``ARCHIVE_BYTES`` each: every record is its own gzip member.
Spark writes them as rows (archive, content) of a Parquet table in the shared folder, so a lost
executor's archives are made again and only committed ones are seen, on any store that Spark can
write. ``read_archives`` takes such rows, or those of Spark's ``binaryFile`` source over plain
``.warc.gz`` files.

The reader walks the members in order. It feeds the bytes to zlib in pieces of ``CHUNK``, frames the
record by its Content-Length, checks that member and record end together and that payload and block
have the digests that the header gives.

Defined results: a null html is an empty payload, a null url an empty target. Of records with equal
payloads of at least ``min_bytes`` bytes, that with the largest page_id is the response and the
others revisit it; null ids count as smallest. Rows that share the largest id are all responses. If
all ids of a payload are null, all are responses. Repeated rows give repeated records. An empty table
gives no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, table

ARCHIVE_BYTES = 8 << 20
CHUNK = 64 << 10
#: Payloads that repeat are broadcast up to so many rows (50 bytes each), and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
_DATE = "2020-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """An archive that breaks the format, or a digest that does not agree."""


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id, url, payload: bytes, record_type: str = "response", refers_to=None, level: int = 4) -> bytes:
    """One record as one gzip member. A revisit holds the HTTP head and no payload."""
    http = _HTTP % len(payload)
    block = http + (payload if record_type == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=~-._')}",
        f"WARC-Payload-Digest: sha1:{_b32(payload)}",
        f"WARC-Block-Digest: sha1:{_b32(block)}",
        f"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if record_type == "revisit":
        head.insert(3, f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(data: bytes, chunk: int = CHUNK):
    """The content of each gzip member in turn, decompressed a piece at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + chunk]
            if not len(piece):
                raise WarcError("the archive ends inside a member")
            try:
                out.append(z.decompress(piece))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        n = int(names["content-length"])
    except (KeyError, ValueError):
        raise WarcError("no Content-Length") from None
    if n < 0 or rest[n:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not frame the record")
    return names, rest[:n]


def read_records(data: bytes):
    """Verified records of one archive: (page_id, url, payload_bytes, payload_digest, record_type, refers_to)."""
    for m in members(data):
        h, block = parse_record(m)
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise WarcError("no HTTP head in the block")
        if _b32(block) != h["warc-block-digest"].removeprefix("sha1:"):
            raise WarcError("the block does not have its digest")
        digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
        n = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        if kind == "response" and (_b32(payload) != digest or len(payload) != n):
            raise WarcError("the payload does not have its digest or its length")
        ident = lambda k: h[k].removeprefix("<urn:page:").rstrip(">")
        own, refers = ident("warc-record-id"), ident("warc-refers-to") if kind == "revisit" else ""
        yield int(own) if own else None, unquote(h["warc-target-uri"]), n, digest, kind, int(refers) if refers else None


def planned(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, record_type and refers_to of every row."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload")
    ).withColumn("digest", F.when(F.length("payload") >= min_bytes, F.unhex(F.sha1("payload"))))
    again = materialize(
        rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1 and first_id is not null").select("digest", "first_id"), "repeated"
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(broadcast_if(again, again.count(), BROADCAST_ROWS), "digest", "left").select(
        "page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def write_archives(plan: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (content, records): archives of about ``archive_bytes``."""

    def run(batches):
        parts, size = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                parts.append(encode_record(r[0], r[1], r[2], r[3], r[4]))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([len(parts)], pa.int64())], ["content", "records"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([len(parts)], pa.int64())], ["content", "records"])

    return plan.mapInArrow(run, "content binary, records long")


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """Verified records of archives, in order within each. Fails on the first that breaks the format."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = list(read_records(content.as_py() or b""))
                for a in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[a : a + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return archives.select(content_col).mapInArrow(run, _COLUMNS)


def op6_warc_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(write_archives(planned(table(spark, sf_dir, "pages"))), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS x FROM p),
d AS (SELECT page_id, payload_bytes,
        list_aggregate(list_transform(range(32), lambda i:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), 'string_agg', '') AS payload_digest
      FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM m
"""
