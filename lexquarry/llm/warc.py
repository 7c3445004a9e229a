"""Content-addressed web archive: payloads once by digest, exact record headers apart, records by join.

``<archive>/payloads`` holds each payload once under its SHA-256, compressed; ``<archive>/headers``
holds for every record its exact WARC and HTTP header bytes and the digest of its payload. A record
is put together by joining the two and is checked against the digest and the lengths in its header.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.common import bounded

LEAST = 100
CRLF = "\r\n"
SHAPE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def digested(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (UTF-8; null: empty), n, digest."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return bounded(pages).select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"n": F.length("payload").cast("long"), "digest": F.sha2("payload", 256)})


def headers(pages: DataFrame, date: str, least: int = LEAST) -> DataFrame:
    """Per record: page_id, digest, warc and http header bytes. No payload is shuffled."""
    rows = digested(pages).select("page_id", "url", "n", "digest")
    first = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first")).withColumnRenamed("digest", "of")
    rows = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("n") >= least), "left")
    again = F.col("of").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    uri = F.regexp_replace(F.regexp_replace("url", r"[\r\n\t ]", "%20"), r"[\x00-\x1f\x7f]", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _line("Content-Length", F.col("n").cast("string")), F.lit(CRLF))
    block = F.length(http) + F.when(again, 0).otherwise(F.col("n"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.when(again, "revisit").otherwise("response")), _line("WARC-Record-ID", _urn(F.col("page_id"))), _line("WARC-Date", F.lit(date)),
        F.when(uri.isNull(), "").otherwise(_line("WARC-Target-URI", uri)), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(_line("WARC-Refers-To", _urn(F.col("first"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        _line("Content-Type", F.lit("application/http;msgtype=response")), _line("Content-Length", block.cast("string")), F.lit(CRLF),
    )
    return rows.select("page_id", "digest", F.encode(warc, "UTF-8").alias("warc"), F.encode(http, "UTF-8").alias("http"))


def payloads(pages: DataFrame) -> DataFrame:
    """Every distinct payload once: digest, n, packed (zstandard). Fails if two payloads share a digest."""

    def squeeze(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = b["payload"].to_pylist()
            yield pa.RecordBatch.from_arrays([b["digest"], b["n"], pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), pa.array([z.compress(x) for x in raw], pa.binary())], names=["digest", "n", "second", "packed"])

    packed = digested(pages).select("digest", "n", "payload").mapInArrow(squeeze, "digest string, n long, second binary, packed binary")
    one = packed.groupBy("digest").agg(F.min("second").alias("a"), F.max("second").alias("b"), F.first("n").alias("n"), F.first("packed").alias("packed"))
    return one.select(F.when(F.col("a") == F.col("b"), F.col("digest")).otherwise(F.raise_error(F.lit("two payloads with one digest"))).alias("digest"), "n", "packed")


def write(pages: DataFrame, archive: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Writes one record per row.

    Of records with equal payloads of ``least`` bytes or more that with the smallest page_id is the
    response (a null page_id comes last; rows that repeat it are responses too); the others
    revisit it. A null payload is empty; a null url leaves out its line. Other columns are ignored.
    """
    headers(pages, date, least).write.option("compression", "zstd").parquet(f"{archive}/headers")
    payloads(pages).write.option("compression", "zstd").parquet(f"{archive}/payloads")


def records(spark: SparkSession, archive: str) -> DataFrame:
    """The archive's records: warc and http header bytes, and the payload that is theirs, packed."""
    h = spark.read.parquet(f"{archive}/headers")
    p = spark.read.parquet(f"{archive}/payloads").withColumnRenamed("digest", "key")
    return h.join(p, F.col("digest") == F.col("key"), "left").select("warc", "http", "packed")


FIELD = re.compile(rb"^([^:\r\n]+): ([^\r\n]*)\r\n", re.M)


def parsed(warc: bytes) -> dict[bytes, bytes]:
    if not warc.startswith(b"WARC/1.1\r\n") or not warc.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC header")
    return dict(FIELD.findall(warc))


def record_bytes(warc: bytes, http: bytes, payload: bytes) -> bytes:
    """A record as it stands in a .warc file; a revisit has no payload of its own."""
    return warc + http + (b"" if b"\r\nWARC-Type: revisit\r\n" in warc else payload) + b"\r\n\r\n"


def read(spark: SparkSession, archive: str) -> DataFrame:
    """Rebuilds and checks every record: page_id, payload_bytes, payload_digest, record_type, refers_to, uri."""

    def rebuild(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        page = lambda x: None if x is None or x == b"<urn:page:none>" else int(x[10:-1])
        for b in batches:
            out = []
            for warc, http, packed in zip(*(b[c].to_pylist() for c in ("warc", "http", "packed"))):
                f, payload = parsed(warc), z.decompress(packed)
                digest = hashlib.sha256(payload).hexdigest()
                block = len(record_bytes(warc, http, payload)) - len(warc) - 4
                if f[b"WARC-Payload-Digest"] != b"sha256:" + digest.encode() or int(f[b"Content-Length"]) != block:
                    raise ValueError("a record doesn't match its header")
                uri = f.get(b"WARC-Target-URI")
                out.append((page(f[b"WARC-Record-ID"]), len(payload), digest, f[b"WARC-Type"].decode(), page(f.get(b"WARC-Refers-To")), uri and uri.decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"])

    return records(spark, archive).mapInArrow(rebuild, SHAPE)
