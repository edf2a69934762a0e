"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is a request, a response (or revisit) and a metadata record that name each other by
WARC-Concurrent-To. Archives are gzipped record by record and lie in the shared folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massloom.session import Scratch

FILE_BYTES = 8 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
_DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target string, payload_digest string, measured_digest string, payload binary, fields map<string,string>"
_NO_URI = re.compile(r"[\x00-\x20\x7f]")


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ':'.join(map(str, parts)))}>"


def bare_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, own: str, target: str, content_type: str, block: bytes, **headers: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {_DATE}"]
    if target:
        lines.append(f"WARC-Target-URI: {target}")
    lines += [f"WARC-{name.replace('_', '-')}: {value}" for name, value in headers.items() if value]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def capture_records(page_id: int | None, url: str | None, payload: bytes, digest: str, nth: int, original: int | None, revisit: bool) -> bytes:
    """The three gzipped records of one capture."""
    target = _NO_URI.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    key = (page_id, digest, nth)
    request, answer, about = (record_id(*key, kind) for kind in ("request", "answer", "metadata"))
    parts = urlsplit(target) if target.isprintable() and "[" not in target else urlsplit("")
    asked = f"GET {parts.path or '/'} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    whole = b"".join(
        gzip.compress(record, compresslevel=4, mtime=0)
        for record in (
            _record("request", request, target, "application/http; msgtype=request", asked, Concurrent_To=answer),
            _record(
                "revisit" if revisit else "response", answer, target, "application/http; msgtype=response", http + (b"" if revisit else payload), Payload_Digest=f"sha1:{digest}",
                Refers_To=record_id(original, digest, 0, "answer") if revisit else None, Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
            ),
            _record(
                "metadata", about, target, "application/warc-fields",
                f"page-id: {'' if page_id is None else page_id}\r\n".encode(), Concurrent_To=answer,
            ),
        )
    )
    return whole


def _with_originals(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, packed payload, digest, nth, original and revisit of each page.

    The payload passes one shuffle, packed; which page is the original is found from digests alone.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [(x.as_py() or "").encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bare_digest(x) for x in payloads], pa.string()), pa.array([len(x) for x in payloads], pa.int64())], ["page_id", "digest", "bytes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                ids, urls, htmls = (batch.column(i).slice(low, 256) for i in range(3))
                payloads = [(x or "").encode() for x in htmls.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array([bare_digest(x) for x in payloads], pa.string()), pa.array([engine.compress(x) for x in payloads], pa.binary())], ["page_id", "url", "digest", "packed"])

    scratch = Scratch(pages.sparkSession, "warc-pages")
    keys = scratch.keep(pages.select("page_id", "html").mapInArrow(digests, "page_id long, digest string, bytes long"), "digests")
    # The largest page_id of each payload; counted before the shuffle, so copies of one page stay few rows.
    largest = scratch.keep(keys.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("original"), F.lit(True).alias("grouped")), "originals")
    page_key = F.coalesce("page_id", F.lit(-(1 << 63))).alias("key")
    flags = keys.distinct().join(largest, ["digest", "bytes"], "left").select(page_key, "digest", "original", "grouped")
    rows = pages.mapInArrow(pack, "page_id long, url string, digest string, packed binary").withColumn("key", page_key)
    rows = rows.join(flags.hint("shuffle_merge"), ["key", "digest"])
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "digest").orderBy("url")) - 1).drop("key")
    is_first = F.col("page_id").eqNullSafe(F.col("original")) & (F.col("nth") == 0)
    return rows.withColumn("revisit", F.col("grouped").isNotNull() & ~is_first).drop("grouped")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> int:
    """Write ``pages`` (page_id, url, html) as .warc.gz files below ``folder``; returns the number of captures.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least ``least_bytes``
    the one with the largest page_id is a response and the others revisit it; rows that repeat a
    page_id with one payload revisit the first of them. A null page_id is the least. White space and
    control characters of a url are percent-encoded; a null url is empty. Names and contents of the files depend on
    the rows alone, and a file appears under its name only when whole, so a task that runs again
    writes the same files over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        partition, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        held, size, files, total = [], 0, 0, 0
        unpack = zstandard.ZstdDecompressor().decompress

        def flush() -> None:
            nonlocal held, size, files
            if held:
                name = f"{root}/part-{partition:06d}-{files:05d}.warc.gz"
                with store.open_output_stream(f"{root}/_{attempt}-{files}.tmp") as out:
                    for part in held:
                        out.write(part)
                store.move(f"{root}/_{attempt}-{files}.tmp", name)
                held, size, files = [], 0, files + 1

        for batch in batches:
            for page_id, url, packed, digest, nth, original, revisit in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                held.append(capture_records(page_id, url, unpack(packed), digest, nth, original, revisit))
                size += len(held[-1])
                total += 1
                if size >= file_bytes:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["captures"])

    rows = _with_originals(pages, least_bytes).sortWithinPartitions("page_id", "digest", "nth")
    rows = rows.select("page_id", "url", "packed", "digest", F.col("nth").cast("long"), "original", "revisit")
    return rows.mapInArrow(run, "captures long").agg(F.sum("captures")).first()[0] or 0


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a file gzipped record by record."""
    at, step = 0, 1 << 14
    while at < len(data):
        inflater, parts = zlib.decompressobj(31), []
        while not inflater.eof:  # in steps, since what follows a record is copied each time
            parts.append(inflater.decompress(data[at : at + step]))
            at += min(step, len(data) - at)
            if at >= len(data) and not inflater.eof:
                parts.append(inflater.flush())
                break
        at -= len(inflater.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")[1:]
        headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
        yield headers, rest[: int(headers["content-length"])]


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives below ``folder``; columns as in ``RECORD``.

    The payload of a response is its HTTP body, whose digest is measured as it is read; metadata
    fields come as a map.
    """
    names = [part.split()[0] for part in RECORD.split(", ")]
    types = [*[pa.string()] * 7, pa.binary(), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            rows, size = [], 0
            for content in batch.column(0):
                for headers, block in parse_archive(content.as_py()):
                    kind = headers["warc-type"]
                    body = block.partition(b"\r\n\r\n")[2] if kind in ("response", "request") else None
                    fields = [tuple(line.partition(": ")[::2]) for line in block.decode().split("\r\n") if line] if kind == "metadata" else None
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    measured = bare_digest(body) if kind == "response" else None
                    rows.append((headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest, measured, body, fields))
                    size += len(block)
                    if size >= 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """One nested row per capture: capture_id, request, response and metadata, joined by concurrent-to.

    A capture is known by its response's or revisit's record id; request and metadata are null
    where the archive holds none. ``others`` may give the request and metadata records apart, so
    that reading them does not carry payloads.
    """
    others = records if others is None else others
    columns = [F.col(name) for name in ("record_id", "refers_to", "target", "payload_digest", "measured_digest", "payload", "type")]
    answers = records.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct(*columns).alias("response"))
    requests = others.filter("type = 'request'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target").alias("request"))
    about = others.filter("type = 'metadata'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields").alias("metadata"))
    return answers.join(requests.hint("merge"), "capture_id", "left").join(about.hint("merge"), "capture_id", "left")


def archive_digests(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each capture that the archives hold.

    Length and digest are those of the body that was read; a revisit takes them from the response
    that its refers-to record id names, and has nulls where the archives hold no such response. A
    body, or a response revisited, that does not have the digest its record states is an error.
    """
    scratch = Scratch(spark, "warc-records")
    records = read_records(spark, folder)
    others = scratch.keep(records.filter(F.col("type").isin("request", "metadata")).drop("payload"), "others")
    captures = assemble(records, others)
    found = captures.select(
        "capture_id",
        F.nullif(F.col("metadata.fields")["page-id"], F.lit("")).cast("long").alias("page_id"),
        F.octet_length("response.payload").cast("long").alias("bytes"),
        F.col("response.type").alias("type"),
        F.col("response.refers_to").alias("refers_to"),
        F.col("response.payload_digest").alias("stated"),
        F.col("response.measured_digest").alias("measured"),
    )
    found = scratch.keep(found, "captures")
    bodies = found.filter("type = 'response'").select(F.col("capture_id").alias("body_id"), F.col("page_id").alias("body_page"), F.col("bytes").alias("body_bytes"), F.col("measured").alias("body_digest"))
    whole = found.join(bodies.hint("merge"), F.coalesce("refers_to", "capture_id") == F.col("body_id"), "left")
    wrong = F.raise_error(F.concat(F.col("capture_id"), F.lit(": the payload does not have its digest")))
    return whole.select(
        "page_id",
        F.col("body_bytes").alias("payload_bytes"),
        F.when(F.col("body_digest") != F.col("stated"), wrong).otherwise(F.col("body_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", F.col("body_page")).alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return what reading them back gives."""
    spark = pages.sparkSession
    folder = Scratch(spark, "warc").path("archives")
    return archive_digests(spark, folder) if write_archives(pages, folder) else spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS original FROM p),
b AS (SELECT page_id, original, strlen(html)::BIGINT AS payload_bytes, (unhex(sha1(html))::BIT)::VARCHAR AS bits FROM g)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + substr(bits, (1 + 5 * i)::BIGINT, 1)::INT * 16 + substr(bits, (2 + 5 * i)::BIGINT, 1)::INT * 8 + substr(bits, (3 + 5 * i)::BIGINT, 1)::INT * 4
      + substr(bits, (4 + 5 * i)::BIGINT, 1)::INT * 2 + substr(bits, (5 + 5 * i)::BIGINT, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
FROM b
"""
