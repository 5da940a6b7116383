"""WARC archives as a table of chunks.

An archive is a table of rows (record number, chunk number, bytes); its rows in that order are a WARC file.
Payloads are cut into chunks, each with the digest of the payload up to its end, so that a reader holds one
chunk and one running digest at a time, whatever the size of a record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_parts, stored, table

CHUNK_BYTES = 64 * 1024
#: Smaller payloads are never replaced by a reference.
LEAST_REVISIT_BYTES = 0
#: Revisits (a digest and two numbers each) up to which their list is sent to all tasks; a longer one is joined by shuffle.
SENT_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_no long, chunk_no int, n_chunks int, digest_so_far string, data binary"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def classified(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html (binary), digest (of the html), refers_to: null for responses, the response's page_id for revisits.

    Of equal payloads that with the largest page_id is the response. Null html counts as empty. Ids may repeat: all rows
    of the largest id are responses; rows without an id refer to it too, or are all responses if none has an id.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    pages = pages.withColumn("digest", F.sha1("html"))
    keys = pages.select("page_id", "digest", F.octet_length("html").alias("n"))
    groups = keys.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "response")
    revisits = keys.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("response")))
    revisits = revisits.groupBy("page_id", "digest").agg(F.max("response").alias("refers_to")).withColumnsRenamed({"page_id": "r_id", "digest": "r_digest"})
    revisits = stored(revisits, "revisits")
    if revisits.count() <= SENT_ROWS:
        revisits = F.broadcast(revisits)
    return pages.join(revisits, (pages.digest == F.col("r_digest")) & pages.page_id.eqNullSafe(F.col("r_id")), "left").select("page_id", "url", "html", "digest", "refers_to")


def record_head(page_id: int | None, record_no: int, url: str | None, payload_bytes: int, sha1: bytes, refers_to: int | None) -> bytes:
    """All of a record before its payload: the WARC header and the HTTP header that starts its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}:{record_no}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c.isprintable()))
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(sha1)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (payload_bytes if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def record_chunks(head: bytes, payload: memoryview, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, str, bytes]]:
    """chunk number, number of chunks, digest of the payload so far, bytes. The first holds the head, the last the record's end."""
    n, running = max(1, -(-len(payload) // size)), hashlib.sha1()
    for k in range(n):
        part = payload[k * size : (k + 1) * size]
        running.update(part)
        yield k, n, base32_sha1(running.digest()), b"".join([head if k == 0 else b"", part, b"\r\n\r\n" if k == n - 1 else b""])


def write(records: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of classified() pages. Payloads are sliced where Arrow holds them, and rows leave a task as they are made: no record is copied whole."""

    def run(batches):
        names = ["record_no", "chunk_no", "n_chunks", "digest_so_far", "data"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            rows, held = [], 0
            for no, page, url, html, digest, refers in zip(*(b.column(c) for c in ("record_no", "page_id", "url", "html", "digest", "refers_to")), strict=True):
                no, refers, payload = no.as_py(), refers.as_py(), memoryview(html.as_buffer())
                head = record_head(page.as_py(), no, url.as_py(), len(payload), bytes.fromhex(digest.as_py()), refers)
                for chunk in record_chunks(head, payload if refers is None else memoryview(b""), size):
                    rows.append((no, *chunk))
                    held += len(chunk[3])
                    if held > 4_000_000:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    return records.withColumn("record_no", F.monotonically_increasing_id()).mapInArrow(run, CHUNKS)


class Reader:
    """Takes the chunks of one record in order; keeps its head, a running digest and counts."""

    def __init__(self):
        self.running, self.bytes, self.head, self.intact, self.next = hashlib.sha1(), 0, None, True, 0

    def add(self, chunk_no: int, n_chunks: int, digest_so_far: str, data: bytes) -> None:
        self.intact &= chunk_no == self.next
        self.next += 1
        part = memoryview(data)
        if chunk_no == 0:
            end = data.index(b"\r\n\r\n") + 4
            http = data.index(b"\r\n\r\n", end) + 4
            self.head = [dict(x.split(": ", 1) for x in data[i:j].decode().split("\r\n")[1:] if ": " in x) for i, j in ((0, end), (end, http))]
            self.left = int(self.head[0]["Content-Length"]) - (http - end)
            part = part[http:]
        part = part[: self.left]
        self.left -= len(part)
        self.running.update(part)
        self.bytes += len(part)
        self.intact &= base32_sha1(self.running.digest()) == digest_so_far

    def row(self) -> tuple:
        warc, http = self.head
        digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
        response = warc["WARC-Type"] == "response"
        own = base32_sha1(self.running.digest())
        page = warc["WARC-Record-ID"].split(":")[2]
        refers = None if response else int(warc["WARC-Refers-To"].strip("<>").split(":")[2])
        intact = self.intact and not self.left and (not response or (own == digest and self.bytes == int(http["Content-Length"])))
        return None if page == "none" else int(page), warc.get("WARC-Target-URI"), self.bytes if response else int(http["Content-Length"]), own if response else digest, warc["WARC-Type"], refers, intact


def read(archive: DataFrame) -> DataFrame:
    """One row per record of a chunk table: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and whether its chunks, digests and lengths agree.

    Records of one chunk are read where they lie; only chunks of larger ones are brought together by record, in order.
    """

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        names = [x.split()[0] for x in READ.split(", ")]
        own, at = None, None

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            rows = []
            for no, chunk, n, digest, data in zip(*(b.column(c) for c in ("record_no", "chunk_no", "n_chunks", "digest_so_far", "data")), strict=True):
                if no.as_py() != at:
                    if own is not None:
                        rows.append(own.row())
                    own, at = Reader(), no.as_py()
                own.add(chunk.as_py(), n.as_py(), digest.as_py(), data.as_py())
            if rows:
                yield batch(rows)
        if own is not None:
            yield batch([own.row()])

    small = archive.where("n_chunks = 1").mapInArrow(run, READ)
    large = archive.where("n_chunks > 1").repartition(shuffle_parts(archive.sparkSession), "record_no").sortWithinPartitions("record_no", "chunk_no")
    return small.unionByName(large.mapInArrow(run, READ))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(stored(write(classified(table(spark, sf_dir, "pages"))), "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
