"""WARC archives as a table of chunks: (record, chunk number, headers, bytes, running digest).

The headers and bytes of an archive's rows, in order of record and chunk number, are a WARC 1.1 file.
Each row holds at most `chunk_bytes` of payload, the first one of a record also its WARC and HTTP
headers, the last one also the record's end. Every row carries the SHA-1 of the payload up to its end. The
table's row is cut in pieces before it leaves Spark, and writer and reader both hash piece after piece and
never hold an oversized record whole; a damaged chunk is found where it lies. Records of one payload chunk are read where they are, only longer ones are dealt out by
record and sorted.

Payloads that occur twice are found by digest: pages whose digest is not in a bitmap of the repeated
ones are written without a shuffle; the others meet the first page's id, salted so that a hot payload
spreads over many tasks.

Cases: a null html is an empty payload; equal payloads, empty ones too, are revisits of the smallest
id (null ids come last and are revisits unless alone). Repeated rows of the smallest id are responses
each. A null url leaves the target out; line breaks in one are removed. An empty table gives an empty
archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_bitmap, salted_left_join, staged, with_flag

CHUNK_BYTES = 1 << 20
DIGEST_BITS = 25
CHUNKS = "record bigint, chunk int, chunks int, head binary, running string, data binary"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, valid boolean"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _b32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _headers(page, url, size: int, digest: str, refers) -> bytes:
    """The WARC and HTTP headers; `refers` is the response's page for a revisit, else None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": _record_id(page), "WARC-Date": "2020-01-01T00:00:00Z"}
    if url is not None:
        fields["WARC-Target-URI"] = "".join(url.split())
    fields["WARC-Payload-Digest"] = f"sha1:{digest}"
    if refers is not None:
        fields |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": _record_id(refers), "Refers-To-Page": refers}
    if page is not None:
        fields["Page"] = page
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(http) + (size if refers is None else 0)}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n", http]).encode()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows of payload pieces, which come record by record in order; only the running digest is kept from piece to piece."""
    record = TaskContext.get().partitionId() << 40
    names = ("page_id", "url", "size", "digest", "refers_to", "chunks", "chunk", "piece")
    running = hashlib.sha1()
    for batch in batches:
        rows: list[tuple] = []
        for page, url, size, digest, refers, chunks, chunk, piece in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            head = None
            if not chunk:
                record += 1
                running = hashlib.sha1()
                head = _headers(page, url, size, base64.b32encode(bytes.fromhex(digest)).decode(), refers)
            running.update(piece)
            rows.append((record, chunk, chunks, head, _b32(running), piece + (_END if chunk + 1 == chunks else b"")))
        yield _batch(rows)


_CHUNK_SCHEMA = pa.schema([("record", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("head", pa.binary()), ("running", pa.string()), ("data", pa.binary())])
_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("valid", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema = _CHUNK_SCHEMA) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def archive(pages: DataFrame, min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of `pages` (page_id, url, html), one record a row; equal payloads of at least `min_revisit_bytes` become revisits."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= min_revisit_bytes)
    first = staged(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    flagged = with_flag(rows, key_bitmap(first, F.col("digest"), DIGEST_BITS), F.col("digest"), DIGEST_BITS, "twin")
    alone = flagged.filter("not twin").select("page_id", "url", "payload", "digest", F.lit(None).cast("bigint").alias("refers_to"))
    twins = salted_left_join(flagged.filter("twin"), first, "digest", "page_id")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    twins = twins.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    size = F.octet_length("payload")
    pieces = F.when(F.col("refers_to").isNull(), F.greatest(F.lit(1), F.ceil(size / chunk_bytes).cast("int"))).otherwise(1)
    cut = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b"")))
    rows = alone.unionByName(twins).select("page_id", "url", size.cast("bigint").alias("size"), "digest", "refers_to", pieces.alias("chunks"), F.posexplode(cut).alias("chunk", "piece"))
    return rows.mapInArrow(_write, CHUNKS)


def _parse(head: bytes) -> dict:
    warc, _, http = head.decode().partition("\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in warc.split("\r\n")[1:])
    fields |= {f"http:{k}": v for k, v in (line.split(": ", 1) for line in http.rstrip("\r\n").split("\r\n")[1:])}
    return fields


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of rows sorted by record and chunk, hashed chunk after chunk."""
    fields: dict = {}
    size, sha1, valid = 0, hashlib.sha1(), True
    for batch in batches:
        out = []
        for chunk, chunks, head, running, data in zip(*(batch.column(n).to_pylist() for n in ("chunk", "chunks", "head", "running", "data")), strict=True):
            if chunk == 0:
                fields, size, sha1, valid = _parse(head), 0, hashlib.sha1(), True
            last = chunk + 1 == chunks
            piece = memoryview(data)[: len(data) - len(_END)] if last else data
            sha1.update(piece)
            size += len(piece)
            valid &= _b32(sha1) == running
            if last:
                digest, page, refers = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields.get("Page"), fields.get("Refers-To-Page")
                if revisit := fields["WARC-Type"] == "revisit":
                    size = int(fields["http:Content-Length"])
                else:
                    valid &= _b32(sha1) == digest and size == int(fields["http:Content-Length"])
                out.append((page and int(page), size, digest, "revisit" if revisit else "response", refers and int(refers), valid))
        yield _batch(out, _RECORD_SCHEMA)


def sound(records: DataFrame) -> DataFrame:
    """`records` of read_archive() without `valid`; a damaged one ends the query with an error that names it, whatever is asked for."""
    message = F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    return records.filter(F.when(F.coalesce("valid", F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean"))).drop("valid")


def read_archive(chunks: DataFrame) -> DataFrame:
    """One row for each record of a chunk table: page_id, payload_bytes, payload_digest, record_type, refers_to, valid.

    `valid` is false where a chunk or the payload differs from its digest. The size of a revisit is that of the payload it stands for.
    """
    short = chunks.filter("chunks = 1")
    long = chunks.filter("chunks > 1").repartition("record").sortWithinPartitions("record", "chunk")
    return short.mapInArrow(_read, RECORDS).unionByName(long.mapInArrow(_read, RECORDS))
