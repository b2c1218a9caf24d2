"""WARC archives: pages written as records, long ones in segments, and read back.

An archive is a folder of gzip files of records ending in two blank lines. A page's record holds an HTTP response whose body
has chunked transfer framing. A record longer than ``segment_bytes`` is split: the first part is the response record with
segment number 1, the others are continuation records that name it as their origin, the last with the total length.

Reading parses every file, keeps whole records as they are, brings the segments of one origin together in the order of their
numbers, checks the total length, undoes the chunked framing and checks the payload digest. A record whose segments are
missing, whose length differs or whose digest does not fit comes out with a null payload and ``complete`` false.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest page_id is the response, and the
others are revisit records without a body that refer to it; they carry the payload's digest and length. A null html is an empty
payload. Null page_ids are smaller than any other; rows that repeat the largest page_id of their payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import attach, materialize

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
FILE_RECORDS = 4_096
END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_NO_ID = -(1 << 63)
_PARSED = ("record_id string, record_type string, page_id long, refers_to long, payload_digest string, "
           "payload_bytes long, origin string, segment int, total_length long, block binary")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at:at + size])
        at += size + 2


def response_payload(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(k.strip().lower() == b"transfer-encoding" and v.strip().lower() == b"chunked"
                 for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]))
    return unchunked(body) if framed else body


def _record(block: bytes, **fields: object) -> bytes:
    """A record without its end."""
    named = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.0\r\n{named}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_response: bool,
                 segment_bytes: int) -> Iterator[bytes]:
    record_id = f"<urn:uuid:{uuid.uuid4()}>"
    # a line break in a url would end the header
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{sha1_base32(payload)}",
              "WARC_Payload_Length": len(payload), "WARC_Page_ID": page_id}
    if not is_response:
        yield _record(b"", WARC_Type="revisit", WARC_Record_ID=record_id, WARC_Refers_To=f"<urn:page:{refers_to}>", **common)
        return
    block = _HTTP + chunked(payload)
    kind = {"Content_Type": "application/http; msgtype=response"}
    if len(block) <= segment_bytes:
        yield _record(block, WARC_Type="response", WARC_Record_ID=record_id, **common, **kind)
        return
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record(parts[0], WARC_Type="response", WARC_Record_ID=record_id, WARC_Segment_Number=1, **common, **kind)
    for number, part in enumerate(parts[1:], 2):
        yield _record(part, WARC_Type="continuation", WARC_Record_ID=f"<urn:uuid:{uuid.uuid4()}>",
                      WARC_Segment_Origin_ID=record_id, WARC_Segment_Number=number,
                      WARC_Segment_Total_Length=len(block) if number == len(parts) else None)


def parse_records(content: bytes) -> Iterator[dict]:
    """The records of one file, in their order."""
    at = 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        lines = content[at:head_end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        begin = head_end + 4
        end = begin + int(fields["content-length"])
        if content[end:end + 4] != END:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        digest, refers = fields.get("warc-payload-digest"), fields.get("warc-refers-to")
        yield {
            "record_id": fields["warc-record-id"], "record_type": fields["warc-type"],
            "page_id": _number(fields.get("warc-page-id")),
            "refers_to": _number(refers.rsplit(":", 1)[-1].rstrip(">")) if refers else None,
            "payload_digest": digest.partition(":")[2] if digest else None,
            "payload_bytes": _number(fields.get("warc-payload-length")), "origin": fields.get("warc-segment-origin-id"),
            "segment": _number(fields.get("warc-segment-number")),
            "total_length": _number(fields.get("warc-segment-total-length")), "block": content[begin:end]}
        at = end + 4


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
                  file_records: int = FILE_RECORDS) -> None:
    """Write a record per row of (page_id, url, html) into the folder ``path``, with Spark's text writer."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(payload, "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    classes = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(
        F.max(F.coalesce("page_id", F.lit(_NO_ID))).alias("winner"), F.count(F.lit(1)).alias("n"))
    # only payloads that occur more than once have to meet their rows
    classes = materialize(classes.where("n > 1"), "payloads")
    out = attach(rows, classes, ["digest"], "n")
    alone = F.col("winner").isNull() | F.coalesce("page_id", F.lit(_NO_ID)).eqNullSafe(F.col("winner"))
    out = out.select("page_id", "url", "payload", F.when(F.col("winner") != _NO_ID, F.col("winner")).alias("refers_to"),
                     alone.alias("is_response"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records, held = [], 0
            for row in zip(*(batch.column(c) for c in batch.schema.names), strict=True):
                for record in page_records(*(x.as_py() for x in row), segment_bytes):
                    records.append(record)
                    held += len(record)
                if held > 1 << 23:
                    yield pa.record_batch({"value": pa.array(records, pa.binary())})
                    records, held = [], 0
            yield pa.record_batch({"value": pa.array(records, pa.binary())})

    made = out.mapInArrow(task, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", END.decode()).option("compression", "gzip").option(
        "maxRecordsPerFile", file_records).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files below ``path``. A file is read by one task, so writers bound their records."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                            ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                            ("origin", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()),
                            ("block", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                data = content.as_py()
                for record in parse_records(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data):
                    rows.append(record)
                    held += len(record["block"])
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(task, _PARSED)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per page: page_id, record_type, refers_to, payload, payload_digest, payload_bytes, complete."""
    records = read_records(spark, path)
    one_part = F.col("segment").isNull() & F.col("origin").isNull()
    head = ("record_type", "page_id", "refers_to", "payload_digest", "payload_bytes")
    whole = records.where(one_part).select(*head, "block", F.lit(True).alias("complete"))
    parts = records.where(~one_part).withColumn("key", F.coalesce("origin", "record_id"))
    first = F.col("origin").isNull()
    joined = parts.groupBy("key").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in head],
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total_length").alias("total"))
    numbers = F.transform("parts", lambda p: p["segment"])
    block = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    fits = numbers.eqNullSafe(F.sequence(F.lit(1), F.size("parts"))) & F.col("total").isNotNull()
    joined = joined.select(*head, block.alias("block"), "total", fits.alias("fits"))
    joined = joined.select(*head, "block", (F.col("fits") & (F.length("block") == F.coalesce("total", F.lit(-1)))).alias("complete"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, complete, sizes, digests = [], [], [], []
            for kind, block, fits, size, digest in zip(*(batch.column(c) for c in (
                    "record_type", "block", "complete", "payload_bytes", "payload_digest")), strict=True):
                payload, fits, digest = None, fits.as_py(), digest.as_py()
                if kind.as_py() == "response" and fits:
                    try:
                        payload = response_payload(block.as_py())
                    except ValueError:
                        fits = False
                    else:
                        own = sha1_base32(payload)
                        fits, digest = digest in (None, own), own if digest is None else digest
                        payload = payload if fits else None
                payloads.append(payload)
                complete.append(fits)
                sizes.append(size.as_py() if payload is None else len(payload))
                digests.append(digest)
            yield pa.record_batch({
                "page_id": batch.column("page_id"), "record_type": batch.column("record_type"),
                "refers_to": batch.column("refers_to"), "payload": pa.array(payloads, pa.binary()),
                "payload_digest": pa.array(digests, pa.string()), "payload_bytes": pa.array(sizes, pa.int64()),
                "complete": pa.array(complete, pa.bool_())})

    return whole.unionByName(joined).mapInArrow(
        task, "page_id long, record_type string, refers_to long, payload binary, payload_digest string, "
              "payload_bytes long, complete boolean")
