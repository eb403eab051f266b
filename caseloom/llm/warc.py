"""WARC archives: one gzip member per record, written and read in order.

Writing: payload digests are computed by Spark, equal payloads are found by an aggregate on (digest, bytes), and each
task writes its own archives to a shared folder under names no other attempt uses. The manifest, a table that Spark
commits, names the archives that count; what a lost attempt left behind is not in it.

Reading: each task takes archives from the manifest and reads them from the front. Bytes go through an incremental
decompressor, one member at a time; ``Content-Length`` frames the block, and digests are verified. Memory holds one
record and one read buffer.

Defined results: a null payload is empty; a null url gives a record without target; control characters of a url are
percent-encoded. A null id gives a record without a page name. Rows that repeat the smallest id of a group of equal
payloads are responses too. An empty table gives no archive and no rows. A damaged record gives a row with
``problem`` set, and ends the reading of its archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import parts, scratch, store

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, offset long, record_type string, record_id string, refers_to string, uri string, "
    "payload binary, payload_bytes long, payload_digest string, problem string"
)
#: A task begins a new archive at this size.
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 20
NAME = "urn:x-page:"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(page, url, payload: bytes | None, size: int, digest: str, first, date: str) -> bytes:
    """One record before compression. ``payload`` is None for a revisit of page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}"]
    head.append(f"WARC-Record-ID: <{NAME}{page}>" if page is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest + (url or ''))}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if kind == "revisit":
        head.append(f"WARC-Refers-To: <{NAME}{first}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, date: str, limit: int):
    def run(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        out, name, records, size = None, "", 0, 0
        done = []
        for batch in batches:
            for page, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, records, size = where.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                revisit = first is not None and page != first
                data = _member(record_bytes(page, url, None if revisit else payload, len(payload), digest, first, date))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= limit:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["path", "records", "bytes"])

    return run


def write_warc(
    pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """``pages(page_id, url, html)`` -> the manifest of the archives written below ``folder``.

    Payloads of ``revisit_bytes`` or more that occur again are written once, for the smallest id.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = rows.select("page_id", "digest", F.octet_length("payload").alias("size")).filter(F.col("size") >= revisit_bytes)
    again = keys.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = store(again.select(F.col("digest").alias("d"), F.col("size").alias("s"), "first"))
    same = (rows["digest"] == again["d"]) & (F.octet_length(rows["payload"]) == again["s"])
    rows = rows.join(again, same, "left").select("page_id", "url", "payload", "digest", "first")
    return store(rows.mapInArrow(_writer(folder, date, archive_bytes), MANIFEST))


def members(chunks):
    """(offset, bytes, problem) of every gzip member of a stream of chunks."""
    z, data, start, at, fed = zlib.decompressobj(31), [], 0, 0, False
    for chunk in chunks:
        while chunk:
            try:
                data.append(z.decompress(chunk))
            except zlib.error as e:
                yield start, b"", f"not a gzip member: {e}"
                return
            fed = True
            at += len(chunk) - len(z.unused_data)
            chunk = z.unused_data
            if z.eof:
                yield start, b"".join(data), None
                z, data, start, fed = zlib.decompressobj(31), [], at, False
    if fed:
        yield start, b"".join(data), "the archive ends inside a member"


def parse_record(data: bytes) -> dict:
    """The fields of one record; ``problem`` says what is wrong with it."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out = {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
        "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"), "payload": None,
        "payload_bytes": None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "problem": None,
    }
    if not sep or not lines[0].startswith("WARC/"):
        return out | {"problem": "no record header"}
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": "the block does not have the length it states"}
    block = rest[:-4]
    said = fields.get("warc-block-digest", "").removeprefix("sha1:")
    if said and base64.b32encode(hashlib.sha1(block).digest()).decode() != said:
        return out | {"problem": "block digest differs"}
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    out["payload_bytes"] = int(stated[1]) if stated else None
    if out["record_type"] == "response":
        out["payload"] = payload
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["payload_digest"] or len(payload) != out["payload_bytes"]:
            return out | {"problem": "payload digest differs"}
    return out


def _reader(keep_payload: bool):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORDS))

    def chunks(stream):
        while data := stream.read(READ_BYTES):
            yield data

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for offset, data, problem in members(chunks(stream)):
                        row = parse_record(data)
                        row |= {"path": path, "offset": offset, "problem": problem or row["problem"]}
                        size += len(row["payload"] or b"")
                        if not keep_payload:
                            row["payload"] = None
                        rows.append(row)
                        if size > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_warc(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """``paths(path)`` -> one row per record, in the order of the archive."""
    spark = paths.sparkSession
    return paths.select("path").repartition(parts(spark)).mapInArrow(_reader(payloads), RECORDS)


def page_id(record_id):
    """The page number inside a record name."""
    return F.regexp_extract(record_id, f"<{NAME}(-?[0-9]+)>", 1).try_cast("long")


def archive_folder(spark: SparkSession) -> str:
    return scratch(spark, "warc")
