"""WARC archives through a table of chunks.

A payload of any size travels as rows (record, chunk number, bytes), each with the digest
of all bytes up to its end, so that writing and reading hold one chunk at a time.
Records are gzip members of their own. A payload seen before is a revisit record.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, small, unkeyed
from tidemark.llm.packing import _open
from tidemark.sources.shared import materialise, table_folder

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcOptions:
    """`chunk` bytes a row at most; payloads under `least` bytes are never revisits."""

    chunk: int = 1 << 16
    least: int = 100
    stamp: str = "2001-01-01T00:00:00Z"


def planned(pages: DataFrame, options: WarcOptions) -> DataFrame:
    """Pages with key, url, payload, n, digest and refers (the response's key, or NULL)."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        payload.alias("payload"),
    )
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    seen = materialise(rows.where(F.col("n") >= options.least).select("key", "digest"), "warc-digests")
    first = seen.groupBy("digest").agg(F.min("key").alias("refers"), F.count("*").alias("copies")).where("copies > 1")
    later = seen.join(first, "digest").where("key <> refers").select("key", "digest", "refers").distinct()
    return rows.join(small(materialise(later, "warc-revisits")), ["key", "digest"], "left")


def chunks(rows: DataFrame, options: WarcOptions) -> DataFrame:
    """The chunk table: a row per `chunk` bytes, with `sofar`, the digest of all bytes up to
    its end; revisits and empty payloads have one empty chunk. A payload is a value of the
    input and held as such; from here on a batch holds some chunks alone."""
    schema = pa.schema(
        [("key", pa.int64()), ("row", pa.int64()), ("url", pa.string()), ("n", pa.int64()), ("digest", pa.string()),
         ("refers", pa.int64()), ("chunk", pa.int32()), ("sofar", pa.string()), ("data", pa.binary())]
    )
    whole = F.when(F.col("refers").isNull(), F.col("payload")).otherwise(F.lit(b""))
    held = rows.select("key", F.monotonically_increasing_id().alias("row"), "url", "n", "digest", "refers", whole.alias("payload"))
    kind = "key long, row long, url string, n long, digest string, refers long, chunk int, sofar string, data binary"
    return held.mapInArrow(lambda it: _chunked(it, options, schema), kind)


def _chunked(batches: Iterator[pa.RecordBatch], options: WarcOptions, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    common = schema.names[:6]
    out: list[dict] = []
    held = 0
    for batch in batches:
        payloads = batch.column("payload")
        for i, row in enumerate(batch.select(common).to_pylist()):
            payload, digest = memoryview(payloads[i].as_buffer()), hashlib.sha256()
            for chunk, start in enumerate(range(0, max(1, len(payload)), options.chunk)):
                data = payload[start : start + options.chunk]
                digest.update(data)
                out.append(row | {"chunk": chunk, "sofar": digest.hexdigest(), "data": bytes(data)})
                held += len(data)
                if held >= 1 << 22 or len(out) == 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def _header(row: dict, options: WarcOptions) -> tuple[bytes, bytes]:
    """The record's header, and the HTTP header that opens its block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["n"]
    revisit = row["refers"] is not None
    url = row["url"].replace("\r", "%0D").replace("\n", "%0A") or f"urn:x-page:{row['key']}"
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:x-page:{row['key']}>",
        "WARC-Target-URI": url,
        "WARC-Date": options.stamp,
        "WARC-Payload-Digest": f"sha256:{row['digest']}",
        "WARC-Payload-Length": row["n"],
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + (0 if revisit else row["n"]),
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{row['refers']}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return VERSION + lines.encode() + b"\r\n", http


def _written(batches: Iterator[pa.RecordBatch], folder: str, options: WarcOptions) -> Iterator[pa.RecordBatch]:
    """One archive a task, moved to its place when whole."""
    files, root = _open(folder)
    out = draft = packer = digest = None
    name, records = "", 0

    def close_record() -> None:
        if digest.hexdigest() != expected and not revisit:
            raise ValueError(f"record {last} differs from its digest")
        out.write(packer.compress(b"\r\n\r\n") + packer.flush())

    last = expected = revisit = None
    for batch in batches:
        for row in batch.to_pylist():
            if out is None:
                files.create_dir(root, recursive=True)
                name = f"{row['key'] + 2**63:020d}-{row['row']}.warc.gz"
                draft = f"{root}/.{name}-{uuid.uuid4().hex}"
                out = files.open_output_stream(draft, compression=None)
            if row["row"] != last:
                if last is not None:
                    close_record()
                last, expected, revisit = row["row"], row["digest"], row["refers"] is not None
                packer, digest, records = zlib.compressobj(1, wbits=31), hashlib.sha256(), records + 1
                out.write(packer.compress(b"".join(_header(row, options))))
            digest.update(row["data"])
            if digest.hexdigest() != row["sofar"]:
                raise ValueError(f"record {last} differs from its digest at chunk {row['chunk']}")
            out.write(packer.compress(row["data"]))
    if out is None:
        return
    close_record()
    out.close()
    files.move(draft, f"{root}/{name}")
    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64())], names=["file", "records"])


def write_warc(pages: DataFrame, options: WarcOptions = WarcOptions()) -> DataFrame:
    """Writes a record per row of `pages`; returns the stored manifest (file, records).

    Of equal payloads of at least `least` bytes that with the smallest id is the response, the
    others revisit it; rows repeating that id are responses too. A NULL html is an empty
    payload, a NULL url becomes one made of the id, a NULL id is smaller than all others. An
    empty table writes no archive.
    """
    spark = pages.sparkSession
    parts, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), table_folder(spark, "warc")
    spread = chunks(planned(pages, options), options).repartitionByRange(parts, "key", "row")
    manifest = spread.sortWithinPartitions("key", "row", "chunk").mapInArrow(
        lambda it: _written(it, folder, options), "file string, records long"
    )
    return materialise(manifest, "warc-manifest")


def _parsed(path: str, options: WarcOptions, data: bool) -> Iterator[dict]:
    folder, _, name = path.rpartition("/")
    files, root = _open(folder)
    with files.open_input_file(f"{root}/{name}") as raw, gzip.GzipFile(fileobj=raw) as source:
        record = 0
        while source.readline():
            fields = {}
            while line := source.readline().rstrip(b"\r\n").decode():
                key, _, value = line.partition(": ")
                fields[key] = value
            left = int(fields["Content-Length"])
            while line := source.readline():
                left -= len(line)
                if line == b"\r\n":
                    break
            digest, chunk = hashlib.sha256(), 0
            common = {
                "file": path,
                "record": record,
                "key": int(fields["WARC-Record-ID"].rpartition(":")[2].rstrip(">")),
                "kind": fields["WARC-Type"],
                "refers": int(fields["WARC-Refers-To"].rpartition(":")[2].rstrip(">")) if "WARC-Refers-To" in fields else None,
                "stated_bytes": int(fields["WARC-Payload-Length"]),
                "stated_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            }
            while left or not chunk:
                got = source.read(min(left, options.chunk))
                if left and not got:
                    raise EOFError(f"{path} ends in record {record}")
                digest.update(got)
                left -= len(got)
                yield common | {"chunk": chunk, "bytes": len(got), "digest": digest.hexdigest(), "data": got if data else None}
                chunk += 1
            source.read(4)
            record += 1


_KIND = "file string, record long, key long, kind string, refers long, stated_bytes long, stated_digest string, chunk long, bytes long, digest string, data binary"
_ARROW = pa.schema(
    [("file", pa.string()), ("record", pa.int64()), ("key", pa.int64()), ("kind", pa.string()), ("refers", pa.int64()),
     ("stated_bytes", pa.int64()), ("stated_digest", pa.string()), ("chunk", pa.int64()), ("bytes", pa.int64()),
     ("digest", pa.string()), ("data", pa.binary())]
)


def read_warc(manifest: DataFrame, options: WarcOptions = WarcOptions(), data: bool = True) -> DataFrame:
    """The chunk table read back; `digest` covers the payload up to the chunk's end."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p.as_py() for b in batches for p in b.column("file")):
            rows = []
            for row in _parsed(path, options, data):
                rows.append(row)
                if len(rows) == 100:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    # A fixed number of partitions: an archive's row is small, the archive behind it is not.
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(parts, "file").mapInArrow(read, _KIND)


def records(read: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    revisit = F.col("kind") == "revisit"
    return (
        read.groupBy("file", "record", "key", "kind", "refers", "stated_bytes", "stated_digest")
        .agg(F.sum("bytes").alias("n"), F.max_by("digest", "chunk").alias("last"))
        .select(
            unkeyed("key", "page_id"),
            F.when(revisit, F.col("stated_bytes")).otherwise(F.col("n")).alias("payload_bytes"),
            F.when(revisit, F.col("stated_digest")).otherwise(F.col("last")).alias("payload_digest"),
            F.col("kind").alias("record_type"),
            unkeyed("refers", "refers_to"),
        )
    )
