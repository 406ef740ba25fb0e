"""WARC archives: write records with an index first, then read selected records by coalesced byte ranges."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize

INDEX = "file string, offset long, length long, date string, url string, digest string, page_id long, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
MIN_REVISIT = 100
BROADCAST_DIGESTS = 500_000
TASK_BYTES = 128 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def classify(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least min_bytes the smallest page_id is the response and the others revisit it.
    Null html is an empty payload. A null page_id never is the smallest; alone it is a response. Repeated rows
    of the smallest page_id are all responses. The sums per digest are partial before the shuffle. Digests that
    occur twice are broadcast while they are few, so that pages stay where they are; beyond, Spark joins by digest
    and splits hot ones.
    """
    p = pages.select("page_id", "url", "html").withColumns({"payload_bytes": F.octet_length(F.coalesce("html", F.lit(""))).cast("long"), "payload_digest": F.sha2(F.coalesce("html", F.lit("")), 256)})
    first = p.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    first = materialize(first, "digests")
    if first.count() <= BROADCAST_DIGESTS:  # about 100 bytes each
        first = F.broadcast(first)
    revisit = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return p.join(first, "payload_digest", "left").withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("__first"))}).drop("__first")


def _head(kind: str, date: str, fields: list[str], block: bytes) -> bytes:
    """A record: header lines, the block, two line ends. Its identifier is new with every record that is written."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", *fields, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    return _head("warcinfo", date, [f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def _record(page_id, url, kind, refers, digest, payload: bytes, date: str) -> bytes:
    """A response holds an HTTP head and the payload, a revisit the head alone."""
    fields = [f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        fields += [f"X-Refers-To-Page-ID: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = HTTP.format(len(payload)).encode()
    return _head(kind, date, fields, block if kind == "revisit" else block + payload)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload): what follows the HTTP head of the block."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(x.partition(":")[::2] for x in head.decode().split("\r\n")[1:])
    fields = {k: v.removeprefix(" ") for k, v in fields.items()}
    return fields, body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _open(uri: str):
    """A filesystem and path for what an executor writes or reads: any scheme that Arrow's filesystems know."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def write_warc(classified: DataFrame, folder: str, max_file_bytes: int = 256 << 20, date: str | None = None) -> DataFrame:
    """Write a gzip member per record into archives below folder; the index, written beside them as Parquet.

    Each task attempt writes files of its own name, and only the attempts that Spark commits are in the index,
    so lost or repeated attempts leave at most files that no index names. Memory is a batch and a file's
    output stream. Files roll at max_file_bytes and begin with a warcinfo record, which the index doesn't name. date:
    the WARC-Date of all records, now if not given. Records of a repeated page_id have identifiers of their own.
    """
    folder = _uri(folder)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = _open(folder)
        filesystem.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= max_file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = filesystem.open_output_stream(f"{path}/{name}", compression=None)
                        raw = _gzip(_info(name, date))
                        out.write(raw)
                        at = len(raw)
                    raw = _gzip(_record(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"], (r["html"] or "").encode(), date))
                    out.write(raw)
                    rows.append((name, at, len(raw), date, r["url"], r["payload_digest"], r["page_id"], r["record_type"], r["refers_to"]))
                    at += len(raw)
                names = [x.split()[0] for x in INDEX.split(", ")]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)
        finally:
            if out is not None:
                out.close()

    columns = classified.select(F.col("page_id").cast("long"), "url", "html", "payload_digest", "record_type", F.col("refers_to").cast("long"))
    index = columns.mapInArrow(write, INDEX)
    index.write.parquet(f"{folder}/index")
    return classified.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def plan_ranges(index: DataFrame, max_gap: int = 64 << 10, max_range: int = 4 << 20) -> DataFrame:
    """(file, start, end, records): the selected records of a file sorted by offset and coalesced.

    Records nearer than max_gap share a read; a read covers at most about max_range bytes. Windows are per
    file, and files have a bounded size.
    """
    w = Window.partitionBy("file").orderBy("offset")
    end = F.lag(F.col("offset") + F.col("length")).over(w)
    cut = (end.isNull() | (F.col("offset") - end > max_gap) | (F.floor(F.col("offset") / max_range) != F.floor(F.lag("offset").over(w) / max_range))).cast("long")
    runs = index.select("file", "offset", "length").withColumn("__cut", cut).withColumn("__run", F.sum("__cut").over(w))
    return runs.groupBy("file", "__run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")).drop("__run")


def _page(text: str | None) -> int | None:
    return int(text) if text else None


def read_warc(index: DataFrame, folder: str, max_gap: int = 64 << 10, max_range: int = 4 << 20, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records that the index rows name, read from the archives: one ranged read per coalesced range.

    payload_bytes and payload_digest of a response are those of the bytes read; a revisit has no body and
    gives those of its header. A response whose digest differs from its header raises an error. Ranges are dealt to
    tasks by hash, in as many partitions as task_bytes of selected archive bytes ask for; few rows of an index stand
    for many bytes, so that Spark's own sizes would put all in one task.
    """
    folder = _uri(folder)
    selected = index.agg(F.sum("length")).first()[0] or 0
    n_tasks = max(8, math.ceil(selected / task_bytes))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        filesystem, path = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with filesystem.open_input_file(f"{path}/{r['file']}") as f:
                    f.seek(r["start"])
                    raw = f.read(r["end"] - r["start"])
                rows = []
                for x in r["records"]:
                    at = x["offset"] - r["start"]
                    fields, body = parse_record(zlib.decompress(raw[at : at + x["length"]], 31))
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    n = int(fields["X-Payload-Length"])
                    if kind == "response":
                        n, found = len(body), hashlib.sha256(body).hexdigest()
                        if found != digest:
                            raise ValueError(f"{r['file']} at {x['offset']}: payload digest {found}, header {digest}")
                    rows.append((_page(fields["X-Page-ID"]), fields.get("WARC-Target-URI"), kind, _page(fields.get("X-Refers-To-Page-ID")), n, digest, body))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    ranges = plan_ranges(index, max_gap, max_range)
    return ranges.repartition(n_tasks, "file", "start").mapInArrow(read, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    folder = folder or fresh_path(spark, "warc")
    index = write_warc(classify(pages), folder)
    return read_warc(index, folder)


def urls(index: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Index rows of the given URLs: a selection to read."""
    return index.filter(F.col("url").isin(list(wanted)))
