"""WARC 1.1 archives: a writer with payload de-duplication and a splittable reader.

Writer: each record is one gzip member; a record whose payload another record holds is a revisit of it. A task writes its archive under its final
name, with a part of its own in it, and reports it; Spark commits the reports of the tasks that counted as a manifest. What lost or repeated tasks
have left is not in it and goes. No file is renamed.

Reader: an archive is cut into byte ranges at any place. The task of a range scans it for the gzip magic; a candidate is a member
only if its header decodes and what it inflates to begins with a WARC version line. A task owns the records that start
in its range and reads past its end for the last one.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship
from tessera.sources.store import shared_path

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a reader's range.
RANGE = 32 << 20
_CHUNK = 1 << 20
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """A response record, or a revisit that keeps the HTTP header alone."""
    name = lambda k: f"<urn:page:{'none' if k is None else k}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: The table of the archives that count, in a folder of archives.
MANIFEST = "_manifest"


def write(pages: DataFrame, path: str, smallest: int = 0, level: int = 6) -> str:
    """Write a record for each row of pages (page_id, url, html) as .warc.gz files under path.

    Of the records with equal payloads of at least `smallest` bytes, that of the largest page_id is the response and the others are
    revisits; rows that repeat that page_id are responses too. Null html: an empty payload. A null page_id counts as the
    smallest. Very long texts are records like any other. Other columns, whatever their names, are ignored. Empty table: a folder without records."""
    spark = pages.sparkSession
    ship(spark)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("sha"))
    holder = rows.where(F.length("html") >= smallest).groupBy("sha").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("sha", "holder")
    revisit = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id")) & (F.length("html") >= smallest)
    joined = rows.join(holder, "sha", "left").select("page_id", "url", "html", F.when(revisit, F.col("holder")).alias("refers_to"), revisit.alias("revisit"))

    folder = _qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        records = size = 0
        with contextlib.ExitStack() as held:
            file = None
            for batch in batches:
                for page_id, url, payload, refers_to, again in zip(*batch.columns, strict=True):
                    body = payload.as_py()
                    data = member(record(page_id.as_py(), url.as_py(), body, digest32(body), refers_to.as_py(), again.as_py()), level)
                    if file is None:
                        file = held.enter_context(fs.open_output_stream(f"{at}/{name}", compression=None))
                    file.write(data)
                    records, size = records + 1, size + len(data)
        some = records > 0
        yield pa.RecordBatch.from_arrays([pa.array([name] * some, pa.string()), pa.array([size] * some, pa.int64()), pa.array([records] * some, pa.int64())], ["name", "size", "records"])

    joined.mapInArrow(run, "name string, size long, records long").write.parquet(f"{path}/{MANIFEST}")
    counted = {name for name, _ in _archives(spark, path)}
    for fs, status in _files(spark, path, ".warc.gz"):
        if status.getPath().getName() not in counted:
            fs.delete(status.getPath(), False)
    return path


def _qualified(spark: SparkSession, path: str) -> str:
    """The URI of a folder, which is made if need be."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    return fs.makeQualified(at).toUri().toString()


def _archives(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, size) of the archives in a folder: those of its manifest, if it has one, else all."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return [(r["name"], r["size"]) for r in spark.read.schema("name string, size long, records long").parquet(f"{path}/{MANIFEST}").collect()]
    return [(s.getPath().getName(), s.getLen()) for _, s in _files(spark, path, ".warc.gz")]


def _files(spark: SparkSession, path: str, ending: str) -> list:
    """(file system, status) of the files in a folder that any of Spark's file systems holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(fs, s) for s in fs.listStatus(at) if s.isFile() and s.getPath().getName().endswith(ending)]


class _Ranged:
    """Bytes of one archive, read in chunks from any position."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        """Up to n bytes from start; kept while the next call reads close by."""
        end = min(start + n, self.size)
        if start < self.at or end > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(_CHUNK, end - start))
        return self.held[start - self.at : end - self.at]


def _inflate(data: _Ranged, start: int) -> Iterator[tuple[bytes, int]]:
    """What the member at start holds, in parts, each with the member's end or 0 while that is not reached."""
    z, at = zlib.decompressobj(31), start
    while not z.eof:
        raw = data.get(at, _CHUNK)
        if not raw:
            raise zlib.error("the member has no end")
        part = z.decompress(raw)
        at += len(raw)
        yield part, at - len(z.unused_data) if z.eof else 0


def _headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])}


def read_record(data: _Ranged, start: int) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, end) of the record whose first member is at start; None if none starts there."""
    got, at = b"", start
    need = None
    parts = []
    try:
        while need is None or len(got) < need:
            for part, end in _inflate(data, at):
                parts.append(part)
                if need is None:
                    got = b"".join(parts)
                    parts = [got]
                    if len(got) >= 10 and not _VERSION.match(got):
                        return None
                    if (cut := got.find(b"\r\n\r\n")) >= 0:
                        headers = _headers(got[:cut])
                        need = cut + 4 + int(headers["content-length"])
                if end:
                    at = end
            got = b"".join(parts)
            parts = [got]
            if need is None and (at >= data.size or len(got) < 10):
                return None
    except (zlib.error, KeyError, ValueError):
        return None
    return headers, got[cut + 4 : need], at


def records(data: _Ranged, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, headers, block) of the records that start in [start, end)."""
    at = start
    while at < end:
        window = data.get(at, min(_CHUNK, end - at + len(MAGIC) - 1))
        hit = window.find(MAGIC)
        if hit < 0 or at + hit >= end:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if found := read_record(data, at):
            yield at, found[0], found[1]
            at = found[2]
        else:
            at += 1


SCHEMA = "file string, position long, record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def read(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """A row (SCHEMA) for each record of the .warc.gz files under path, read in ranges of `size` bytes.

    payload is null for revisits; their payload_bytes and payload_digest are those of the full payload, from the kept HTTP header and the record's.
    For responses both come from the bytes read. No files or no records: no rows. Archives may be
    on any file system that pyarrow opens by URI (local, HDFS, S3, GCS)."""
    ship(spark)
    folder = _qualified(spark, path)
    found = [(f"{folder}/{name}", size) for name, size in _archives(spark, path)]
    files = spark.createDataFrame(found, "uri string, size long")
    ranges = files.where("size > 0").select("uri", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))).alias("start"))
    n = max(1, sum(-(-s // size) for _, s in found))
    kinds = pa.schema([("file", pa.string()), ("position", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def row(uri: str, at: int, head: dict[str, str], block: bytes) -> tuple:
        page, ref = (_PAGE.fullmatch(head.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
        http, _, payload = block.partition(b"\r\n\r\n")
        again = head.get("warc-type") == "revisit"
        length = int(_headers(http)["content-length"]) if again else len(payload)
        digest = head["warc-payload-digest"].removeprefix("sha1:") if again else digest32(payload)
        return uri, at, head.get("warc-type"), page and int(page[1]), head.get("warc-target-uri"), None if again else payload, length, digest, ref and int(ref[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                fs, name = pyarrow.fs.FileSystem.from_uri(task["uri"])
                with fs.open_input_file(name) as file:
                    out, held = [], 0
                    for at, head, block in records(_Ranged(file, task["size"]), task["start"], min(task["start"] + size, task["size"])):
                        out.append(row(task["uri"], at, head, block))
                        held += len(block)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return ranges.repartition(n).mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """What the archives of pages hold, written to the shared folder and read back."""
    spark = pages.sparkSession
    return read(spark, write(pages, shared_path(spark, "warc")))

