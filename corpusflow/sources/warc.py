"""Web-archive (WARC) records as a Spark data source, one partition per archive file.

Records are read as a stream, one gzip member / record at a time, so an
archive is never held in memory whole.  Use::

    register_warc(spark)
    spark.read.format("warc").option("paths", "a.warc.gz,b.warc.gz").load()

``paths`` is a comma-separated list (e.g. from the manifest scan, S2); files
are opened with Python's ``open``, so they must be on a filesystem every
executor mounts.  ``read_warc`` reads through Spark's own file systems instead,
yields Arrow batches, and gives a damaged archive an error row rather than
failing the job; ``archive_status`` sums up each archive.
"""

from __future__ import annotations

import gzip
import io
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WARC_SCHEMA = ("file string, offset bigint, rec_type string, content_type string, target_uri string, "
               "warc_date string, payload binary")


def iter_records(stream):
    """Yield ``(offset, headers, block)`` per record of an (uncompressed) WARC byte stream."""
    offset = 0
    while True:
        start = offset
        line = stream.readline()
        if not line:
            return
        offset += len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            continue  # resynchronise on the next version line
        headers: dict[str, str] = {}
        while True:
            h = stream.readline()
            offset += len(h)
            if h in (b"\r\n", b"\n", b""):
                break
            k, _, v = h.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers.get("content-length", "0") or 0)
        block = stream.read(n)
        offset += len(block)
        yield start, headers, block


def http_body(block: bytes) -> bytes:
    """Payload of an HTTP response block (after the status line and headers)."""
    for sep in (b"\r\n\r\n", b"\n\n"):
        i = block.find(sep)
        if i >= 0:
            return block[i + len(sep):]
    return b""


def read_warc(spark: SparkSession, path: str, glob: str = "*", with_payload: bool = True) -> DataFrame:
    """``WARC_SCHEMA`` plus ``error`` for every record of the files below ``path`` that match ``glob``.

    A file is read by one task, in its packed form, and unpacked as a stream;
    what could be read of a damaged archive is followed by a row with ``error``.
    Without ``with_payload`` blocks are skipped.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
             .load(path).select("path", "content"))
    arrow = pa.schema([("file", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in (
        "rec_type", "content_type", "target_uri", "warc_date")], ("payload", pa.binary()), ("error", pa.string())])

    def run(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                raw = io.BytesIO(content.as_py())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                rows, held = [], 0
                try:
                    for offset, h, block in iter_records(stream):
                        if len(block) < int(h.get("content-length", "0") or 0):
                            raise EOFError("record is cut off")
                        rec_type = h.get("warc-type")
                        payload = None
                        if with_payload:
                            payload = http_body(block) if rec_type == "response" else block
                            held += len(payload)
                        rows.append((name, offset, rec_type, h.get("content-type"), h.get("warc-target-uri"),
                                     h.get("warc-date"), payload, None))
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, held = [], 0
                except (OSError, EOFError, ValueError, zlib.error) as e:
                    rows.append((name, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, WARC_SCHEMA + ", error string")


def archive_status(records: DataFrame) -> DataFrame:
    """One row per archive: ``file, records, error`` (null: read to its end)."""
    return records.groupBy("file").agg(F.count_if(F.col("error").isNull()).alias("records"), F.max("error").alias("error"))


class _WarcPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _WarcReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p.strip() for p in options.get("paths", "").split(",") if p.strip()]

    def partitions(self):
        return [_WarcPartition(p) for p in self.paths]

    def read(self, partition):
        path = partition.path
        opener = gzip.open if path.endswith(".gz") else open
        with opener(path, "rb") as f:
            for offset, h, block in iter_records(f):
                rec_type = h.get("warc-type")
                payload = http_body(block) if rec_type == "response" else block
                yield (path, offset, rec_type, h.get("content-type"), h.get("warc-target-uri"),
                       h.get("warc-date"), payload)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return WARC_SCHEMA

    def reader(self, schema):
        return _WarcReader(self.options)


def register_warc(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def write_warc(path: str, records) -> None:
    """Test helper: write ``(uri, date, html)`` responses as a gzip-per-record WARC file."""
    with open(path, "wb") as out:
        for uri, date, html in records:
            body = html.encode("utf-8") if isinstance(html, str) else html
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
            head = (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\n"
                    f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n")
            out.write(gzip.compress(head.encode() + http + b"\r\n\r\n"))
