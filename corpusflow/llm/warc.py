"""WARC archives: write captures as transactions, read them back, assemble the transactions.

A capture is three records: a request, a response (or a revisit, if an equal
payload is kept by another capture) and a metadata record.  Request and metadata
name the response in ``WARC-Concurrent-To``; assembly joins them on it and gives
one nested row per capture.

Writing uses Spark's text writer with the record terminator as line separator,
so files are committed like any table's, on any file system Spark writes to.
Reading goes through Spark's binary file source and a streaming parser, so any
path that Spark reads will do; gzip members, one or many a file, are unpacked.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, ensure_checkpoint_dir, pick, small

CRLF = "\r\n"
GAP = CRLF + CRLF
#: Uncompressed bytes a file should hold; the reader takes one file at a time.
FILE_BYTES = 24 << 20
BROADCAST_ROWS = 500_000
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: each five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def first_captures(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, size, first): payloads that several captures have, with the smallest page id."""
    groups = pages.groupBy("digest", "size").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    return checkpoint(groups.where((F.col("n") > 1) & (F.col("size") >= least_bytes) & F.col("first").isNotNull())
                      .select("digest", "size", "first"))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = 0, date: str = DATE,
                   file_bytes: int = FILE_BYTES, compression: str = "gzip") -> None:
    """One transaction per row of ``pages``, as WARC 1.1 files below ``path``.

    Of captures whose payloads are equal and of at least ``least_bytes`` bytes,
    that with the smallest id is the response, the others are revisits of it
    and store no payload.  Null html is an empty payload, a null url an empty
    target; line ends in a url are percent-encoded.  Rows that repeat the
    smallest id are responses too; rows without an id are revisits if an equal
    payload has one, else responses.  An empty table writes no record.

    No html is shuffled: only digests are grouped, and payloads that several
    captures have are broadcast while they are few (else joined by shuffle).
    """
    p = pick(pages, page=id_col, url=url_col, html=html_col).select(
        "page", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    raw = F.col("html").cast("binary")
    p = p.select("page", "url", "html", sha1_base32(raw).alias("digest"), F.octet_length("html").cast("bigint").alias("size"))
    firsts = first_captures(p.select("page", "digest", "size"), least_bytes)
    j = p.join(small(firsts, BROADCAST_ROWS), ["digest", "size"], "left")
    is_revisit = F.col("first").isNotNull() & (F.col("page").isNull() | (F.col("page") != F.col("first")))
    j = j.withColumn("revisit", is_revisit).withColumn("rid", F.uuid())

    def text(*parts) -> Column:
        return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])

    def record(kind: Column | str, suffix: str, kind_of_block: str, extra: list, block: Column) -> Column:
        return text("WARC/1.1", CRLF, "WARC-Type: ", kind, CRLF, "WARC-Record-ID: <urn:uuid:", F.col("rid"), suffix, ">", CRLF,
                    "WARC-Date: ", date, CRLF, "WARC-Target-URI: ", F.col("uri"), CRLF, *extra,
                    "Content-Type: ", kind_of_block, CRLF, "Content-Length: ", F.octet_length(block).cast("string"), GAP, block)

    j = j.withColumn("uri", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"))
    concurrent = ["WARC-Concurrent-To: <urn:uuid:", F.col("rid"), ">", CRLF]
    request = record("request", ":request", "application/http; msgtype=request", concurrent,
                     text("GET ", F.col("uri"), " HTTP/1.1", GAP))
    head = text("HTTP/1.1 200 OK", CRLF, "Content-Type: text/html; charset=utf-8", CRLF, "Content-Length: ",
                F.col("size").cast("string"), GAP)
    refers = F.when(F.col("revisit"), text(
        "WARC-Refers-To: <urn:page:", F.col("first").cast("string"), ">", CRLF,
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", CRLF)).otherwise("")
    main = record(F.when(F.col("revisit"), "revisit").otherwise("response"), "", "application/http; msgtype=response",
                  ["WARC-Payload-Digest: sha1:", F.col("digest"), CRLF, refers],
                  F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("html"))))
    facts = record("metadata", ":metadata", "application/warc-fields", concurrent,
                   text("page-id: ", F.coalesce(F.col("page").cast("string"), F.lit("")), CRLF,
                        "payload-bytes: ", F.col("size").cast("string"), CRLF))
    mean = p.agg(F.avg("size")).first()[0] or 0.0
    per_file = max(1, int(file_bytes / (mean + 1500)))
    (j.select(text(request, GAP, main, GAP, facts).alias("value")).write.mode("overwrite")
     .option("lineSep", GAP).option("maxRecordsPerFile", per_file).option("compression", compression).text(path))


# --- reading ------------------------------------------------------------------------------------

def chunks(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The content in pieces, unpacked if it is gzip (any number of members)."""
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), size):
            yield content[at:at + size]
        return
    while content:
        z = zlib.decompressobj(31)
        data = content
        while data and not z.eof:
            yield z.decompress(data, size)
            data = z.unconsumed_tail
        tail = z.flush()
        if tail:
            yield tail
        if not z.eof:
            raise ValueError("truncated gzip member")
        content = z.unused_data.lstrip(b"\0")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record, by its Content-Length; raises ValueError on damage."""
    source, data = chunks(content), bytearray()

    def more() -> bool:
        part = next(source, None)
        if part is None:
            return False
        data.extend(part)
        return True

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0 or not data.strip():
            if not more():
                if data.strip():
                    raise ValueError("record header has no end")
                return
        skip = len(data) - len(data.lstrip(b"\r\n"))
        if skip:
            del data[:skip]
            continue
        if not data.startswith(b"WARC/"):
            raise ValueError("no record begins here")
        lines = data[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else None
        if length is None:
            raise ValueError("record has no length")
        del data[:end + 4]
        while len(data) < length:
            if not more():
                raise ValueError("record is cut off")
        yield headers, bytes(data[:length])
        del data[:length]


#: ``block`` is the text of request and metadata records, ``payload`` what a response holds.
RECORD = ("archive string, kind string, record_id string, concurrent_to string, refers_to string, uri string, date string, "
          "block string, payload binary, payload_bytes bigint, payload_digest string, declared_digest string, error string")


def _row(archive: str, headers: dict[str, str], block: bytes) -> tuple:
    import base64

    kind = headers.get("warc-type", "")
    payload = block
    if headers.get("content-type", "").startswith("application/http") and kind != "request":
        payload = block.partition(b"\r\n\r\n")[2]
    about = kind in ("request", "metadata", "warcinfo")
    bare = lambda k: headers[k].strip("<>") if k in headers else None
    return (archive, kind, bare("warc-record-id"), bare("warc-concurrent-to"), bare("warc-refers-to"),
            headers.get("warc-target-uri"), headers.get("warc-date"), block.decode("utf-8", "replace") if about else None,
            None if about else payload, len(payload),
            None if about else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, None)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all files below ``path``; a damaged file ends with a row of kind ``damaged``.

    A file is held whole in compressed form, and unpacked in pieces: memory
    grows with the largest file and record, not with the archive.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    schema = spark.createDataFrame([], RECORD).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for files in batches:
            for k in range(files.num_rows):
                name = files.column("path")[k].as_py()
                rows, held = [], 0
                try:
                    for headers, block in parse(files.column("content")[k].as_py()):
                        rows.append(_row(name, headers, block))
                        held += len(block)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield batch(rows)
                            rows, held = [], 0
                except (ValueError, zlib.error) as e:
                    rows.append((name, "damaged", *[None] * 10, str(e)))
                if rows:
                    yield batch(rows)

    return files.select("path", "content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit, with its request and metadata joined through concurrent-to ids.

    Of several requests (or metadata records) for one capture that with the
    smallest record id is taken; captures without one have a null struct.
    Records that name no capture of the table are left out.  Captures are kept
    as often as they occur.  Without a column ``payload`` the rows carry none
    (and none is shuffled).
    """
    held = [c for c in ("payload",) if c in records.columns]

    def side(kind: str) -> DataFrame:
        body = F.struct("record_id", "date", "block")
        return (records.where((F.col("kind") == kind) & F.col("concurrent_to").isNotNull())
                .groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(body).alias(kind)))

    main = records.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "uri", "date",
        F.struct("kind", "refers_to", *held, "payload_bytes", "payload_digest", "declared_digest").alias("response"))
    return main.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")


def page_captures(pages: DataFrame, *, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives, read them back and give one row per page.

    Columns: page_id, payload_bytes and payload_digest of the full payload,
    record_type, refers_to (the page whose response a revisit repeats), uri,
    intact (a response's payload has the digest that its header declares).
    ``path`` defaults to a new folder in the shared checkpoint folder.
    """
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    c = assemble(checkpoint(read_archives(spark, path).drop("payload")))  # parsed once; payloads stay in the archives
    fact = lambda name: F.regexp_extract(F.col("metadata.block"), f"(?:^|\r\n){name}: ([^\r]*)", 1)
    revisit = F.col("response.kind") == "revisit"
    return c.select(
        F.nullif(fact("page-id"), F.lit("")).cast("bigint").alias("page_id"),
        F.when(revisit, fact("payload-bytes").cast("bigint")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.declared_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.when(revisit, F.regexp_extract("response.refers_to", "([0-9-]+)$", 1).cast("bigint")).alias("refers_to"),
        "uri", (revisit | (F.col("response.declared_digest") == F.col("response.payload_digest"))).alias("intact"))


#: DuckDB: digests in hex turned into base32, five hex digits at a time.
SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(url, '') AS url
  FROM pages),
d AS (
  SELECT page_id, payload_bytes, url, h, list_aggregate(list_transform(generate_series(0, 31),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INTEGER), 1)),
    'string_agg', '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS uri, true AS intact
FROM f
"""
