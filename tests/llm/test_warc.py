import base64
import gzip
import hashlib
import uuid

from helpers import clashing, prose
from pyspark.sql import functions as F

from corpusflow.llm import warc as W
from corpusflow.session import ensure_checkpoint_dir

ROWS = [(5, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://a/\r\nX: y", None),
        (3, "", ""), (4, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "u", "é漢\U0001f600\r\n\r\n"),
        (7, "u", prose(1, 60000)), (None, "u", "<p>same</p>"), (None, "u", "alone"), (8, "u", "dup"), (8, "u", "dup")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def expected(rows, least=0):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [j for j, _, x in rows if (x or "").encode() == b and j is not None]
        first = min(ids) if ids and len(b) >= least else None
        again = first is not None and len([1 for _, _, x in rows if (x or "").encode() == b]) > 1 and i != first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None, True))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in df.collect()], key=str)


def test_round_trip_equals_brute_force(spark):
    assert result(W.page_captures(clashing(pages(spark)))) == expected(ROWS)
    assert result(W.page_captures(pages(spark), least_bytes=8, compression="none", file_bytes=10_000)) == expected(ROWS, 8)


def test_empty_table(spark):
    assert W.page_captures(pages(spark).limit(0)).count() == 0


def test_nested_rows_hold_the_payload(spark):
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    W.write_archives(pages(spark), path)
    records = W.read_archives(spark, path)
    assert {r["kind"]: r["count"] for r in records.groupBy("kind").count().collect()} == {"request": 12, "metadata": 12, "response": 8, "revisit": 4}
    rows = W.assemble(records).collect()
    assert len(rows) == len(ROWS)
    assert all(r.request.block.startswith("GET ") and r.metadata.block.startswith("page-id: ") for r in rows)
    payloads = sorted(bytes(r.response.payload) for r in rows if r.response.kind == "response")
    assert payloads == sorted([b"dup", *{(h or "").encode() for _, _, h in ROWS}])


def test_parser_and_damage(spark):
    rec = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nab\r\n\r\nWA\r" + b"\r\n\r\n"
    for content in (rec * 2, gzip.compress(rec) * 2, gzip.compress(rec * 2)):
        assert [b for _, b in W.parse(content)] == [b"ab\r\n\r\nWA\r"] * 2
    assert list(W.parse(b"")) == []
    for bad in (rec[:-8], b"junk\r\n\r\n", gzip.compress(rec)[:-12], b"WARC/1.1\r\nX: y\r\n\r\n"):
        try:
            list(W.parse(bad))
            raise AssertionError("damage not seen")
        except ValueError:
            pass


def test_orphans_and_several_parts(spark):
    schema = "kind string, record_id string, concurrent_to string, refers_to string, uri string, date string, block string, payload binary, payload_bytes bigint, payload_digest string, declared_digest string"
    none = (None,) * 2
    rows = [("response", "r1", None, None, "u", "d", None, bytearray(b"x"), 1, *none), ("request", "q2", "r1", None, "u", "d", "2", None, 1, *none),
            ("request", "q1", "r1", None, "u", "d", "1", None, 1, *none), ("metadata", "m", "gone", None, "u", "d", "m", None, 1, *none),
            ("response", "r2", None, None, None, None, None, None, None, *none)]
    got = {r.capture_id: r for r in W.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].request.record_id == "q1" and got["r1"].metadata is None and got["r2"].request is None


def test_base32(spark):
    for t in ("", "a", "é" * 1000):
        r = spark.range(1).select(W.sha1_base32(F.lit(t).cast("binary"))).first()[0]
        assert r == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
