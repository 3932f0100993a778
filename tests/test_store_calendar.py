"""Store (W1, J5, F7) and calendar (A2, W3, J2, W2) boundary rows."""

import datetime as dt

from pyspark.sql import functions as F

from corpusflow.operators import calendar as C
from corpusflow.operators import store as S


def test_unique_first_and_null_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id long, text string")
    out = sorted((r["id"], r["n"]) for r in S.unique_first(df, "text", ["id"], count_col="n").collect())
    assert out == [(1, 2), (3, 2), (5, 1)]


def test_insert_absent(spark):
    store = spark.createDataFrame([(10, "stored"), (11, None)], "id long, text string")
    batch = spark.createDataFrame([(1, "stored"), (2, "new"), (3, "new"), (4, None), (5, "other")],
                                  "id long, text string")
    out = sorted(r["id"] for r in S.insert_absent(store, batch, "text", ["id"]).collect())
    assert out == [2, 5]


def test_parse_dates(spark):
    df = spark.createDataFrame([("02-03-2021",), ("2021-02-03",), ("2-3-2021",), (None,)], "raw string")
    got = [r[0] for r in df.select(S.parse_publish_date("raw")).collect()]
    assert got == [dt.date(2021, 2, 3), None, None, None]


def _articles(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, text string, publish_date date")


def test_qualifying_dates_and_windows(spark):
    rows = []
    i = 0
    days = {dt.date(2021, 1, 1): 10, dt.date(2021, 1, 2): 9, dt.date(2021, 1, 3): 10,
            dt.date(2021, 1, 5): 12, dt.date(1989, 6, 1): 15, dt.date(2021, 1, 9): 10}
    for d, n in days.items():
        for _ in range(n):
            rows.append((i, f"t{i}", f"x{i}", d))
            i += 1
    for _ in range(10):
        rows.append((i, "t", "x", None))
        i += 1
    a = _articles(spark, rows)
    q = sorted(r["publish_date"] for r in C.qualifying_dates(a).collect())
    assert q == [dt.date(2021, 1, 1), dt.date(2021, 1, 3), dt.date(2021, 1, 5), dt.date(2021, 1, 9)]
    w = sorted((r["window_id"], r["start"], r["end"]) for r in C.date_windows(C.qualifying_dates(a)).collect())
    assert w == [(0, dt.date(2021, 1, 1), dt.date(2021, 1, 3)), (1, dt.date(2021, 1, 5), dt.date(2021, 1, 9))]
    # the non-qualifying 2021-01-02 lies between the ends and is included
    inside = C.window_articles(a, C.date_windows(C.qualifying_dates(a)))
    counts = {r["window_id"]: r["count"] for r in inside.groupBy("window_id").count().collect()}
    assert counts == {0: 29, 1: 22}


def test_odd_number_of_dates_drops_last(spark):
    dates = spark.createDataFrame([(dt.date(2021, 1, d),) for d in (1, 2, 3)], "publish_date date")
    assert C.date_windows(dates).count() == 1


def test_window_dedup_earliest_and_null_title(spark):
    text = "y" * 150
    rows = [(1, 0, "T -- x", text, dt.date(2021, 1, 2)), (2, 0, "T -- x", text, dt.date(2021, 1, 1)),
            (3, 0, None, text, dt.date(2021, 1, 1)), (4, 0, "T -- x", text[:100] + "z", dt.date(2021, 1, 2))]
    df = spark.createDataFrame(rows, "id long, window_id long, title string, text string, publish_date date")
    out = C.window_dedup(df).collect()
    assert sorted((r["id"], r["copies"]) for r in out) == [(2, 2), (4, 1)]  # texts differ after 100 characters
    short = C.window_dedup(df, text_chars=100).collect()
    assert len(short) == 1 and short[0]["id"] == 2 and short[0]["copies"] == 3
    assert short[0]["dedup_key"] == "T -- x -- " + "y" * 100
    # title mode "reference" cuts the title at the first separator
    assert df.select(C.key_title(C.dedup_key("title", "text"))).first()[0] == "T"


def test_month_grouping_skips_null(spark):
    rows = [(i, "t", "x", dt.date(2021, 3, 1 + i % 20)) for i in range(10)] + [(99, "t", "x", None)]
    out = C.articles_by_month(_articles(spark, rows)).collect()
    assert [(r["year"], r["month"], r["n"]) for r in out] == [(2021, 3, 10)]
    assert C.in_month(_articles(spark, rows), 2021, 3).count() == 10
    assert C.in_range(_articles(spark, rows), "2021-03-01", "2021-03-02").count() == 2
    assert C.latest_first(_articles(spark, rows)).first()["publish_date"] == dt.date(2021, 3, 10)


def test_window_file_name(spark):
    from corpusflow.operators.pairs import window_file_name
    df = spark.createDataFrame([(dt.date(2021, 4, 1), dt.date(2021, 4, 12))], "s date, e date")
    assert df.select(window_file_name("s", "e")).first()[0] == "2021-4-1-to-2021-4-12-sister-articles.jsonl"
    assert df.select(F.lit(1)).count() == 1


def test_append_unique_store(spark):
    import os
    import tempfile
    path = os.path.join(tempfile.mkdtemp(prefix="cf-store-", dir="/tmp"), "store")
    b1 = spark.createDataFrame([("f1", 0, "a"), ("f1", 1, "b"), ("f1", 2, "a")], "source_file string, source_offset long, text string")
    b2 = spark.createDataFrame([("f2", 0, "b"), ("f2", 1, "c"), ("f2", 2, None), ("f2", 3, None)],
                               "source_file string, source_offset long, text string")
    assert S.append_unique(spark, path, b1) == 2
    assert S.append_unique(spark, path, b2) == 2
    assert S.append_unique(spark, path, b2) == 0
    got = sorted((r["text"] or "") for r in spark.read.parquet(path).collect())
    assert got == ["", "a", "b", "c"]
    assert S.store_projection(b1).columns == ["text"]
