"""Dates, two-date windows and the dedup key.

Size bounds used for broadcasting: the qualifying-date table has one row per
calendar day and the window-day table at most one row per day (windows are
disjoint), so both are bounded by the calendar span of the data, not by the
number of articles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values of the date grouping: a date (or month) qualifies with at least
# 10 articles and a year from 1990 on
MIN_COUNT = 10
MIN_YEAR = 1990
KEY_SEPARATOR = " -- "


def articles_by_month(df: DataFrame, date_col: str = "publish_date", min_count: int = MIN_COUNT,
                      min_year: int = MIN_YEAR) -> DataFrame:
    """A1 + P10: ``year, month, n`` for months with enough articles (null dates never qualify)."""
    d = F.col(date_col)
    return (df.where(d.isNotNull())
            .groupBy(F.year(d).alias("year"), F.month(d).alias("month"))
            .agg(F.count(F.lit(1)).alias("n"))
            .where((F.col("n") >= min_count) & (F.col("year") >= min_year))
            .orderBy("year", "month"))  # L2; one row per month


def qualifying_dates(df: DataFrame, date_col: str = "publish_date", min_count: int = MIN_COUNT,
                     min_year: int = MIN_YEAR) -> DataFrame:
    """A2 + P10: ``publish_date, n`` for dates with enough articles."""
    d = F.col(date_col)
    return (df.where(d.isNotNull())
            .groupBy(d.alias("publish_date"))
            .agg(F.count(F.lit(1)).alias("n"))
            .where((F.col("n") >= min_count) & (F.year("publish_date") >= min_year))
            .orderBy("publish_date"))  # L2; one row per day


def date_windows(dates: DataFrame) -> DataFrame:
    """Pair consecutive qualifying dates (d0,d1), (d2,d3), ...; an odd last date is dropped.

    The input has one row per calendar day, so the ordering window over it
    is bounded by the calendar span (tens of thousands of rows at most).
    """
    w = Window.orderBy("publish_date")
    ranked = dates.select("publish_date", (F.row_number().over(w) - 1).alias("rn"))
    return (ranked.groupBy(F.floor(F.col("rn") / 2).cast("long").alias("window_id"))
            .agg(F.min("publish_date").alias("start"), F.max("publish_date").alias("end"),
                 F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == 2).drop("_n"))


def window_days(windows: DataFrame) -> DataFrame:
    """Each window expanded to its calendar days (both ends included)."""
    return windows.select("window_id", F.explode(F.sequence("start", "end")).alias("day"))


def window_articles(articles: DataFrame, windows: DataFrame, date_col: str = "publish_date") -> DataFrame:
    """Articles inside each window, ends inclusive, non-qualifying days in between included.

    The range join becomes an equi-join on the day: the day table is
    broadcast (bounded by the calendar span), so no article is shuffled and a
    date holding a third of all articles costs nothing extra.
    """
    days = F.broadcast(window_days(windows))
    return articles.join(days, articles[date_col] == days["day"]).drop("day")


def dedup_key(title: str | Column, text: str | Column, text_chars: int | None = None) -> Column:
    """F8: title, ``' -- '``, and a digest of the whole text (with ``text_chars``: its first so many characters)."""
    t = F.col(title) if isinstance(title, str) else title
    x = F.col(text) if isinstance(text, str) else text
    return F.concat(t, F.lit(KEY_SEPARATOR), F.sha2(x, 256) if text_chars is None else F.substring(x, 1, text_chars))


def key_title(key: str | Column) -> Column:
    """F9 (``title_mode="reference"``): the title cut at the first separator."""
    k = F.col(key) if isinstance(key, str) else key
    return F.substring_index(k, KEY_SEPARATOR, 1)


def window_dedup(rows: DataFrame, id_col: str = "id", date_col: str = "publish_date",
                 title_col: str = "title", text_col: str = "text", text_chars: int | None = None,
                 keep: Sequence[str] | None = None) -> DataFrame:
    """One article per (window, dedup key): the earliest date, then the smallest id.

    Rows with a null title or text are dropped (the reference aborts the whole
    window on them).  ``min_by`` is a partial aggregation: a key repeated in a
    third of the rows is reduced map-side.  Adds ``dedup_key`` and ``copies``.
    ``keep`` names the columns that are carried along (all of them by default);
    without the text among them, no text is shuffled.
    """
    ok = rows.where(F.col(title_col).isNotNull() & F.col(text_col).isNotNull())
    keyed = ok.withColumn("dedup_key", dedup_key(title_col, text_col, text_chars))
    others = [c for c in (keyed.columns if keep is None else keep) if c not in ("window_id", "dedup_key")]
    return (keyed.groupBy("window_id", "dedup_key")
            .agg(F.min_by(F.struct(*others), F.struct(date_col, id_col)).alias("_r"),
                 F.count(F.lit(1)).alias("copies"))
            .select("window_id", "dedup_key", "_r.*", "copies"))


def latest_first(df: DataFrame, date_col: str = "publish_date", id_col: str = "id") -> DataFrame:
    """L1: articles by publish date descending (id breaks ties)."""
    return df.orderBy(F.col(date_col).desc(), F.col(id_col).asc())


def in_range(df: DataFrame, start, end, date_col: str = "publish_date") -> DataFrame:
    """Dates between ``start`` and ``end`` inclusive; null dates never match."""
    return df.where(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def in_month(df: DataFrame, year: int, month: int, date_col: str = "publish_date") -> DataFrame:
    """One month, derived from the date (partition-prunable when stored by month)."""
    d = F.col(date_col)
    return df.where((F.year(d) == year) & (F.month(d) == month))
