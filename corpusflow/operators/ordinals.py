"""Global / per-key ordinals without a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` pulls every row into one task,
and ``Window.partitionBy(key)`` puts a hot key (a third of all rows) into one
task.  Instead:

1. range-partition on (keys, order) and sort inside partitions;
2. checkpoint reliably, so partition ids and row positions are fixed even if
   tasks are retried or executors lost;
3. local position = ``monotonically_increasing_id`` minus the partition's base;
4. per-(partition, key) row counts -> exclusive prefix sums per key (a table
   of at most #partitions + #keys rows) -> join back.

A hot key spans several range partitions, so no task holds more than one
partition's worth of it.  The order columns must form a total order (append a
unique id) or ties get an arbitrary but fixed order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import cut_lineage

_PID, _LOCAL, _N, _OFF, _FIRST = "_cf_pid", "_cf_local", "_cf_n", "_cf_off", "_cf_first"


ROWS_PER_PARTITION = 2_000_000


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    """The session's shuffle partitions, or as many as hold ``ROWS_PER_PARTITION`` rows each if those are more."""
    if num_partitions:
        return num_partitions
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_PARTITION))


def sorted_tagged(df: DataFrame, keys: Sequence[str | Column],
                  num_partitions: int | None = None) -> DataFrame:
    """Range-sorted, checkpointed copy of ``df`` with partition id and local row index."""
    n = _num_partitions(df, num_partitions)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    fixed = cut_lineage(ranged)
    return (fixed
            .withColumn(_PID, F.spark_partition_id())
            .withColumn(_LOCAL, F.monotonically_increasing_id()
                        - F.shiftleft(F.spark_partition_id().cast("long"), 33)))


def with_ordinal(df: DataFrame, order_by: Sequence[str | Column], partition_by: Sequence[str] = (),
                 name: str = "ordinal", num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based ``name`` column numbering rows by ``order_by`` within ``partition_by``."""
    part = list(partition_by)
    tagged = sorted_tagged(df, [*part, *order_by], num_partitions)
    counts = tagged.groupBy(_PID, *part).agg(F.count(F.lit(1)).alias(_N),
                                             F.min(_LOCAL).alias(_FIRST))
    # Window over the per-(partition, key) count table: one row per key and
    # partition it touches, never the data itself.
    w = Window.partitionBy(*part).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(_OFF, F.coalesce(F.sum(_N).over(w), F.lit(0)).cast("long"))
    offsets = offsets.select(_PID, *part, _OFF, _FIRST)
    if not part:
        # at most num_partitions rows: a proven bound, so broadcasting is safe
        offsets = F.broadcast(offsets)
    out = tagged.join(offsets, [_PID, *part])
    return (out.withColumn(name, (F.col(_OFF) + F.col(_LOCAL) - F.col(_FIRST)).cast("long"))
            .drop(_PID, _LOCAL, _OFF, _FIRST))


def running_totals(df: DataFrame, value_cols: Sequence[str], order_by: Sequence[str | Column],
                   partition_by: Sequence[str] = (), num_partitions: int | None = None,
                   prefix: str = "cum_") -> DataFrame:
    """Inclusive running sum and count of ``value_cols`` in order, restarting per key.

    Same plan as :func:`with_ordinal`: per-(partition, key) totals give each
    partition its carry-in; inside a partition the sum over the rows before
    the current one is a window over (partition id, key) that never crosses a
    range partition, so a hot key is still spread over many tasks.
    """
    part = list(partition_by)
    tagged = sorted_tagged(df, [*part, *order_by], num_partitions)
    aggs = [F.count(F.lit(1)).alias(_N)] + [F.sum(c).alias(f"_cf_s_{c}") for c in value_cols]
    totals = tagged.groupBy(_PID, *part).agg(*aggs)
    w = Window.partitionBy(*part).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        _PID, *part,
        F.coalesce(F.sum(_N).over(w), F.lit(0)).alias("_cf_cn"),
        *[F.coalesce(F.sum(f"_cf_s_{c}").over(w), F.lit(0)).alias(f"_cf_cs_{c}") for c in value_cols])
    local_w = (Window.partitionBy(_PID, *part).orderBy(_LOCAL)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = tagged.join(carry, [_PID, *part])
    out = out.withColumn(f"{prefix}count", F.col("_cf_cn") + F.count(F.lit(1)).over(local_w))
    for c in value_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_cf_cs_{c}") + F.sum(c).over(local_w))
    drop = [_PID, _LOCAL, "_cf_cn", *[f"_cf_cs_{c}" for c in value_cols]]
    return out.drop(*drop)
