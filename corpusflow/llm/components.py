"""Connected components of an edge table, by rounds of joins with checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges`` (long columns ``a``, ``b``); component is its smallest node.

    Large-star and small-star rounds: each node hooks its larger neighbours,
    then its smaller ones, onto the least node it knows of.  The edge count does
    not grow beyond the input's, and the neighbourhood is reduced to its minimum
    by a partial aggregation, so a hub is never gathered in one task.  Rounds
    needed grow with the logarithm of the longest chain.
    """
    e = checkpoint(_ordered(edges.select("a", "b")))
    before = None
    for _ in range(max_rounds):
        # large star: larger neighbours of a go to a's least neighbour (or a itself)
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = checkpoint(_ordered(large))
        # small star: of the smaller neighbours of a (now: b's per larger node), all go to the least
        small = large.select(F.col("b").alias("n"), F.col("a").alias("lo"))
        to = small.groupBy("n").agg(F.min("lo").alias("m"))
        hook = small.join(to, "n").where("lo > m").select(F.col("lo").alias("a"), F.col("m").alias("b"))
        e = checkpoint(_ordered(hook.unionByName(to.select(F.col("n").alias("a"), F.col("m").alias("b")))))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    stars = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with a < b; loops go."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
