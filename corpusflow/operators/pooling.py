"""Masked mean pooling of vectors per key, then L2 normalisation.

``sum(v * mask) / max(sum(mask), 1e-9)`` per key and dimension.  Vectors are
exploded to (key, dim, value) rows, so the sums are plain partial
aggregations (a hot key is combined map-side); only the final per-key vector,
bounded by the vector width, is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.vectors import l2_normalize

MASK_FLOOR = 1e-9  # fixed value of the pooling formula


def masked_mean_pool(df: DataFrame, keys: Sequence[str], vec_col: str, mask_col: str | None = None,
                     normalize: bool = True, out_col: str = "vector") -> DataFrame:
    keys = list(keys)
    mask = F.col(mask_col).cast("double") if mask_col else F.lit(1.0)
    exploded = df.select(*keys, mask.alias("_m"), F.posexplode(vec_col).alias("_dim", "_x"))
    sums = (exploded.groupBy(*keys, "_dim")
            .agg(F.sum(F.col("_x").cast("double") * F.col("_m")).alias("_s"), F.sum("_m").alias("_ms")))
    means = sums.withColumn("_mean", F.col("_s") / F.greatest(F.col("_ms"), F.lit(MASK_FLOOR)))
    vec = (means.groupBy(*keys)
           .agg(F.array_sort(F.collect_list(F.struct("_dim", "_mean"))).alias("_pairs"))
           .select(*keys, F.transform("_pairs", lambda p: p["_mean"]).alias(out_col)))
    if normalize:
        vec = vec.withColumn(out_col, l2_normalize(out_col))
    return vec
