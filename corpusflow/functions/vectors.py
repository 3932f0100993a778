"""Vector expressions on ``array<float>`` columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product in double precision (cosine for unit vectors)."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: str | Column, eps: float = 1e-12) -> Column:
    """F16: divide by the L2 norm (clamped away from zero)."""
    norm = F.greatest(l2_norm(v), F.lit(eps))
    return F.transform(_col(v), lambda x: x.cast("double") / norm)


def cosine(a: str | Column, b: str | Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(l2_norm(a) * l2_norm(b), F.lit(eps))
