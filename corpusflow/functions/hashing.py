"""Seeded integer hash built from column arithmetic (L5 shuffle order, L6 split).

Three Lehmer steps modulo 2^31 - 1 over the low 31 bits and the high bits of
a 64-bit id, with the seed folded in.  Every intermediate stays below 2^49,
so it is exact in 64-bit integers on any engine; the same formula in SQL
gives the same value, which keeps shuffles and splits reproducible and
checkable.  (For pure throughput ``xxhash64`` would do; it is not portable.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed: Lehmer modulus and multiplier
MODULUS = 2147483647
MULTIPLIER = 48271


def seeded_hash(id_col: str | Column, seed: int | Column) -> Column:
    c = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("long")
    s = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    lo = c.bitwiseAND(F.lit(MODULUS))
    hi = F.pmod(F.shiftright(c, 31), F.lit(MODULUS))
    h = F.pmod(lo * MULTIPLIER + F.pmod(s, F.lit(MODULUS)), F.lit(MODULUS))
    h = F.pmod((h + hi) * MULTIPLIER, F.lit(MODULUS))
    return F.pmod(h * MULTIPLIER + 1, F.lit(MODULUS))


def wide_hash(id_col: str | Column, seed: int) -> Column:
    """62 bits from two seeded hashes, for positions in tables of more than 2^31 rows."""
    return seeded_hash(id_col, seed) * (1 << 31) + seeded_hash(id_col, seed + 7919)


def seeded_hash_sql(id_expr: str, seed: int | str) -> str:
    m = MODULUS
    lo = f"(CAST({id_expr} AS BIGINT) & {m})"
    hi = f"((((CAST({id_expr} AS BIGINT) >> 31) % {m}) + {m}) % {m})"
    h1 = f"(({lo} * {MULTIPLIER} + ((CAST({seed} AS BIGINT) % {m} + {m}) % {m})) % {m})"
    h2 = f"((({h1} + {hi}) * {MULTIPLIER}) % {m})"
    return f"(({h2} * {MULTIPLIER} + 1) % {m})"
