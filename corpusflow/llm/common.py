"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ASCII white space (fixed by the contracts): space, tab, LF, VT, FF, CR.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Java regular expression for one or more of them.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``pick(df, new="old")``: exactly these columns, under new names.

    Columns are found by exact name and position, so extra columns may carry any
    name, also one that differs only in case or that an operator uses inside.
    """
    names = df.columns
    return positional(df).select(*[F.col(f"_in{names.index(old)}").alias(new) for new, old in columns.items()])


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns named ``_in0``, ``_in1``, ... by position; ``.toDF(*df.columns)`` names them back."""
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))])


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space, in order (null text: none)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " ", -1), "")


def checkpoint(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (narrow rows only).

    ``df`` must be cheap to count (checkpointed).  Beyond the bound there is no
    hint: Spark then joins by shuffle and splits skewed keys at run time.
    """
    return F.broadcast(df) if df.count() <= rows else df


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``remainder`` (null id: as empty text)."""
    digest = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return digest % modulus == remainder


def map_texts(df: DataFrame, schema: str, row: Callable[[str], tuple], *carry: str) -> DataFrame:
    """``row(text)`` for each text, in Arrow batches; ``carry`` columns pass through unread.

    ``schema`` names and types what ``row`` returns.  A null text counts as
    empty.  ``row`` may be a factory result holding per-worker caches.
    """
    out = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in carry] + [schema])
    target = df.sparkSession.createDataFrame([], out).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)
    kinds = list(arrow.types)[len(carry):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [row(t or "") for t in part.column("text").to_pylist()]
                cols = list(zip(*found)) if found else [()] * len(kinds)
                arrays = [part.column(c) for c in carry]
                arrays += [pa.array(c, k) for c, k in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*carry, "text").mapInArrow(run, target)


#: What a Python worker keeps from task to task (workers are reused), by key.
_KEPT: dict = {}


def kept(key, make: Callable):
    """``make()`` once per worker process and key; the latest eight keys are kept."""
    if key not in _KEPT:
        while len(_KEPT) >= 8:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[key] = make()
    return _KEPT[key]


def from_file_bytes(data: bytes, make: Callable[[str], object], suffix: str = ".json"):
    """``make(path)`` for a library that reads a path; the worker's own temporary file goes at once."""
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=suffix) as own:
        own.write(data)
        own.flush()
        return make(own.name)


def slices(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows of about ``size`` bytes, so Python holds few texts at once."""
    n = batch.num_rows
    step = max(1, min(n, n * size // max(1, batch.nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)
