"""Bounded, documented samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, pick

#: A class has at least this share of the sample's rows, as far as it has rows.
LEAST_SHARE = 0.1


def shares(have: dict[int, int], most: int) -> dict[int, int]:
    """How many of ``most`` go to each class: as many as its rows' share, but not less than ``LEAST_SHARE`` of them."""
    total = sum(have.values())
    if total <= most:
        return dict(have)
    out = {c: min(n, max(round(most * n / total), int(most * LEAST_SHARE))) for c, n in have.items()}
    largest = max(have, key=lambda c: have[c])
    out[largest] = min(have[largest], most - sum(n for c, n in out.items() if c != largest))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str,
                    exclude: Column, max_rows: int, max_bytes: int) -> list[tuple[str, int]]:
    """At most ``max_rows`` whole labelled texts of ``max_bytes`` bytes together, in order of a hash of the id.

    ``exclude`` is an expression over column ``id`` that marks held-out rows.
    Rows without an id or with a label other than 0 and 1 are no training rows.
    Each class is sampled by itself, by its share of the training rows that have
    a text; a class that is rarer than a tenth gets a tenth, or all it has, so
    no class is missing that has a text.  The sample is chosen by the lengths of
    the texts; a text that does not fit in what is left of the bytes is passed
    over, and shorter ones after it are taken.  Only the ids of the
    sample (at most ``max_rows``) are broadcast to find its texts, so no text is
    shuffled but the sample's own.  A class whose texts are all longer than
    ``max_bytes`` is an error.
    """
    training = (pick(labels, id=id_col, label=label_col).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
                .where(~exclude).withColumn("rank", F.xxhash64(F.col("id").cast("string"))))
    texts = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    # ids and labels alone, so a class is as large as what it has texts for
    training = checkpoint(training.select("rank", "id", "label").join(texts.select("id"), "id", "left_semi"))
    have = {int(r["label"]): r["n"] for r in training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not have:
        return []
    rows = shares(have, max_rows)
    ids = checkpoint(reduce(DataFrame.unionAll, [
        training.where(F.col("label") == c).orderBy("rank", "id", "label").limit(n) for c, n in sorted(rows.items())]))
    size, digest = F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("text").alias("digest")
    order = ["rank", "id", "label", "bytes", "digest"]
    sized = texts.join(F.broadcast(ids), "id").select("rank", "id", "label", size, digest)
    sized = reduce(DataFrame.unionAll, [sized.where(F.col("label") == c).orderBy(*order).limit(n) for c, n in sorted(rows.items())])
    found = sized.collect()  # at most max_rows rows of five numbers
    # the hashes of a class that is cut end early: spread over the whole range, so that no class comes last
    width = {c: 1 << 64 if rows[c] == have[c] else max(r["rank"] for r in found if r["label"] == c) + (1 << 63) + 1 for c in rows}
    found.sort(key=lambda r: ((r["rank"] + (1 << 63)) * (1 << 64) // width[r["label"]], *(r[c] for c in order)))
    chosen, room = [], max_bytes
    for r in found:
        if r["bytes"] <= room:
            room -= r["bytes"]
            chosen.append(r)
    for c in set(have) - {r["label"] for r in chosen}:  # no text fitted: the shortest takes the place of the last ones
        one = min((r for r in found if r["label"] == c), key=lambda r: (r["bytes"], *(r[k] for k in order)))
        if one["bytes"] > max_bytes:
            raise ValueError(f"every text of label {c} in the sample is longer than {max_bytes} bytes")
        while sum(r["bytes"] for r in chosen) + one["bytes"] > max_bytes:
            chosen.pop()
        chosen.append(one)
    keys = docs.sparkSession.createDataFrame(sorted({(r["id"], r["bytes"], r["digest"]) for r in chosen}), sized.select("id", "bytes", "digest").schema)
    whole = (texts.join(F.broadcast(keys.select("id").distinct()), "id").select("id", "text", size, digest)
             .join(F.broadcast(keys), ["id", "bytes", "digest"]).groupBy("id", "bytes", "digest").agg(F.first("text").alias("text")))
    got = whole.toArrow()
    by_key = dict(zip(zip(*(got.column(c).to_pylist() for c in ("id", "bytes", "digest"))), got.column("text").to_pylist()))
    return [(by_key[r["id"], r["bytes"], r["digest"]], int(r["label"])) for r in chosen]
