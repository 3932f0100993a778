"""Weighted multi-dataset batches with in-batch text uniqueness.

* A12: sampling probability of a dataset = weight / sum(weights).
* L7 batch plan: global batch ``g`` has ``datasets_per_batch`` slots; slot 0
  draws a dataset by weight, later slots draw among datasets of the same
  arity (the conditional distribution the reference's re-draw loop samples
  from).  Draws use the portable seeded hash, so the plan is reproducible.
* L8: a slot reads its dataset's shuffled stream from a slot-specific start
  (wrapping around the dataset, sampling with replacement across batches)
  and accepts a sample only when none of its texts already appeared in an
  accepted sample of the same global batch, until ``per_slot`` are accepted.
  Candidates are grouped per global batch (one Arrow group = one batch, of a
  fixed size); slots that run short - too many repeated texts in their window -
  go on in further rounds, without the candidates that the batch's accepted
  digests exclude, until full or the dataset is exhausted (flagged ``short``),
  so there is no cap on candidates.
"""

from __future__ import annotations

import itertools
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.hashing import MODULUS, seeded_hash, wide_hash
from corpusflow.operators.ordinals import with_ordinal
from corpusflow.session import cut_lineage

PAIR_LIST = T.ArrayType(T.StringType())


def read_pair_dataset(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """One JSON list per line, or ``{"texts": [...]}``; ``dataset, texts``."""
    lines = spark.read.text(path)
    as_list = F.from_json("value", PAIR_LIST)
    as_obj = F.from_json("value", T.StructType([T.StructField("texts", PAIR_LIST)]))["texts"]
    texts = F.when(F.ltrim("value").startswith("["), as_list).otherwise(as_obj)
    ds = F.lit(name) if name else F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return lines.select(ds.alias("dataset"), texts.alias("texts")).where(F.col("texts").isNotNull())


def read_forum_dataset(spark: SparkSession, path: str, name: str = "forum") -> DataFrame:
    """Lines having both keys become ``[response, context]`` (that order)."""
    schema = T.StructType([T.StructField("response", T.StringType()), T.StructField("context", T.StringType())])
    df = spark.read.schema(schema).json(path)
    return forum_pairs(df, name)


def forum_pairs(df: DataFrame, name: str = "forum") -> DataFrame:
    ok = df.where(F.col("response").isNotNull() & F.col("context").isNotNull())
    return ok.select(F.lit(name).alias("dataset"), F.array("response", "context").alias("texts"))


def check_arity(samples: DataFrame) -> DataFrame:
    """S13 check: ``dataset, arity, rows``; raises when a dataset mixes arities."""
    stats = (samples.groupBy("dataset")
             .agg(F.min(F.size("texts")).alias("arity"), F.max(F.size("texts")).alias("_max"),
                  F.count(F.lit(1)).alias("rows")))
    bad = stats.where(F.col("arity") != F.col("_max")).count()
    if bad:
        raise ValueError(f"{bad} dataset(s) mix 2- and 3-text rows")
    return stats.drop("_max")


def read_mixture_config(spark: SparkSession, path: str) -> DataFrame:
    """The mixture config, a JSON list of ``{"name", "weight"}`` (small; broadcast where joined)."""
    schema = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("weight", T.LongType())]))
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", schema)).alias("c")).select("c.name", "c.weight")


def sampling_probabilities(config: DataFrame) -> DataFrame:
    """``name, weight, probability`` (window over the small config table)."""
    w = Window.partitionBy()
    return config.withColumn("probability", F.col("weight") / F.sum("weight").over(w))


def _uniform(key: F.Column, seed: int) -> F.Column:
    return seeded_hash(key, seed).cast("double") / float(MODULUS)


def batch_plan(config: DataFrame, arity: DataFrame, n_batches: int | DataFrame, datasets_per_batch: int,
               seed: int = 0) -> DataFrame:
    """``batch, slot, dataset, arity`` for ``n_batches`` global batches.

    Dataset d owns ``weight`` consecutive integers (the reference's index list
    repeats it so often); a draw is a uniform integer ``k`` and takes the dataset
    whose range holds it.  Slot 0 draws over all datasets; later slots draw over
    the datasets of slot 0's arity.  The ranges are array literals, one entry per
    dataset of the config, so no draw is joined or shuffled.
    """
    spark = config.sparkSession
    cfg = (config.join(arity.withColumnRenamed("dataset", "name"), "name").where(F.col("weight") > 0)
           .select("name", "weight", "arity").orderBy("name").collect())  # the config: one row per dataset
    if not cfg:
        return spark.createDataFrame([], "batch long, slot long, dataset string, arity int")

    def draw(rows, key):
        """(dataset, arity) of the range that holds a uniform integer below the rows' total weight."""
        upper = list(itertools.accumulate(int(r["weight"]) for r in rows))
        k = F.floor(_uniform(key, seed) * F.lit(upper[-1])).cast("long")
        n = F.element_at(F.transform(F.array(k), lambda x: F.size(F.filter(F.lit(upper), lambda u: u <= x))), 1)
        return F.element_at(F.transform(F.array(n), lambda i: F.struct(
            F.get(F.lit([r["name"] for r in rows]), i).alias("dataset"),
            F.get(F.lit([int(r["arity"]) for r in rows]), i).cast("int").alias("arity"))), 1)

    batches = (spark.range(n_batches).select(F.col("id").alias("batch")) if isinstance(n_batches, int)
               else n_batches)
    first = batches.select("batch", F.lit(0).alias("slot"), draw(cfg, F.col("batch") * datasets_per_batch).alias("d"))
    first = first.select("batch", "slot", "d.dataset", "d.arity")
    rest = (first.select("batch", "arity")
            .withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(max(1, datasets_per_batch - 1)))))
            .where(F.col("slot") < datasets_per_batch))
    of_arity = F.coalesce(*[F.when(F.col("arity") == a, draw([r for r in cfg if r["arity"] == a], F.col("batch") * datasets_per_batch + F.col("slot")))
                            for a in sorted({r["arity"] for r in cfg})])
    rest = rest.select("batch", "slot", of_arity.alias("d")).select("batch", "slot", "d.dataset", "d.arity")
    return first.unionByName(rest).withColumn("slot", F.col("slot").cast("long"))


_PICK = T.StructType([T.StructField("batch", T.LongType()), T.StructField("slot", T.LongType()),
                      T.StructField("pos", T.LongType()), T.StructField("dataset", T.StringType()),
                      T.StructField("sample", T.LongType()), T.StructField("skey", T.StringType()),
                      T.StructField("tkeys", T.ArrayType(T.StringType())),
                      # a row per slot instead: samples it has, and where it goes on (null: it is done)
                      T.StructField("got", T.LongType()), T.StructField("cursor", T.LongType())])


def _greedy(per_slot: int, window: int):
    """Fill a batch's open slots in order from their next candidates; what follows the first slot left open is given up."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        rows: list[tuple] = []
        batch = int(pdf["batch"].iloc[0])
        for slot, own in pdf.sort_values(["slot", "j"]).groupby("slot", sort=True):
            head, found = own.iloc[0], own.iloc[1:]  # the slot itself stands first, with j = -1
            got, upto = int(head["got"]), int(head["upto"])
            for j, sample, skey, keys in zip(found["j"], found["sample"], found["skey"], found["tkeys"]):
                if got == per_slot:
                    break
                if seen.isdisjoint(keys):
                    seen.update(keys)
                    got += 1
                    rows.append((batch, int(slot), int(j), head["dataset"], int(sample), skey, list(keys), None, None))
            # after a full window the next round goes on behind its last candidate
            at = int(found["j"].iloc[-1]) + 1 if len(found) == window else upto
            done = got == per_slot or at >= int(head["n"])
            rows.append((batch, int(slot), None, head["dataset"], None, None, None, got, None if done else at))
            if not done:
                break
        return pd.DataFrame(rows, columns=_PICK.names).astype({c: "Int64" for c in ("pos", "sample", "got", "cursor")})
    return run


def unique_text_batches(samples: DataFrame, plan: DataFrame, per_slot: int, seed: int = 0,
                        over_draw: int = 2, stats: dict | None = None) -> DataFrame:
    """``batch, slot, pos, dataset, sample, texts, short`` with every text at most once per batch.

    The slots of a batch are filled in order, each from its dataset's samples in
    shuffled order from a place of its own on (``pos`` counts from there); a
    sample is taken if the batch holds none of its texts yet.  ``short`` marks
    the samples of a slot whose dataset was exhausted before it was full.

    A round gives each open slot its next candidates: those of a span that none
    of the batch's accepted digests excludes, ``per_slot * over_draw`` of them
    at most, so no task holds more than that for each slot of a batch.  A slot
    that stays open goes on behind them with a span twice as wide, so also a
    dataset that repeats one text is gone through in few rounds.  ``stats``
    (optional dict) receives the rounds and the largest group.

    Texts are compared through their SHA-256 digests, so only 64-character
    keys move through the numbering, the candidates and the rounds; the texts
    are joined back for the accepted samples at the end.
    """
    keyed = (samples.withColumn("tkeys", F.transform("texts", lambda t: F.coalesce(F.sha2(t, 256), F.lit(""))))
             .withColumn("skey", F.sha2(F.array_join("tkeys", "|"), 256)))
    narrow = keyed.select("dataset", "tkeys", "skey",
                          seeded_hash(F.xxhash64("skey"), seed).alias("_h"))
    numbered = with_ordinal(narrow, ["_h", "skey"], partition_by=["dataset"], name="sample")
    numbered = cut_lineage(numbered)
    sizes = numbered.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    window = per_slot * over_draw
    zero = F.lit(0).cast("long")
    slots = cut_lineage(plan.join(F.broadcast(sizes), "dataset").select(
        "batch", F.col("slot").cast("long").alias("slot"), "dataset", "n",
        F.pmod(wide_hash(F.col("batch") * 1000 + F.col("slot"), seed + 1), F.col("n")).alias("start"),
        zero.alias("got"), zero.alias("cursor"), F.lit(window).cast("long").alias("span")))
    taken: list[DataFrame] = []
    ends: list[DataFrame] = []
    of_batch = None  # digests that each batch has accepted: per_slot * slots samples at most
    rounds = largest = 0
    while not slots.isEmpty():
        rounds += 1
        open_ = slots.withColumn("upto", F.least(F.col("cursor") + F.col("span"), F.col("n")))
        heads = open_.select("batch", "slot", "dataset", "n", "got", "upto", F.lit(-1).cast("long").alias("j"), F.lit(None).cast("long").alias("sample"),
                             F.lit(None).cast("string").alias("skey"), F.lit(None).cast("array<string>").alias("tkeys"))
        cand = (open_.where("upto > cursor").withColumn("j", F.explode(F.sequence("cursor", F.col("upto") - 1)))
                .withColumn("sample", F.pmod(F.col("start") + F.col("j"), F.col("n")))
                .join(numbered.select("dataset", "sample", "tkeys", "skey"), ["dataset", "sample"]))
        if of_batch is not None:
            cand = cand.join(of_batch, "batch", "left").where(F.col("held").isNull() | ~F.arrays_overlap("tkeys", "held"))
        first = Window.partitionBy("batch", "slot").orderBy("j")
        cand = cand.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= window).select(heads.columns)
        group = cut_lineage(heads.unionByName(cand))
        if stats is not None:
            largest = max(largest, group.groupBy("batch").count().agg(F.max("count")).first()[0])
        done = cut_lineage(group.groupBy("batch").applyInPandas(_greedy(per_slot, window), _PICK))
        taken.append(done.where("pos is not null").select("batch", "slot", "pos", "dataset", "sample", "skey", "tkeys"))
        states = done.where("pos is null").select("batch", "slot", F.col("got").alias("_got"), F.col("cursor").alias("_cursor"))
        ends.append(states.where("_cursor is null").select("batch", "slot", (F.col("_got") < per_slot).alias("short")))
        # slots that the round did not reach stay as they are
        left = slots.join(states, ["batch", "slot"], "left").where("_got is null or _cursor is not null")
        went_on = F.col("_cursor").isNotNull()
        slots = cut_lineage(left.select("batch", "slot", "dataset", "n", "start", F.coalesce("_got", "got").alias("got"),
                                        F.coalesce("_cursor", "cursor").alias("cursor"),
                                        F.when(went_on, F.col("span") * 2).otherwise(F.col("span")).alias("span")))
        still = slots.select("batch").distinct()
        of_batch = cut_lineage(reduce(DataFrame.unionAll, taken).join(still, "batch", "left_semi").groupBy("batch").agg(
            F.flatten(F.collect_list("tkeys")).alias("held")))
    if stats is not None:
        stats.update(rounds=rounds, largest=largest)
    if not taken:
        return keyed.select(zero.alias("batch"), zero.alias("slot"), zero.alias("pos"), "dataset", zero.alias("sample"), "texts",
                            F.lit(False).alias("short")).where("false")
    out = reduce(DataFrame.unionAll, taken).drop("tkeys").join(reduce(DataFrame.unionAll, ends), ["batch", "slot"])
    texts = keyed.select("dataset", "skey", "texts").dropDuplicates(["dataset", "skey"])
    return out.join(texts, ["dataset", "skey"]).select("batch", "slot", "pos", "dataset", "sample", "texts", "short")
