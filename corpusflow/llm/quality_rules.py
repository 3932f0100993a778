"""Quality rules as weak supervision, native Spark expressions only.

Each rule votes good (1), bad (-1) or abstains (0).  A generative model with
one latent class per document and independent votes given the class (Dawid and
Skene) is fitted by expectation-maximisation: the class share and each rule's
vote probabilities per class.  A document is kept if its posterior probability
of being good reaches one half, in place of asking that all rules pass.

Votes are a function of a few counts, so documents fall into at most 3^rules
vote patterns.  The texts are read once into a narrow table of counts and
votes; EM then runs on the pattern table, one small aggregation per step.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, checkpoint, pick, words_of

STEPS = 25
#: Belief that EM starts from, and its weight: as many votes per rule and class as this share of all documents.
START_GOOD, START_BAD, START_SHARE = 0.02, 0.3, 0.7
WEIGHT = 0.1
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _removed(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts that the rules look at, one row per document.

    ``n_repeat_words``: words in 5-word windows that stand twice or more in the
    text.  Windows are compared by 64-bit hash.  A text whose windows are all
    different (found by a hash set over the row's own array) needs no more;
    else windows are sorted with their positions, and those equal to a
    neighbour cover the repeated words.  All of it stays inside the row.
    """
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", words_of(F.col("t")))
    d = d.withColumn("win", F.when(F.size("w") >= 5, F.transform(
        F.sequence(F.lit(0), F.size("w") - 5),
        lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(5)]))
    ).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, SPACES, "") != ""))
    pairs = F.when(
        F.size(F.array_distinct("win")) < F.size("win"),
        F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    d = d.select(
        *keep, "lines", "t",
        F.size("w").cast("long").alias("n_words"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        pairs.alias("p"))
    last = F.size("p") - 1
    same = lambda a, b: F.get(F.col("p"), a)["h"] == F.get(F.col("p"), b)["h"]
    hit = F.filter(F.col("p"), lambda x, k: F.coalesce(same(k, k - 1), F.lit(False))
                   | (F.when(k < last, same(k, k + 1)).otherwise(F.lit(False))))
    d = d.withColumn("pos", F.sort_array(F.transform(hit, lambda x: x["i"])))
    covered = F.aggregate(
        "pos", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["at"])).alias("n"), i.alias("at")),
        lambda a: a["n"].cast("long"))
    t = F.col("t")
    return d.select(
        *keep, "n_words",
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        _removed(t, SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), "n_distinct",
        _removed(t, UPPER).alias("n_upper"), _removed(t, "!?").alias("n_shouts"),
        _removed(t, "0123456789").alias("n_digits"))


def rules() -> dict[str, tuple[Column, Column]]:
    """name -> (votes bad if, votes good if); neither: abstains.  Bad goes before good."""
    c = F.col
    n, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    return {
        "length": (c("n_words") < 12, c("n_words") >= 40),
        "word_length": ((chars < 2 * n) | (chars > 15 * n), (chars >= 3 * n) & (chars <= 11 * n)),
        "symbols": (10 * c("n_symbols") > n, 50 * c("n_symbols") <= n),
        "symbol_share": (50 * c("n_symbols") > chars, 200 * c("n_symbols") <= chars),
        "dup_lines": (10 * c("n_dup_lines") > 3 * c("n_lines"), (c("n_dup_lines") == 0) & (c("n_lines") >= 3)),
        "repeats": (100 * c("n_repeat_words") > 15 * n, 100 * c("n_repeat_words") <= n),
        "shouting": (5 * c("n_upper") > 2 * chars, 10 * c("n_upper") <= chars),
        "marks": (10 * c("n_shouts") > 3 * n, 50 * c("n_shouts") <= n),
        "variety": (4 * c("n_distinct") < n, 5 * c("n_distinct") >= 2 * n),
        "digits": (10 * c("n_digits") > 3 * chars, 20 * c("n_digits") <= chars),
    }


def votes(counted: DataFrame) -> DataFrame:
    """The counts with one int column ``v_<rule>`` per rule."""
    return counted.select("*", *[
        F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint").alias(f"v_{name}")
        for name, (bad, good) in rules().items()])


def slots(names: list[str]) -> Column:
    """A document's places in the table of log odds: 0 for the class share, then one place per rule and vote."""
    return F.array(F.lit(0), *[F.col(f"v_{x}").cast("int") + (3 * k + 2) for k, x in enumerate(names)])


def _posterior(odds: list[float]) -> Column:
    """P(good | votes) from column ``slots``; the odds are one array literal, so every EM step runs the same compiled code."""
    logit = F.aggregate("slots", F.lit(0.0), lambda a, i: a + F.get(F.lit(odds), i))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def fit(patterns: DataFrame, names: list[str], steps: int = STEPS) -> list[float]:
    """EM over the table of vote patterns (``slots``, count ``n``); gives the log odds by slot.

    Starts from the belief that a rule seldom votes bad on a good document
    (1 in 50) and misses most kinds of bad ones (votes bad on 3 in 10), with a
    share of good documents of 0.7.  The belief stays as a prior that weighs as
    much as a tenth of the documents, so a rare kind of bad document that only
    one or two rules know is not taken for good ones' noise.  Abstaining says nothing about the class.
    Each step is one small aggregation: the expected number of good documents
    by slot.  No document: the start values.
    """
    def table(share: float, good: list[float], bad: list[float]) -> list[float]:
        out = [math.log(share / (1 - share))]
        for g, b in zip(good, bad):  # shares of bad votes among votes
            out += [math.log(g / b), 0.0, math.log((1 - g) / (1 - b))]
        return out

    share, good, bad = START_SHARE, [START_GOOD] * len(names), [START_BAD] * len(names)
    sums = lambda df, x: {r[0]: float(r[1]) for r in (
        df.select(F.explode("slots").alias("s"), x.alias("x")).groupBy("s").agg(F.sum("x")).collect())}
    every = sums(patterns, F.col("n"))
    total = every.get(0, 0.0)
    for _ in range(steps if total else 0):
        g = sums(patterns, F.col("n") * _posterior(table(share, good, bad)))
        before, share = share, (g[0] + START_SHARE * WEIGHT * total) / ((1 + WEIGHT) * total)
        for k in range(len(names)):
            lo, hi = 3 * k + 1, 3 * k + 3
            in_good = [g.get(lo, 0.0), g.get(hi, 0.0)]
            in_bad = [max(0.0, every.get(s, 0.0) - g.get(s, 0.0)) for s in (lo, hi)]
            good[k] = (in_good[0] + START_GOOD * WEIGHT * total) / (sum(in_good) + WEIGHT * total)
            bad[k] = (in_bad[0] + START_BAD * WEIGHT * total) / (sum(in_bad) + WEIGHT * total)
        if abs(share - before) < 1e-4:
            break
    return table(share, good, bad)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS,
          cut: float = 0.5) -> DataFrame:
    """One row per document: id, counts, base_failed, kept, posterior and the votes.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in
    repeated 5-word windows; such a document is never kept.  Null and empty
    texts count as no words, so they fail.  Null ids pass through; repeated
    rows give repeated rows; an empty table gives an empty result.
    """
    names = list(rules())
    voted = checkpoint(votes(counts(pick(docs, doc=id_col, text=text_col), "doc")))
    voted = voted.withColumn("slots", slots(names))
    patterns = checkpoint(voted.groupBy("slots").agg(F.count(F.lit(1)).alias("n")).repartition(1))  # 3^10 rows at most, counted before
    odds = fit(patterns, names, steps)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (voted.withColumn("posterior", _posterior(odds))
            .select(F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", failed.alias("base_failed"),
                    (~failed & (F.col("posterior") >= cut)).alias("kept"), "posterior",
                    *[f"v_{x}" for x in names]))


def oracle_sql() -> str:
    """DuckDB: the same counts, votes and EM (a recursive query with one row per step) over ``documents``."""
    n, ch = "greatest(n_words, 1)", "greatest(word_chars, 1)"
    rule_sql = {
        "length": ("n_words < 12", "n_words >= 40"),
        "word_length": (f"{ch} < 2 * {n} OR {ch} > 15 * {n}", f"{ch} >= 3 * {n} AND {ch} <= 11 * {n}"),
        "symbols": (f"10 * n_symbols > {n}", f"50 * n_symbols <= {n}"),
        "symbol_share": (f"50 * n_symbols > {ch}", f"200 * n_symbols <= {ch}"),
        "dup_lines": ("10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
        "repeats": (f"100 * n_repeat_words > 15 * {n}", f"100 * n_repeat_words <= {n}"),
        "shouting": (f"5 * n_upper > 2 * {ch}", f"10 * n_upper <= {ch}"),
        "marks": (f"10 * n_shouts > 3 * {n}", f"50 * n_shouts <= {n}"),
        "variety": (f"4 * n_distinct < {n}", f"5 * n_distinct >= 2 * {n}"),
        "digits": (f"10 * n_digits > 3 * {ch}", f"20 * n_digits <= {ch}"),
    }
    vote = ", ".join(f"CASE WHEN {b} THEN -1 WHEN {g} THEN 1 ELSE 0 END" for b, g in rule_sql.values())
    ks = range(1, len(rule_sql) + 1)
    logit = "ln(share / (1 - share)) + " + " + ".join(
        f"CASE v[{k}] WHEN -1 THEN ln(good[{k}] / bad[{k}]) WHEN 1 THEN ln((1 - good[{k}]) / (1 - bad[{k}])) ELSE 0 END" for k in ks)
    post = f"1 / (1 + exp(-({logit})))"

    def rates(p: str, start: float) -> str:
        return "[" + ", ".join(
            f"(sum(CASE WHEN v[{k}] = -1 THEN n * {p} ELSE 0 END) + {start * WEIGHT} * sum(n)) / "
            f"(sum(CASE WHEN v[{k}] <> 0 THEN n * {p} ELSE 0 END) + {WEIGHT} * sum(n))" for k in ks) + "]"

    def removed(chars: str) -> str:
        return f"length(t) - length(translate(t, '{chars}', ''))"

    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    start = [f"[{', '.join([str(x)] * len(rule_sql))}]" for x in (START_GOOD, START_BAD)]
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: translate(x, {spaces}, '') <> '') AS l FROM d),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, p - q)) AS n
        FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), p - 5) AS q FROM dup) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {spaces}, '')) AS BIGINT) AS word_chars,
        CAST({removed(SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
        {removed(UPPER)} AS n_upper, {removed('!?')} AS n_shouts, {removed('0123456789')} AS n_digits
      FROM w LEFT JOIN rep USING (doc_id)),
voted AS (SELECT *, [{vote}] AS v FROM c),
pat AS (SELECT v, count(*) AS n FROM voted GROUP BY v),
em(step, share, good, bad, moved) AS (
  SELECT 0, CAST({START_SHARE} AS DOUBLE), CAST({start[0]} AS DOUBLE[]), CAST({start[1]} AS DOUBLE[]), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, share2, good2, bad2, abs(share2 - share) FROM (
    SELECT step, share, (sum(n * p) + {START_SHARE * WEIGHT} * sum(n)) / ({1 + WEIGHT} * sum(n)) AS share2,
           {rates('p', START_GOOD)} AS good2, {rates('(1 - p)', START_BAD)} AS bad2
    FROM (SELECT step, share, v, n, {post} AS p FROM em, pat WHERE step < {STEPS} AND moved >= 1e-4)
    GROUP BY step, share)),
fit AS (SELECT * FROM em ORDER BY step DESC LIMIT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {post} >= 0.5 AS kept
FROM voted, fit"""
