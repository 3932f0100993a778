"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import base64
import random

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)


def clashing(df):
    """The same rows with extra columns named like those that operators make."""
    names = ("DOC_ID", "score", "kept", "w", "_in0", "text_", "id", "page", "fp", "node", "h", "label", "n_words", "component")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names) if n != "DOC_ID"], F.lit("x").alias("DOC_ID"))


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(random.Random(k).choice("abcdefghijklmnop") for _ in range(2 + k % 7)) for k in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def odd_texts():
    """(id, text): the cases every operator must survive."""
    base = prose(1, 60)
    return [(1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, prose(2, 20000)), (7, "ab " * 3000), (7, "ab " * 3000),
            (11, "x eyJ" + base64.b64encode(b'{"a":' * 20_000).decode().rstrip("=")[3:] + ".e30.sig y"),  # JSON nested deeper than Python reads
            (12, "the mit license" + "\n" * 30_000), (13, "gnu general public license" + " " * 8_000 + "version"),
            (None, prose(3, 30)), (None, None), (8, "Ünïcödé ß 漢字 \U0001f600 \x00 \x85   x"), (9, "one"), (10, "one two three four five")]
