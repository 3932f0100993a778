"""2.11: the default text encoder, fully Spark: tokens -> hashed term counts -> IDF -> L2 norm.

The neural encoder of the reference is not shipped (its weights are absent);
any encoder producing unit-length ``array<float>`` vectors plugs into the
similarity join, and precomputed vectors are always accepted.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUM_FEATURES = 4096
TOKEN_PATTERN = r"(?U)\W+"


def fit_encoder(df: DataFrame, text_col: str, num_features: int = NUM_FEATURES):
    """Fit tokenizer + hashing TF + IDF + normaliser on ``text_col`` (IDF is one aggregation pass)."""
    stages = [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_PATTERN),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
              IDF(inputCol="_tf", outputCol="_idf"),
              Normalizer(inputCol="_idf", outputCol="_vec", p=2.0)]
    return Pipeline(stages=stages).fit(df.select(text_col))


def encode(model, df: DataFrame, text_col: str, out_col: str = "vector") -> DataFrame:
    """Unit-length ``array<float>`` per row (zero vector for texts without tokens)."""
    out = model.transform(df)
    return out.withColumn(out_col, vector_to_array("_vec", "float32")).drop("_tok", "_tf", "_idf", "_vec")


def encode_column(df: DataFrame, text_col: str, out_col: str = "vector") -> DataFrame:
    return encode(fit_encoder(df, text_col), df, text_col, out_col)

