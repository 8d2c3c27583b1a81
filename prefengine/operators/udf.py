"""Batch plug-ins (U1-U3): scorer, sampler and tokenizer callables on Arrow batches.

The model (or any heavy state) is built once per task by the ``make_*`` factory and then
applied batch by batch; rows never cross the Python boundary one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType


def score_with(df: DataFrame, make_scorer: Callable[[], Callable[[pd.Series], pd.Series]], text: str,
               out: str = "score") -> DataFrame:
    """Score ``text`` with a batch scorer (U1): mapInPandas, scorer built once per task."""
    schema = StructType(df.schema.fields + [StructField(out, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            pdf[out] = scorer(pdf[text]).astype("float64")
            yield pdf
    return df.mapInPandas(run, schema)


def generate_with(df: DataFrame, make_sampler: Callable[[], Callable[[pd.Series, int], pd.Series]], prompt: str,
                  n: int, out: str = "completion") -> DataFrame:
    """n completions per prompt (U2): mapInPandas -> array<string>."""
    schema = StructType(df.schema.fields + [StructField(out, ArrayType(StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = make_sampler()
        for pdf in batches:
            pdf[out] = sampler(pdf[prompt], n)
            yield pdf
    return df.mapInPandas(run, schema)


def encode_with(df: DataFrame, tokenize: Callable[[pd.Series], pd.Series], text: str, out: str) -> DataFrame:
    """Tokenizer plug-in (U3): a pandas UDF returning array<int> per row."""
    udf = F.pandas_udf(tokenize, ArrayType(IntegerType()))
    return df.withColumn(out, udf(F.col(text)))
