"""Token counts by the whole-token shortcut.

Each text is counted where it is read: one pass, no shuffle. The vocabulary (a file of
bounded size, read on the driver) is broadcast with the proof which strings are one token.

Defined results for edge cases: a null text counts as an empty one, with 0 bytes and 0
tokens; very long texts are counted whole; repeated rows are counted row by row; an empty
table gives an empty result; further columns of the input pass through, apart from columns
named as a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary

RESULTS = ("n_bytes", "n_tokens", "over_limit")


def token_counter(spark, path: str):
    """A function of a text column that gives its number of tokens."""
    shared = vocabulary.SharedEncoder(spark, path)

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.get()
        for texts in batches:
            yield pd.Series([0 if t is None else own.count(t) for t in texts], dtype="int64")

    return F.pandas_udf(counts, "long")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit."""
    keep = [c for c in docs.columns if c not in RESULTS]
    counter = token_counter(docs.sparkSession, path)
    counted = docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), counter(F.col(text)).alias("n_tokens"))
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
