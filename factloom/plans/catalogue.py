"""Registered queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import answering, boards, evidence, maintaining, reading, retrieval, settling, streams, versions, wide, writing

_MODULES = (retrieval, versions, reading, writing, answering, maintaining, evidence, settling, boards, wide, streams)

QUERIES: dict = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES: dict = {name: s for m in _MODULES for name, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused retrieval: the twenty best turns of each query."""
    return retrieval.noisy_or_fusion(spark, sf_dir)
