"""A corpus pipeline of five stages over the documents table.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bin_slack_packing, edit_decontamination, jaccard_join, quality_rules, quality_trees
from factloom.llm.common import materialise, spread, table
from factloom.llm.queries import VOCABULARY


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    forest = quality_trees.train(docs, table(spark, sf_dir, "labels"))
    return quality_trees.keep_good(docs, forest)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail a quality rule."""
    return quality_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return jaccard_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return edit_decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), short=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row a piece, as op8 returns them."""
    return bin_slack_packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("jaccard_join", deduplicate), ("decontamination", decontaminate), ("packing", pack)]

#: No SQL expresses the classifier, the edit distances or the packing; the stages are
#: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
