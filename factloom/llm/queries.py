"""The queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bin_slack_packing, edit_decontamination, extendible_sharding, html_wrappers, importance_resampling, jaccard_join, quality_rules, quality_trees, quote_linking, simhash_golay, token_counts, url_rules, whitening
from .common import spread, table

VOCABULARY = "word_bpe_49k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.count_tokens(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No parent is -1 here, so that the columns stay whole numbers in every reader.
    return quote_linking.link(table(spark, sf_dir, "conversations")).fillna(-1, ["parent_conv", "parent_turn"])


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = url_rules.mine(url_rules.label_pages(pages, table(spark, sf_dir, "labels")))
    return url_rules.verdicts(pages, url_rules.LISTED, mined).select("page_id", "host", "path", "rule", "verdict")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return html_wrappers.extract_pages(pages).select("page_id", "url", "text", "n_chars")


#: One MiB, a shard that a loader reads at once.
SHARD_BYTES = 2**20


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)


def op8_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bin_slack_packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    forest = quality_trees.train(docs, table(spark, sf_dir, "labels"))
    return quality_trees.score(docs, forest).select("doc_id", "held_out", "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return edit_decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), short=True)


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.join(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    drawn = importance_resampling.resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    return white.withColumn("deviation", white["deviation"].cast("long"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quote_linking": op4_quote_linking,
    "op5_url_filters": op5_url_filters,
    "op6_html_extraction": op6_html_extraction,
    "op7_sharding": op7_sharding,
    "op8_bin_slack_packing": op8_bin_slack_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_decontamination": op10_decontamination,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op4_quote_linking": quote_linking.ORACLE,
    "op5_url_filters": url_rules.ORACLE,
    "op7_sharding": extendible_sharding.ORACLE.replace("__LIMIT__", str(SHARD_BYTES)),
    "op12_importance_resampling": importance_resampling.ORACLE,
}
