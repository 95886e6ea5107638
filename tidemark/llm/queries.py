"""The registered queries of the llm operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_tree, divergence, jaccard_join, language_id, lm_trie, minhash, mixing, multi_index, pieces, pii, quality, toxicity, warc
from .common import table


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints_with_next(table(spark, sf_dir, "documents"))


def near_copies_by_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 1: signature bands joined, Jaccard similarity verified."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_trie.model_scores(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_lm_trie, op4_mixing, op5_toxicity, op6_multi_index, op7_pii, op8_jaccard_join, op9_sentencepiece, op10_language_id, op11_ball_tree, op12_warc, op13_divergence, near_copies_by_bands)}


def oracle_sql() -> dict[str, str]:
    return {"op11_ball_tree": ball_tree.sql(), "op12_warc": warc.SQL, "op13_divergence": divergence.sql()}
