"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import byte_bpe, byte_cnn, decontaminate, lm_score, ngram_join, oracle, quality_rules, samples, secrets, substring_dedup, token_files, toxicity
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents")).drop("most_owners", "most_repositories")


def _classified(scored: DataFrame, held_out: tuple[int, int]) -> DataFrame:
    return scored.select("doc_id", F.coalesce(samples.remainder("doc_id", held_out[0]) == held_out[1], F.lit(False)).alias("held_out"), "score", "predicted")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return _classified(byte_cnn.score(documents, byte_cnn.fit(documents, _table(spark, sf_dir, "labels"))), byte_cnn.HELD_OUT)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality_rules.apply(documents, quality_rules.fit(documents, _table(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return _classified(toxicity.score(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels"))), toxicity.HELD_OUT)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), Scratch(spark, "token-files"))
    return token_files.read_files(files)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_decontamination,
        op2_substring_dedup,
        op3_byte_bpe,
        op4_secret_scan,
        op5_quality_classifier,
        op6_lm_score,
        op7_quality_rules,
        op8_toxicity,
        op9_token_files,
        op10_ngram_jaccard,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": oracle.DECONTAMINATION,
        "op4_secret_scan": oracle.SECRETS,
        "op10_ngram_jaccard": oracle.JACCARD,
    }
