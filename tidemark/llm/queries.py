"""The queries of the ten operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import oracles
from tidemark.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import lines

    return lines.summary(lines.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, keep_first=False))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import suffix

    return suffix.summary(suffix.remove_repeats(table(spark, sf_dir, "documents"), length=200))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import ctw

    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import quality

    return quality.judge(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import tokens

    return tokens.encoded_summary(tokens.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), decoded="decoded"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import sharding

    return sharding.shards(table(spark, sf_dir, "documents"), 8)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import tokens

    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_line_dedup, op2_suffix_dedup, op3_toxicity, op4_lm_scoring, op5_quality_rules, op6_simhash, op7_sentencepiece, op8_decontamination, op9_sharding, op10_token_counts)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
