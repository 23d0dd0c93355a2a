"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from storyloom.llm import codec, conversation_repair, embedding_dedup, exact_dedup, language_id, lexical_search, line_dedup, ngram_join, packing, quality, secrets, suffix_dedup, token_files
from storyloom.llm.common import documents, shared_folder
from storyloom.llm.tokenizers import byte_bpe


#: Power of a source's part of all tokens that is its target in each window.
TEMPER = 0.7


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(documents(spark, sf_dir))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), byte_bpe(), temper=TEMPER)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(documents(spark, sf_dir))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.digests(documents(spark, sf_dir), byte_bpe())


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write(documents(spark, sf_dir), path, byte_bpe())
    return token_files.documents(spark, path)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_line_dedup,
        op2_exact_dedup,
        op3_ngram_join,
        op4_mixture_packing,
        op5_language_id,
        op6_bpe_codec,
        op7_suffix_dedup,
        op8_token_files,
        op9_secret_scan,
        op10_quality_rules,
        op11_embedding_dedup,
        op12_conversation_repair,
        op13_lexical_search,
    )
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    found = {"op1_line_dedup": line_dedup.SQL, "op13_lexical_search": lexical_search.SQL, "op2_exact_dedup": exact_dedup.SQL, "op10_quality_rules": quality.sql(), "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
