"""The operators with production parameters over whole tables, as registered queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vantle.llm import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vantle.llm.packing import pack_documents

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.substrings import shared_passages

    return shared_passages(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.pii import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.media import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.secret_scan import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.sharding import sharded

    return sharded(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.retrieval import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantle.llm.audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": sql.NEAR_DUPLICATES, "op12_ranked_search": sql.LEXICAL_SEARCH, "op13_filter_audit": sql.FILTER_AUDIT}
