"""Queries of the corpus operators and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, collocations, conversation, decontaminate, exact_dedup, line_dedup, near_dedup, pii, quality, quality_rules, toxicity, url_filter, warc
from marlstone.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85).drop("class_id")


def tokenizer_file() -> str:
    """The public tokenizer of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), low_ratios=line_dedup.LOW_RATIOS).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("uri")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "row")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("offending")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    return conversation.repair_summary(conversation.damaged(convs), convs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_near_dedup, op3_bpe, op4_quality, op5_line_dedup, op6_url_filter, op7_warc, op8_decontaminate, op9_toxicity, op10_pii, op11_collocations, op12_quality_rules, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE_SQL, "op2_near_dedup": near_dedup.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL, "op6_url_filter": url_filter.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL, "op8_decontaminate": decontaminate.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_quality_rules": quality_rules.ORACLE_SQL, "op13_conversation_repair": conversation.ORACLE_SQL}
