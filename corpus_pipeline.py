"""Corpus pipeline: quality classifier, line dedup, near-dedup, benchmark decontamination, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Between stages the rows are written as Parquet in the
folder that driver and executors share and read again, so that a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from marlstone.llm.common import crc_mod, shared_dir, table, whole_text
from marlstone.llm.registry import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. It learns from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    model = quality.train(docs, labels)
    return quality.score(docs, model, out_col="__quality").where(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source; n_chars follows the text."""
    out = line_dedup.line_dedup(docs, low_ratios=line_dedup.LOW_RATIOS)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the smallest doc_id.

    Rows that repeat a doc_id are told apart by text: with equal texts one row stays, with others each is a document of its
    own. Rows without a doc_id can't be told apart and stay.
    """
    row_id = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id"), F.unhex(F.md5(whole_text())).alias("digest")))
    kept = near_dedup.near_duplicates(docs.select(row_id.alias("id"), "text"), id_col="id").where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    told = docs.withColumn("__id", row_id).join(kept, F.col("__id") == F.col("__kept")).drop("__kept").dropDuplicates(["__id"]).drop("__id")
    return told.unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return found.where(~F.col("contaminated")).select("row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_decode(docs, tokenizer_file())


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", bpe_stage),
]

#: The quality model and the BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
