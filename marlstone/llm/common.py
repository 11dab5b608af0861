"""Shared helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.storage import persisted, shared_dir

__all__ = ["crc_mod", "packed", "persisted", "shared_dir", "table", "whole_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def packed(docs: DataFrame, text_col: str, carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """``carry`` (null: all columns) as one struct ``row`` beside the text, and the struct's DDL.

    Rows pass through Python so whatever their columns are called, and only what is carried comes back from it.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), F.col(text_col).alias("text"))
    return rows, f"row {rows.schema['row'].dataType.simpleString()}"


def crc_mod(id_col: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: fold assignment that every engine can repeat."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % divisor
