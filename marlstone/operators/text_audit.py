"""Scans of text columns: fenced blocks, links, numbers, markdown tables, forbidden words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, link for every href."""
    return df.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


def markdown_links(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no, target of links outside fenced blocks, percent-decoded and without their fragment.

    The fence's state is folded along the lines of one text.
    """
    start = F.struct(F.lit(False).alias("open"), F.expr("cast(array() as array<struct<n:int,line:string>>)").alias("out"))
    lines = F.transform(F.split(text_col, "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))

    def step(acc: Column, s: Column) -> Column:
        fence = s["line"].rlike(r"^\s*(?:```|~~~)")
        return F.struct((acc["open"] != fence).alias("open"), F.when(~acc["open"] & ~fence, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    free = df.select(id_col, F.explode(F.aggregate(lines, start, step, lambda acc: acc["out"])).alias("s"))
    found = free.select(id_col, F.col("s.n").alias("line_no"), F.explode(F.regexp_extract_all(F.col("s.line"), F.lit(r"\]\(([^)\s]+)"), F.lit(1))).alias("t"))
    return found.select(id_col, "line_no", F.url_decode(F.regexp_replace("t", "#.*$", "")).alias("target")).where("target <> ''")


def numbers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, number (as shown), decimals."""
    found = df.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("number"))
    return found.withColumn("decimals", F.length(F.regexp_extract("number", r"\.([0-9]+)", 1)))


def agrees(shown: Column, value: Column, decimals: Column) -> Column:
    """Whether a shown value is within half a unit of its last place."""
    return F.abs(shown - value) <= F.lit(0.5) * F.pow(F.lit(10.0), -decimals) + F.lit(1e-12)


def forbidden(df: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """id, line_no of lines that the pattern hits."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line")).where(F.col("line").rlike(pattern)).select(id_col, (F.col("n") + 1).alias("line_no"))


def table_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no, cells of markdown table rows; rules are left out."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line")).where(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    return lines.select(id_col, (F.col("n") + 1).alias("line_no"), cells.alias("cells"))
