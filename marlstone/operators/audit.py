"""Checks that give findings: check, severity, message. No rows: nothing found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.hashing import hash_fold


def finding(rows: DataFrame, check: str, severity: str, message: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message"))


def audit(images: DataFrame, ann: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Schema and facts of a ground truth: unique ids, known images and classes, positive sides, boxes in the frame."""
    text = lambda c: F.col(c).cast("string")
    boxes = ann.join(images, "image_id")
    parts = [
        finding(ann.groupBy("ann_id").count().where("count > 1"), "unique_id", "fatal", text("ann_id")),
        finding(ann.join(images, "image_id", "left_anti"), "known_image", "fatal", text("ann_id")),
        finding(ann.where(~F.col("cls").isin(*classes)), "known_class", "fatal", text("ann_id")),
        finding(ann.where("w <= 0 or h <= 0"), "positive_sides", "fatal", text("ann_id")),
        finding(boxes.where("x < 0 or y < 0 or x + w > width or y + h > height"), "in_frame", "warning", text("ann_id")),
        finding(images.join(ann, "image_id", "left_anti"), "annotated", "warning", text("image_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def drift(recorded: DataFrame, present: DataFrame, key: str, digest: str) -> DataFrame:
    """key, state for each key whose digest changed or that one side lacks: changed, missing or new."""
    a, b = recorded.select(key, F.col(digest).alias("__a")), present.select(key, F.col(digest).alias("__b"))
    both = a.join(b, key, "full")
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "new").when(F.col("__a") != F.col("__b"), "changed")
    return both.select(key, state.alias("state")).where("state is not null")


def flattened(wide: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """Wide metrics as rows metric, value, with the instance counts of the same keys."""
    long = wide.unpivot(keys, [c for c in wide.columns if c not in keys], "metric", "value")
    return long.join(counts, keys, "left")


def spread(df: DataFrame, group: str, value: str, least: float) -> DataFrame:
    """group, spread, discriminates: whether the values differ by ``least`` at least."""
    out = df.groupBy(group).agg((F.max(value) - F.min(value)).alias("spread"))
    return out.withColumn("discriminates", F.col("spread") >= least)


def missing_metrics(metrics: DataFrame, group: str, metric: str, required: list[str]) -> DataFrame:
    """``group``, ``metric`` for each required metric that a group of ``metrics`` lacks. No rows: complete."""
    wanted = metrics.select(group).distinct().select(group, F.explode(F.array(*map(F.lit, required))).alias(metric))
    return wanted.join(metrics.select(group, metric), [group, metric], "left_anti")


def required_metrics(truth: DataFrame, cls: str = "cls", always: tuple[str, ...] = ("map", "bare_head_recall")) -> DataFrame:
    """metric: those that must have an interval, ``always`` and the average precision of each class that the truth has."""
    return truth.select(F.concat(F.lit("ap."), cls).alias("metric")).distinct().unionByName(truth.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, always))).alias("metric")))


def missing_of(metrics: DataFrame, group: str, metric: str, required: DataFrame) -> DataFrame:
    """``group``, ``metric`` for each metric of the table ``required`` (a few names) that a group of ``metrics`` lacks."""
    wanted = metrics.select(group).distinct().crossJoin(required.agg(F.collect_set("metric").alias("__all"))).select(group, F.explode("__all").alias(metric))
    return wanted.join(metrics.select(group, metric), [group, metric], "left_anti")


def manifest(digests: DataFrame, hashes: DataFrame, groups: DataFrame, *, seed: str = "split", folds: int = 10) -> DataFrame:
    """item_id, sha256, phash (16 hex digits), group_id, split, blocked: what a frozen split says of every item.

    ``digests`` has item_id and sha256, ``hashes`` item_id and hash (a long), ``groups`` item_id and group_id. All three must have the
    same items, each once. The split is that of the group, by hash: fold 0 is test, which is blocked for training, fold 1 val.
    """
    ids = [t.groupBy("item_id").agg(F.count("*").alias("n")) for t in (digests, hashes, groups)]
    for own in ids:
        if bad := own.where("n > 1").take(1):
            raise ValueError(f"item {bad[0][0]!r} is repeated")
    for own in ids[1:]:
        if bad := ids[0].join(own.withColumnRenamed("n", "m"), "item_id", "full").where("n is null or m is null").take(1):
            raise ValueError(f"item {bad[0][0]!r} is not in all tables")
    fold = hash_fold(seed, F.col("group_id"), folds)
    met = digests.join(hashes, "item_id").join(groups, "item_id").withColumn("fold", fold)
    split = F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train")
    return met.select("item_id", "sha256", F.lpad(F.lower(F.hex("hash")), 16, "0").alias("phash"), "group_id", split.alias("split"), (F.col("fold") == 0).alias("blocked"))
