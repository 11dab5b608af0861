"""Readers and writers of annotation formats, with explicit schemas; a row that does not fit is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import geometry as g

VOC = "filename string, size struct<width: int, height: int>, object array<struct<name: string, difficult: int, truncated: int, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
COCO = "images array<struct<id: long, file_name: string, width: int, height: int>>, annotations array<struct<id: long, image_id: long, category_id: int, bbox: array<double>, area: double, iscrowd: int>>, categories array<struct<id: int, name: string>>"
DETECTION = "image_id long, category_id int, bbox array<double>, score double"
METRIC = "arm string, seed int, split string, metric string, value double, n_instances long, n_images long, ci_low double, ci_high double, notes string"


def file_pairs(spark: SparkSession, folder: str, left: str = "xml", right: str = "png") -> DataFrame:
    """key, left, right for files with the same case-folded stem under a folder; a stem that is single or twice is an error."""

    def listed(ext: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{ext}").load(folder).select("path")
        stem = F.lower(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
        return files.groupBy(stem.alias("key")).agg(F.min("path").alias(name), F.count("*").alias(f"n_{name}"))

    both = listed(left, "left").join(listed(right, "right"), "key", "full")
    if bad := both.where("coalesce(n_left, 0) <> 1 or coalesce(n_right, 0) <> 1").select("key").take(5):
        raise ValueError(f"stems without one file of each kind: {sorted(r[0] for r in bad)}")
    return both.select("key", "left", "right")


def voc_annotations(spark: SparkSession, path: str, classes: tuple[str, ...] = ("helmet", "head", "person")) -> DataFrame:
    """ann_id, image_id, file_name, cls, x, y, w, h, difficult, truncated of VOC files.

    The coordinate offset is 1 if the least coordinate of all files is 1, else 0. Unknown labels are an error, objects
    without a box are left out, boxes are normalised and empty ones dropped; ids are dense in order of name and place.
    """
    from marlstone.operators.sampling import global_rank

    docs = spark.read.format("xml").option("rowTag", "annotation").option("mode", "FAILFAST").schema(VOC).load(path)
    rows = docs.select("filename", "size", F.posexplode_outer("object").alias("place", "o")).select("filename", F.col("size.width").alias("width"), F.col("size.height").alias("height"), "place", F.lower(F.trim("o.name")).alias("cls"), "o.difficult", "o.truncated", "o.bndbox.*")
    if unknown := rows.where(F.col("cls").isNotNull() & ~F.col("cls").isin(*classes)).select("cls").take(1):
        raise ValueError(f"unknown label {unknown[0][0]!r}")
    least = rows.agg(F.min(F.least("xmin", "ymin", "xmax", "ymax"))).first()[0]
    b, done = g.normalised(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("width"), F.col("height"), 1 if least == 1 else 0)
    boxes = rows.where("cls is not null and xmin is not null").select("filename", "place", "cls", *[c.alias(n) for n, c in zip("xywh", b)], done["empty"].alias("empty"), "difficult", "truncated").where("not empty").drop("empty")
    images = global_rank(docs.select("filename").distinct(), ["filename"], "image_id")
    return global_rank(boxes.join(images, "filename"), ["filename", "place"], "ann_id").select("ann_id", "image_id", F.col("filename").alias("file_name"), "cls", "x", "y", "w", "h", "difficult", "truncated")


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of a COCO document."""
    doc = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(COCO).json(path)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    box = F.col("a.bbox")
    ann = doc.select(F.explode("annotations").alias("a")).select(F.col("a.id").alias("ann_id"), "a.image_id", "a.category_id", *[F.get(box, F.lit(k)).alias(n) for k, n in enumerate("xywh")], "a.area", "a.iscrowd")
    return images, ann, doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("cls"))


def write_coco(images: DataFrame, ann: DataFrame, categories: DataFrame, path: str) -> None:
    """One JSON record a line in three folders, each in order of id; a document is put together from them at the edge."""
    images.orderBy("image_id").write.json(f"{path}/images")
    ann.orderBy("ann_id").write.json(f"{path}/annotations")
    categories.orderBy("category_id").write.json(f"{path}/categories")


def read_detections(spark: SparkSession, path: str, categories: tuple[int, ...]) -> DataFrame:
    """image_id, category_id, x, y, w, h, score of a JSON list; wrong fields, box lengths or categories are an error."""
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(DETECTION).json(path)
    whole = F.size("bbox") == 4
    ok = whole & F.col("image_id").isNotNull() & F.col("score").isNotNull() & F.col("category_id").isin(*categories)
    if bad := rows.where(~F.coalesce(ok, F.lit(False))).take(1):
        raise ValueError(f"not a detection: {bad[0].asDict()}")
    return rows.select("image_id", "category_id", *[F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")], "score")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a given schema; blank lines are passed over."""
    return spark.read.option("mode", "FAILFAST").schema(schema).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("mode", "FAILFAST").option("nullValue", "").schema(METRIC).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """CSV whose numbers read back as they were; null is an empty field."""
    metrics.write.option("header", True).option("nullValue", "").csv(path)


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, sha256 of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def training_points(spark: SparkSession, path: str) -> DataFrame:
    """step, metric, value: the numeric ``eval_`` entries of a log's history, in long form."""
    logs = spark.read.option("multiLine", True).schema("log_history array<map<string, string>>").json(path)
    rows = logs.select(F.explode("log_history").alias("m")).select(F.col("m")["step"].cast("long").alias("step"), F.explode("m").alias("metric", "raw"))
    return rows.where(F.col("metric").startswith("eval_")).select("step", "metric", F.expr("try_cast(raw as double)").alias("value")).where("value is not null")


def samples(images: DataFrame, ann: DataFrame, categories: DataFrame, keep_names: DataFrame | None = None) -> DataFrame:
    """image_id, file_name, width, height, boxes: one row an image, boxes in order of id, classes from 0; empty boxes go."""
    if keep_names is not None:
        images = images.join(keep_names.select("file_name"), "file_name", "left_semi")
    index = categories.select("category_id", F.array_position(F.lit(sorted(r[0] for r in categories.select("category_id").collect())), F.col("category_id")).alias("k"))
    one = F.struct("ann_id", "x", "y", "w", "h", (F.col("k") - 1).cast("int").alias("class_index"))
    boxes = ann.where("w > 0 and h > 0").join(index, "category_id").groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("boxes"))
    return images.join(boxes, "image_id", "left")
