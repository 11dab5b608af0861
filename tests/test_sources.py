import json

import pytest

from marlstone.sources import formats

XML = "<annotation><filename>{n}.png</filename><size><width>100</width><height>80</height></size>{o}</annotation>"
OBJ = "<object><name>{c}</name><difficult>0</difficult><truncated>1</truncated><bndbox><xmin>{b[0]}</xmin><ymin>{b[1]}</ymin><xmax>{b[2]}</xmax><ymax>{b[3]}</ymax></bndbox></object>"


def test_voc_pairs_and_boxes(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML.format(n="a", o=OBJ.format(c=" Helmet", b=(1, 1, 11, 21)) + OBJ.format(c="head", b=(50, 30, 200, 20))))
    (tmp_path / "B.xml").write_text(XML.format(n="B", o=OBJ.format(c="person", b=(5, 5, 5, 9))))
    for n in ("A", "b"):
        (tmp_path / f"{n}.png").write_bytes(b"x")
    assert [r.key for r in formats.file_pairs(spark, str(tmp_path)).orderBy("key").collect()] == ["a", "b"]
    got = [(r.ann_id, r.cls, r.x, r.y, r.w, r.h) for r in formats.voc_annotations(spark, f"{tmp_path}/*.xml").orderBy("ann_id").collect()]
    assert got == [(1, "person", 4, 4, 1, 5), (2, "helmet", 0, 0, 11, 21), (3, "head", 49, 19, 51, 11)]
    (tmp_path / "c.xml").write_text(XML.format(n="c", o=OBJ.format(c="cat", b=(1, 1, 2, 2))))
    with pytest.raises(ValueError, match="cat"):
        formats.voc_annotations(spark, f"{tmp_path}/*.xml")
    with pytest.raises(ValueError, match="c"):
        formats.file_pairs(spark, str(tmp_path))


def test_coco_detections_and_samples(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.png", "width": 10, "height": 10}], "annotations": [{"id": 7, "image_id": 1, "category_id": 5, "bbox": [0, 1, 2, 3], "area": 6, "iscrowd": 0}, {"id": 6, "image_id": 1, "category_id": 3, "bbox": [0, 1, 0, 3], "area": 0, "iscrowd": 0}], "categories": [{"id": 5, "name": "head"}, {"id": 3, "name": "helmet"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    images, ann, categories = formats.read_coco(spark, str(tmp_path / "c.json"))
    boxes = formats.samples(images, ann, categories).first().boxes
    assert [(b.ann_id, b.w, b.class_index) for b in boxes] == [(7, 2.0, 1)]
    formats.write_coco(images, ann, categories, str(tmp_path / "out"))
    assert spark.read.json(f"{tmp_path}/out/annotations").count() == 2
    good = [{"image_id": 1, "category_id": 5, "bbox": [0, 0, 1, 1], "score": 0.5}]
    (tmp_path / "d.json").write_text(json.dumps(good))
    assert formats.read_detections(spark, str(tmp_path / "d.json"), (3, 5)).count() == 1
    (tmp_path / "e.json").write_text(json.dumps([good[0] | {"bbox": [1, 2, 3]}]))
    with pytest.raises(ValueError):
        formats.read_detections(spark, str(tmp_path / "e.json"), (3, 5))


def test_metrics_round_trip_and_digests(spark, tmp_path):
    rows = [("a", 1, "test", "map", 0.1 + 0.2, 5, None, None, 0.4, "n"), ("b", None, "test", "map", None, None, 2, 0.1, None, None)]
    table = spark.createDataFrame(rows, formats.METRIC)
    formats.write_metrics(table, str(tmp_path / "m"))
    assert sorted(map(str, formats.read_metrics(spark, str(tmp_path / "m")).collect())) == sorted(map(str, table.collect()))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    assert formats.file_digests(spark, str(tmp_path / "f")).first().sha256.startswith("ba7816bf")
    (tmp_path / "log.json").write_text(json.dumps({"log_history": [{"step": 5, "eval_map": 0.5, "loss": 1}, {"step": 10, "eval_map": True}]}))
    assert [tuple(r) for r in formats.training_points(spark, str(tmp_path / "log.json")).collect()] == [(5, "eval_map", 0.5)]
