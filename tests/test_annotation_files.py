"""The data source of annotation files: rows, errors, conditions that reach the listing, the stream, all formats at once."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

from terrace.sources import annotation_files, files, labelme, yolo
from terrace.sources.annotation_files import AnnotationFiles


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(AnnotationFiles)
    at = tmp_path / "in"
    for folder in ("ann", "bob/deep"):
        (at / folder).mkdir(parents=True)
    ring = [[1, 1], [12, 1], [12, 12], [1, 12]]
    shapes = [{"label": "Tree", "shape_type": "polygon", "points": ring, "group_id": None, "flags": {}}]
    (at / "ann/a.json").write_text("﻿" + json.dumps({"imagePath": "a.png", "imageWidth": 16, "imageHeight": 16, "shapes": shapes * 2}), encoding="utf-8")
    (at / "ann/b.txt").write_text("0 0.5 0.5 0.5 0.25\n1 0.1 0.1 0.9 0.1 0.9 0.9\n0 1\n"[:-4], encoding="utf-8")
    (at / "ann/none.txt").write_text("")
    (at / "ann/pic.png").write_bytes(b"x")
    coco = {"images": [{"id": 1, "file_name": "c.png", "width": 9, "height": 9}], "categories": [{"id": 1, "name": "tree"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0], "segmentation": []}, {"id": 2, "image_id": 1, "category_id": 8, "bbox": [1.0, 2.0, 3.0, 4.0]}]}
    (at / "bob/deep/c.json").write_text(json.dumps(coco))
    (at / "bob/deep/bad.txt").write_bytes(b"\xff\xfe1")
    (at / "bob/big.json").write_text('{"x": "' + "y" * 3000 + '"}')
    (at / "bob/lone.txt").write_text("0 0.5 0.5 0.5 0.25")
    return at


def load(spark, root, **options):
    return annotation_files.load(spark, str(root), max_file_bytes="2000", group_bytes="300", **options)


def test_rows_and_errors(spark, root):
    rows = {os.path.basename(r["path"]): r for r in load(spark, root).collect()}
    assert {k: r["error"] for k, r in rows.items()} == {"a.json": None, "b.txt": None, "none.txt": None, "c.json": None, "bad.txt": "not UTF-8", "big.json": "larger than a cell should hold", "lone.txt": None}
    assert rows["a.json"]["text"].startswith("{") and rows["none.txt"]["length"] == 0
    assert {r["disposition"]: r["count"] for r in annotation_files.told(load(spark, root)).groupBy("disposition").count().collect()} == {"read": 4, "empty": 1, "unreadable": 2}
    (root / "nothing").mkdir()
    assert load(spark, root / "nothing").count() == 0
    assert load(spark, root, suffixes=".txt").count() == 4
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert load(spark, root).where("length > 2000").count() == 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_same_objects_as_the_readers(spark, root):
    sizes = spark.createDataFrame([("b", 100, 200)], "stem string, width int, height int")
    rows = annotation_files.objects(load(spark, root), sizes)
    got = {(os.path.basename(r["path"]), r["ordinal"]): r for r in rows.collect()}
    assert {k: r["error"] for k, r in got.items() if r["error"]} == {
        ("bad.txt", None): "not UTF-8", ("big.json", None): "larger than a cell should hold", ("lone.txt", None): "no size of its image", ("c.json", 2): "category isn't listed",
    }
    texts = files.texts(spark, str(root), "*.json")
    for r in labelme.objects(labelme.read(texts.where("path LIKE '%a.json'"))).collect():
        mine = got["a.json", r["ordinal"] + 1]
        assert (mine["class_id"], mine["box"], mine["polygon"]) == (r["class_id"], r["box"], r["polygon"])
    lines = files.texts(spark, str(root), "b.txt").withColumn("width", F.lit(100)).withColumn("height", F.lit(200))
    for r in yolo.parse(lines).collect():
        assert (got["b.txt", r["line"]]["box"], got["b.txt", r["line"]]["class_name"]) == (r["box"], r["class_name"])
    assert tuple(got["c.json", 1]["box"]) == (1.0, 2.0, 4.0, 6.0)


def test_conditions_reach_the_listing(spark, root):
    def folders(*conditions):
        reader = annotation_files._ConditionReader({"path": str(root), "group_bytes": "300"})
        left = list(reader.pushFilters(list(conditions)))
        return left, {f[len(str(root)) :] for s in reader.partitions() for f in s.folders}, reader

    assert folders()[1] == {"/ann", "/bob", "/bob/deep"}
    plain = annotation_files._Reader({"path": str(root), "group_bytes": "300"}).partitions()
    assert len(plain) > 3 and len(annotation_files._Reader({"path": str(root)}).partitions()) == 1
    left, found, reader = folders(StringStartsWith(("path",), f"{root}/bob/deep/c"))
    assert left == [] and found == {"/bob/deep"}
    assert sum(b.num_rows for s in reader.partitions() for b in reader.read(s)) == 1
    assert folders(EqualTo(("path",), f"{root}/ann/b.txt"))[1] == {"/ann"}
    assert folders(GreaterThan(("length",), 2000))[1] == {"/bob"}
    other = EqualTo(("error",), "x")
    assert folders(other)[0] == [other]
    df = load(spark, root)
    assert df.where(F.col("path").startswith(f"{root}/bob/deep/")).count() == 2
    assert df.where(F.col("path").isin(f"{root}/ann/a.json", f"{root}/bob/lone.txt")).count() == 2
    assert df.where("length > 2000 AND error IS NOT NULL").count() == 1


def test_stream_takes_each_file_once(spark, root, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.format("annotation_files").option("settle", "0.2").load(str(root))
        stream.select("path", "length").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    time.sleep(0.3)
    run()
    assert spark.read.parquet(out).count() == 7
    (root / "ann/late.txt").write_text("0 0.5 0.5 0.5 0.25")
    time.sleep(0.3)
    run()
    run()
    paths = [r["path"] for r in spark.read.parquet(out).collect()]
    assert len(paths) == len(set(paths)) == 8
