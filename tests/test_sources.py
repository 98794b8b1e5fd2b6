"""Formats, from files written here."""

import json

import pytest
from pyspark.sql import functions as F

from terrace.sources import coco, files, labelme, tables, yolo


def test_yolo_lines(spark):
    text = "0 0.5 0.5 0.5 0.25\n\n1 0.1 0.1 0.9 0.1 0.9 0.9\r\nx 1 2\n0 0.1 0.2 0.3\n"
    rows = yolo.parse(spark.createDataFrame([("a.txt", text, 100, 200)], "path string, text string, width int, height int")).orderBy("line").collect()
    assert [r["line"] for r in rows] == [1, 3, 4, 5]
    assert tuple(rows[0]["box"]) == (25.0, 75.0, 75.0, 125.0) and rows[0]["class_name"] == "tree"
    assert [tuple(p) for p in rows[1]["polygon"]] == [(10.0, 20.0), (90.0, 20.0), (90.0, 180.0)]
    assert rows[2]["error"].startswith("line 4") and rows[3]["error"].startswith("line 5")


def test_label_lines_round_binary_values(spark):
    points = [(123.457, 1.0), (700.001, 9.0), (3.3, 77.77)]
    df = spark.createDataFrame([("k", 0, 1, points, 1024, 1024)], "key string, ordinal int, class_id int, polygon array<struct<x:double,y:double>>, width int, height int")
    assert yolo.label_lines(df).first()["label"] == "1 " + " ".join("%.8f" % (v / 1024) for p in points for v in p)


def shape(label, points, kind="polygon"):
    return {"label": label, "shape_type": kind, "points": points, "group_id": None, "flags": {}}


def test_labelme(spark, tmp_path):
    ring = [[1, 1], [12, 1], [12, 12], [1, 12]]
    docs = {
        "a.json": {"imagePath": "a.png", "imageWidth": 16, "imageHeight": 16, "shapes": [shape(" Tree ", [[-0.5, 3], [16.4, 3], [8, 30]]), shape("bush", [])]},
        "b.json": {"imagePath": "b.png", "imageWidth": 16, "imageHeight": 16, "shapes": [shape("tree", ring)]},
        "c.json": {"imagePath": "c.png", "imageWidth": 16, "imageHeight": 16, "shapes": [shape("TREE", (ring[2:] + ring[:2])[::-1])]},
        "d.json": {"shapes": []},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text("﻿" + json.dumps(doc), encoding="utf-8")
    (tmp_path / "e.json").write_text("{not json")
    read = labelme.read(files.texts(spark, str(tmp_path), "*.json"))
    found = {r["path"].rsplit("/", 1)[1]: r["disposition"] for r in read.collect()}
    assert found == {"a.json": "ok", "b.json": "ok", "c.json": "ok", "d.json": "invalid_json", "e.json": "invalid_json"}
    rows = labelme.objects(read).where(F.col("path").endswith("a.json")).orderBy("ordinal").collect()
    assert [r["class_id"] for r in rows] == [0, -1]
    assert [tuple(p) for p in rows[0]["polygon"]] == [(0.0, 3.0), (16.0, 3.0), (8.0, 30.0)]
    assert tuple(rows[1]["box"]) == (0.0, 0.0, 0.0, 0.0)
    signs = {r["path"].rsplit("/", 1)[1]: r["signature"] for r in labelme.signature(read).collect()}
    assert signs["b.json"] == signs["c.json"] != signs["a.json"]
    formats = {r["path"].rsplit("/", 1)[1]: r["format"] for r in files.with_format(files.texts(spark, str(tmp_path), "*.json")).collect()}
    assert formats["a.json"] == "labelme" and formats["e.json"] == "unknown"


@pytest.mark.parametrize("text,want", [("0 .1 .1 .1 .1\n", "yolo_box"), ("0 .1 .1 .1 .1 .2 .2\n", "yolo_polygon"), ("0 .1 .1 .1 .1\n0 .1 .1 .1 .1 .2 .2", "mixed"), ("\n \n", "empty"), ("1 2 3", "unknown")])
def test_format_of_text(spark, text, want):
    assert files.with_format(spark.createDataFrame([("a.txt", text)], "path string, text string")).first()["format"] == want


def test_texts_are_whole_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/a.txt").write_text("0 1\n1 2\n")
    assert [r["text"] for r in files.texts(spark, str(tmp_path), "*.txt").collect()] == ["0 1\n1 2\n"]


def test_coco_round_trip(spark, tmp_path):
    ring = [(1.0, 1.0), (12.0, 1.0), (12.0, 12.0), (1.0, 12.0)]
    manifest = spark.createDataFrame([("i1", "train", "x/I1.png", 16, 16), ("i2", "train", "x/i2.png", 16, 16), ("i3", "val", "x/i3.png", 16, 16)], "image_id string, split string, file_name string, width int, height int")
    objects = spark.createDataFrame([("i1", 0, 0, ring), ("i3", 0, 1, ring), ("i3", 1, 1, ring[:2])], "image_id string, ordinal int, class_id int, polygon array<struct<x:double,y:double>>")
    docs, issues = coco.export(manifest, objects)
    assert [tuple(r) for r in issues.collect()] == [("val", "i3", 1, "under three vertices")]
    text = {r["split"]: json.loads(r["json"]) for r in docs.collect()}
    assert [i["id"] for i in text["train"]["images"]] == [1, 2]
    note = text["val"]["annotations"][0]
    assert (note["id"], note["image_id"], note["category_id"], note["area"], note["bbox"]) == (1, 1, 2, 121.0, [1.0, 1.0, 11.0, 11.0])
    (tmp_path / "t.json").write_text(json.dumps(text["train"]))
    back = coco.read(spark, str(tmp_path / "t.json"))
    there = coco.objects(back, spark.createDataFrame([("/img/i1.PNG",), ("/img/i2.png",), ("/img/i9.png",)], "path string")).orderBy("path").collect()
    assert [len(r["objects"]) for r in there] == [1, 0] and coco.unknown_images(back).count() == 0
    assert [tuple(p) for p in there[0]["objects"][0]["polygon"]] == ring


def test_delimited(spark, tmp_path):
    (tmp_path / "d.csv").write_text('﻿review_id;notes\nR1;"two\nlines"\nR2;x,y\n', encoding="utf-8")
    rows = tables.read_delimited(spark, str(tmp_path / "d.csv"), ["review_id"]).orderBy("review_id").collect()
    assert [tuple(r) for r in rows] == [("R1", "two\nlines"), ("R2", "x,y")]
    with pytest.raises(ValueError, match="lacks columns"):
        tables.read_delimited(spark, str(tmp_path / "d.csv"), ["human_decision"])
    (tmp_path / "e.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):  # noqa: B017  a ragged row
        tables.read_delimited(spark, str(tmp_path / "e.csv")).collect()


def test_scan_and_sinks(spark, tmp_path):
    (tmp_path / "in/x").mkdir(parents=True)
    (tmp_path / "in/x/A.PNG").write_bytes(b"1")
    (tmp_path / "in/b.jpg").write_bytes(b"1")
    (tmp_path / "in/b.txt").write_bytes(b"1")
    rows = files.scan(spark, str(tmp_path / "in")).collect()
    assert sorted(r["stem"] for r in rows) == ["A", "b"] and len({r["content_sha256"] for r in rows}) == 1
    df = spark.range(3)
    assert [tables.write_once(df, str(tmp_path / "o"), ["id"]) for _ in range(2)] == ["written", "same"]
    with pytest.raises(ValueError, match="other rows"):
        tables.write_once(spark.range(4), str(tmp_path / "o"), ["id"])
    with pytest.raises(ValueError, match="JSON"):
        tables.write_json(spark.sql("SELECT double('nan') v"), str(tmp_path / "j"))
    for _ in range(2):
        tables.append_results(spark.sql("SELECT 'm' model, 1 surplus"), str(tmp_path / "log"), ["model", "split"])
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [("m", None)] * 2


def test_delimited_with_a_mark_is_read_back(spark, tmp_path):
    rows = [("R1", "čau; \"x\"", "a\nb"), ("R2", "", "n")]
    df = spark.createDataFrame(rows, "review_id string, notes string, more string")
    path = str(tmp_path / "answers")
    tables.write_delimited(df, path, ";", mark=True)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "answers").glob("part-*"))
    assert raw.startswith("\ufeffreview_id;notes;more\n".encode())
    back = tables.read_delimited(spark, path, ["review_id", "notes"])
    assert back.columns == ["review_id", "notes", "more"]
    assert sorted((r["review_id"], r["notes"] or "", r["more"]) for r in back.collect()) == rows
    with pytest.raises(Exception, match="already exists"):
        tables.write_delimited(df, path)
    tables.write_delimited(df.limit(1), path, replace=True)
    assert tables.read_delimited(spark, path).count() == 1
