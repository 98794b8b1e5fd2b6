"""Settings, descriptions, paths that must not be written to, and links."""

import json

import pytest
from pyspark.sql import functions as F

from terrace.functions import text as X
from terrace.operators import audit, splits
from terrace.sources import settings

WHOLE = {"input": {}, "dataset": {"seed": 1}, "classes": {"0": "tree", "1": 7}, "models": {}, "training": {}, "evaluation": {}}


def test_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps(WHOLE, indent=1), encoding="utf-8")
    found = settings.load(spark, str(tmp_path / "a.json"))
    assert found["classes"] == {0: "tree", 1: "7"} and found["dataset"] == {"seed": 1}
    assert "_path" in found and set(settings.public(found)) == set(WHOLE)
    (tmp_path / "b.json").write_text(json.dumps({k: v for k, v in WHOLE.items() if k != "models"}))
    with pytest.raises(ValueError, match="models"):
        settings.load(spark, str(tmp_path / "b.json"))


def test_description(spark, tmp_path):
    at = str(tmp_path / "d")
    settings.write_description(spark, at, "/data/of: mine", {0: "tree", 1: "TreeGroup"})
    text = spark.read.text(at, wholetext=True).first()[0]
    assert text.splitlines() == ['path: "/data/of: mine"', "train: train/images", "val: val/images", "test: test/images", "names:", '  0: "tree"', '  1: "TreeGroup"']
    with pytest.raises(Exception, match="(?i)exists"):
        settings.write_description(spark, at, "/other", {})


@pytest.mark.parametrize(
    "url,want",
    [("https://h", "https://h"), ("HTTP://h:80/a/", "HTTP://h:80/a"), ("http://h/?", "http://h"), ("http://u@h", None), ("http://u:p@h", None), ("http://", None), ("ftp://h", None), ("http://h?a", None), ("http://h#a", None), ("h", None), ("", None), (None, None)],
)
def test_http_base(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(X.http_base(F.col("u"))).first()[0] == want


def test_paths(spark):
    rows = [("/a/b/c", "/a/b", True), ("/a/b", "/a/b/", True), ("/a/bc", "/a/b", False), ("/a/b/../c", "/a/b", False), ("/a/./b//x", "/a/b", True), ("/../a", "/a", True), ("a\\b\\c", "a/b", True), ("/a", "/", True), (None, "/a", False)]
    df = spark.createDataFrame([(p, f, w) for p, f, w in rows], "p string, f string, w boolean")
    assert df.where(X.inside(F.col("p"), F.col("f")) != F.col("w")).count() == 0


def test_overlapping_equals_all_pairs(spark):
    outs = ["/a/b", "/a", "/c/d/e", "/x/../a/b", "/zz"]
    ins = ["/a/b/c", "/c", "/c/d/e", "/z", "/a"]
    path = lambda v: spark.createDataFrame([(x,) for x in v], "path string")
    got = {tuple(r) for r in settings.overlapping(path(outs), path(ins)).collect()}
    parts = lambda p: p.replace("/x/..", "").strip("/").split("/")
    want = {(o, i) for o in outs for i in ins if parts(o)[: len(parts(i))] == parts(i) or parts(i)[: len(parts(o))] == parts(o)}
    assert got == want


def test_reused_split_refuses_other_rows(spark):
    frozen = spark.createDataFrame([("a", "train"), ("b", "val")], "k string, split string")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert {(r["k"], r["split"]) for r in splits.reused(rows, "k", frozen).collect()} == {("a", "train"), ("b", "val")}
    with pytest.raises(ValueError, match="1 are new, 1 are gone"):
        splits.reused(rows.withColumn("k", F.when(F.col("k") == "b", "c").otherwise("a")), "k", frozen)


def test_class_counts_of_empty_images(spark):
    images = spark.createDataFrame([(1, "train"), (2, "train"), (3, "val")], "image_id int, split string")
    objects = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (9, 1)], "image_id int, class_id int")
    classes = spark.createDataFrame([(0, "tree"), (1, "TreeGroup")], "class_id int, class_name string")
    assert sorted(map(tuple, audit.class_counts(images, objects, classes).collect())) == [("train", "TreeGroup", 2, 1, 3), ("train", "tree", 2, 2, 3), ("val", "TreeGroup", 1, 0, 0), ("val", "tree", 1, 0, 0)]
