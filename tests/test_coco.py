"""COCO documents of any length: cut at every byte, written from sorted ranges, read back by ranges."""

import json

from pyspark.sql import functions as F

from terrace.sources import coco, coco_ranges
from terrace.sources.streamed import listing

DOC = {
    "info": {"a": {"b": "]}"}, "c": [[1]]},
    "images": [{"id": 1, "file_name": 'q"\\\\"[{é'}, {"id": 2, "file_name": "\\"}],
    'x"y': [[1, [2]], 3, "s{"],
    "annotations": [{"id": 5, "segmentation": [[1.0, 2.0]], "z": {"t": "}"}}],
    "categories": [],
}
WANTED = [("images", DOC["images"][0]), ("images", DOC["images"][1]), ('x\\"y', [1, [2]]), ("annotations", DOC["annotations"][0])]


def test_scanner_at_every_byte():
    raw = json.dumps(DOC, ensure_ascii=False, indent=1).encode()

    def begin(k):
        _, step, state = coco_ranges.brackets(raw[:k], coco_ranges.OUTSIDE)
        return state, int(step.sum())

    def cut(start, end):
        return list(coco_ranges.cut(lambda p: raw[p : p + 7], start, end, *begin(start)))

    whole = cut(0, len(raw))
    assert len(whole) == 6 and [json.loads(t) for _, t in whole][2:4] == DOC["images"]
    for k in range(len(raw) + 1):
        assert cut(0, k) + cut(k, len(raw)) == whole, k
        state, depth = begin(k)
        for m in range(k, len(raw) + 1):
            _, step, after = coco_ranges.brackets(raw[k:m], state)
            assert (after, depth + int(step.sum())) == begin(m)


def test_elements_of_any_range(spark, tmp_path):
    texts = {"a.json": "﻿" + json.dumps(DOC, ensure_ascii=False), "b.json": json.dumps(DOC)[:-1], "c.json": "", "d.json": "{}]", "e.json": "{}"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    files = listing(spark, str(tmp_path), ("json",))
    for size in (3, 17, 1 << 20):
        found, errors = coco_ranges.elements(files, size)
        rows = sorted((r for r in found.collect()), key=lambda r: r["at"])
        assert [(r["section"], json.loads(r["text"])) for r in rows] == WANTED
        assert {r["path"].rsplit("/", 1)[1]: r["error"] for r in errors.collect()} == {"b.json": "ends early", "c.json": "is empty", "d.json": "closes more than it opened"}


def test_written_documents_are_those_of_cells(spark, tmp_path):
    ring = "array(named_struct('x', 1D, 'y', 1D), named_struct('x', 12D, 'y', 1D), named_struct('x', 12D, 'y', 12D + id % 3))"
    ids = spark.range(300)
    manifest = ids.select(F.format_string("i%04d", "id").alias("image_id"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"), F.format_string("i%04d.png", "id").alias("file_name"), F.lit(16).alias("width"), F.lit(16).alias("height"))
    pushed = F.when(F.col("id") == 7, F.expr("array(named_struct('x', 1D, 'y', 1D))")).otherwise(F.expr(ring))
    objects = ids.where("id % 5 <> 0").select(F.format_string("i%04d", "id").alias("image_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"), (F.col("id") % 2).cast("int").alias("class_id"), pushed.alias("polygon"))
    docs, _ = coco.export(manifest, objects)
    want = {r["split"]: json.loads(r["json"]) for r in docs.collect()}
    written, issues = coco.write(manifest, objects, str(tmp_path / "out"))
    assert issues.count() == 2
    got = {r["split"]: r["path"] for r in written.collect()}
    assert set(got) == {"train", "val"}
    for split, path in got.items():
        assert json.load(open(path)) == want[split]
        assert [i["id"] for i in want[split]["images"]] == list(range(1, len(want[split]["images"]) + 1))
    found, errors = coco_ranges.elements(written, 500)
    assert errors.count() == 0
    marks = coco.shaped(coco.section(found, "annotations"))
    assert marks.where("error IS NULL AND size(polygon) = 3 AND box.x2 = 12").count() == marks.count() == sum(len(d["annotations"]) for d in want.values())
    assert coco.section(found, "images").count() == 300
    assert coco.category_errors(coco.section(found, "categories").distinct()).count() == 0


def test_elements_that_do_not_fit(spark):
    rows = spark.createDataFrame([("p", "images", 1, '{"id": 1, "width": 3}'), ("p", "images", 9, '{"id": "x"}'), ("p", "categories", 20, "{}")], "path string, section string, at long, text string")
    assert [(r["id"], r["error"]) for r in coco.section(rows, "images").orderBy("at").collect()] == [(1, None), (None, "not an element of images")]


def test_category_errors(spark):
    rows = spark.createDataFrame([(1, "Tree "), (2, "bush"), (7, "x")], "id int, name string")
    assert {(r["id"], r["error"]) for r in coco.category_errors(rows).collect()} == {(2, "other name"), (7, "unknown")}
    assert {(r["id"], r["error"]) for r in coco.category_errors(rows.limit(0)).collect()} == {(1, "missing"), (2, "missing")}
