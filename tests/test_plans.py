"""Annotation plans, reconciliation, random order, patience, and ranks without the optimiser's help."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from terrace.operators import annotation_plan as P
from terrace.operators import evaluation, improvement, reconcile, splits

SHAPE = "annotation string, annotation_sha256 string, content_sha256 string, shape_index int, label string, polygon array<struct<x:double,y:double>>, width int, height int"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ring(*points):
    return [(float(x), float(y)) for x, y in points]


SQUARE = ring((1, 1), (12, 1), (12, 12), (1, 12))
DOUBLE = ring((1, 1), (12, 1), (12, 1), (12, 12), (1, 12))
NEAR = ring((2, 2), (10, 2), (10.000000001, 2), (10, 10), (2, 10))
BOW = ring((1, 1), (12, 10), (1, 12), (10, 1))


def plan(spark, shapes, catalog, answers, copies=(), copied=(), sizes=(("c1", 16, 16),)):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return P.planned(
        frame(shapes, SHAPE), frame(catalog, "review_id string, annotation string, shape_index int, severity string, review_status string"),
        frame(answers, "review_id string, human_decision string, selected_annotation string"),
        frame(copies, "copy string, copy_sha256 string, original_annotation string, original_annotation_sha256 string, fixed_annotation_sha256 string, content_sha256 string"),
        frame(copied, "copy string, shape_index int, label string, polygon array<struct<x:double,y:double>>, width int, height int"),
        frame(sizes, "content_sha256 string, image_width int, image_height int"),
    )


def shape(i, polygon, annotation="a", label="Tree", size=16):
    return (annotation, "d" + annotation, "c1", i, label, polygon, size, size)


def test_repairs_in_order_with_places_of_the_source(spark):
    turned = ring((1, 1), (1, 1), (12, 10), (1, 12), (10, 1))
    got = plan(
        spark, [shape(1, DOUBLE), shape(2, NEAR), shape(3, BOW), shape(4, BOW), shape(5, SQUARE), shape(6, turned)],
        [("G1", "a", 1, "", P.REPAIRED), ("G2", "a", 2, "", P.REPAIRED), ("G3", "a", 3, "MINOR", "UNRESOLVED"), ("G4", "a", 4, "MINOR", "UNRESOLVED"), ("G6", "a", 6, "MINOR", "UNRESOLVED")],
        [("G3", "AUTO_FIX_APPROVED", ""), ("G4", "KEEP_AS_IS", None), ("G6", "AUTO_FIX_APPROVED", "")],
    )
    rows = {r["shape_index"]: r for r in got.shapes.collect()}
    assert rows[1]["places"] == [0, 1, 3, 4] and rows[2]["places"] == [0, 1, 3, 4] and rows[5]["places"] == [0, 1, 2, 3]
    assert [tuple(p) for p in rows[1]["polygon"]] == SQUARE
    events = sorted(map(tuple, got.events.select("shape_index", "step", "repair_type", "review_id", "before", "after", "places").collect()))
    assert events[:2] == [(1, 2, "RAW_CONSECUTIVE_DUPLICATE", None, 5, 4, [2]), (2, 4, "EXPORT_ROUNDING_CONSECUTIVE_DUPLICATE", None, 5, 4, [2])]
    assert events[2][:6] == (3, 3, P.UNCROSSED, "G3", 4, 4)
    # the ring's vertices are those of the source at the places that go with them
    assert [BOW[i] for i in rows[3]["places"]] == [tuple(p) for p in rows[3]["polygon"]] and sorted(rows[3]["places"]) == [0, 1, 2, 3]
    assert rows[4]["exception"] and not rows[3]["exception"]
    assert {(r["shape_index"], r["problem"]) for r in got.problems.collect()} == {(6, "turning vertices round doesn't give a simple ring")}


def test_a_manual_copy_comes_first(spark):
    good = ("Ca", "dC", "a", "da", "dC", "c1")
    stale = [("Cb", "changed", "b", "db", "dC", "c1"), ("Cc", "dC", "a", "dc", "dC", "c1"), ("Cd", "dC", "d", "old", "dC", "c1"), ("Ce", "dC", "e", "de", "dC", "c2")]
    names = "abcdef"  # the copy of f doesn't exist
    shapes = [shape(i, p, annotation=n) for n in names for i, p in ((1, BOW), (2, DOUBLE))]
    catalog = [row for n in names for row in ((f"G1{n}", n, 1, "MINOR", "UNRESOLVED"), (f"G2{n}", n, 2, "", P.REPAIRED))]
    got = plan(spark, shapes, catalog, [(f"G1{n}", "MANUAL_FIX", f"C{n}") for n in names], [good, *stale], [(f"C{n}", 1, "Tree", SQUARE, 16, 16) for n in names])
    told = {r["annotation"]: r["problem"] for r in got.problems.collect() if r["shape_index"] is None}
    assert told == {n: "the copy's record doesn't hold" for n in "bcde"} | {"f": "no such copy"}
    assert [(r["annotation"], r["shape_index"], r["places"], [e["repair_type"] for e in r["events"]]) for r in got.usable.collect()] == [("a", 1, None, [P.MANUAL])]


def test_copies_must_be_named_and_agree(spark):
    rows = [shape(1, BOW), shape(2, BOW)]
    catalog = [("G1", "a", 1, "MINOR", "UNRESOLVED"), ("G2", "a", 2, "MINOR", "UNRESOLVED")]
    copies = [(c, "d" + c, "a", "da", "d" + c, "c1") for c in ("C", "D")]
    for answers, problem in ([("G1", "MANUAL_FIX", "C"), ("G2", "MANUAL_FIX", "D")], "rows name different copies"), ([("G1", "MANUAL_FIX", " ")], "no copy is named"):
        told = {r["problem"] for r in plan(spark, rows, catalog, answers, copies).problems.collect()}
        assert problem in told


def test_what_no_answer_settles_is_a_problem(spark):
    got = plan(spark, [shape(1, BOW), shape(2, SQUARE, label="shrub"), shape(3, SQUARE, size=20), shape(4, DOUBLE), shape(5, BOW), shape(6, [])], [("G5", "a", 5, "AMBIGUOUS", "UNRESOLVED")], [("G5", "AUTO_FIX_APPROVED", "")])
    assert {(r["shape_index"], r["problem"]) for r in got.problems.collect()} == {(1, "edges cross"), (2, "label isn't known"), (3, "size isn't the image's"), (4, "vertex used twice"), (5, "only slight crossings are undone"), (6, "under three vertices")}


def sides(spark, *breaks):
    """An image with two objects for each of ``breaks``, on four sides that agree; a break changes its image's rows."""
    flat = [v for p in SQUARE for v in p]
    data = {n: [] for n in ("manifest", "images", "annotations", "labels")}
    for k, break_ in enumerate(breaks, 1):
        own = {
            "manifest": [("train", f"i{k}", f"h{k}", 16, 16, 2)], "images": [("train", f"i{k}", 16, 16, f"h{k}")],
            "annotations": [("train", f"i{k}", 10 * k + o, o, [flat], [1.0, 1.0, 11.0, 11.0], 121.0) for o in (1, 2)], "labels": [("train", f"i{k}", o, o - 1, SQUARE, None) for o in (1, 2)],
        }
        if break_:
            break_(own)
        for n, rows in own.items():
            data[n] += rows
    schemas = {
        "manifest": "split string, image_id string, content_sha256 string, width int, height int, total long", "images": "split string, image_id string, width int, height int, file_sha256 string",
        "annotations": "split string, image_id string, id long, category_id int, segmentation array<array<double>>, bbox array<double>, area double",
        "labels": "split string, image_id string, ordinal long, class_id int, polygon array<struct<x:double,y:double>>, error string",
    }
    return [spark.createDataFrame(data[n], schemas[n]) for n in schemas]


def changed(side, at, cell, value):
    def run(data):
        row = list(data[side][at])
        row[cell] = value(row[cell]) if callable(value) else value
        data[side][at] = tuple(row)

    return run


BREAKS = [
    (None, set()),
    (changed("manifest", 0, 5, 3), {(None, "manifest", "number of objects")}),
    (lambda d: d["manifest"].pop(0), {(None, "manifest", "image isn't in it")}),
    (lambda d: d["images"].pop(0), {(None, "images", "image isn't listed")}),
    (changed("images", 0, 4, "other"), {(None, "images", "content differs")}),
    (changed("images", 0, 4, None), {(None, "images", "content differs")}),
    (changed("images", 0, 2, 17), {(None, "images", "size differs")}),
    (lambda d: d["images"].append(d["images"][0]), {(None, "images", "image stands twice")}),
    (changed("annotations", 0, 6, 120.0), {(1, "annotations", "box or area isn't its ring's")}),
    (changed("annotations", 0, 3, 3), {(1, "annotations", "category isn't known")}),
    (changed("annotations", 0, 3, 2), {(1, "annotations, labels", "class differs")}),
    (changed("annotations", 1, 2, lambda i: i - 1), {(None, "annotations", "id is used twice")}),
    (lambda d: d["annotations"].pop(1), {(2, "annotations", "annotation is missing"), (None, "annotations", "number of objects")}),
    (lambda d: d["labels"].pop(1), {(2, "labels", "line is missing"), (None, "labels", "number of objects")}),
    (changed("labels", 0, 4, BOW), {(1, "labels", "edges cross")}),
    (changed("labels", 0, 4, SQUARE[::-1]), {(1, "annotations, labels", "ring differs")}),
    (changed("labels", 0, 5, "line 1: neither"), {(1, "labels", "line 1: neither")}),
]


def test_each_side_broken_once(spark):
    rows = reconcile.findings(*sides(spark, *(b for b, _ in BREAKS))).collect()
    for k, (_, want) in enumerate(BREAKS, 1):
        got = [(r["ordinal"], r["side"], r["problem"]) for r in rows if r["image_id"] == f"i{k}"]
        assert set(got) == want and len(got) == len(want), k


def test_exceptions_may_cross_themselves(spark):
    flat = [v for p in BOW for v in p]
    area, box = 0.5, [1.0, 1.0, 11.0, 11.0]

    def cross(data):
        changed("labels", 0, 4, BOW)(data)
        changed("annotations", 0, 4, [flat])(data)
        changed("annotations", 0, 5, box)(data)
        changed("annotations", 0, 6, area)(data)

    shoelace = abs(sum(BOW[i][0] * BOW[(i + 1) % 4][1] - BOW[(i + 1) % 4][0] * BOW[i][1] for i in range(4))) / 2
    area = shoelace
    excepted = spark.createDataFrame([("train", "i1", 1)], "split string, image_id string, ordinal long")
    assert reconcile.findings(*sides(spark, cross), excepted).count() == 0
    assert [r["problem"] for r in reconcile.findings(*sides(spark, cross)).collect()] == ["edges cross"]


@pytest.mark.parametrize("n", [1, 3, 17, 1000])
def test_random_order_is_a_bijection(spark, n):
    rows = spark.range(n).select(F.col("id").alias("k"))
    got = {r["k"]: r["place"] for r in splits.shuffled(rows.repartition(3), "k").collect()}
    assert sorted(got.values()) == list(range(n))
    if n == 1000:
        assert got == {r["k"]: r["place"] for r in splits.shuffled(rows.coalesce(1), "k").collect()}
        other = {r["k"]: r["place"] for r in splits.shuffled(rows, "k", seed=7).collect()}
        assert sum(got[k] == other[k] for k in got) < 20 and sum(got[k] == k for k in got) < 20
        ups = sum(got[k] < got[k + 1] for k in range(n - 1))
        assert 430 < ups < 570


def test_random_split_has_exact_shares_and_keeps_what_is_frozen(spark):
    rows = spark.range(203).select(F.col("id").alias("k"), F.lit("x").alias("place"))
    first = splits.randomised(rows, "k")
    assert {r["split"]: r["count"] for r in first.groupBy("split").count().collect()} == {"train": 142, "val": 30, "test": 31}
    old = {r["k"]: r["split"] for r in first.collect()}
    more = spark.range(303).select(F.col("id").alias("k"))
    new = {r["k"]: r["split"] for r in splits.randomised(more, "k", frozen=first.select("k", "split")).collect()}
    assert len(new) == 303 and all(new[k] == s for k, s in old.items())
    assert sorted([s for k, s in new.items() if k not in old]).count("train") == 70


def plain_patience(values, patience):
    best, last, stopped, out = None, 0, False, []
    for place, v in enumerate(values, 1):
        better = v is not None and (best is None or v > best)
        if better:
            best, last = v, place
        stopped = stopped or place - last >= patience
        out.append((best, better, place - last, stopped))
    return out


def test_patience_equals_a_plain_loop_over_any_ranges(spark):
    draw = random.Random(3)
    runs = {"long": [draw.choice([None, *range(200)]) for _ in range(400)], "short": [5], "none": [None, None, None], "rise": list(range(60)), "flat": [1.0] * 40}
    df = spark.createDataFrame([(k, i, None if v is None else float(v)) for k, run in runs.items() for i, v in enumerate(run)], "k string, step int, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 17)
    try:
        for patience in (1, 30):
            rows = improvement.best_so_far(df.repartition(5), "k", "step", "v", patience).collect()
            got = {k: [(r["best"], r["improved"], r["since"], r["stopped"]) for r in sorted((r for r in rows if r["k"] == k), key=lambda r: r["step"])] for k in runs}
            assert got == {k: plain_patience(run, patience) for k, run in runs.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ranks_and_curves_hold_without_exchange_reuse(spark, reuse):
    rows = spark.range(0, 300_000, 1, 12).select(F.xxhash64("id").alias("a"), F.col("id").alias("b"))
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        ranked = splits.ranked(rows, "a", "b")
        assert ranked.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn")).first()[:] == (300_000, 1, 300_000)
        scored = rows.select(F.lit(1).alias("c"), (F.col("a") % 1_000_000_007).cast("double").alias("score"), F.col("b").alias("det_id"), (F.col("b") % 6 == 0).alias("hit"))
        last = evaluation.curve(scored, ["c"], spark.createDataFrame([(1, 50_000)], "c int, n long")).agg(F.max("tp"), F.max("seen"), F.count_distinct("seen")).first()
        assert last[:] == (50_000, 300_000, 300_000)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession, functions as F
from terrace.functions.arrow import round8, round8_all
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.range(1).select(round8(F.lit(0.1234567891)).alias("v")).first()["v"] == 0.12345679
assert spark.range(1).select(round8_all(F.array(F.lit(0.1234567891))).alias("v")).first()["v"] == [0.12345679]
print("sent")
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "sent" in out.stdout, out.stderr[-2000:]
