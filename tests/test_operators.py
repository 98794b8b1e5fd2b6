"""Operators on small tables: each rule once, and each thing that must be refused."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrace.sources.versions import Store
from terrace.schema import SHARES
from terrace.operators import archive, audit, decisions, evaluation, matching, results, rules, splits
from terrace.plans import build

ASSET = "content_sha256 string, scan_ord long, annotator string, has_path boolean, signature string"


def test_conflicts_and_canonicals(spark):
    rows = [("a", 1, "x", True, "s"), ("a", 2, "y", True, "s"), ("b", 3, "x", True, "s"), ("b", 4, "y", True, "t"), ("c", 5, "x", True, None), ("c", 6, "y", True, "s"), ("d", 7, "x", False, None), ("d", 8, "y", True, "s"), ("e", 9, "x", True, "s")]
    got = {r["scan_ord"]: (r["status"], r["canonical"]) for r in audit.dispositions(spark.createDataFrame(rows, ASSET)).collect()}
    assert got[1] == ("included", None) and got[2] == ("duplicate", 1)
    assert got[3][0] == got[4][0] == "conflict" and got[6][0] == "conflict" and got[5][0] == "excluded"
    assert got[7][0] == "excluded" and got[8][0] == "included" and got[9][0] == "included"
    assert not audit.gate(spark.createDataFrame(rows, ASSET)).first()["safe_to_build"]


REQUIRED = "review_id string, issue_type string, content_sha256 string, annotation_a string, annotation_b string"
ANSWER = "review_id string, issue_type string, content_sha256 string, human_decision string, selected_annotation string"
BASE = {"review_id": "R1", "issue_type": "ANNOTATION_CONFLICT", "content_sha256": "c1", "human_decision": "KEEP_A", "selected_annotation": ""}


def status_of(spark, answers, required=None, **more):
    required = required or [("R1", "ANNOTATION_CONFLICT", "c1", "a.json", "b.json")]
    df = spark.createDataFrame([tuple(a.values()) for a in answers], ANSWER)
    return decisions.row_status(spark.createDataFrame(required, REQUIRED), df, **more)


@pytest.mark.parametrize(
    "change,status,error",
    [
        ({}, "COMPLETE", ""), ({"human_decision": " "}, "PENDING", ""), ({"human_decision": None}, "PENDING", ""), ({"human_decision": "KEEP_AS_IS"}, "INVALID", "not offered"), ({"content_sha256": "c2"}, "INVALID", "another case"),
        ({"issue_type": "GEOMETRY"}, "INVALID", "another case"), ({"selected_annotation": "b.json"}, "INVALID", "other side"), ({"human_decision": "EXCLUDE", "selected_annotation": "a.json"}, "INVALID", "without use"),
    ],
)
def test_one_broken_field(spark, change, status, error):
    r = status_of(spark, [BASE | change]).first()
    assert r["status"] == status and error in r["errors"]


def test_missing_duplicate_unknown_and_strict(spark):
    rows = {r["review_id"]: r for r in status_of(spark, [BASE | {"review_id": "R9"}]).collect()}
    assert rows["R1"]["status"] == "PENDING" and rows["UNKNOWN:R9"]["status"] == "INVALID"
    assert status_of(spark, [BASE, BASE]).first()["status"] == "INVALID"
    geometry = [("R1", "GEOMETRY", "c1", "a.json", None)]
    answer = [BASE | {"issue_type": "GEOMETRY", "human_decision": "KEEP_AS_IS"}]
    assert status_of(spark, answer, geometry).first()["status"] == "COMPLETE"
    assert status_of(spark, answer, geometry, strict=True).first()["status"] == "INVALID"
    told = spark.createDataFrame([("source changed",)], "problem string")
    assert status_of(spark, [BASE], problems=told).first()["status"] == "INVALID"


def test_content_plan(spark):
    required = [("R1", "ANNOTATION_CONFLICT", "c1", "a", "b"), ("R2", "ANNOTATION_CONFLICT", "c1", "a", "b"), ("R3", "GEOMETRY", "c2", "a", None), ("R4", "ANNOTATION_CONFLICT", "c2", "a", "b"), ("R5", "GEOMETRY", "c3", "a", None)]
    answers = [BASE, BASE | {"review_id": "R2", "human_decision": "KEEP_B"}, BASE | {"review_id": "R3", "issue_type": "GEOMETRY", "content_sha256": "c2", "human_decision": "EXCLUDE"}, BASE | {"review_id": "R4", "content_sha256": "c2"}]
    status = status_of(spark, answers, required)
    assert {r["content_sha256"]: r["plan"] for r in decisions.content_plan(status).collect()} == {"c1": "INVALID", "c2": "EXCLUDE", "c3": "INCOMPLETE"}
    done = {r["review_id"]: r["status"] for r in decisions.resolved(status).collect()}
    assert done["R1"] == done["R2"] == "INVALID" and done["R4"] == "COMPLETE" and done["R5"] == "PENDING"
    left = decisions.unresolved(status, spark.createDataFrame([("R5",)], "review_id string"))
    assert sorted(r["review_id"] for r in left.collect()) == ["R1", "R2", "R4"]


def test_splits(spark):
    rows = spark.createDataFrame([(f"k{i:03d}", f"g{i % 17}") for i in range(100)], "key string, g string")
    n = {r["split"]: r["count"] for r in splits.contiguous(rows, "key", "key").groupBy("split").count().collect()}
    assert n == {"train": 70, "val": 15, "test": 15}
    grouped = splits.grouped(rows, "g")
    assert splits.leakage(grouped, "g").count() == 0 and grouped.count() == 100
    assert sorted(map(tuple, grouped.collect())) == sorted(map(tuple, splits.grouped(rows.orderBy(F.rand()), "g").collect()))
    assert splits.hashed(rows, "key").where("split = 'train'").count() > 50
    assert splits.sample(rows, "key", 5).count() == 5
    with pytest.raises(ValueError):
        splits.grouped(rows.where("g < 'g1'"), "g")


def test_groups_go_where_most_is_lacking(spark):
    """Numbers of groups of each size in each split against one group at a time; sizes with very many groups too."""
    rng = random.Random(4)
    for case in range(12):
        sizes = [rng.choice([1, 1, 2, 3, 7, 40, 1000]) for _ in range(rng.choice([3, 4, 9, 60, 900]))]
        total, left = sum(sizes), len(sizes)
        have, want = [0] * 3, {}
        for n in sorted(sizes, reverse=True):
            bare = [i for i in range(3) if not have[i]]
            best = min(bare if left == len(bare) else range(3), key=lambda i: (have[i] + n - SHARES[i] * total) ** 2 - (have[i] - SHARES[i] * total) ** 2)
            have[best] += n
            left -= 1
            want.setdefault(n, [0] * 3)[best] += 1
        room, used, left, got = [s * total for s in SHARES], [False] * 3, len(sizes), {}
        for n in sorted(set(sizes), reverse=True):
            got[n] = splits._shares_of(n, sizes.count(n), left, room, used)
            room = [r - n * k for r, k in zip(room, got[n])]
            used = [u or k > 0 for u, k in zip(used, got[n])]
            left -= sizes.count(n)
        assert all(n * abs(a - b) <= n for n in got for a, b in zip(got[n], want[n])), (case, got, want)
        assert all(used) and [sum(got[n]) for n in got] == [sizes.count(n) for n in got]
    many = splits._shares_of(1, 10_000_000, 10_000_000, [7e6, 1.5e6, 1.5e6], [False] * 3)
    assert many == [7_000_000, 1_500_000, 1_500_000]


def test_matching(spark):
    a, b = spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string")
    assert {r["k"]: r["status"] for r in matching.match(a, b, "k").collect()} == {"a": "missing_annotation", "b": "matched", "c": "orphan_annotation"}
    one = matching.same_sets(a, b).first()
    assert (one["only_left"], one["only_right"], one["equal"]) == (1, 1, False)
    folder = "folder string, stem string, path string"
    got = matching.match_in_folders(spark.createDataFrame([("f", "a", "1"), ("f", "a", "2"), ("g", "a", "3")], folder), spark.createDataFrame([("f", "a", "4"), ("g", "a", "5"), ("g", "z", "6")], folder))
    assert {(r["folder"], r["stem"]): r["status"] for r in got.collect()} == {("f", "a"): "ambiguous", ("g", "a"): "matched", ("g", "z"): "orphan_annotation"}


def plain_ap(hits, positives):
    tp, best = 0, []
    for i, h in enumerate(hits, 1):
        tp += h
        best.append((tp / positives, tp / i))
    return sum(max([p for r, p in best if r >= k * 0.01], default=0.0) for k in range(101)) / 101


def test_average_precision_equals_a_plain_loop(spark):
    rng = random.Random(2)
    data, want = [], {}
    for c in range(20):
        hits = [rng.random() < 0.5 for _ in range(rng.randint(0, 15))]
        positives = sum(hits) + rng.randint(0, 4) or 1
        want[c] = (positives, plain_ap(hits, positives))
        data += [(c, 1.0 - i / 100, i, h) for i, h in enumerate(hits)]
    scored = spark.createDataFrame(data, "c int, score double, det_id int, hit boolean")
    positives = spark.createDataFrame([(c, n) for c, (n, _) in want.items()], "c int, n long")
    for r in evaluation.average_precision(scored, ["c"], positives).collect():
        assert math.isclose(r["ap"], want[r["c"]][1], abs_tol=1e-12)


def test_greedy_takes_the_best_free_truth(spark):
    kind = "vec_id long, image_id long, category_id int, score double, box struct<x1:double,y1:double,x2:double,y2:double>"
    truth = spark.createDataFrame([(1, 0, 1, None, (0.0, 0.0, 10.0, 10.0)), (2, 0, 1, None, (0.0, 0.0, 10.0, 8.0))], kind)
    found = spark.createDataFrame([(11, 0, 1, 0.9, (0.0, 0.0, 10.0, 10.0)), (12, 0, 1, 0.8, (0.0, 0.0, 10.0, 10.0)), (13, 0, 1, 0.7, (50.0, 50.0, 60.0, 60.0)), (14, 0, 2, 0.7, (0.0, 0.0, 10.0, 10.0))], kind)
    got = {(r["threshold"], r["det_id"]): r["truth_id"] for r in evaluation.greedy_matches(found, truth, [0.5, 0.95]).collect()}
    assert (got[0.5, 11], got[0.5, 12], got[0.5, 13], got[0.5, 14]) == (1, 2, None, None) and got[0.95, 12] is None
    s = {r["category_id"]: r for r in evaluation.summary(found, truth).collect()}
    assert s[1]["ap50"] == pytest.approx(1.0) and s[None]["ap50"] == pytest.approx(1.0)
    empty = evaluation.summary(found.where("false"), truth).where("category_id = 1").first()
    assert empty["ap"] == 0.0 and empty["ar100"] == 0.0


def test_of_equal_overlaps_the_last_truth_is_taken(spark):
    kind = "vec_id long, image_id long, category_id int, score double, box struct<x1:double,y1:double,x2:double,y2:double>"
    box = (0.0, 0.0, 10.0, 10.0)
    truth = spark.createDataFrame([(1, 0, 1, None, box), (2, 0, 1, None, box)], kind)
    found = spark.createDataFrame([(11, 0, 1, 0.9, box), (12, 0, 1, 0.9, box), (13, 0, 1, 0.9, box)], kind)
    got = {r["det_id"]: (r["rank"], r["truth_id"]) for r in evaluation.greedy_matches(found, truth, [0.5]).collect()}
    assert got == {11: (1, 2), 12: (2, 1), 13: (3, None)}


def test_masks_subset_and_categories_without_truth(spark):
    """A perfect mask, none, an image left out, and a category without truth: 1, 0, unseen and null."""
    kind = "vec_id long, image_id long, category_id int, score double, mask array<bigint>"
    whole = [0, 1024]
    truth = spark.createDataFrame([(1, 1, 1, None, whole)], kind)
    found = spark.createDataFrame([(11, 1, 1, 0.9, whole), (12, 2, 1, 0.95, whole)], kind)
    classes = spark.createDataFrame([(1,), (2,)], "category_id int")
    image = spark.createDataFrame([(1,)], "image_id long")
    rows = {r["category_id"]: r.asDict() for r in evaluation.summary(found, truth, "mask", classes, image).collect()}
    assert all(rows[1][c] == pytest.approx(1.0) for c in ("ap", "ap50", "ap75", "ar1", "ar10", "ar100"))
    assert all(rows[2][c] is None for c in ("ap", "ap50", "ar100")) and rows[None]["ap50"] == pytest.approx(1.0)
    both = {r["category_id"]: r["ap50"] for r in evaluation.summary(found, truth, "mask", classes).collect()}
    assert both[1] == pytest.approx(0.5)  # the better-scored one stands on an image without truth
    none = {r["category_id"]: r.asDict() for r in evaluation.summary(found.where("false"), truth, "mask", classes, image).collect()}
    assert none[1]["ap50"] == none[1]["ar100"] == 0.0 and none[None]["ap"] == 0.0 and none[2]["ap"] is None
    assert evaluation.summary(found, truth.where("false"), "mask", classes).where("category_id IS NULL").first()["ap"] is None


def test_curve_over_many_ranges_equals_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2]), rng.choice([0.1, 0.5, 0.5, 0.9]), i, rng.random() < 0.4) for i in range(3000)]
    positives = spark.createDataFrame([(1, 5000), (2, 700)], "c int, n long")
    got = {r["det_id"]: (r["tp"], r["seen"]) for r in evaluation.curve(spark.createDataFrame(rows, "c int, score double, det_id int, hit boolean").repartition(7), ["c"], positives).collect()}
    want, counts = {}, {1: [0, 0], 2: [0, 0]}
    for c, _, i, hit in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        counts[c][0] += hit
        counts[c][1] += 1
        want[i] = tuple(counts[c])
    assert got == want


def test_fingerprint_is_free_of_order(spark):
    df = spark.createDataFrame([("b", "train", None), ("a", "val", "1")], "image_id string, split string, note string")
    one, two = (results.fingerprint(d, "image_id").first()[0] for d in (df, df.select("note", "split", "image_id").orderBy("image_id")))
    assert one == two != results.fingerprint(df.fillna("x"), "image_id").first()[0]
    assert results.digest_tree(df, "image_id").first()[0] == results.digest_tree(df.orderBy("image_id"), "image_id").first()[0]


def test_rules_and_checks(spark):
    found = rules.checks({"a": spark.range(0), "b": spark.range(2)})
    assert {r["check"]: r["ok"] for r in found.collect()} == {"a": True, "b": False}
    with pytest.raises(ValueError, match="b \\(2\\)"):
        rules.require(found)
    names = spark.createDataFrame([("x",), ("x",), ("y",)], "key string")
    none = names.limit(0)
    assert [tuple(r) for r in rules.file_issues(none, names.where("key = 'y'"), none, names).orderBy("key").collect()] == [("x", "ERROR_DUPLICATE_FILENAME"), ("y", "ERROR_MISSING_ANNOTATION")]


def test_archive_latest_wins(spark):
    points = [[10.0, 10.0], [50.0, 10.0], [50.0, 60.0]]

    def note(i, at, cancelled, shapes):
        return (str(i), at, None, cancelled, [("polygonlabels", 200, 100, (points, ["tree"]))] * shapes)

    url = "http://h/data/?d=classroom_runs/r/images/a%20b.jpg"
    tasks = spark.createDataFrame([(1, (url,), [note(1, "2024-01-02T00:00:00Z", False, 1), note(2, "2024-01-03T00:00:00Z", True, 2), note(3, "2024-01-02T00:00:00Z", False, 0)]), (1, ("http://h/x/../c.jpg",), []), (2, ("http://h/x/c.jpg",), [])], archive.TASKS)
    latest = {(r["project"], r["filename"]): r for r in archive.latest_annotations(tasks).collect()}
    assert latest[1, "a b.jpg"]["annotation"]["id"] == "3" and not latest[2, "c.jpg"]["submitted"] and (1, None) in latest
    one = spark.createDataFrame([(1, (url,), [note(1, "2024-01-02T00:00:00Z", False, 1)])], archive.TASKS)
    r = archive.shapes(archive.latest_annotations(one)).first()
    assert r["label"] == "tree" and [tuple(p) for p in r["polygon"]] == [(20.0, 10.0), (100.0, 10.0), (100.0, 60.0)]
    plan = spark.createDataFrame([("s001", ["a b.jpg", "q.jpg"]), ("zz", ["a b.jpg"])], "alias string, images array<string>")
    state = spark.createDataFrame([("s001", 1)], "alias string, project long")
    bad = {r["check"]: r["violations"] for r in rules.checks(archive.import_checks(plan, state, archive.latest_annotations(one))).collect()}
    assert bad == {"alias without project": 1, "project without alias": 0, "alias used twice": 0, "malformed alias": 1, "image assigned twice": 0, "assignment without task": 1, "task without assignment": 0}


def test_prediction_coverage(spark):
    expected = spark.createDataFrame([("a.jpg", "h", 4, 5), ("b.jpg", "i", 4, 5)], "filename string, image_sha256 string, width int, height int")
    got = spark.createDataFrame([("a.jpg", "x", 4, 5, [(0.5,), (1.5,)]), ("c.gif", "i", 4, 5, [])], "filename string, image_sha256 string, width int, height int, predictions array<struct<confidence:double>>")
    assert [r["violations"] for r in rules.checks(archive.prediction_checks(got, expected)).orderBy("check").collect()] == [1, 1, 1, 1, 1]


def test_build(spark, tmp_path):
    ring = [(1.0, 1.0), (12.0, 1.0), (12.0, 12.0), (1.0, 12.0)]
    rows = [(f"h{i:02d}", i, "x", True, "s", 16, 16, f"p{i // 2}") for i in range(20)] + [("h00", 50, "y", True, "t", 16, 16, "p0")]
    assets = spark.createDataFrame(rows, ASSET + ", width int, height int, parent string")
    objects = spark.createDataFrame([(i, 0, 0, [ring[0], *ring]) for i in range(20)], "image_key long, ordinal int, class_id int, polygon array<struct<x:double,y:double>>")
    first = build.prepare(assets, objects, "parent")
    with pytest.raises(ValueError, match="conflict left"):
        build.publish(first, str(tmp_path / "no"))
    required = spark.createDataFrame([("R1", "ANNOTATION_CONFLICT", "h00", "a", "b")], REQUIRED)
    with pytest.raises(ValueError, match="not complete"):
        build.reviewed(assets, objects, required, spark.createDataFrame([("R1", "ANNOTATION_CONFLICT", "h00", "", "")], ANSWER))
    done = build.reviewed(assets, objects, required, spark.createDataFrame([("R1", "ANNOTATION_CONFLICT", "h00", "KEEP_A", "")], ANSWER), parent="parent")
    build.publish(done, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/manifest")).count() == 20
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError, match="conflict left"):
        build.publish_version(first, store)
    assert store.current() is None
    build.publish_version(done, store, "v1")
    assert store.read("manifest").count() == 20 and store.read("fingerprint").first() == done.fingerprint.first()
    assert done.objects.select(F.size("polygon"), "repair.kind").distinct().collect() == [(4, "RAW_CONSECUTIVE_DUPLICATE")]
    assert done.fingerprint.first()[0] == build.prepare(assets, objects, "parent", decisions.content_plan(status_of(spark, [BASE | {"content_sha256": "h00"}], [("R1", "ANNOTATION_CONFLICT", "h00", "a", "b")]))).fingerprint.first()[0]
