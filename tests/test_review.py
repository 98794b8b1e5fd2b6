"""Review rows, repairs and plans on small tables."""

import json

import pytest

from terrace.operators import review

SHAPE = "annotation string, annotation_sha256 string, content_sha256 string, shape_index int, label string, polygon array<struct<x:double,y:double>>, width int, height int"


def ring(*points):
    return [(float(x), float(y)) for x, y in points]


SQUARE = ring((1, 1), (12, 1), (12, 12), (1, 12))
DOUBLE = ring((1, 1), (12, 1), (12, 1), (12, 12), (1, 12))
NEAR = ring((2, 2), (10, 2), (10.000000001, 2), (10, 10), (2, 10))
BOW = ring((1, 1), (12, 10), (1, 12), (10, 1))
CLOSED = ring((1, 1), (12, 1), (12, 12), (1, 12), (1, 1))


def shapes(spark, *rows):
    return spark.createDataFrame([(a, a + "d" * 20, c, i, "Tree", p, 16, 16) for a, c, i, p in rows], SHAPE)


def test_geometry_rows_of_three_representations(spark):
    df = shapes(spark, ("a", "c1", 1, SQUARE), ("a", "c1", 2, DOUBLE), ("a", "c1", 3, NEAR), ("a", "c1", 4, BOW), ("a", "c1", 5, CLOSED), ("a", "c1", 6, []))
    got = {r["shape_index"]: r for r in review.geometry_rows(df).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6] and got[2]["review_id"] == "G-a" + "d" * 15 + "-2"
    assert [got[i]["recommended"] for i in (2, 3, 4, 5, 6)] == ["SAFE_REMOVE_DUPLICATE_VERTEX"] * 2 + ["MANUAL_GEOMETRY_REPAIR", "LIKELY_VALID_CLOSING_VERTEX", "MANUAL_GEOMETRY_REPAIR"]
    assert (got[3]["raw"]["consecutive"], got[3]["normalized"]["consecutive"], got[3]["serialized"]["consecutive"]) == (0, 0, 1)
    assert got[4]["assessment"] == "complex/ambiguous" and got[2]["assessment"] == ""


def test_repairs_in_both_spaces(spark):
    df = shapes(spark, ("a", "c1", 1, DOUBLE), ("a", "c1", 2, NEAR), ("a", "c1", 3, SQUARE), ("a", "c1", 4, ring((0, 0), (10, 10), (10, 10), (0, 10), (10, 0))))
    digest = "a" + "d" * 20
    rows = [("G1", "a", digest, 1), ("G2", "a", digest, 2), ("G3", "a", digest, 3), ("G4", "a", digest, 4), ("G5", "a", "old", 1), ("G6", "z", digest, 1)]
    cases = spark.createDataFrame(rows, "review_id string, annotation string, annotation_sha256 string, shape_index int")
    events, problems = review.repair_events(df, cases)
    got = {r["review_id"]: r for r in events.collect()}
    assert sorted(got) == ["G1", "G2"]
    assert [(got[g]["repair_type"], got[g]["before"], got[g]["after"], got[g]["removed"]) for g in ("G1", "G2")] == [("RAW_CONSECUTIVE_DUPLICATE", 5, 4, [2]), ("EXPORT_ROUNDING_CONSECUTIVE_DUPLICATE", 5, 4, [2])]
    assert {r["review_id"]: r["problem"] for r in problems.collect()} == {"G3": "nothing to remove", "G4": "ring has another fault", "G5": "source has changed", "G6": "source is missing"}


def test_generated_points_round_the_binary_value(spark):
    df = shapes(spark, ("a", "c", 1, ring((16.5, -0.5), (1 / 3, 7.123456789), (30, 2))))
    got = [tuple(p) for p in review.generated(df).first()["generated"]]
    assert got == [(round(x / 16, 8) * 16, round(y / 16, 8) * 16) for x, y in [(16.0, 0.0), (1 / 3, 7.123456789), (30.0, 2.0)]]


@pytest.fixture(scope="module")
def overlapping(spark):
    members = spark.createDataFrame([("c1", 1, "a", "Ann"), ("c1", 2, "b", "Bo"), ("c1", 3, "e", "Bo"), ("c2", 1, "f", "Ann")], "content_sha256 string, place int, annotation string, annotator string")
    conflicts = review.conflict_rows(members, spark.createDataFrame([("c1",)], "content_sha256 string"), {"Ann and Bo": frozenset({"ann", "bo"})})
    df = shapes(spark, ("a", "c1", 1, BOW), ("b", "c1", 1, DOUBLE), ("e", "c1", 1, SQUARE), ("f", "c2", 1, BOW), ("f", "c2", 2, CLOSED))
    return conflicts, review.geometry_rows(df)


def test_conflicts_overlaps_and_what_is_left(spark, overlapping):
    conflicts, geometry = overlapping
    rows = {r["review_id"]: r for r in conflicts.collect()}
    assert sorted(rows) == ["C-c1-1", "C-c1-2", "C-c1-3"] and {r["section"] for r in rows.values()} == {"Ann and Bo"}
    assert (rows["C-c1-3"]["annotation_a"], rows["C-c1-3"]["annotation_b"]) == ("b", "e")
    repaired = geometry.where("recommended = 'SAFE_REMOVE_DUPLICATE_VERTEX'").select("review_id")
    told = review.geometry_status(geometry, repaired)
    over = review.overlap_rows(conflicts, told).collect()
    assert {r["conflict_review_id"] for r in over} == {"C-c1-3"} and {r["choices"] for r in over} == {"KEEP_B"}
    assert sorted(r["geometry_status"] for r in over) == ["AUTO_REPAIRED_DUPLICATE_VERTEX", "UNRESOLVED"]
    left = review.unresolved_rows(conflicts, told).collect()
    assert sorted(r["issue_type"] for r in left) == ["ANNOTATION_CONFLICT"] * 3 + ["GEOMETRY"] * 2
    assert {r["severity"] for r in left if r["issue_type"] != "GEOMETRY"} == {"AMBIGUOUS"}
    work = {r["measure"]: r["value"] for r in review.workload(conflicts, told).collect()}
    assert work["recommended REVIEW_BOTH"] == 3 and work["unresolved rows"] == 5 and work["severity AMBIGUOUS"] == 2 and work["closing vertex only"] == 1


CATALOG = [("C-1", "ANNOTATION_CONFLICT", "x", "a.json", "b.json"), ("G-1", "GEOMETRY", "x", "a.json", None)]


def plan_of(spark, *answers, repaired=()):
    catalog = spark.createDataFrame(CATALOG, "review_id string, issue_type string, content_sha256 string, annotation_a string, annotation_b string")
    given = spark.createDataFrame([tuple(a) + (None,) * (4 - len(a)) for a in answers], "review_id string, human_decision string, selected_annotation string, geometry_decisions string")
    plans, _, problems = review.source_plan(catalog, given, spark.createDataFrame([(r,) for r in repaired], "review_id string"))
    r = plans.first()
    return r["status"], r["source"], r["pending"], sorted(p["problem"] for p in problems.collect())


@pytest.mark.parametrize(
    "answers,want",
    [
        ([("C-1", "KEEP_B")], ("REVIEW_RESOLVED", "b.json", "", [])), ([("C-1", "KEEP_A")], ("PENDING", "a.json", "G-1", [])), ([], ("AWAITING_SOURCE_SELECTION", None, "C-1", [])),
        ([("C-1", "KEEP_A"), ("G-1", "KEEP_AS_IS")], ("REVIEW_RESOLVED", "a.json", "", [])), ([("C-1", "KEEP_A"), ("G-1", "MANUAL_FIX")], ("PENDING", "a.json", "G-1", [])),
        ([("C-1", "KEEP_A", None, json.dumps({"G-1": "KEEP_AS_IS"}))], ("REVIEW_RESOLVED", "a.json", "", [])), ([("C-1", "KEEP_PATH: a.json"), ("G-1", "AUTO_FIX_APPROVED")], ("PENDING", "a.json", "G-1", [])),
        ([("C-1", "KEEP_A"), ("G-1", "EXCLUDE")], ("EXCLUDED", None, "", [])), ([("C-1", "KEEP_A", "b.json")], ("PENDING", "a.json", "G-1", ["selection is another source"])),
        ([("C-1", "KEEP_A"), ("G-9", "EXCLUDE"), ("C-1", "KEEP_A")], ("PENDING", "a.json", "G-1", ["answered twice", "not in the catalog"])),
        ([("C-1", "KEEP_A", None, "{")], ("PENDING", "a.json", "G-1", ["linked answers aren't a JSON object"])),
    ],
)
def test_source_plan(spark, answers, want):
    assert plan_of(spark, *answers) == want


def test_repaired_polygons_need_no_answer(spark):
    assert plan_of(spark, ("C-1", "KEEP_A"), repaired=["G-1"])[0] == "REVIEW_RESOLVED"
