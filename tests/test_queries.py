"""Each registered query of the core against its SQL on the smallest tables."""

import pytest

from terrace.plans.oracle import SQL
from terrace.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_every_query_without_sql_gives_rows(spark, data):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, data).limit(1).count() == 1, name


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_consecutive_vertices_of_all_users(spark, tmp_path):
    rows = [(i, user, value) for i, (user, value) in enumerate((u, v) for u in (7, 200, 5000) for v in (10.0, 20.0, 120.0))]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, QUERIES["remove_consecutive_vertices"](spark, str(tmp_path)).collect()))
    assert got == [(u, 3, 2, "1") for u in (7, 200, 5000)]


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Vectors of 400 annotations: forty contents of ten."""
    d = str(tmp_path_factory.mktemp("crowded"))
    spark.range(2000).selectExpr("id AS vec_id", "CAST(id % 10 AS INT) AS label", "transform(sequence(0, 9), i -> CAST(sin(id * 10 + i) AS FLOAT)) AS embedding").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_conflict_rows_are_all_pairs_of_crowded_contents(spark, crowded):
    assert QUERIES["review_conflict_rows"](spark, crowded).count() == 10 * 45


def test_overlaps_are_with_the_last_pair_of_crowded_contents(spark, crowded):
    ids = {r[0] for r in QUERIES["review_overlaps"](spark, crowded).select("conflict_review_id").distinct().collect()}
    assert ids == {f"C-c{c}-45" for c in range(0, 40, 4)}


def test_unresolved_rows_hold_all_pairs_of_crowded_contents(spark, crowded):
    out = QUERIES["review_unresolved"](spark, crowded)
    assert out.where("issue_type = 'ANNOTATION_CONFLICT'").count() == 10 * 45
    assert out.where("issue_type = 'GEOMETRY'").count() > 0


def test_workload_counts_all_pairs_of_crowded_contents(spark, crowded):
    counts = {r["measure"]: r["value"] for r in QUERIES["review_workload"](spark, crowded).collect()}
    assert counts["recommended REVIEW_BOTH"] == 10 * 45


def test_historical_versions_name_all_rows_of_a_text(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (4, "a"), (3, "b"), (5, None), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["historical_versions"](spark, str(tmp_path)).collect()))
    assert got == [(1, 3, 1, 4, "2,4"), (2, 3, 1, 4, "1,4"), (3, 1, 3, 3, ""), (4, 3, 1, 4, "1,2"), (5, 2, 5, 6, "6"), (6, 2, 5, 6, "5")]
