"""Publishing whole versions, and answers written back beside other writers."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terrace.operators import merging
from terrace.schema import ALLOWED
from terrace.sources.versions import Lost, Store, digest

ANSWER = "review_id string, issue_type string, content_sha256 string, annotation_a string, annotation_b string, human_decision string, selected_annotation string, notes string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int")


def held(store, name="t"):
    return sorted(map(tuple, store.read(name).collect()))


def test_publish_history_and_rollback(spark, store):
    assert store.current() is None and store.history() == []
    with pytest.raises(ValueError, match="nothing is published"):
        store.read("t")
    one = store.publish({"t": table(spark, ("a", 1), ("b", None)), "u": table(spark, ("x", 9))}, "one")
    two = store.publish({"t": table(spark, ("a", 2))}, "two")
    assert held(store) == [("a", 2)] and [c.note for c in store.history()] == ["one", "two"]
    assert two.parent == one.version
    back = store.rollback()
    assert back.version == one.version and back.number == 3
    assert held(store) == [("a", 1), ("b", None)] and held(store, "u") == [("x", 9)]
    store.rollback(2)
    assert held(store) == [("a", 2)] and len(store.history()) == 4
    with pytest.raises(ValueError, match="no such version"):
        store.rollback(99)


def test_a_version_is_known_by_its_rows(spark, store):
    rows = [(f"k{i}", i) for i in range(50)] + [("k1", 1)]
    df = table(spark, *rows)
    assert digest(df.repartition(7)) == digest(df.coalesce(1)) != digest(df.distinct())
    first = store.publish({"t": df})
    again = store.publish({"t": df.repartition(5)})
    assert first.version == again.version and again.number == 2
    assert store.sweep() == []


@pytest.mark.parametrize("at", ["while tables are written", "before the version moves", "before the swap", "within the swap", "after the swap"])
def test_a_failure_leaves_one_whole_version(spark, store, monkeypatch, at):
    store.publish({"t": table(spark, ("old", 1)), "u": table(spark, ("old", 2))})
    real = Store._move

    def move(self, old, new):
        if at == "before the version moves" and new.startswith("versions/"):
            raise OSError(at)
        if at in ("before the swap", "within the swap") and new.startswith("log/"):
            if at == "within the swap":  # another writer's entry is there first
                real(self, old, new)
                self._files.rename(self._at(new), self._at("log/.lost"))
            raise OSError(at)
        real(self, old, new)
        if at == "after the swap" and new.startswith("log/"):
            raise OSError(at)

    monkeypatch.setattr(Store, "_move", move)
    bad = table(spark, ("new", 3)).withColumn("v", F.when(F.lit(at == "while tables are written") & (F.spark_partition_id() >= 0), F.raise_error(F.lit(at)).cast("int")).otherwise(F.col("v")))
    with pytest.raises((OSError, PySparkException)):
        store.publish({"t": table(spark, ("new", 3)), "u": bad})
    monkeypatch.setattr(Store, "_move", real)
    want = "new" if at == "after the swap" else "old"
    assert {r[0] for name in ("t", "u") for r in held(store, name)} == {want}
    store.verify(store.current().version)
    store.sweep()
    assert {r[0] for r in held(store)} == {want}
    assert held(Store(spark, store.path), "u") == held(store, "u")


def test_of_two_writers_one_wins(spark, store):
    first = store.publish({"t": table(spark, ("a", 1))})
    mine, theirs = store.stage({"t": table(spark, ("mine", 1))}), store.stage({"t": table(spark, ("theirs", 1))})
    store.commit(theirs, first)
    with pytest.raises(Lost):
        store.commit(mine, first)
    assert held(store) == [("theirs", 1)]
    assert store.sweep() == [f"versions/{mine}"]


def test_a_changed_version_is_not_restored(spark, store, tmp_path):
    one = store.publish({"t": table(spark, ("a", 1))})
    store.publish({"t": table(spark, ("a", 2))})
    table(spark, ("b", 7)).write.mode("append").parquet(f"{store.path}/versions/{one.version}/t")
    with pytest.raises(ValueError, match="isn't what it was"):
        store.rollback()
    assert held(store) == [("a", 2)]


def answers(spark, *cells):
    rows = [(f"C{i}", "ANNOTATION_CONFLICT" if i % 2 == 0 else "GEOMETRY", "c", f"/a{i}", f"/b{i}", *cell) for i, cell in enumerate(cells)]
    return spark.createDataFrame(rows, ANSWER)


def edits(spark, *rows):
    return spark.createDataFrame(list(rows), "review_id string, human_decision string, selected_annotation string, notes string")


def test_merge_of_cells_and_rows(spark):
    def side(*rows):
        return spark.createDataFrame(list(rows), "review_id string, human_decision string, selected_annotation string, notes string, kind string")

    base = side(("same", "", "", "n", "k"), ("mine", "", "", "n", "k"), ("theirs", "", "", "n", "k"), ("both", "", "", "n", "k"), ("alike", "", "", "n", "k"), ("cells", "", "", "n", "k"), ("gone", "", "", "n", "k"), ("lost", "", "", "n", "k"), ("null", None, "", "n", "k"))
    mine = side(("same", "", "", "n", "k"), ("mine", "A", "", "n", "k"), ("theirs", "", "", "n", "k"), ("both", "A", "", "n", "k"), ("alike", "A", "", "n", "k"), ("cells", "A", "", "n", "k"), ("lost", "A", "", "n", "k"), ("null", "", "", "n", "k"), ("new", "A", "", "x", "k"))
    theirs = side(("same", "", "", "n", "k"), ("mine", "", "", "n", "k"), ("theirs", "B", "", "n", "k2"), ("both", "B", "", "n", "k"), ("alike", "A", "", "n", "k"), ("cells", "", "", "m", "k"), ("gone", "", "", "n", "k"), ("null", None, "", "n", "k"))
    rows = merging.merged(base, mine, theirs)
    got = {r["review_id"]: (r["human_decision"], r["notes"], r["kind"]) for r in merging.settled(rows).collect()}
    assert got == {"same": ("", "n", "k"), "mine": ("A", "n", "k"), "theirs": ("B", "n", "k2"), "both": ("B", "n", "k"), "alike": ("A", "n", "k"), "cells": ("A", "m", "k"), "null": ("", "n", "k"), "new": ("A", "x", "k")}
    told = sorted(map(tuple, merging.conflicts(rows).collect()))
    assert told == [("both", "human_decision", "", "A", "B"), ("lost", "row", None, "changed", "removed")]
    with pytest.raises(PySparkException, match="mine has more than one row"):
        merging.merged(base, mine.union(mine), theirs).collect()


def test_two_writers_of_one_table(spark, store):
    start = answers(spark, ("", "", "first note"), ("", "", ""), ("", "", ""))
    base = store.publish({"decisions": start})
    mine = merging.edited(start, edits(spark, ("C0", "KEEP_B", None, None)), ALLOWED)
    theirs = merging.edited(start, edits(spark, ("C1", "EXCLUDE", None, "Reviewed český text")), ALLOWED)
    done, told = merging.write_back(store, theirs, base)
    assert done.number == 2 and told.count() == 0
    done, told = merging.write_back(store, mine, base)  # other cells: both stand
    assert done.number == 3 and told.count() == 0
    got = {r["review_id"]: (r["human_decision"], r["selected_annotation"], r["notes"]) for r in store.read("decisions").collect()}
    assert got == {"C0": ("KEEP_B", "/b0", "first note"), "C1": ("EXCLUDE", "", "Reviewed český text"), "C2": ("", "", "")}
    stale = merging.edited(start, edits(spark, ("C0", "KEEP_A", None, None)), ALLOWED)
    done, told = merging.write_back(store, stale, base)  # the same cells: nothing is written, the conflicts are named
    assert done is None and store.current().number == 3
    assert sorted(map(tuple, told.collect())) == [("C0", "human_decision", "", "KEEP_A", "KEEP_B"), ("C0", "selected_annotation", "", "/a0", "/b0")]
    fresh = merging.edited(store.read("decisions"), edits(spark, ("C0", "KEEP_A", None, None)), ALLOWED)
    assert merging.write_back(store, fresh, store.current())[0].number == 4
    assert len({c.version for c in store.history()}) == 4


def test_a_race_is_merged_again(spark, store, monkeypatch):
    start = answers(spark, ("", "", ""), ("", "", ""))
    base = store.publish({"decisions": start})
    real, raced = Store.commit, []

    def commit(self, version, parent, note=""):
        if not raced:
            raced.append(True)
            real(self, self.stage({"decisions": merging.edited(start, edits(spark, ("C1", "EXCLUDE", None, None)), ALLOWED)}), parent)
        return real(self, version, parent, note)

    monkeypatch.setattr(Store, "commit", commit)
    done, _ = merging.write_back(store, merging.edited(start, edits(spark, ("C0", "EXCLUDE", None, None)), ALLOWED), base)
    assert done.number == 3
    assert {r["human_decision"] for r in store.read("decisions").collect()} == {"EXCLUDE"}


@pytest.mark.parametrize("edit, error", [(("C9", "EXCLUDE", None, None), "no such row"), (("C0", "KEEP_AS_IS", None, None), "choice not offered"), (("C1", "KEEP_A", None, None), "choice not offered")])
def test_edits_that_cannot_be_made(spark, edit, error):
    with pytest.raises(PySparkException, match=error):
        merging.edited(answers(spark, ("", "", ""), ("", "", "")), edits(spark, edit), ALLOWED).collect()
