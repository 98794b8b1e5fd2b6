"""Joins by name: images with annotations, sets with sets, snapshots with what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def match(images: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """(key, status): matched, missing_annotation or orphan_annotation; one full join tells all three apart."""
    a, b = images.select(F.col(key).alias("ik")).distinct(), annotations.select(F.col(key).alias("ak")).distinct()
    both = a.join(b, F.col("ik") == F.col("ak"), "full_outer")
    status = F.when(F.col("ak").isNull(), "missing_annotation").when(F.col("ik").isNull(), "orphan_annotation").otherwise("matched")
    return both.select(F.coalesce("ik", "ak").alias(key), status.alias("status"))


def match_in_folders(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """By (folder, stem), both sides possibly many: status is ambiguous unless each side has exactly one."""
    a = images.groupBy("folder", "stem").agg(F.count("*").alias("n_images"), F.min("path").alias("image_path"))
    b = annotations.groupBy("folder", "stem").agg(F.count("*").alias("n_annotations"), F.min("path").alias("annotation_path"))
    both = a.join(b, ["folder", "stem"], "full_outer").fillna(0, ["n_images", "n_annotations"])
    status = (
        F.when(F.col("n_annotations") == 0, "missing_annotation").when(F.col("n_images") == 0, "orphan_annotation")
        .when((F.col("n_images") == 1) & (F.col("n_annotations") == 1), "matched").otherwise("ambiguous")
    )
    return both.withColumn("status", status)


def snapshot_diff(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change) of what was changed, is missing or was added; null digests are equal to each other."""
    a, b = before.select(F.col(key).alias("k1"), F.col(digest).alias("d1"), F.lit(True).alias("in1")), now.select(F.col(key).alias("k2"), F.col(digest).alias("d2"), F.lit(True).alias("in2"))
    both = a.join(b, F.col("k1") == F.col("k2"), "full_outer")
    change = F.when(F.col("in2").isNull(), "missing").when(F.col("in1").isNull(), "added").when(~F.col("d1").eqNullSafe(F.col("d2")), "changed")
    return both.select(F.coalesce("k1", "k2").alias(key), change.alias("change")).where("change IS NOT NULL")


def pairs_in_groups(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(group, first, second, pair): unordered pairs in a group, numbered from 1 by their members' order.

    For review, where a group is a few sources of one image; what is asked for is every pair.
    """
    a, b = rows.select(group, F.col(order).alias("first")), rows.select(group, F.col(order).alias("second"))
    both = a.join(b, group).where("first < second")
    return both.withColumn("pair", F.row_number().over(W.partitionBy(group).orderBy("first", "second")).cast("long"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row with the greatest ``order``: an aggregate with map-side combine, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: only_left, only_right, equal, for the distinct rows of two tables of one column list."""
    left, right = a.distinct().withColumn("l", F.lit(1)), b.distinct().withColumn("r", F.lit(1))
    cond = [left[c].eqNullSafe(right[c]) for c in a.columns]
    both = left.join(right, cond, "full_outer").agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))
    return both.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
