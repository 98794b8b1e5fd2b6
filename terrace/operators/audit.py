"""Content audit: duplicate groups by hash, conflicts between annotations, canonical members, dispositions.

``assets`` has content_sha256, scan_ord, annotator, has_path and signature (null: no valid annotation). A group's facts are
aggregates with map-side combine and come back by a join on the hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def groups(assets: DataFrame) -> DataFrame:
    """One row a hash: members, annotators, signatures, and whether its annotations conflict."""
    eligible = F.col("signature").isNotNull()
    out = assets.groupBy("content_sha256").agg(
        F.count("*").alias("members"), F.min("annotator").alias("a0"), F.max("annotator").alias("a1"), F.min("signature").alias("s0"), F.max("signature").alias("s1"),
        F.count_if(eligible).alias("eligible"), F.count_if(F.col("signature").isNull() & F.col("has_path")).alias("unsigned"),
        F.min(F.when(eligible, F.col("scan_ord"))).alias("canonical"), F.count_distinct("annotator").alias("annotators"),
    )
    differ = (F.col("s0") != F.col("s1")) | ((F.col("unsigned") > 0) & (F.col("eligible") > 0))
    return out.withColumn("conflict", (F.col("members") > 1) & F.coalesce(differ, (F.col("unsigned") > 0) & (F.col("eligible") > 0)))


def duplicate_groups(assets: DataFrame) -> DataFrame:
    """Groups of two or more, with where their members are."""
    return groups(assets).where("members > 1").select("content_sha256", "members", (F.col("annotators") < F.col("members")).alias("within_annotator"), (F.col("annotators") > 1).alias("between_annotators"))


def duplicates_between(assets: DataFrame, folder: str) -> DataFrame:
    """Groups of two or more with whether they lie in more than one ``folder``, besides more than one annotator's."""
    places = assets.groupBy("content_sha256").agg((F.min(folder) != F.max(folder)).alias("between_folders"))
    return duplicate_groups(assets).join(places, "content_sha256").withColumn("between_folders", F.coalesce("between_folders", F.lit(False)))


def class_counts(images: DataFrame, objects: DataFrame, classes: DataFrame) -> DataFrame:
    """(split, class_name, images, instances, most): for each split of ``images(image_id, split)`` and each of ``classes(class_id,
    class_name)``, with or without objects, the split's images, its instances of the class, and the most objects an image has."""
    held = objects.groupBy("image_id", "class_id").agg(F.count("*").alias("n"))
    each = images.select("image_id", "split").join(held, "image_id", "left")
    whole = each.groupBy("split", "image_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).groupBy("split").agg(F.count("*").alias("images"), F.max("n").alias("most"))
    found = each.groupBy("split", "class_id").agg(F.sum("n").alias("instances"))
    # a few splits by a few classes
    wanted = whole.crossJoin(F.broadcast(classes.select("class_id", "class_name")))
    return wanted.join(found, ["split", "class_id"], "left").select("split", "class_name", "images", F.coalesce("instances", F.lit(0)).alias("instances"), "most")


def conflicts(assets: DataFrame) -> DataFrame:
    """Conflicting groups, and which arm of the rule made them so."""
    reason = F.when(F.coalesce(F.col("s0") != F.col("s1"), F.lit(False)), "signatures differ").otherwise("a member without a valid annotation")
    return groups(assets).where("conflict").select("content_sha256", "members", reason.alias("reason"))


def dispositions(assets: DataFrame) -> DataFrame:
    """Each asset with status: excluded, conflict, duplicate (with its canonical) or included."""
    facts = groups(assets).select("content_sha256", "conflict", "members", "canonical")
    status = (
        F.when(F.col("signature").isNull(), "excluded").when(F.col("conflict"), "conflict")
        .when((F.col("members") > 1) & (F.col("scan_ord") != F.col("canonical")), "duplicate").otherwise("included")
    )
    out = assets.join(facts, "content_sha256").withColumn("status", status)
    return out.select("scan_ord", "content_sha256", "annotator", "status", F.when(F.col("status") == "duplicate", F.col("canonical")).alias("canonical"))


def disposition_counts(assets: DataFrame) -> DataFrame:
    return dispositions(assets).groupBy("status").agg(F.count("*").alias("n"))


def gate(assets: DataFrame, least: int = 3) -> DataFrame:
    """One row: whether a data set may be built from what the audit found."""
    found = dispositions(assets).agg(F.count_if(F.col("status") == "conflict").alias("conflicts"), F.count_if(F.col("status") == "included").alias("included"))
    return found.withColumn("safe_to_build", (F.col("conflicts") == 0) & (F.col("included") >= least))


def folder_rollup(assets: DataFrame, folder: str, value: str) -> DataFrame:
    """Counts and sums by annotator and folder, by annotator, and over all."""
    out = assets.rollup("annotator", folder).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.grouping_id().alias("level"))
    return out.select("annotator", folder, "n", "total", F.col("level").cast("long").alias("level"))


def tile_parents(assets: DataFrame, parent: str) -> DataFrame:
    """Parents that more than one asset names, with the number of tiles."""
    return assets.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.count("*").alias("tiles")).where("tiles > 1")


def multiplicity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur so many times."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("n_keys"))


def first_in_group(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Rows with place, 1 for the first of a group; for groups that are small by nature."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(order)))
