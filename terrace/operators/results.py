"""Statistics, fingerprints, comparison of results and the import of submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNIT


def statistics(manifest: DataFrame) -> DataFrame:
    """(measure, value): images, objects, and the mean, exact median, least and most objects of an image."""
    n = F.col("number_of_objects")
    row = manifest.agg(
        F.count("*").cast("double").alias("images"), F.sum(n).cast("double").alias("objects"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.min(n).cast("double").alias("least"), F.max(n).cast("double").alias("most")
    )
    return row.unpivot([], ["images", "objects", "mean", "median", "least", "most"], "measure", "value")


def class_distribution(objects: DataFrame, classes: DataFrame, key: str = "class_id") -> DataFrame:
    """Objects of each class, none left out."""
    counts = objects.groupBy(key).agg(F.count("*").alias("n"))
    return classes.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def label_counts(objects: DataFrame, group: str, label: str) -> DataFrame:
    """(group, counts): for each group a map from label to count; labels are few."""
    n = objects.groupBy(group, label).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("counts"))


def fingerprint(manifest: DataFrame, key: str) -> DataFrame:
    """One row: a digest that doesn't depend on the order of rows or columns; null is the empty string.

    It is defined over the whole table's text in order of its key, so the ordered rows meet in one task: each is sent as its
    joined cells, for manifests of as many images as one task can hold.
    """
    cells = F.concat_ws(UNIT, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(manifest.columns)))
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), cells.alias("row"))))
    return manifest.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["row"]), "\n"), 256).alias("fingerprint"))


def digest_tree(manifest: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """One row: a digest of the digests of hash buckets, for tables that no task can hold; also free of order."""
    cells = F.concat_ws(UNIT, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(manifest.columns)))
    rows = manifest.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("b"), F.sha2(cells, 256).alias("d"))
    parts = rows.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda r: r["d"]), ""), 256).alias("fingerprint"))


def compare(results: DataFrame, reference: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 5e-4) -> DataFrame:
    """(keys, metric, value, expected, delta, within) of each metric against a reference."""
    a = results.unpivot(keys, metrics, "metric", "value")
    b = reference.unpivot(keys, metrics, "metric", "expected")
    out = a.join(b, [*keys, "metric"], "left").withColumn("delta", F.col("value") - F.col("expected"))
    return out.withColumn("within", F.abs("delta") <= tolerance)


def optional(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are."""
    return df.select(*(c for c in wanted if c in df.columns))


def per_item(total: Column, n: Column, factor: float = 1000.0) -> Column:
    """A total for each item; null for none."""
    return F.try_divide(total * factor, n)
