"""Rules over images and objects: issues, reasons, whole-table checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import CLASSES


def object_issues(images: DataFrame) -> DataFrame:
    """(key, ordinal, status) of each rule that an object breaks, and of each image without objects or without issues.

    ``images`` has key, width, height and objects (class_id, box, polygon).
    """
    rows = images.select("key", "width", "height", F.posexplode("objects").alias("ordinal", "o"))
    b = F.col("o.box")
    corners = [b[c] for c in ("x1", "y1", "x2", "y2")]
    odd = reduce(Column.__or__, [F.isnan(c) | (F.abs(c) == float("inf")) for c in corners])
    rules = [
        (~F.coalesce(F.col("o.class_id").isin(*CLASSES), F.lit(False)), "ERROR_INVALID_CLASS"),
        (odd | (b["x2"] <= b["x1"]) | (b["y2"] <= b["y1"]), "ERROR_ZERO_OR_INVALID_BOX"),
        ((b["x1"] < 0) | (b["y1"] < 0) | (b["x2"] > F.col("width")) | (b["y2"] > F.col("height")), "ERROR_OUT_OF_BOUNDS"),
        (F.col("o.polygon").isNotNull() & (F.size("o.polygon") < 3), "ERROR_SHORT_POLYGON"),
    ]
    found = rows.select("key", "ordinal", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(s)) for c, s in rules)))).alias("status"))
    empty = images.where(F.size("objects") == 0).select("key", F.lit(None).cast("int").alias("ordinal"), F.lit("VALID_EMPTY_IMAGE").alias("status"))
    valid = images.where(F.size("objects") > 0).select("key").join(found.select("key").distinct(), "key", "left_anti")
    return found.unionByName(empty).unionByName(valid.select("key", F.lit(None).cast("int").alias("ordinal"), F.lit("VALID").alias("status")))


def file_issues(unreadable: DataFrame, missing: DataFrame, orphans: DataFrame, names: DataFrame) -> DataFrame:
    """(key, status) for files: unreadable, without annotation, without image, or of a name that isn't unique."""
    twice = names.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = ((unreadable, "ERROR_UNREADABLE_IMAGE"), (missing, "ERROR_MISSING_ANNOTATION"), (orphans, "ERROR_ANNOTATION_WITHOUT_IMAGE"), (twice, "ERROR_DUPLICATE_FILENAME"))
    return reduce(DataFrame.unionByName, [d.select("key", F.lit(s).alias("status")) for d, s in parts])


def excluded_images(images: DataFrame, labels: tuple[str, ...], shapes: tuple[str, ...]) -> DataFrame:
    """Images with any excluded label or shape type, and which ones they matched."""
    hit = F.filter(F.transform("objects", lambda o: X.folded(o["class_name"])), lambda v: v.isin(*labels) if labels else F.lit(False))
    odd = F.filter(F.transform("objects", lambda o: X.folded(o["shape_type"])), lambda v: v.isin(*shapes) if shapes else F.lit(False))
    out = images.withColumn("matched", F.array_sort(F.array_distinct(F.concat(hit, odd))))
    return out.where(F.size("matched") > 0).select("key", F.array_join("matched", ";").alias("matched"))


def checks(named: dict[str, DataFrame]) -> DataFrame:
    """(check, violations, ok) for tables that should be empty."""
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("violations")).select(F.lit(k).alias("check"), "violations", (F.col("violations") == 0).alias("ok")) for k, d in named.items()])


def require(found: DataFrame) -> None:
    """Fail with the names of checks that did; a check is one row."""
    bad = [f"{r['check']} ({r['violations']})" for r in found.where("NOT ok").collect()]
    if bad:
        raise ValueError("checks failed: " + ", ".join(sorted(bad)))
