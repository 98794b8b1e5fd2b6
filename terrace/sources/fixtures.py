"""Annotation tables derived from the test tables: assets, rings, boxes and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assets: content hash, annotator, a flag for an annotation path and a made-up signature."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("scan_ord"), F.sha2("text", 256).alias("content_sha256"), F.col("source").alias("annotator"), (F.col("doc_id") % 11 != 0).alias("has_path"),
        F.when((F.col("doc_id") % 11 != 0) & (F.col("doc_id") % 7 != 0), (F.col("doc_id") % 3).cast("string")).alias("signature"),
    )


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, ring): a polygon of five vertices in a frame of 1024 x 1024."""
    at = "named_struct('x', (CAST(embedding[2 * i] AS DOUBLE) + 1) * 512, 'y', (CAST(embedding[2 * i + 1] AS DOUBLE) + 1) * 512)"
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr(f"transform(sequence(0, 4), i -> {at})").alias("ring"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes: even ids are truth, odd ones detections with a score."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(5)]
    x1, y1 = (e[0] + 1) * 512, (e[1] + 1) * 512
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 10).cast("long").alias("image_id"), (F.col("label") % 2 + 1).cast("int").alias("category_id"), (F.col("vec_id") % 2 == 0).alias("is_truth"),
        F.abs(e[4]).alias("score"), F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + 100 + 400 * F.abs(e[2])).alias("x2"), (y1 + 100 + 400 * F.abs(e[3])).alias("y2")).alias("box"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images: id, hash, source, size, number of objects and an asset name with a parent."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16).alias("image_id"), F.sha2("text", 256).alias("content_sha256"), F.col("source").alias("source_dataset"),
        F.lit(1024).alias("width"), F.lit(1024).alias("height"), (F.col("n_chars") % 40).cast("int").alias("number_of_objects"),
        F.concat(F.lit("frame"), (F.col("doc_id") % 97).cast("string"), F.lit("_"), F.col("doc_id").cast("string")).alias("asset_name"), F.sha2(F.col("doc_id").cast("string"), 256).alias("shuffle_key"),
    )


#: Contents of annotations by their number: three annotations or two each, or as many as there are over forty contents.
FEW, MANY = "number div 8 * 3 + number % 8 div 3", "number % 40"


def shapes(spark: SparkSession, sf_dir: str, content: str = FEW) -> DataFrame:
    """Rings as shapes, five an annotation; three of four rings get a fault: a closing vertex, a vertex twice in a row, the first
    vertex once more after the third."""
    faults = "CASE vec_id % 4 WHEN 0 THEN ring WHEN 1 THEN concat(ring, slice(ring, 1, 1)) WHEN 2 THEN concat(slice(ring, 1, 2), slice(ring, 2, 4)) ELSE concat(slice(ring, 1, 3), slice(ring, 1, 1), slice(ring, 4, 2)) END"
    rows = rings(spark, sf_dir).withColumn("number", F.expr("vec_id div 5"))
    name = F.concat(F.lit("a"), F.col("number").cast("string"))
    return rows.select(
        "vec_id", "number", name.alias("annotation"), F.sha2(name, 256).alias("annotation_sha256"), F.concat(F.lit("c"), F.expr(content).cast("string")).alias("content_sha256"),
        (F.col("vec_id") % 5 + 1).cast("int").alias("shape_index"), F.when(F.col("label") % 2 == 0, "Tree").otherwise("TreeGroup").alias("label"), F.expr(faults).alias("polygon"), F.lit(1024).alias("width"), F.lit(1024).alias("height"),
    )
