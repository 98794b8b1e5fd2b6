"""COCO JSON: images, annotations and categories in one document, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from ..functions import geometry as G
from ..functions import text as X
from ..operators.splits import ranked
from ..schema import CLASSES
from .streamed import listing, put_together, spread

DOCUMENT = (
    "info struct<dataset_fingerprint:string,split:string>, images array<struct<id:bigint,canonical_image_id:string,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,iscrowd:int,segmentation:array<array<double>>,bbox:array<double>,area:double>>, "
    "categories array<struct<id:int,name:string>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def images(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("images").alias("i")).select("i.*")


def annotations(docs: DataFrame) -> DataFrame:
    """Annotations with polygon (the first ring) and box as corners."""
    return shaped(docs.select(F.explode("annotations").alias("a")).select("a.*"))


def shaped(rows: DataFrame) -> DataFrame:
    """Annotation rows with polygon and box."""
    ring = "if(segmentation IS NULL OR size(segmentation) = 0, null, transform(sequence(0, size(segmentation[0]) div 2 - 1), i -> named_struct('x', segmentation[0][2 * i], 'y', segmentation[0][2 * i + 1])))"
    box = "named_struct('x1', bbox[0], 'y1', bbox[1], 'x2', bbox[0] + bbox[2], 'y2', bbox[1] + bbox[3])"
    return rows.withColumn("polygon", F.expr(ring)).withColumn("box", F.expr(box))


def objects(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Annotations of the images that ``files(path)`` has by folded base name; images without annotations stay."""
    named = files.select("path", F.lower(X.basename(F.col("path"))).alias("name"))
    there = images(docs).withColumn("name", F.lower(X.basename(F.col("file_name")))).join(named, "name")
    found = annotations(docs).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("id", "category_id", "box", "polygon"))).alias("objects"))
    empty = F.array().cast("array<struct<id:bigint,category_id:int,box:struct<x1:double,y1:double,x2:double,y2:double>,polygon:array<struct<x:double,y:double>>>>")
    return there.join(found, there["id"] == found["image_id"], "left").select("path", there["id"], "width", "height", F.coalesce("objects", empty).alias("objects"))


def section(elements: DataFrame, name: str) -> DataFrame:
    """(path, at, fields of the section, error) of ``elements(path, section, at, text)``, as ``coco_ranges`` reads them from large documents.

    An element that doesn't fit the section's type has an error and no fields.
    """
    kind = next(f.dataType.elementType for f in T._parse_datatype_string(DOCUMENT) if f.name == name)
    rows = elements.where(F.col("section") == name).withColumn("e", F.from_json("text", kind.add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    error = F.when(F.col("e._bad").isNotNull() | F.col("e").isNull(), F.concat(F.lit("not an element of "), F.lit(name)))
    return rows.select("path", "at", *(F.when(error.isNull(), F.col("e")[f.name]).alias(f.name) for f in kind if f.name != "_bad"), error.alias("error"))


def category_errors(categories: DataFrame) -> DataFrame:
    """(id, name, error) of ``categories(id, name)`` that aren't the vocabulary's, and of those of the vocabulary that aren't there."""
    spark = categories.sparkSession
    wanted = spark.createDataFrame([(k + 1, v) for k, v in sorted(CLASSES.items())], "id int, wanted string")
    rows = categories.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names")).join(F.broadcast(wanted), "id", "full")
    error = F.when(F.col("names").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.size("names") != 1, "named twice").when(F.lower(F.trim(F.col("names")[0])) != F.lower("wanted"), "other name")
    return rows.select("id", F.coalesce("wanted", F.get("names", F.lit(0))).alias("name"), error.alias("error")).where("error IS NOT NULL")


def unknown_images(docs: DataFrame) -> DataFrame:
    """Annotations whose image isn't listed."""
    return annotations(docs).join(images(docs).select(F.col("id").alias("image_id")), "image_id", "left_anti")


def numbered(rows: DataFrame, name: str, *order: str, by: str | None = None) -> DataFrame:
    """``rows`` of the unique ``order`` with a number from 1, over all or in each value of ``by``; by sorted ranges, so that no task
    sees all rows or all of a value."""
    own = ((by,) if by else ()) + order
    ranks = ranked(rows, *own)
    if by:
        first = ranks.groupBy(by).agg((F.min("rn") - 1).alias("rows before it"))
        ranks = ranks.join(first, by).withColumn("rn", F.col("rn") - F.col("rows before it"))
    return rows.join(ranks.select(*own, F.col("rn").alias(name)), list(dict.fromkeys(own)))


def numbered_images(manifest: DataFrame, by_split: bool = True) -> DataFrame:
    """``manifest(image_id, split, ...)`` with coco_id from 1 by image_id, in each split or over all."""
    return numbered(manifest, "coco_id", "image_id", by="split" if by_split else None)


def _exported(manifest: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(split, n, e) of the images and of the annotations, numbered in each split, and the issues."""
    images_ = numbered_images(manifest)
    rows = objects.join(images_, "image_id").withColumn("error", F.expr(G.polygon_error("polygon", "width", "height")))
    issues = rows.where("error IS NOT NULL").select("split", "image_id", F.col("ordinal").alias("line"), "error")
    good = numbered(scratch.kept(rows.where("error IS NULL"), "export").withColumn("b", F.expr(G.box("polygon"))), "id", "image_id", "ordinal", by="split")
    flat = F.flatten(F.transform("polygon", lambda p: F.array(p["x"], p["y"])))
    marked = good.select(
        "split", F.col("id").alias("n"),
        F.struct("id", F.col("coco_id").alias("image_id"), (F.col("class_id") + 1).alias("category_id"), F.array(flat).alias("segmentation"), F.expr(G.corners_to_sides("b")).alias("bbox"), F.expr(G.area("polygon")).alias("area"), F.lit(0).alias("iscrowd")).alias("e"),
    )
    listed = images_.select("split", F.col("coco_id").alias("n"), F.struct(F.col("coco_id").alias("id"), F.col("image_id").alias("canonical_image_id"), "file_name", "width", "height").alias("e"))
    return listed, marked, issues


def _categories() -> Column:
    return F.array(*(F.struct(F.lit(k + 1).alias("id"), F.lit(v).alias("name")) for k, v in sorted(CLASSES.items())))


def export(manifest: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents, one a split, and the issues that forbid them; for splits that fit a cell, others are written by ``write``.

    ``manifest`` has image_id, split, file_name, width, height; ``objects`` has image_id, ordinal, class_id, polygon.
    """
    listed, marked, issues = _exported(manifest, objects)
    listed = listed.groupBy("split").agg(F.array_sort(F.collect_list("e")).alias("images"))
    marked = marked.groupBy("split").agg(F.array_sort(F.collect_list("e")).alias("annotations"))
    docs = listed.join(marked, "split", "left").select("split", F.to_json(F.struct("images", F.col("annotations"), _categories().alias("categories"))).alias("json"))
    return docs, issues


def write(manifest: DataFrame, objects: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents of any length below ``folder``, (split, path, length) of each, and the issues, whose objects are left out.

    The elements are sorted by ranges and written as parts ``split=.../part-*`` that follow each other by name; then a task a split
    puts its parts together as a stream, into ``<split>.json``, whose name appears when it's whole. ``folder`` must not be there.
    """
    spark = manifest.sparkSession
    listed, marked, issues = _exported(manifest, objects)
    line = F.concat(F.when(F.col("n") > 1, F.lit(",")).otherwise(F.lit("")), F.to_json("e")).alias("value")
    splits_ = listed.select("split").distinct()
    heads = [(0, F.lit('{"images":[')), (2, F.lit('],"annotations":[')), (4, F.concat(F.lit('],"categories":'), F.to_json(_categories()), F.lit("}")))]
    lines = listed.select("split", F.lit(1).alias("place"), "n", line).unionByName(marked.select("split", F.lit(3).alias("place"), "n", line))
    for place, text in heads:
        lines = lines.unionByName(splits_.select("split", F.lit(place).alias("place"), F.lit(0).cast("long").alias("n"), text.alias("value")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(parts, "split", "place", "n").sortWithinPartitions("split", "place", "n")
    dealt.select("split", "value").write.option("maxRecordsPerFile", 0).partitionBy("split").text(f"{folder}/parts")
    found = listing(spark, f"{folder}/parts", ("txt",)).withColumn("split", F.regexp_extract("path", "/split=([^/]*)/", 1))
    whole = found.groupBy("split").agg(F.array_sort(F.collect_list("path")).alias("parts")).withColumn("path", F.concat(F.lit(f"{folder}/"), "split", F.lit(".json")))
    return scratch.kept(spread(whole.select("split", "path", "parts")).mapInArrow(put_together, "split string, path string, length long"), "written"), issues
