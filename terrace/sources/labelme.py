"""LabelMe JSON: shapes with a label, a type and points in pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schema import CLASSES

DOCUMENT = (
    "imagePath string, imageWidth int, imageHeight int, "
    "shapes array<struct<label:string,shape_type:string,points:array<array<double>>,group_id:string,flags:string>>"
)


def read(files: DataFrame) -> DataFrame:
    """``files(path, text)`` with doc and disposition: ok, or invalid_json where a key is missing or the text isn't JSON."""
    out = files.withColumn("doc", F.from_json("text", DOCUMENT, {"mode": "PERMISSIVE"}))
    whole = F.expr("try_parse_json(text) IS NOT NULL")
    ok = whole & F.col("doc.shapes").isNotNull() & F.col("doc.imagePath").isNotNull()
    return out.withColumn("disposition", F.when(ok, "ok").otherwise("invalid_json"))


def objects(docs: DataFrame) -> DataFrame:
    """(path, ordinal, class_id, class_name, shape_type, box, polygon) of each shape; unknown labels have class -1.

    Points at most a pixel outside are moved to the edge. A shape without points has the zero box.
    """
    rows = docs.where("disposition = 'ok'").select("path", F.col("doc.imageWidth").alias("w"), F.col("doc.imageHeight").alias("h"), F.posexplode("doc.shapes").alias("ordinal", "s"))
    rows = rows.withColumn("raw", F.transform(F.coalesce("s.points", F.array().cast("array<array<double>>")), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    rows = rows.withColumn("polygon", F.expr(G.clamp("raw", "w", "h"))).withColumn("class_name", F.trim(F.coalesce("s.label", F.lit(""))))
    ids = F.create_map(*(F.lit(x) for k, v in CLASSES.items() for x in (v.lower(), k)))
    zero = "named_struct('x1', 0D, 'y1', 0D, 'x2', 0D, 'y2', 0D)"
    return rows.select(
        "path", "ordinal", F.coalesce(F.try_element_at(ids, F.lower("class_name")), F.lit(-1)).alias("class_id"), "class_name",
        F.lower(F.trim(F.coalesce("s.shape_type", F.lit("polygon")))).alias("shape_type"), F.expr(f"if(size(polygon) = 0, {zero}, {G.box('polygon')})").alias("box"), "polygon",
    )


def signature(docs: DataFrame) -> DataFrame:
    """(path, signature): a digest of the shapes that doesn't depend on their order, first vertex or direction, nor on case."""
    one = docs.where("disposition = 'ok'").select("path", F.explode_outer("doc.shapes").alias("s"))
    one = one.withColumn("raw", F.transform("s.points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    one = one.withColumn("key", F.struct(F.lower(F.trim("s.label")).alias("label"), F.lower(F.trim("s.shape_type")).alias("type"), F.expr(G.ring_key("raw")).alias("ring"), F.col("s.group_id").alias("group_id"), F.col("s.flags").alias("flags")))
    keys = one.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.col("key")))).alias("keys"))
    return keys.select("path", F.sha2(F.to_json(F.struct("keys")), 256).alias("signature"))
