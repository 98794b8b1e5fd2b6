"""YOLO text: one object a line, a class and a normalised box or polygon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.arrow import round8
from ..schema import CLASSES


def parse(files: DataFrame) -> DataFrame:
    """(path, line, class_id, class_name, box, polygon, error) of each line that isn't blank.

    ``files`` has path, text, width and height. Five fields are a box; an odd number from seven is a polygon; what can't be
    read gives a row with an error that names the line.
    """
    lines = files.select("path", "width", "height", F.posexplode(F.split("text", r"\r?\n")).alias("at", "raw")).where(F.trim("raw") != "")
    cells = F.split(F.trim("raw"), r"\s+")
    lines = lines.select("path", "width", "height", (F.col("at") + 1).alias("line"), cells.alias("cells"))
    lines = lines.withColumn("class_id", F.expr("try_cast(cells[0] AS int)")).withColumn("v", F.expr("transform(slice(cells, 2, size(cells) - 1), c -> try_cast(c AS double))"))
    ok = F.col("class_id").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    polygon = "transform(sequence(0, size(v) div 2 - 1), i -> named_struct('x', v[2 * i] * width, 'y', v[2 * i + 1] * height))"
    lines = lines.withColumn("polygon", F.when(ok & (F.size("v") >= 6) & (F.size("v") % 2 == 0), F.expr(polygon)))
    box = G.center_to_corners("v[0] * width", "v[1] * height", "v[2] * width", "v[3] * height")
    lines = lines.withColumn("box", F.when(F.col("polygon").isNotNull(), F.expr(G.box("polygon"))).when(ok & (F.size("v") == 4), F.expr(box)))
    names = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))
    error = F.when(F.col("box").isNull(), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": neither a box nor a polygon")))
    return lines.select("path", "line", "class_id", F.try_element_at(names, F.col("class_id")).alias("class_name"), "box", "polygon", error.alias("error"))


def label_line(class_id: Column, polygon: Column, width: Column, height: Column) -> Column:
    """A line for a polygon, with 8 decimals of the exact binary values."""
    flat = F.flatten(F.transform(polygon, lambda p: F.array(p["x"] / width, p["y"] / height)))
    return F.concat_ws(" ", class_id.cast("string"), F.transform(flat, lambda v: F.format_string("%.8f", v)))


def label_lines(objects: DataFrame) -> DataFrame:
    """(key, ordinal, label) of ``objects(key, ordinal, class_id, polygon, width, height)``.

    Values are rounded as binary numbers before they are printed, since printing alone rounds their decimal text.
    """
    points = objects.select("key", "ordinal", "class_id", "width", "height", F.posexplode("polygon").alias("at", "p"))
    points = points.withColumn("x", round8(F.col("p.x") / F.col("width"))).withColumn("y", round8(F.col("p.y") / F.col("height")))
    row = F.struct("at", F.concat_ws(" ", F.format_string("%.8f", "x"), F.format_string("%.8f", "y")).alias("text"))
    rows = points.groupBy("key", "ordinal", "class_id").agg(F.sort_array(F.collect_list(row)).alias("points"))
    return rows.select("key", "ordinal", F.concat_ws(" ", F.col("class_id").cast("string"), F.transform("points", lambda p: p["text"])).alias("label"))
