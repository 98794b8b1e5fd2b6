"""Four sides of a data set held against each other: manifest, listed images, annotations and label lines.

Sides meet by (split, image, ordinal) in full joins, so what one lacks is a row and not a loss; comparisons are null-safe.
A finding names the side that differs: where three agree it's the fourth, where a value contradicts itself it's its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G

FINDING = ("split", "image_id", "ordinal", "side", "problem")
IMAGE = ["split", "image_id"]


def _finding(side: str | Column, problem: str | Column) -> Column:
    return F.struct(*(v.alias(n) if isinstance(v, Column) else F.lit(v).alias(n) for n, v in (("side", side), ("problem", problem))))


def _told(rows: DataFrame, each: list[Column], ordinal: Column) -> DataFrame:
    return rows.select(*IMAGE, ordinal.cast("long").alias("ordinal"), F.explode(F.array_compact(F.array(*each))).alias("f")).select(*IMAGE, "ordinal", "f.*")


def of_images(manifest: DataFrame, images: DataFrame, counts: DataFrame) -> DataFrame:
    """Findings about whole images. ``manifest``: split, image_id, content_sha256, width, height, total. ``images``: the same but
    total, and file_sha256 (null if the file is missing). ``counts``: split, image_id, annotations, lines."""
    once = [df.groupBy(*IMAGE).agg(F.count("*").alias(f"{name}_times"), F.max(F.struct(*cells)).alias(name)) for df, name, cells in ((manifest, "m", ["content_sha256", "width", "height", "total"]), (images, "i", ["width", "height", "file_sha256"]))]
    rows = once[0].join(once[1], IMAGE, "full").join(counts, IMAGE, "full")
    m, i = F.col("m"), F.col("i")
    a, n = F.coalesce("annotations", F.lit(0)), F.coalesce("lines", F.lit(0))
    listed = m.isNotNull() & i.isNotNull()
    odd = F.when((a == n) & ~m["total"].eqNullSafe(a), "manifest").when(m["total"].eqNullSafe(n) & (a != n), "annotations").when(m["total"].eqNullSafe(a) & (a != n), "labels").when((a != n) & ~m["total"].eqNullSafe(a), "all")
    return _told(rows, [
        F.when(m.isNull() & i.isNotNull(), _finding("manifest", "image isn't in it")),
        F.when(i.isNull() & m.isNotNull(), _finding("images", "image isn't listed")),
        F.when(m.isNull() & i.isNull() & (a > 0), _finding("annotations", "image is unknown")),
        F.when(m.isNull() & i.isNull() & (n > 0), _finding("labels", "image is unknown")),
        F.when(F.col("m_times") > 1, _finding("manifest", "image stands twice")),
        F.when(F.col("i_times") > 1, _finding("images", "image stands twice")),
        F.when(listed & ~(m["width"].eqNullSafe(i["width"]) & m["height"].eqNullSafe(i["height"])), _finding("images", "size differs")),
        F.when(listed & ~i["file_sha256"].eqNullSafe(m["content_sha256"]), _finding("images", "content differs")),
        F.when(m.isNotNull() & odd.isNotNull(), _finding(odd, "number of objects")),
    ], F.lit(None))


def of_objects(images: DataFrame, annotations: DataFrame, labels: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Findings about objects. ``annotations``: split, image_id, ordinal, category_id, segmentation (rings as numbers), bbox, area.
    ``labels``: split, image_id, ordinal, class_id, polygon in pixels, error. ``exceptions``: split, image_id, ordinal of polygons
    that may cross themselves."""
    sizes = images.groupBy(*IMAGE).agg(F.max("width").alias("width"), F.max("height").alias("height"))
    key = [*IMAGE, "ordinal"]
    left = annotations.select(*key, F.struct("category_id", "segmentation", "bbox", "area").alias("a"))
    right = labels.select(*key, F.struct("class_id", "polygon", "error").alias("l"))
    rows = left.join(right, key, "full").join(sizes, IMAGE, "left")
    if exceptions is not None:
        rows = rows.join(exceptions.select(*key, F.lit(True).alias("excepted")).distinct(), key, "left")
    else:
        rows = rows.withColumn("excepted", F.lit(None).cast("boolean"))
    a, line = F.col("a"), F.col("l")
    ring = "if(a.segmentation IS NULL OR size(a.segmentation) <> 1, null, transform(sequence(0, greatest(size(a.segmentation[0]) div 2 - 1, 0)), k -> named_struct('x', a.segmentation[0][2 * k], 'y', a.segmentation[0][2 * k + 1])))"
    rows = G.settled(rows.withColumn("ring", F.expr(ring)), "ring")
    rows = rows.withColumn("own_box", F.expr(f"if(size(ring) > 0, {G.corners_to_sides('(' + G.box('ring') + ')')}, null)")).withColumn("own_area", F.when(F.size("ring") > 0, F.expr(G.area("ring"))))
    rows = rows.withColumn("fault", F.when(F.size(line["polygon"]) > 0, F.expr(G.validity_error("l.polygon", "width", "height"))))
    rows = G.settled(rows, "own_box", "own_area", "fault")
    both = a.isNotNull() & line.isNotNull()
    agrees = F.col("own_box").eqNullSafe(a["bbox"]) & F.col("own_area").eqNullSafe(a["area"])
    same_ring = F.col("ring").eqNullSafe(line["polygon"])
    sound = line["error"].isNull() & line["polygon"].isNotNull() & (F.col("fault").isNull() | (F.coalesce("excepted", F.lit(False)) & (F.col("fault") == "edges cross")))
    return _told(rows, [
        F.when(line.isNull(), _finding("labels", "line is missing")),
        F.when(a.isNull(), _finding("annotations", "annotation is missing")),
        F.when(line.isNotNull() & ~sound, _finding("labels", F.coalesce(line["error"], F.col("fault"), F.lit("no polygon")))),
        F.when(a.isNotNull() & ~agrees, _finding("annotations", "box or area isn't its ring's")),
        F.when(a.isNotNull() & ~F.coalesce(a["category_id"].isin(1, 2), F.lit(False)), _finding("annotations", "category isn't known")),
        F.when(both & a["category_id"].isin(1, 2) & ~(a["category_id"] - 1).eqNullSafe(line["class_id"]), _finding("annotations, labels", "class differs")),
        F.when(both & sound & ~same_ring, _finding(F.when(agrees, "annotations, labels").otherwise("annotations"), "ring differs")),
    ], F.col("ordinal"))


def numbered(annotations: DataFrame) -> DataFrame:
    """Annotations with ordinal, their place by id in their image; an image's annotations are what one label file holds."""
    return annotations.withColumn("ordinal", F.row_number().over(W.partitionBy(*IMAGE).orderBy("id")).cast("long"))


def repeated_ids(annotations: DataFrame) -> DataFrame:
    """Findings about annotation ids used more than once in a split."""
    twice = annotations.groupBy("split", "id").agg(F.count("*").alias("n"), F.min("image_id").alias("image_id")).where("n > 1")
    return twice.select("split", "image_id", F.lit(None).cast("long").alias("ordinal"), F.lit("annotations").alias("side"), F.lit("id is used twice").alias("problem"))


def findings(manifest: DataFrame, images: DataFrame, annotations: DataFrame, labels: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """All findings (split, image_id, ordinal, side, problem); none means that the four sides tell one story."""
    here = numbered(annotations)
    counts = here.groupBy(*IMAGE).agg(F.count("*").alias("annotations")).join(labels.groupBy(*IMAGE).agg(F.count("*").alias("lines")), IMAGE, "full")
    return of_images(manifest, images, counts).unionByName(of_objects(images, here, labels, exceptions)).unionByName(repeated_ids(annotations))
