"""COCO-style evaluation over detections and truth, by image and category, of boxes or of masks.

Matching is greedy in score order and so sequential within an image and category: a fold over at most ``MOST``
detections. Curves come from running counts over sorted ranges, so no task sees all detections of a category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scratch
from ..functions import geometry as G
from ..functions.arrow import mask_iou

# Detections kept of an image and category, the IoU thresholds, and how many recall points are sampled.
MOST = 100
THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
STEPS = 100


def top_detections(detections: DataFrame, most: int = MOST) -> DataFrame:
    """The best-scored detections of each image and category with their rank; ties by id."""
    own = W.partitionBy("image_id", "category_id").orderBy(F.col("score").desc(), "vec_id")
    return detections.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)


def overlaps(detections: DataFrame, truth: DataFrame, shape: str = "box") -> DataFrame:
    """(image_id, category_id, det_id, truth_id, score, iou) of pairs that overlap.

    ``shape`` names the column compared: ``box`` (corners) or ``mask`` (run lengths, see ``functions.arrow``).
    """
    d = detections.select("image_id", "category_id", F.col("vec_id").alias("det_id"), "score", F.col(shape).alias("a"))
    t = truth.select("image_id", "category_id", F.col("vec_id").alias("truth_id"), F.col(shape).alias("b"))
    iou = F.expr(G.box_iou("a", "b")) if shape == "box" else mask_iou(F.col("a"), F.col("b"))
    return d.join(t, ["image_id", "category_id"]).withColumn("iou", iou).where("iou > 0").drop("a", "b")


def _taken(threshold: Column) -> Column:
    """The fold over ``found``, an image's detections from the best: each takes its best truth that none before it took."""
    nothing = F.array().cast("array<struct<det_id:bigint,score:double,rank:int,truth_id:bigint>>")

    def step(done: Column, d: Column) -> Column:
        free = F.filter(d["near"], lambda c: (c["iou"] >= threshold) & ~F.exists(done, lambda x: x["truth_id"].eqNullSafe(c["truth_id"])))
        truth = F.get(free, F.lit(0))["truth_id"]
        return F.concat(done, F.array(F.struct(d["det_id"].alias("det_id"), d["score"].alias("score"), d["rank"].alias("rank"), truth.alias("truth_id"))))

    return F.aggregate("found", nothing, step)


def greedy_matches(detections: DataFrame, truth: DataFrame, thresholds: list[float] = THRESHOLDS, shape: str = "box") -> DataFrame:
    """(image_id, category_id, threshold, det_id, score, rank, truth_id): each detection takes the best truth still free.

    Of truths that overlap it equally the one with the greatest id is taken; truth_id is null where none is left.
    """
    top = top_detections(detections)
    near = overlaps(top, truth, shape).groupBy("image_id", "category_id", "det_id").agg(F.sort_array(F.collect_list(F.struct("iou", "truth_id")), asc=False).alias("near"))
    each = top.select("image_id", "category_id", F.col("vec_id").alias("det_id"), "score", "rank").join(near, ["image_id", "category_id", "det_id"], "left")
    each = each.withColumn("near", F.coalesce("near", F.array().cast("array<struct<iou:double,truth_id:bigint>>")))
    images = each.groupBy("image_id", "category_id").agg(F.sort_array(F.collect_list(F.struct("rank", "det_id", "score", "near"))).alias("found"))
    levels = F.transform(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.struct(t.alias("threshold"), _taken(t).alias("rows")))
    levels = images.select("image_id", "category_id", F.explode(levels).alias("level"))
    return levels.select("image_id", "category_id", "level.threshold", F.explode("level.rows").alias("m")).select("image_id", "category_id", "threshold", "m.det_id", "m.score", "m.rank", "m.truth_id")


def curve(scored: DataFrame, keys: list[str], positives: DataFrame) -> DataFrame:
    """(keys, score, det_id, hit, tp, seen, n, recall, precision) at each detection of ``scored(keys, score, det_id, hit)``.

    ``positives`` has keys and n, the number of truths. Rows are dealt into sorted ranges; a row's counts are those of the
    earlier ranges of its keys, one row a range, and those before it in its own. The ranges are written once and read twice.
    """
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scored.select(*keys, (-F.col("score")).alias("down"), "det_id", F.col("hit").cast("long").alias("hit"))
    rows = scratch.kept(rows.repartitionByRange(parts, *keys, "down", "det_id").withColumn("range", F.spark_partition_id()), "curve")
    earlier = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "range").agg(F.sum("hit").alias("range_hits"), F.count("det_id").alias("range_rows"))
    before = totals.select(*keys, "range", F.coalesce(F.sum("range_hits").over(earlier), F.lit(0)).alias("hits_before"), F.coalesce(F.sum("range_rows").over(earlier), F.lit(0)).alias("rows_before"))
    within = W.partitionBy(*keys, "range").orderBy("down", "det_id").rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(before, [*keys, "range"]).withColumn("tp", F.col("hits_before") + F.sum("hit").over(within)).withColumn("seen", F.col("rows_before") + F.count("det_id").over(within))
    out = out.join(positives.where("n > 0"), keys)
    return out.select(*keys, (-F.col("down")).alias("score"), "det_id", (F.col("hit") == 1).alias("hit"), "tp", "seen", "n", (F.col("tp") / F.col("n")).alias("recall"), (F.col("tp") / F.col("seen")).alias("precision"))


def average_precision(scored: DataFrame, keys: list[str], positives: DataFrame) -> DataFrame:
    """(keys, ap, ar): the envelope sampled at 101 recall points, and the last recall; 0 for no detection.

    The envelope at a point is the best precision at that recall or beyond, so a maximum for each point reached, then one
    over the points above it, give it: 101 rows a key whatever the number of detections.
    """
    points = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: i * F.lit(0.01))
    reached = F.size(F.filter(points, lambda p: p <= F.col("recall"))) - 1
    best = curve(scored, keys, positives).groupBy(*keys, reached.alias("at")).agg(F.max("precision").alias("best"), F.max("recall").alias("recall"))
    each = best.groupBy(*keys).agg(F.collect_list(F.struct("at", "best")).alias("steps"), F.max("recall").alias("ar"))
    # both sides are in the same order, so a point takes the greatest of the steps at or above it
    levels = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.coalesce(F.array_max(F.transform(F.filter("steps", lambda s: s["at"] >= i), lambda s: s["best"])), F.lit(0.0)))
    found = each.select(*keys, (F.aggregate(levels, F.lit(0.0), lambda s, v: s + v) / (STEPS + 1)).alias("ap"), "ar")
    out = positives.where("n > 0").join(found, keys, "left")
    return out.select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("ar", F.lit(0.0)).alias("ar"))


def summary(detections: DataFrame, truth: DataFrame, shape: str = "box", categories: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """(category_id, ap, ap50, ap75, ar1, ar10, ar100) of each category, and the plain means as category null.

    ``images(image_id)`` restricts both sides; ``categories(category_id)`` adds those without truth. A category without
    truth has nulls and no part in the means; one with truth and no detection has zeros.
    """
    spark = truth.sparkSession
    if images is not None:
        wanted = images.select("image_id").distinct()
        detections, truth = detections.join(wanted, "image_id", "left_semi"), truth.join(wanted, "image_id", "left_semi")
    levels = spark.createDataFrame([(t,) for t in THRESHOLDS], "threshold double")
    positives = truth.groupBy("category_id").agg(F.count("*").alias("n"))
    leveled = positives.crossJoin(F.broadcast(levels))  # ten rows a category
    scored = greedy_matches(detections, truth, shape=shape).withColumn("hit", F.col("truth_id").isNotNull())
    each = average_precision(scored, ["category_id", "threshold"], leveled)
    rows = each.groupBy("category_id").agg(
        F.avg("ap").alias("ap"), F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("ap50"), F.max(F.when(F.col("threshold") == 0.75, F.col("ap"))).alias("ap75")
    )
    # the first m detections of an image match alike whatever comes after them
    reach = scored.groupBy("category_id").agg(*(F.count_if(F.col("hit") & (F.col("rank") <= m)).alias(f"h{m}") for m in (1, 10, 100)))
    reach = positives.join(reach, "category_id", "left").select("category_id", *((F.coalesce(f"h{m}", F.lit(0)) / (F.col("n") * len(THRESHOLDS))).alias(f"ar{m}") for m in (1, 10, 100)))
    rows = rows.join(reach, "category_id")
    means = rows.agg(F.lit(None).cast("int").alias("category_id"), *(F.avg(c).alias(c) for c in rows.columns[1:]))
    if categories is not None:
        rows = categories.select("category_id").distinct().join(rows, "category_id", "left")
    return rows.unionByName(means)
