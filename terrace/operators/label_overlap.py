"""Overlap of label boxes within an image: a range join by grid cells, each pair kept in one cell alone.

A box goes to the cells it touches; boxes of one cell and image are compared. A pair that shares several cells is kept in
the cell of its intersection's upper left corner, so no ``distinct`` follows. A crowded cell is cut into ``SPLIT`` x ``SPLIT``
smaller ones, again and again, until no cell holds more than ``CROWD`` boxes or its boxes are all larger than a cell: the
work follows the pairs that really are near, not the square of a cell's boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import geometry as G

#: Boxes of a cell beyond which it's cut, how it's cut, and how often at most.
CROWD, SPLIT, DEPTH = 64, 4, 8


def _cells(boxes: DataFrame, size: float) -> DataFrame:
    """A row for each cell of ``size`` that a box touches; an edge on a border belongs to both."""
    low = [F.floor(F.col(f"box.{c}") / size) for c in ("x1", "y1")]
    high = [F.floor(F.col(f"box.{c}") / size) for c in ("x2", "y2")]
    out = boxes.withColumn("cx", F.explode(F.sequence(low[0], high[0]))).withColumn("cy", F.explode(F.sequence(low[1], high[1])))
    return out.withColumn("size", F.lit(float(size)))


def _finer(cells: DataFrame) -> DataFrame:
    """The rows of crowded cells in cells of a quarter of the size, of those that lie in the old cell."""
    size = F.col("size") / SPLIT
    spans = []
    for c, a, b in (("cx", "x1", "x2"), ("cy", "y1", "y2")):
        first = F.greatest(F.floor(F.col(f"box.{a}") / size), F.col(c) * SPLIT)
        last = F.least(F.floor(F.col(f"box.{b}") / size), F.col(c) * SPLIT + SPLIT - 1)
        spans.append(F.sequence(first, last))
    out = cells.withColumn("nx", F.explode(spans[0])).withColumn("ny", F.explode(spans[1]))
    return out.select(*[c for c in cells.columns if c not in ("cx", "cy", "size")], F.col("nx").alias("cx"), F.col("ny").alias("cy"), size.alias("size"))


def overlaps(boxes: DataFrame, least: float = 0.0, cell: float = 128.0, crowd: int = CROWD) -> DataFrame:
    """(image_id, a, b, iou) of pairs of ``boxes(image_id, object_id, box)`` with a < b whose boxes share an area and iou > ``least``.

    Boxes without area overlap nothing; null boxes take no part; ids are unique in an image.
    """
    good = boxes.select("image_id", "object_id", "box").where("box.x2 > box.x1 AND box.y2 > box.y1")
    cells = scratch.kept(_cells(good, cell), "cells")
    key = ["image_id", "size", "cx", "cy"]
    done = None
    for depth in range(DEPTH + 1):
        # a cell is cut while it's crowded and some of its boxes are smaller than it: cutting around larger ones only makes copies
        small = F.least(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")) < F.col("size")
        full = cells.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(small).alias("small")).where((F.col("n") > crowd) & (F.col("small") * 2 > F.col("n"))).select(*key)
        last = depth == DEPTH or not full.limit(1).count()
        ready = cells if last else cells.join(full, key, "left_anti")
        done = ready if done is None else done.unionByName(ready)
        if last:
            break
        cells = scratch.kept(_finer(cells.join(full, key, "left_semi")), "cells")
    left = done.select(*key, F.col("object_id").alias("a"), F.col("box").alias("p"))
    right = done.select(*key, F.col("object_id").alias("b"), F.col("box").alias("q"))
    pairs = left.join(right, key).where("a < b AND least(p.x2, q.x2) > greatest(p.x1, q.x1) AND least(p.y2, q.y2) > greatest(p.y1, q.y1)")
    corner = [F.floor(F.greatest(F.col(f"p.{c}"), F.col(f"q.{c}")) / F.col("size")) for c in ("x1", "y1")]
    pairs = pairs.where((corner[0] == F.col("cx")) & (corner[1] == F.col("cy"))).withColumn("iou", F.expr(G.box_iou("p", "q")))
    return pairs.where(F.col("iou") > least).select("image_id", "a", "b", "iou")
