"""Best so far and patience along a run of measures, over sorted ranges.

A range of rows is summed up by its best value and by how many rows stand since that was first reached, which is an
associative summary: the ranges before one, in order, tell all that a row of it has to know about them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scratch


def best_so_far(rows: DataFrame, key: str, step: str, value: str, patience: int) -> DataFrame:
    """(key, step, value, best, improved, since, stopped) in the order of steps within a key.

    ``improved``: the value is above all before it (null values never are). ``since``: rows since the last improvement, the
    improving row itself being 0; before any, rows so far. ``stopped``: this row or one before has reached ``patience``.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key, step, F.col(value).alias("value")).repartitionByRange(parts, key, step).withColumn("range", F.spark_partition_id())
    dealt = scratch.kept(dealt, "improvement")
    here = W.partitionBy(key, "range").orderBy(step)
    so_far, earlier = here.rowsBetween(W.unboundedPreceding, 0), here.rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumn("at", F.row_number().over(here)).withColumn("before", F.max("value").over(earlier))
    # one row a key and range: its rows, its best, and the first row that reached it
    ends = own.groupBy(key, "range").agg(F.count("*").alias("size"), F.max("value").alias("top"))
    # of each range its best improves on all earlier ranges or it doesn't; a row's own improvements are those above both
    past = W.partitionBy(key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("top_before", F.max("top").over(past)).withColumn("rows_before", F.coalesce(F.sum("size").over(past), F.lit(0)))
    found = own.join(ends.select(key, "range", "top_before", "rows_before"), [key, "range"])
    known = F.greatest("before", "top_before")
    found = found.withColumn("improved", F.col("value").isNotNull() & (known.isNull() | (F.col("value") > known)))
    found = found.withColumn("place", F.col("rows_before") + F.col("at"))
    found = found.withColumn("last", F.max(F.when(F.col("improved"), F.col("place"))).over(so_far))
    # the last improvement of earlier ranges, one row a key and range again
    lasts = found.groupBy(key, "range").agg(F.max("last").alias("range_last")).withColumn("last_before", F.max("range_last").over(past)).select(key, "range", "last_before")
    found = found.join(lasts, [key, "range"]).withColumn("since", F.col("place") - F.coalesce("last", "last_before", F.lit(0)))
    found = found.withColumn("hit", F.max((F.col("since") >= patience).cast("int")).over(so_far))
    hits = found.groupBy(key, "range").agg(F.max("hit").alias("range_hit")).withColumn("hit_before", F.max("range_hit").over(past)).select(key, "range", "hit_before")
    out = found.join(hits, [key, "range"])
    best = F.greatest(known, F.col("value"))
    return out.select(key, step, "value", best.alias("best"), "improved", "since", (F.greatest("hit", F.coalesce("hit_before", F.lit(0))) == 1).alias("stopped"))
