"""Suffix array over line-ID sequences, and a document's longest repeated run of lines.

Distributed prefix doubling to the end: ranks of runs of 2k lines come from pairs of ranks of runs of k lines, numbered in
sorted ranges over all tasks. A line that occurs once, or a document's end, ends every run that reaches it. Doubling goes
on until a round tells no more suffixes apart; the last ranks are the suffix array, in which suffixes that stay equal share a rank.

The longest common prefix of two neighbours in that array is added up from the ranks of all rounds, longest step first. A
place's maximal repeated run is the longest prefix it shares with a neighbour, or all of it where its rank has other places.

``line_dedup`` deletes by the intervals at ``min_lines`` alone, which cost a fraction of this. Defined cases: null and empty
text is one empty line; rows with one id and one text are one document, and each gets its result; of several longest
runs in a document the earliest counts; copies may overlap; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, written
from .line_dedup import LAST, MIN_LINES

#: Stands for the rank of what follows a run that ends.
END = -1
KEY = ["doc", "tag", "at"]


@dataclass
class Runs:
    """``levels[k](doc, tag, at, rank, n, ahead)``: places of repeated lines, rank of the 2^k lines from there, how many share it, lines to the run's end.

    The last level is the suffix array.
    """

    levels: list[DataFrame]

    def discard(self) -> None:
        discard(*self.levels)


def ranked(pairs: DataFrame, name: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Codes (a, b, n, rank) of the pairs (a, b) that occur ``least`` times, in their order; and ``pairs`` with n and rank in their place."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    codes = written(counts.repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id()), f"codes-{name}")
    return codes, pairs.join(codes, ["a", "b"]).drop("a", "b")


def runs(docs: DataFrame, min_lines: int = MIN_LINES) -> Runs:
    """The suffix array, and the ranks it was doubled from. Places in less than ``min_lines`` repeated lines on end are left out."""
    line = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    line = line.select("doc", "tag", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    places = line.select("doc", "tag", "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    places = written(places.distinct(), "places")  # rows with one id and one text are one document
    single = written(ranked(places, "1", 2)[1], "ranks-1")
    discard(places)
    stretch = W.partitionBy("doc", "tag", "island")
    island = single.withColumn("island", F.col("at") - F.row_number().over(W.partitionBy("doc", "tag").orderBy("at")))
    island = island.withColumn("size", F.count("*").over(stretch)).withColumn("ahead", F.max("at").over(stretch) - F.col("at") + 1)
    levels = [written(island.where(F.col("size") >= min_lines).select(*KEY, "rank", "n", "ahead"), "level-0")]
    discard(single)
    told = levels[0].select("rank").distinct().count()
    while True:
        step = 1 << (len(levels) - 1)
        after = levels[-1].select("doc", "tag", (F.col("at") - step).alias("at"), F.col("rank").alias("b"))
        pairs = levels[-1].select(*KEY, F.col("rank").alias("a"), "ahead").join(after, KEY, "left")
        pairs = written(pairs.withColumn("b", F.when(F.col("ahead") > step, F.col("b")).otherwise(END)), "pairs")
        codes, level = ranked(pairs, str(2 * step))
        now = codes.count()
        if now > told:
            levels.append(written(level.select(*KEY, "rank", "n", "ahead"), f"level-{len(levels)}"))
        discard(codes, pairs)
        if now == told:
            return Runs(levels)
        told = now


def neighbours(found: Runs) -> DataFrame:
    """(doc, tag, at, n, next, common): the first place of each rank of the suffix array, the next rank's (doc, tag, at, n), their common lines.

    Only where one of both ranks has a single place; the runs of others are known from their equals.
    """
    sa = found.levels[-1].groupBy("rank", "n").agg(F.min(F.struct(*KEY)).alias("p"))
    own = W.partitionBy(F.shiftright("rank", 33)).orderBy("rank")  # a sorted range
    sa = written(sa.withColumn("next", F.lead(F.struct("p", "n")).over(own)), "suffixes")
    heads = sa.groupBy(F.shiftright("rank", 33).alias("range")).agg(F.min_by(F.struct("p", "n"), "rank").alias("head"))
    heads = heads.select(F.lag("range").over(W.orderBy("range")).alias("range"), "head")  # one row a range
    pairs = sa.join(F.broadcast(heads), (F.shiftright("rank", 33) == F.col("range")) & F.col("next").isNull(), "left")
    pairs = pairs.select("p", "n", F.coalesce("next", "head").alias("next")).where("next IS NOT NULL AND (n = 1 OR next.n = 1)")
    pairs = written(pairs.select("p.*", "n", F.col("next.p").alias("q"), F.col("next.n").alias("next_n"), F.lit(0).alias("common")), "common")
    discard(sa)
    for k in range(len(found.levels) - 2, -1, -1):
        level = found.levels[k].select("doc", "tag", "at", "rank")
        p = level.select(F.struct(*KEY).alias("p"), F.col("rank").alias("p_rank"))
        q = level.select(F.struct(*KEY).alias("r"), F.col("rank").alias("q_rank"))
        here = F.struct("doc", "tag", (F.col("at") + F.col("common")).alias("at"))
        there = F.struct("q.doc", "q.tag", (F.col("q.at") + F.col("common")).alias("at"))
        both = pairs.join(p, here == F.col("p"), "left").join(q, there == F.col("r"), "left")
        same = F.when(F.col("p_rank") == F.col("q_rank"), 1 << k).otherwise(0)
        before, pairs = pairs, written(both.select(*KEY, "n", "q", "next_n", (F.col("common") + same).alias("common")), "common")
        discard(before)
    return pairs


def longest(found: Runs, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc, tag, longest_run, run_copies): lines of a document's longest repeated run, and places where that run begins."""
    pairs = neighbours(found)
    each = found.levels[-1].where("n > 1").select(*KEY, F.col("ahead").alias("lines"))
    each = each.union(pairs.where("n = 1").select(*KEY, F.col("common").alias("lines")))
    each = each.union(pairs.where("next_n = 1").select("q.*", F.col("common").alias("lines"))).where(F.col("lines") >= min_lines)
    top = each.groupBy("doc", "tag").agg(F.max(F.struct("lines", (-F.col("at")).alias("back"))).alias("top"))
    top = top.select("doc", "tag", F.col("top.lines").alias("lines"), (-F.col("top.back")).alias("at"))
    last = len(found.levels) - 1
    top = top.withColumn("k", F.least(F.length(F.bin("lines")) - 1, F.lit(last)))
    top = top.withColumn("rest", F.when(F.col("k") < last, F.col("lines") - F.expr("shiftleft(1, k)")).otherwise(0))
    ladder = reduce(DataFrame.union, [t.select(F.lit(k).alias("k"), *KEY, "rank", "n") for k, t in enumerate(found.levels)])
    top = written(top.join(ladder, ["k", *KEY]), "top")
    whole = top.where("rest = 0").select("doc", "tag", "lines", "n")
    # the other runs are two overlapping runs of 2^k lines: each interval and length is looked through once, whoever asks
    end = ladder.select("k", "doc", "tag", "at", F.col("rank").alias("end"))
    asked = top.where("rest > 0")
    places = ladder.drop("n").join(asked.select("k", "rank", "rest").distinct(), ["k", "rank"])
    places = places.withColumn("at", F.col("at") + F.col("rest")).join(end, ["k", *KEY])
    counts = places.groupBy("k", "rank", "rest", "end").agg(F.count("*").alias("n"))
    asked = asked.drop("n").withColumn("at", F.col("at") + F.col("rest")).join(end, ["k", *KEY])
    part = asked.join(counts, ["k", "rank", "rest", "end"]).select("doc", "tag", "lines", "n")
    out = written(whole.union(part).select("doc", "tag", F.col("lines").cast("long").alias("longest_run"), F.col("n").alias("run_copies")), "longest")
    discard(top, pairs)
    return out


def longest_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, n_lines, longest_run, run_copies) for each row, longs; 0 and 0 where no run of ``min_lines`` lines is repeated."""
    found = runs(docs, min_lines)
    top = longest(found, min_lines)
    found.discard()
    keyed = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("tag"))
    zero = F.lit(0).cast("long")
    return keyed.join(top, ["doc", "tag"], "left").select("doc_id", "n_lines", *(F.coalesce(c, zero).alias(c) for c in ("longest_run", "run_copies")))
