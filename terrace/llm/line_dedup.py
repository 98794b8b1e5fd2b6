"""Line deduplication by a suffix array over line-ID sequences, built by distributed prefix doubling.

A line's ID is the rank of its 128-bit hash among all lines' hashes. Ranks of runs of 2k lines come from pairs of ranks of runs
of k lines: the distinct pairs are sorted in ranges over all tasks and numbered in order, so no task sees them all.
A run that occurs once can't be part of a longer repeated run, so its place drops out, and with it most places.

Doubling ends at ``min_lines``: suffixes that agree on so many lines are neighbours in the suffix array and form an
LCP interval. In each interval the first place in document order stays and the others are later copies. The union of a
document's later copies are its maximal repeated runs: a longer run is covered by the runs of ``min_lines`` in it, so
deeper intervals would delete nothing more. A run doesn't reach over the end of a document. With ``lone``, later copies of
single lines that hold a word go too; a repeated blank line goes only as part of a run.

Documents are in order of their id, null ids last. Defined cases: null and empty text is one empty line (no run); rows
with one id and one text are one document, and each gets its result; in documents with one id and different texts
the text's hash decides which is first; overlapping copies inside a document count like any; an empty table gives an
empty result; clashing extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

MIN_LINES = 2
LAST = (1 << 63) - 1


def ranked(places: DataFrame, a: str, b: str, name: str, *more: str) -> DataFrame:
    """``places(doc, tag, at, a, b, *more)`` whose pair (a, b) occurs more than once, as (doc, tag, at, rank, *more); ranks keep the order."""
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = places.groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1").select(a, b)
    codes = pairs.repartitionByRange(n, a, b).sortWithinPartitions(a, b).withColumn("rank", F.monotonically_increasing_id())
    return written(places.join(written(codes, f"codes-{name}"), [a, b]).select("doc", "tag", "at", "rank", *more), f"ranks-{name}")


def runs(docs: DataFrame, min_lines: int = MIN_LINES) -> tuple[DataFrame, DataFrame]:
    """(doc, tag, at, rank): places where a run of ``min_lines`` lines begins that begins elsewhere too; and such single lines with a word."""
    line = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    line = line.select("doc", "tag", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    places = line.select("doc", "tag", "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.col("line").rlike(WORD).alias("full"))
    places = written(places.distinct(), "places")  # rows with one id and one text are one document
    single = ranked(places, "a", "b", "1", "full")
    known, length = single.drop("full"), 1
    while length < min_lines:
        step = min(length, min_lines - length)
        after = known.select("doc", "tag", (F.col("at") - step).alias("at"), F.col("rank").alias("b"))
        both = known.withColumnRenamed("rank", "a").join(after, ["doc", "tag", "at"])
        length += step
        known = ranked(both, "a", "b", str(length))
    return known, single.where("full").drop("full")


def later(found: DataFrame, length: int) -> DataFrame:
    """(doc, tag, at): the lines of all runs in ``found`` but the first of each rank."""
    # written, so that the join reads a plain table on each side and a rank with very many places can be split
    first = written(found.groupBy("rank").agg(F.min(F.struct("doc", "tag", "at")).alias("first")), "first")
    late = found.join(first, "rank").where(F.struct("doc", "tag", "at") > F.col("first"))
    return late.select("doc", "tag", F.explode(F.sequence(F.col("at"), F.col("at") + (length - 1))).alias("at"))


def removals(docs: DataFrame, min_lines: int = MIN_LINES, lone: bool = False) -> DataFrame:
    """(doc, tag, spans): for each document that loses lines its maximal runs (lo, hi) of later copies, in order."""
    found, single = runs(docs, min_lines)
    gone = later(found, min_lines)
    gone = (gone.union(later(single, 1)) if lone else gone).distinct()
    island = F.col("at") - F.row_number().over(W.partitionBy("doc", "tag").orderBy("at"))
    spans = gone.withColumn("island", island).groupBy("doc", "tag", "island").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))
    return spans.groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, lone: bool = False) -> DataFrame:
    """``docs`` with text less its later copies, and n_lines and n_removed beside it."""
    cut = removals(docs, min_lines, lone).select(F.col("doc").alias("cut doc"), F.col("tag").alias("cut tag"), F.col("spans").alias("cut spans"))
    keyed = docs.withColumn("row doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("row tag", F.xxhash64("text"))
    out = keyed.join(cut, (F.col("row doc") == F.col("cut doc")) & (F.col("row tag") == F.col("cut tag")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    los = F.concat(F.array(F.lit(0)), F.transform("cut spans", lambda s: s["hi"]))
    his = F.concat(F.transform("cut spans", lambda s: s["lo"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(los.alias("lo"), his.alias("hi")), lambda s: F.slice(F.col("lines of text"), s["lo"] + 1, s["hi"] - s["lo"])))
    removed = F.aggregate("cut spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    out = out.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_removed", F.coalesce(removed, F.lit(0).cast("long")))
    out = out.withColumn("lines of text", F.when(F.col("cut spans").isNotNull(), lines))
    out = out.withColumn("text", F.when(F.col("cut spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.select(*docs.columns, "n_lines", "n_removed")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, lone: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) for each row; the digest is of the kept lines joined by line feeds."""
    out = deduplicated(docs.select("doc_id", "text"), min_lines, lone)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
