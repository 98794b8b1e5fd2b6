"""Benchmark decontamination by a prefix-filtered set join.

The set of a window is its words. Words are ordered by rarity over all documents, rarest first; since a document
must contain the whole window, the necessary prefix of a window is one token, its rarest word. Document words
that are some window's prefix token give candidates; a candidate must leave room for the window's words before and
after the token (positional bound) and in the document as a whole (length bound), and is verified word by word.

Documents are cut into segments of ``SEGMENT`` start positions with the following words of a window, so no row
carries a long text's words while single words are looked up. The benchmark's windows and words are broadcast
while there are at most ``FEW`` of them, else joined by shuffle: of hashes and places of words first, then of segments
that have candidates.

Defined cases: null or empty text has no words, is not hit and hits nothing; null doc_id is kept as it is;
repeated documents each give a row (rows are told apart by id and text); items with equal windows are all
named; null item_id has no name and is left out of the digest and the count; empty tables give empty or clean
results; clashing extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, written

#: What separates words of a lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEGMENT = 256
FEW = 200_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text in which A-Z may still be capital; no words for null."""
    split = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.array_remove(split, "")


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """(window, item_id): lower-cased word lists of ``size`` words, or a shorter item's own words."""
    w = benchmark.select(benchmark["item_id"].alias("item_id"), words_of(lower_ascii(benchmark["text"])).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return w.select("item_id", F.explode(starts).alias("p"), "w").select("item_id", F.expr(f"slice(w, p, {size})").alias("window")).distinct()


def hinted(df: DataFrame, few: int) -> DataFrame:
    """Broadcast what is proven to have few rows; else let the planner shuffle."""
    return F.broadcast(df) if is_small(df, few) else df


def hits(docs: DataFrame, benchmark: DataFrame, size: int, few: int = FEW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, tag, n_words) of each document, its hits (doc_id, tag, start, stop, window_id), and (window_id, item_id)."""
    spark = docs.sparkSession
    items = windows_of(benchmark, size)
    windows = items.select("window").distinct().withColumn("window_id", F.xxhash64("window"))
    # equal 64-bit ids of different windows would merge their items; the pair of hashes is as good as the words
    windows = windows.withColumn("window_id", F.concat_ws("-", F.hex("window_id"), F.sha2(F.array_join("window", " "), 256)))
    windows = written(windows, "windows")
    items = written(items.join(windows, "window").select("window_id", "item_id").where("item_id is not null").distinct(), "items")

    words = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("tag"), words_of(docs["text"]).alias("w"))
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    vocabulary = vocabulary.withColumn("key", F.lower("word"))
    spelled = words.select(F.explode("w").alias("raw")).select(F.lower("raw").alias("key"))
    counts = spelled.join(hinted(vocabulary.select("key").distinct(), few), "key").groupBy("key").agg(F.count("*").alias("n"))
    rarity = written(vocabulary.join(counts, "key", "left").select("word", "key", F.coalesce("n", F.lit(0)).alias("n")), "rarity")

    ordered = windows.select("window_id", "window", F.posexplode("window").alias("at", "word")).join(rarity, "word")
    prefix = ordered.groupBy("window_id").agg(F.min_by(F.struct("at", "key"), F.struct("n", "word", "at")).alias("p"), F.first("window").alias("window"))
    prefix = written(prefix.select("window_id", F.array_join("window", " ").alias("spelled"), F.size("window").alias("len"), "p.at", "p.key"), "prefixes")

    # segments of start positions, each with the words that its last window may still need
    n = F.size("w")
    segment = words.select("doc_id", "tag", n.alias("n_words"), F.explode(F.sequence(F.lit(0), F.greatest((n - 1), F.lit(0)), F.lit(SEGMENT))).alias("base"), "w")
    segment = segment.select("doc_id", "tag", "n_words", "base", F.expr(f"slice(w, base + 1, {SEGMENT + size - 1})").alias("w"))
    if is_small(prefix, few):
        word = segment.select("doc_id", "tag", "n_words", "base", "w", F.posexplode("w").alias("p", "raw")).withColumn("key", F.lower("raw"))
        met = word.join(F.broadcast(prefix), "key")
    else:
        # what is shuffled for each word is a hash, its segment's hash and its place; segments come back for candidates alone
        segment = segment.withColumn("segment", F.xxhash64("doc_id", "tag", "base"))
        word = segment.select("segment", F.posexplode("w").alias("p", "raw")).select("segment", "p", F.xxhash64(F.lower("raw")).alias("hash"))
        met = word.join(prefix.withColumn("hash", F.xxhash64("key")).drop("key"), "hash").drop("hash").join(segment, "segment")
    start = F.col("p") - F.col("at")
    met = met.where((F.col("n_words") >= F.col("len")) & (start >= 0) & (start < SEGMENT) & (start + F.col("len") <= F.size("w")))
    # no lambda here: with one, the words of a segment would be copied for each single word on the way to the join
    there = lower_ascii(F.array_join(F.expr("slice(w, p - at + 1, len)"), " "))
    met = met.where(there == F.col("spelled"))
    met = met.select("doc_id", "tag", (F.col("base") + start).alias("start"), (F.col("base") + start + F.col("len")).alias("stop"), "window_id")
    return words.select("doc_id", "tag", n.cast("long").alias("n_words")), written(met, "hits"), items


def covered(spans: Column) -> Column:
    """Number of places in the union of sorted (start, stop)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(a: Column, s: Column) -> Column:
        new = F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))
        return F.struct((a["n"] + new).alias("n"), F.greatest(a["end"], s["stop"]).alias("end"))

    return F.aggregate(spans, zero, add, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, few: int = FEW) -> DataFrame:
    """(doc_id, tag, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``; tag is a hash of the text."""
    rows, found, items = hits(docs, benchmark, size, few)
    # a hit document's spans are at most as many as its words
    spans = found.groupBy("doc_id", "tag").agg(covered(F.sort_array(F.collect_set(F.struct("start", "stop")))).alias("n_hit"))
    named = found.select("doc_id", "tag", "window_id").distinct().join(hinted(items, few), "window_id")
    named = named.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = spans.join(named, [spans["doc_id"].eqNullSafe(named["doc_id"]), spans["tag"] == named["tag"]], "left").select(
        spans["doc_id"].alias("hit_id"), spans["tag"].alias("hit_tag"), "n_hit", "items"
    )
    out = rows.join(found, [rows["doc_id"].eqNullSafe(found["hit_id"]), rows["tag"] == found["hit_tag"]], "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "tag", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, few: int = FEW) -> DataFrame:
    """``docs`` without the contaminated documents."""
    _, found, _ = hits(docs, benchmark, size, few)
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("tag").alias("hit_tag")).distinct()
    return docs.join(hinted(found, few), [docs["doc_id"].eqNullSafe(found["hit_id"]), F.xxhash64(docs["text"]) == found["hit_tag"]], "left_anti")
