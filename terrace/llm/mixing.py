"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets share the whole size by weight, none above ``cap`` times its source; what a cap cuts off is shared again.
Each source's documents go to shards by a seeded hash of their id, about ``shard_words`` to a shard; a shard's
documents in seeded order are one stream of words, cut into blocks of equal size. Seats, each a block, go to
sources by the highest quotients votes / (2k + 1), then to groups of a source's shards, then to its shards: an
integer quota for each shard. In seeded order each block is taken quota div blocks times, the first quota mod blocks
once more, so no block, and no document, is taken more than ``cap`` times.

Only quotients that can be in doubt are listed: with S parties every divisor lies between total / (seats + S / 2)
and total / (seats - S / 2), which leaves some three rows a party. Windows run over one row a source, over
the groups of a source, over the shards of a group and over the documents of a shard; none holds a source's rows.

Defined cases: null text has size 0, and so has empty text; size 0 is never taken; null source is a source, the
last; a row without doc_id is placed by the digest of its text; repeated rows are told apart only by their place in the
stream; an empty table, or no words at all, gives targets of 0. Clashing extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, is_small, written

CAP = 3
BLOCK_WORDS = 256
#: A shard has so many blocks at least, as far as it has words.
LEAST_BLOCKS = 64
SHARD_WORDS = 200_000
#: Shards in a group.
GROUP = 256
#: Rows of the table of sources up to which it is broadcast.
FEW_SOURCES = 10_000


def weight(place: Column) -> Column:
    """1, 2, 3, repeating, for the places 1, 2, 3, ..."""
    return (place - 1) % 3 + 1


def seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)).cast("binary"))


def with_targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``sources(source, source_size, n)`` with s, the place by code point, and target."""
    placed = sources.withColumn("s", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    placed = placed.withColumn("w", weight(F.col("s"))).withColumn("most", cap * F.col("source_size"))
    before = W.orderBy(F.col("most") / F.col("w"), "s").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    heavy = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    placed = placed.withColumn("level", left / heavy)
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("level"))
    level = F.min_by(fits, F.when(fits.isNotNull(), F.struct(F.col("most") / F.col("w"), F.col("s")))).over(whole)
    target = F.least(F.col("most").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("w"))
    return placed.select("source", "s", "n", "source_size", target.alias("target"))


def apportion(parties: DataFrame, within: list[str], key: str) -> DataFrame:
    """``parties`` with got: the seats of ``seats`` that go to each by its ``votes``, at most ``most`` each.

    Parties with the same ``within`` share the seats that each row of theirs names. Ties go to the least key.
    """
    own = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    p = parties.withColumn("v_", F.col("votes").cast("double")).withColumn("t_", F.sum("v_").over(own)).withColumn("p_", F.count("*").over(own) / 2.0)
    low = F.ceil(F.col("v_") * (F.col("seats") - F.col("p_")) / F.col("t_") - 0.5) - 1
    high = F.ceil(F.col("v_") * (F.col("seats") + F.col("p_")) / F.col("t_") + 0.5) + 1
    p = p.withColumn("lo_", F.least(F.greatest(F.coalesce(F.when(F.col("t_") > 0, low), F.lit(0)), F.lit(0)), F.col("most")).cast("long"))
    p = p.withColumn("hi_", F.least(F.coalesce(F.when(F.col("t_") > 0, high), F.lit(0)), F.col("most")).cast("long"))
    p = p.withColumn("rest_", F.col("seats") - F.sum("lo_").over(own))
    open_ = p.where("hi_ > lo_").select(*within, key, "v_", "rest_", F.explode(F.sequence("lo_", F.col("hi_") - 1)).alias("k_"))
    best = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    open_ = open_.withColumn("at_", F.row_number().over(best.orderBy((F.col("v_") / (2 * F.col("k_") + 1)).desc(), key, "k_")))
    won = open_.where(F.col("at_") <= F.col("rest_")).groupBy(*within, key).agg(F.count("*").alias("won_"))
    return p.join(won, [*within, key], "left").withColumn("got", F.col("lo_") + F.coalesce("won_", F.lit(0))).drop("v_", "t_", "p_", "lo_", "hi_", "rest_", "won_", "votes", "seats", "most")


def mix_rows(rows: DataFrame, seed: int = 42, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """For each of ``rows(doc_id, key, source, size, tag)``: source_size, target, taken and parts.

    key seeds the order of a source's rows; rows that agree in key and size are in the order of tag. parts: (lo, hi, times)
    of the row's words, in order; words [lo, hi) are taken so many times.
    """
    sources = written(with_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), cap), "sources")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    known = sources.select(F.col("source").alias("named"), "s", shards.alias("shards"), "source_size", "target")
    if is_small(known, FEW_SOURCES):
        known = F.broadcast(known)
    hashed = F.conv(F.substring(seeded(seed, F.col("key")), 1, 15), 16, 10).cast("long")
    of_source = rows.join(known, rows["source"].eqNullSafe(known["named"]))
    # rows without words are never taken; they stay out of the streams, so that a source of nothing else is no single shard
    idle = of_source.where("size = 0")
    placed = of_source.where("size > 0").withColumn("shard", F.pmod(hashed, F.col("shards")))
    stream = W.partitionBy("s", "shard").orderBy(seeded(seed + 1, F.col("key")), "doc_id", "size", "tag")
    placed = placed.withColumn("r", F.row_number().over(stream))
    placed = placed.withColumn("stop", F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("size"))
    placed = written(placed.select("doc_id", "tag", "size", "source_size", "target", "s", "shard", "r", "start", "stop"), "streams")

    words = placed.groupBy("s", "shard").agg(F.sum("size").alias("words"))
    cut = words.withColumn("blocks", F.greatest(F.ceil(F.col("words") / block_words), F.least(F.col("words"), F.lit(LEAST_BLOCKS))).cast("long"))
    cut = written(cut.withColumn("team", F.floor(F.col("shard") / GROUP)), "shards")
    by_source = cut.groupBy("s").agg(F.sum("blocks").alias("blocks")).join(sources, "s")
    votes = by_source.select("s", "blocks", (F.col("target") * F.col("blocks") / F.col("source_size")).alias("votes"), (cap * F.col("blocks")).alias("most"))
    votes = votes.withColumn("seats", F.round(F.sum("votes").over(W.partitionBy(F.lit(0)))).cast("long"))
    seats = written(apportion(votes, [], "s").select("s", F.col("got").alias("seats")), "source-seats")
    teams = cut.groupBy("s", "team").agg(F.sum("blocks").alias("votes")).withColumn("most", cap * F.col("votes")).join(seats, "s")
    seats = written(apportion(teams, ["s"], "team").select("s", "team", F.col("got").alias("seats")), "team-seats")
    quota = apportion(cut.withColumn("votes", F.col("blocks")).withColumn("most", cap * F.col("blocks")).join(seats, ["s", "team"]), ["s", "team"], "shard")
    quota = written(quota.select("s", "shard", "words", "blocks", F.col("got").alias("quota")), "quotas")

    block = quota.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    order = W.partitionBy("s", "shard").orderBy(seeded(seed + 2, F.col("s"), F.col("shard"), F.col("k")))
    extra = (F.row_number().over(order) <= F.col("quota") % F.col("blocks")).cast("long")
    block = block.select(
        "s", "shard", "k", F.expr("k * words div blocks").alias("from_"), F.expr("(k + 1) * words div blocks").alias("to_"),
        (F.expr("quota div blocks") + extra).alias("times"),
    )
    of = placed.join(cut.select("s", "shard", "words", "blocks"), ["s", "shard"])
    spans = F.sequence(F.expr("((start + 1) * blocks - 1) div words"), F.expr("(stop * blocks - 1) div words"))
    # blocks are many for each row of quotas, which the planner's estimate doesn't know: never broadcast them
    met = of.select(*placed.columns, F.explode(spans).alias("k")).join(block.hint("merge"), ["s", "shard", "k"])
    met = met.withColumn("lo", F.greatest("start", "from_") - F.col("start")).withColumn("hi", F.least("stop", "to_") - F.col("start"))
    got = F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken")
    parts = F.sort_array(F.collect_list(F.when(F.col("times") > 0, F.struct("lo", "hi", "times")))).alias("parts")
    out = met.groupBy("s", "shard", "r", "doc_id", "tag", "size", "source_size", "target").agg(got, parts).drop("s", "shard", "r")
    return out.unionByName(idle.select("doc_id", "tag", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.array().cast(out.schema["parts"].dataType).alias("parts")))


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """What seeds a row's place: its id, or the digest of the text of a row without one."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def mixed_sizes(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row."""
    doc_id, text = docs["doc_id"], docs["text"]
    rows = docs.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("key"), docs["source"].alias("source"), word_count(text).alias("size"), F.lit(0).cast("long").alias("tag"))
    return mix_rows(written(rows, "sizes"), seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document that is taken whole or in part once, twice or three times
    gives as many rows; a part's words are joined by one space, a whole text stays as it is."""
    columns = docs.columns
    # numbered and written, so that a plan finds its row again whatever the columns are and however often it is repeated
    numbered = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(columns)), F.monotonically_increasing_id().alias("row"))
    numbered = written(numbered, "mix-rows")
    at = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    key = row_key(at["doc_id"], at["text"])
    rows = numbered.select(at["doc_id"].alias("doc_id"), key.alias("key"), at["source"].alias("source"), word_count(at["text"]).alias("size"), F.struct(F.xxhash64(at["text"]).alias("text"), "row").alias("tag"))
    plan = mix_rows(written(rows, "sizes"), seed).where("taken > 0").select("tag.row", "size", "parts")
    out = numbered.join(plan, "row")
    split = F.array_remove(F.split(at["text"], r"[\x20\x09-\x0D]+"), "")
    cuts = (F.size("parts") > 1) | (F.col("parts")[0]["hi"] - F.col("parts")[0]["lo"] < F.col("size"))
    copies = F.sequence(F.lit(1), F.array_max(F.transform("parts", lambda p: p["times"])).cast("int"))
    # words before the explode: were both in one projection, each part would split the text again
    out = out.withColumn("words", F.when(cuts, split)).withColumn("copy", F.explode(copies))
    own = F.filter("parts", lambda p: p["times"] >= F.col("copy"))
    taken = F.aggregate(own, F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"])
    cut = F.array_join(F.flatten(F.transform(own, lambda p: F.slice("words", p["lo"].cast("int") + 1, (p["hi"] - p["lo"]).cast("int")))), " ")
    out = out.withColumn("cut text", F.when(taken == F.col("size"), at["text"]).otherwise(cut))
    kept = dict(at) | {"text": F.col("cut text")}
    if "n_chars" in columns:
        kept["n_chars"] = F.length("cut text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(kept[c].alias(c) for c in columns))
