"""The trie of conversations' turns, with sums over subtrees by heavy paths.

Turns are sorted by ranges, and what runs along a conversation (places, prefix hashes, marks) is a scan: each range runs
by itself, one row a range is carried on, and the rows of a conversation that began earlier are shifted. So no task
holds a conversation, however long. A prefix is known by two 64-bit polynomials over MD5 halves of its turns.

Each node's largest child (most members, ties to the smaller conv_id) goes on its path; a child off the path has at
most half of its parent's members, so a way from the root leaves paths at most log2(conversations) times. Paths sum
up their nodes; level by level, deepest first, a light path's total is added to its parent's; at the end each node gets
the totals of paths hanging from it, and suffix sums along the path arrays, in blocks, are the subtrees' sums.

Defined cases: rows without conv_id take no part. Rows of one turn number go by the MD5 of role and text, so repeated
rows are turns of their own in a fixed order. Null role or text is empty. The remainder of a negative conv_id is
negative, as SQL has it. Clashing extra columns are not read. An empty table has no conversation, no root and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, fresh_worker, lean, written

#: Odd multipliers of the two prefix polynomials.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Nodes of a path whose suffix sums one group takes; ids of members in one piece of text.
PATH, PIECE = 1024, 4096
MASK = (1 << 64) - 1
NODE = ["depth", "h1", "h2"]
#: What a scan adds: place from 1; the prefix hash with and without the row; marks so far; place and values of the last
#: marked row up to here and before here; the row before's value.
SCANNED = "place long, h1 long, h2 long, p1 long, p2 long, marks long, m0 long, m1 long, m2 long, q0 long, q1 long, q2 long, before long"


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**64."""
    out, step, left = np.ones(len(exponents), np.uint64), base, exponents.astype(np.uint64)
    while left.any():
        out *= np.where(left & np.uint64(1), np.uint64(step), np.uint64(1))
        left, step = left >> np.uint64(1), step * step & MASK
    return out


def _local(batch: pa.RecordBatch, state: dict | None) -> tuple[dict[str, np.ndarray], dict]:
    """The scan of one batch of sorted rows, going on from ``state``; the last row's state."""
    n = batch.num_rows
    conv, lo, hi, mark = (batch.column(c).to_numpy() for c in ("conv", "lo", "hi", "mark"))
    value = batch.column("value").to_numpy()
    at = np.arange(n)
    new = np.r_[state is None or conv[0] != state["conv"], conv[1:] != conv[:-1]]
    start = np.maximum.accumulate(np.where(new, at, -1))
    on = start < 0  # rows of the conversation that the batch before ended with
    out = {"place": np.where(on, (state or {}).get("place", 0) + at + 1, at - start + 1)}
    first = np.maximum(start, 0)
    for k, values, base in (("1", lo, BASES[0]), ("2", hi, BASES[1])):
        term = values.view(np.uint64) * powers(base, out["place"])
        total = np.cumsum(term)
        h = total - (total - term)[first]
        if state is not None:
            h = np.where(on, h + np.uint64(state["h" + k] & MASK), h)
        out["h" + k], out["p" + k] = h.view(np.int64), (h - term).view(np.int64)
    marks = np.cumsum(mark)
    out["marks"] = marks - (marks - mark)[first] + np.where(on, (state or {}).get("marks", 0), 0)
    last = np.maximum.accumulate(np.where(mark > 0, at, -1))
    for k, values in (("0", out["place"]), ("1", lo), ("2", hi)):
        m = np.where(last >= first, values[last], np.where(on, (state or {}).get("m" + k, 0), 0))
        m = np.where((last < first) & ~on, 0, m)
        out["m" + k] = m
        out["q" + k] = np.where(new, 0, np.r_[(state or {}).get("m" + k, 0), m[:-1]])
    out["before"] = np.where(new, 0, np.r_[(state or {}).get("value", 0), value[:-1]])
    return out, {k: int(v[-1]) for k, v in out.items()} | {"conv": int(conv[-1]), "value": int(value[-1])}


def joined(earlier: dict, later: dict) -> dict:
    """The state after a range that holds one conversation alone, which began with ``earlier``."""
    out = dict(later, place=earlier["place"] + later["place"], marks=earlier["marks"] + later["marks"])
    for k, base in (("1", BASES[0]), ("2", BASES[1])):
        out["h" + k] = (earlier["h" + k] + pow(base, earlier["place"], 1 << 64) * later["h" + k]) & MASK
    if later["m0"]:
        out["m0"] += earlier["place"]
    else:
        out |= {k: earlier[k] for k in ("m0", "m1", "m2")}
    return out


def _shifted(batch: pa.RecordBatch, carried: dict[int, dict]) -> pa.RecordBatch:
    """The rows of conversations that began in an earlier range, going on from there."""
    part, conv = batch.column("part").to_numpy(), batch.column("conv").to_numpy()
    cols = {c: batch.column(c) for c in batch.schema.names}
    for p in np.unique(part):
        if (by := carried.get(int(p))) is None or not (rows := (part == p) & (conv == by["conv"])).any():
            continue
        old = {c: cols[c].to_numpy() for c in [f.split()[0] for f in SCANNED.split(", ")]}
        put = {"place": old["place"] + by["place"], "marks": old["marks"] + by["marks"], "before": np.where(old["place"] == 1, by["value"], old["before"])}
        for k, base in (("1", BASES[0]), ("2", BASES[1])):
            factor = np.uint64(pow(base, by["place"], 1 << 64))
            for c in ("h" + k, "p" + k):
                put[c] = (old[c].view(np.uint64) * factor + np.uint64(by["h" + k] & MASK)).view(np.int64)
        for a in "mq":
            put[a + "0"] = np.where(old[a + "0"] > 0, old[a + "0"] + by["place"], by["m0"])
            for k in "12":
                put[a + k] = np.where(old[a + "0"] > 0, old[a + k], by["m" + k])
        for c, v in put.items():
            cols[c] = pa.array(np.where(rows, v, old[c]))
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def scanned(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows(conv, lo, hi, mark, value, ...)`` with SCANNED along each conv in the given order, as a written table."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [f.split()[0] for f in SCANNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        state, part, seq = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out, state = _local(batch, state)
            n = batch.num_rows
            arrays = [pa.array(out[f].astype(np.int64)) for f in fields] + [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(seq, seq + n))]
            seq += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *fields, "part", "seq"])

    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(parts, "conv", *order).sortWithinPartitions("conv", *order)
    table = written(dealt.mapInArrow(lean(run), f"{plain}, {SCANNED}, part long, seq long"), name)
    # one row a range: its first conversation and the state after its last row
    ends = table.groupBy("part").agg(F.min("conv").alias("first"), F.max_by(F.struct("conv", "value", *fields), "seq").alias("last")).collect()
    carried, state = {}, None
    for r in sorted(ends, key=lambda r: r["part"]):
        last = r["last"].asDict()
        if state is not None and r["first"] == state["conv"]:
            carried[r["part"]] = state
            if last["conv"] == r["first"]:
                last = joined(state, last)
        state = last

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _shifted(batch, carried) if batch.num_rows else batch

    out = table.mapInArrow(lean(shift), table.schema).drop("part", "seq")
    out._scratch = table._scratch
    return out


def hashed(digest: Column) -> tuple[Column, Column]:
    """The halves of an MD5 as signed longs."""
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "lo"), (17, "hi")))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations' ids, and the turns (conv, later, n, lo, hi, words) of all, rebuilt: later tells own turns from those of the base."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv"), conversations["turn"].alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(0).cast("long").alias("mark"), F.lit(0).cast("long").alias("value"), *hashed(digest)
    )
    own = scanned(turns, [F.asc_nulls_first("turn"), F.col("digest")], "trie-turns").select("conv", "place", "lo", "hi", "words")
    convs = written(own.select("conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 4), "trie-convs")
    base = F.col("conv") - F.col("conv") % 20
    heads = own.where((F.col("place") <= 3) & (F.col("conv") % 20 == 0)).select(F.col("conv").alias("base"), "place", "lo", "hi", "words")
    given = convs.where("h > 0").withColumn("base", base).join(heads, "base").where("place <= h").select("conv", F.lit(0).alias("later"), F.col("place").alias("n"), "lo", "hi", "words")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return convs, given.unionAll(own.where(F.col("place") > h).select("conv", F.lit(1), "place", "lo", "hi", "words"))


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends_sha256) of the conversations that end at each node: pieces of ids in order, hashed as a stream."""
    pieces = ends.groupBy(*NODE, F.expr(f"conv div {PIECE}").alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if (d, a, b) == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (d, a, b), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*NODE, "ends_sha256"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], [*NODE, "ends_sha256"])

    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return dealt.mapInArrow(lean(run), "depth long, h1 long, h2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node."""
    zero = F.lit(0).cast("long")
    convs, turns = rebuilt(conversations)
    way = scanned(turns.select("conv", "later", "n", "lo", "hi", "words", zero.alias("mark"), zero.alias("value")), [F.col("later"), F.col("n")], "trie-prefixes")
    way = way.select("conv", F.col("place").alias("depth"), "h1", "h2", "p1", "p2", "words")
    # the node where each conversation ends; of conversations that end alike the smallest alone names nodes
    last = convs.join(way.groupBy("conv").agg(F.max_by(F.struct(*NODE), "depth").alias("at")), "conv", "left")
    ends = written(last.select("conv", *(F.coalesce(F.col("at")[c], zero).alias(c) for c in NODE)), "trie-ends")
    nodes = way.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = nodes.unionByName(root.select(*(zero.alias(c) for c in NODE), "conv_id", "n_convs", zero.alias("words"), zero.alias("p1"), zero.alias("p2")))
    nodes = written(nodes, "trie-nodes")
    child = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    child = written(child.agg(F.count("*").alias("n_children"), F.max_by(F.struct("h1", "h2"), F.struct("n_convs", -F.col("conv_id"))).alias("heavy")), "trie-children")
    heavy = child.select((F.col("depth") + 1).alias("depth"), F.col("heavy.h1").alias("h1"), F.col("heavy.h2").alias("h2"), F.lit(0).cast("long").alias("mark"))
    nodes = nodes.join(child.drop("heavy"), NODE, "left").join(heavy, NODE, "left").join(_digests(ends), NODE, "left")
    known = nodes.withColumns({"n_children": F.coalesce("n_children", zero), "mark": F.coalesce("mark", F.lit(1).cast("long")), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})
    known = written(known.withColumns({"leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}).drop("words"), "trie-known")

    # along the ways that name nodes: on which path a node lies, and from which path that one hangs
    naming = ends.groupBy(*NODE).agg(F.min("conv").alias("conv")).select("conv")
    marked = way.join(naming, "conv", "left_semi").select("conv", *NODE).join(known.where("depth > 0"), NODE)
    marked = marked.select("conv", F.col("h1").alias("lo"), F.col("h2").alias("hi"), "mark", F.col("conv_id").alias("value"), F.col("depth").alias("at"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), "n_convs", "n_children", "ends_sha256", "leaves", "saved")
    found = scanned(marked, [F.col("at")], "trie-paths").where("conv = value")
    least = F.lit(convs.agg(F.min("conv")).first()[0]).cast("long")
    found = found.select(F.col("at").alias("depth"), F.col("lo").alias("h1"), F.col("hi").alias("h2"), F.col("value").alias("conv_id"), F.when(F.col("at") > 1, F.col("before")).otherwise(least).alias("parent_conv_id"),
                         *(F.col(c) for c in ("n_convs", "n_children", "ends_sha256", "leaves", "saved", "up1", "up2")), "mark", F.col("marks").alias("level"), *(F.col(f"m{k}") for k in range(3)), *(F.col(f"q{k}") for k in range(3)))
    top = known.where("depth = 0").select(*NODE, "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "ends_sha256", "leaves", "saved", F.col("p1").alias("up1"), F.col("p2").alias("up2"), zero.alias("mark"), zero.alias("level"), *(zero.alias(f"{a}{k}") for a in "mq" for k in range(3)))
    found = written(found.unionByName(top), "trie-found")

    # totals of paths, level by level; rounds are at most log2 of the number of conversations
    head = F.col("mark") == 1
    paths = found.groupBy("level", "m0", "m1", "m2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), *(F.max(F.when(head, F.col(c))).alias(c) for c in ("q0", "q1", "q2", "up1", "up2")))
    paths = written(paths, "trie-sums")
    deepest = paths.agg(F.max("level")).first()[0] or 0
    hung, totals = None, []
    for level in range(deepest, 0, -1):
        here = paths.where(F.col("level") == level)
        if hung is not None:
            here = here.join(hung, ["m0", "m1", "m2"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
        here = written(here, "trie-totals")
        totals.append(here.select((F.col("m0") - 1).alias("depth"), F.col("up1").alias("h1"), F.col("up2").alias("h2"), "leaves", "saved"))
        hung = here.groupBy(*(F.col(f"q{k}").alias(f"m{k}") for k in range(3))).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    full = found
    if totals:
        below = totals[0]
        for t in totals[1:]:
            below = below.unionAll(t)
        below = below.groupBy(*NODE).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        full = full.join(below, NODE, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("leaves", "saved")})

    # suffix sums along paths: within blocks of a path, and over its later blocks
    path = ["m0", "m1", "m2"]
    full = full.withColumn("block", F.expr(f"depth div {PATH}"))
    later = Window.partitionBy(*path).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = full.groupBy(*path, "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    blocks = blocks.select(*path, "block", F.coalesce(F.sum("l").over(later), zero).alias("later_l"), F.coalesce(F.sum("s").over(later), zero).alias("later_s")).where("later_l > 0 OR later_s > 0")
    within = Window.partitionBy(*path, "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    out = full.withColumns({"n_leaves": F.sum("leaves").over(within), "saved_tokens": F.sum("saved").over(within)}).join(blocks, [*path, "block"], "left")
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("later_l", zero)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("later_s", zero)).alias("saved_tokens"), "ends_sha256")
    discard(convs, ends, child)
    return out
