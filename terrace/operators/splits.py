"""Splits: contiguous by a given order, by groups, by a seeded hash, and the checks that nothing leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scratch
from ..schema import SHARES, SPLITS
from .matching import same_sets


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` of these columns with rn, their rank from 1; ranks come from counts of sorted ranges, so no task sees all rows.

    The ranges are written once: their sizes and their rows are read from the same table, whatever the optimiser does.
    """
    order = tuple(dict.fromkeys(order))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("row of rank", F.monotonically_increasing_id())
    ids = scratch.kept(dealt, "ranges").withColumn("range of rank", F.shiftright("row of rank", 33))
    sizes = ids.groupBy("range of rank").agg(F.count("*").alias("size"))
    before = sizes.select("range of rank", F.coalesce(F.sum("size").over(W.orderBy("range of rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("rows before"))
    at = F.col("row of rank").bitwiseAND(F.lit((1 << 33) - 1))
    return ids.join(F.broadcast(before), "range of rank").select(*order, (F.col("rows before") + at + 1).alias("rn"))


def contiguous(rows: DataFrame, order: str, key: str) -> DataFrame:
    """``rows`` with split: the first 70 % by ``order`` train, the next 15 % val, the rest test; both shares round down."""
    n = rows.count()
    first, second = int(n * SHARES[0]), int(n * SHARES[0]) + int(n * SHARES[1])
    split = F.when(F.col("rn") <= first, SPLITS[0]).when(F.col("rn") <= second, SPLITS[1]).otherwise(SPLITS[2])
    return rows.join(ranked(rows, order, key).select(key, split.alias("split")), key)


def _shares_of(size: int, groups: int, left: int, room: list[float], used: list[bool]) -> list[int]:
    """How many of ``groups`` groups of one size each split gets; ``room`` is what each lacks, ``left`` the groups from here on.

    A group belongs where most is lacking. Many at once: they level what the splits lack, so each gets what it has above that
    level, less one to be safe; the others are given one by one.
    """
    got = [0] * len(room)
    spare = groups - 8 * len(room)
    if spare > 0:
        lo, hi = min(room) - size * (groups + 1.0), max(room)
        for _ in range(200):
            level = (lo + hi) / 2
            if sum(max(0.0, (r - level) / size) for r in room) > spare:
                lo = level
            else:
                hi = level
        got = [max(0, int((r - hi) / size) - 1) for r in room]
    for k in range(sum(got), groups):
        bare = [i for i in range(len(room)) if not used[i] and not got[i]]
        open_ = bare if left - k == len(bare) else range(len(room))
        got[max(open_, key=lambda i: (room[i] - size * got[i], -i))] += 1
    return got


def grouped(rows: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """``rows`` with split, no group in two: groups from large to small, each to the split that lacks most of its share.

    That is the split whose squared distance from its share grows least; if no more groups are left than splits without
    any, these get them. Groups of one size are in the order of a seeded digest of their name, so it's enough to settle how
    many of them each split gets. Only the sizes and the numbers of groups of each come to the driver: at most sqrt(2n) for n rows.
    """
    names = rows.groupBy(group).agg(F.count("*").alias("n")).withColumn("mixed", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(group).cast("string"), F.lit("")))))
    profile = sorted(((r["n"], r["groups"]) for r in names.groupBy("n").agg(F.count("*").alias("groups")).collect()), reverse=True)
    left = sum(m for _, m in profile)
    if left < len(SPLITS):
        raise ValueError("at least three groups are needed")
    total = sum(n * m for n, m in profile)
    room, used, bounds, rank = [share * total for share in SHARES], [False] * len(SPLITS), [], 0
    for size, groups in profile:
        got = _shares_of(size, groups, left, room, used)
        bounds.append((size, rank + got[0], rank + got[0] + got[1]))
        room = [r - size * k for r, k in zip(room, got, strict=True)]
        used = [u or k > 0 for u, k in zip(used, got, strict=True)]
        left, rank = left - groups, rank + groups
    cuts = rows.sparkSession.createDataFrame(bounds, "n long, first long, second long")
    places = ranked(names.withColumn("less", -F.col("n")), "less", "mixed", group).withColumn("n", -F.col("less")).join(cuts, "n")
    split = F.when(F.col("rn") <= F.col("first"), SPLITS[0]).when(F.col("rn") <= F.col("second"), SPLITS[1]).otherwise(SPLITS[2])
    places = places.select(F.col(group).alias("group of split"), split.alias("split"))
    return rows.join(places, rows[group].eqNullSafe(places["group of split"])).drop("group of split")


#: Rounds of the permutation; four are enough for an order without a visible pattern.
ROUNDS = 4
#: Steps of a walk that leads back into the count.
WALK = 96


def _shuffled_place(rank: Column, half: int, seed: int) -> Column:
    """One pass of a keyed Feistel network over numbers of ``2 * half`` bits: swaps halves, mixing one with a hash of the other."""
    mask = (1 << half) - 1
    left, right = F.shiftrightunsigned(rank, half), rank.bitwiseAND(F.lit(mask))
    for k in range(ROUNDS):
        mixed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), right.cast("string"))), 1, 15), 16, 10).cast("long")
        left, right = right, left.bitwiseXOR(mixed.bitwiseAND(F.lit(mask)))
    return F.shiftleft(left, half).bitwiseOR(right)


def shuffled(rows: DataFrame, *key: str, seed: int = 42) -> DataFrame:
    """``rows`` of the unique ``key`` with place, from 0: a seeded random order, without a shuffle on the driver.

    Ranks by key go through a keyed permutation of the numbers of just enough bits; a number that falls outside the
    count is put through again until it's inside, which keeps it a bijection. A place depends on the key's rank, the count and
    the seed alone, so reruns and other layouts of the data agree.
    """
    places = ranked(rows, *key)
    n = places.count()
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _shuffled_place(F.col("rn") - 1, half, seed), lambda place, _: F.when(place >= n, _shuffled_place(place, half, seed)).otherwise(place))
    walked = places.withColumn("place", walk)
    # the numbers are at most four for each row, so next to none is still outside after so many steps
    while n and walked.where(F.col("place") >= n).limit(1).count():
        walked = scratch.kept(walked.withColumn("place", F.when(F.col("place") >= n, _shuffled_place(F.col("place"), half, seed)).otherwise(F.col("place"))), "walk")
    return walked.drop("rn")


def randomised(rows: DataFrame, key: str, seed: int = 42, frozen: DataFrame | None = None) -> DataFrame:
    """``rows`` with split in a seeded random order: 70 % train, 15 % val, the rest test; both shares round down.

    ``frozen(key, split)`` are assignments of an earlier build: its rows keep them and don't count; what is new is shared
    out among itself, so that no row ever changes its split.
    """
    new = rows if frozen is None else rows.join(frozen.select(key), key, "left_anti")
    places = shuffled(new, key, seed=seed)
    n = places.count()
    first, second = int(n * SHARES[0]), int(n * SHARES[0]) + int(n * SHARES[1])
    split = F.when(F.col("place") < first, SPLITS[0]).when(F.col("place") < second, SPLITS[1]).otherwise(SPLITS[2])
    told = places.select(key, split.alias("split"))
    return rows.join(told if frozen is None else told.unionByName(frozen.select(key, "split")), key)


def reused(rows: DataFrame, key: str, frozen: DataFrame) -> DataFrame:
    """``rows`` with the split of an earlier build's ``frozen(key, split)``; refuses if the two don't have the same keys, since a
    split that grows by itself would move what was measured."""
    told = same_sets(rows.select(key), frozen.select(key)).first()
    if not told["equal"]:
        raise ValueError(f"the frozen split is of other rows: {told['only_left']} are new, {told['only_right']} are gone")
    return rows.join(frozen.select(key, "split"), key)


def hashed(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``rows`` with split by a seeded hash of the key: no shuffle, and a row's split doesn't depend on other rows."""
    share = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) / 10_000
    return rows.withColumn("split", F.when(share < SHARES[0], SPLITS[0]).when(share < SHARES[0] + SHARES[1], SPLITS[1]).otherwise(SPLITS[2]))


def sample(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The k rows with the least seeded hash."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k)


def leakage(rows: DataFrame, group: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")
