"""Nearest vectors by shifted space-filling curves.

Each curve projects the vectors on a few random directions, shifts them by a random step and orders them by their place
on a Hilbert curve. Spark sorts the keys by ranges; a row's place is its number in its range plus the rows of earlier
ranges. A query meets the blocks of rows that hold the ``width`` places before and after its own; what the curves find
is merged by exact inner product, in double precision.

Vectors are raised to one length by one more component (queries have zero there), so that the largest inner product is
the least distance. ``fit`` takes the width from a sample of at most ``4 * SAMPLE`` rows: the share of all places within
which ``reach`` of the sample's true neighbours lie on some curve. The index itself holds every row, and the work of a
query is ``2 * curves * share`` of a full comparison: small where vectors have structure, close to one where they have
none (independent components in 64 dimensions). A task searches a stretch of neighbouring blocks and merges what each query
finds in them, so that the rows found follow the queries and the tasks, not the blocks.

Of rows with the same vector only the ``k + 1`` of least id under each key and range go into blocks: any further one
would lose each tie against ``k`` of them, so no result is lost and copies don't fill the windows.

Defined cases: vectors that are null, empty, zero or hold a null or a component that is not finite take no part, nor do
rows without an id. A shorter vector counts as filled up with zeros. Rows that share an id count as one candidate, at
its best score, and as one query with the best of all its rows. Ties go to the smaller id. Clashing extra columns are
not read. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh_worker, lean, written

#: Curves, the directions of each, and bits of a place along one direction (DIRECTIONS * BITS < 64).
CURVES, DIRECTIONS, BITS = 12, 6, 10
#: Rows of a block, which a task holds in memory.
BLOCK = 2048
#: Rows aimed at for the fit, and its queries.
SAMPLE, TRIALS = 8192, 256
#: Share of the sample's true neighbours that some curve has within its width.
REACH = 0.96
#: Curves that share a sort: what lies on disk at once follows it.
AT_ONCE = 3
#: Rows found that a task holds; beyond them they are merged, and given out if most are left.
HELD = 1 << 20
OUT = "query_id long, rank int, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of rows of whole numbers below 2**bits, first column most significant."""
    x = cells.astype(np.uint64)
    dims, one = x.shape[1], np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for i in range(dims):
            upper = (x[:, i] & bit) != 0
            swap = np.where(upper, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(upper, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> np.uint64(level)) & one != 0, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= turn[:, None]
    out = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[:, i] >> np.uint64(level)) & one)
    return out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, filled up with zeros to ``dims``."""
    sizes = np.asarray(column.value_lengths())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) == len(sizes) * dims and (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(starts, sizes)] = values
    return out


class Curves:
    """Keys of vectors on each curve; sent to tasks, so it holds a few numbers for each dimension."""

    def __init__(self, dims: int, longest: float, seed: int = 42, curves: int = CURVES):
        self.dims, self.longest, self.curves = dims, longest, curves
        self.directions = min(DIRECTIONS, dims + 1)
        rng = np.random.default_rng(seed)
        self.axes = [np.linalg.qr(rng.standard_normal((dims + 1, self.directions)))[0] for _ in range(curves)]
        self.shifts = [rng.random(self.directions) for _ in range(curves)]
        self.low = [np.full(self.directions, -1.0)] * curves
        self.wide = [np.full(self.directions, 2.0)] * curves

    def placed(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors on the sphere of radius one: data by one more component, queries by scaling alone."""
        length = np.linalg.norm(x, axis=1)
        unit = x / np.maximum(length, 1e-300)[:, None]
        share = np.ones(len(x)) if query else np.clip(length / self.longest, 0, 1)
        return np.nan_to_num(np.column_stack([unit * share[:, None], np.sqrt(1 - share**2)]))

    def measure(self, x: np.ndarray) -> None:
        """Take the range of each direction from a sample; what lies outside falls in the outermost cells."""
        for c, axes in enumerate(self.axes):
            y = self.placed(x, False) @ axes
            spread = np.maximum(3.2 * y.std(axis=0), 1e-12)
            self.low[c], self.wide[c] = y.mean(axis=0) - spread, 2 * spread

    def key(self, c: int, at: np.ndarray) -> np.ndarray:
        """The key on curve c of vectors given by ``placed``; the shift moves them by up to a fifth of the range."""
        cells = ((at @ self.axes[c] - self.low[c]) / self.wide[c] + 0.2 * self.shifts[c]) / 1.2 * (1 << BITS)
        return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS).astype(np.int64)


def share_of_places(curves: Curves, x: np.ndarray, k: int, reach: float) -> float:
    """Of all places, the share before and after a query within which ``reach`` of its k neighbours lie on some curve."""
    n = len(x)
    tried = np.linspace(0, n - 1, min(n, TRIALS)).astype(np.int64)
    scores = x[tried] @ x.T
    scores[np.arange(len(tried)), tried] = -np.inf
    k = min(k, n - 1)
    if k < 1:
        return 1.0
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    data, asked = curves.placed(x, False), curves.placed(x[tried], True)
    best = np.full(near.shape, np.inf)
    for c in range(curves.curves):
        keys = curves.key(c, data)
        order = np.argsort(keys, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        at = np.searchsorted(keys[order], curves.key(c, asked), side="right")
        best = np.minimum(best, np.abs(place[near] - at[:, None]) / n)
    return float(np.quantile(best, reach))


def usable(vector: Column) -> Column:
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda v: v != 0)


def _keyed(rows: DataFrame, curves: Curves, chosen: list[int], every: int) -> DataFrame:
    """(curve, key, kind, vec_id, same, vector): kind 0 for each row, kind 1 for each query once more."""
    vector = rows.schema["vector"].dataType.simpleString()
    names = ["curve", "key", "kind", "vec_id", "same", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            x = matrix(batch.column("vector"), curves.dims)
            asks = np.flatnonzero(batch.column("vec_id").to_numpy() % every == 0)
            for kind, at, part in ((0, curves.placed(x, False), batch), (1, curves.placed(x[asks], True), batch.take(pa.array(asks)))):
                for c in chosen if part.num_rows else []:
                    n = part.num_rows
                    columns = [pa.array(np.full(n, c, np.int32)), pa.array(curves.key(c, at)), pa.array(np.full(n, kind, np.int32)), *(part.column(name) for name in names[3:])]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(lean(run), f"curve int, key long, kind int, vec_id long, same long, vector {vector}")


def _numbered(keyed: DataFrame, keep: int) -> DataFrame:
    """The keyed rows sorted by ranges, each with its range and the number of data rows before it there and on its curve."""
    order = ["curve", "key", "kind", "same", "vec_id"]
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, curve, last, last_id, copies = TaskContext.get().partitionId(), 0, None, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.column(c).to_numpy() for c in order]
            lead = np.array([a[0] for a in at[:4]])
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([a[1:] != a[:-1] for a in at[:4]], axis=0)
            new[0] = last is None or bool((lead != last).any())
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = new[1:] | (at[4][1:] != at[4][:-1])
            fresh[0] = new[0] or at[4][0] != last_id
            # the number of each id among those of the same vector, going on from the batch before
            ids = np.cumsum(fresh)
            start = np.maximum.accumulate(np.where(new, ids, 0))
            copy = np.where(start == 0, copies + ids, ids - start + 1)
            last, last_id, copies = np.array([a[-1] for a in at[:4]]), at[4][-1], int(copy[-1])
            kept = np.flatnonzero(fresh & ((copy <= keep) | (at[2] == 1)))
            counts = (at[2][kept] == 0).astype(np.int64)
            before = np.cumsum(counts) - counts
            own = at[0][kept]
            if len(kept):
                first = np.r_[True, own[1:] != own[:-1]]
                base = np.maximum.accumulate(np.where(first, before, 0))
                idx = before - base + np.where((own == own[0]) & (own[0] == curve), seen, 0)
                curve, seen = own[-1], int(idx[-1] + counts[-1])
                small = batch.take(pa.array(kept))
                columns = [small.column(c) for c in ("curve", "kind", "vec_id", "vector")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(kept), part, np.int32)), pa.array(idx)], ["curve", "kind", "vec_id", "vector", "part", "idx"])

    vector = keyed.schema["vector"].dataType.simpleString()
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(lean(run), f"curve int, kind int, vec_id long, vector {vector}, part int, idx long")


def best_of(queries: np.ndarray, asks: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of each query's k best rows of a block, ids once, its own left out.

    A matrix product chooses, with what is within rounding of the last place; the scores themselves are sums of
    one fixed order, so that equal vectors tie.
    """
    rough = np.nan_to_num(asks @ rows.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    rough[queries[:, None] == ids[None, :]] = -np.inf
    repeated = len(np.unique(ids)) < len(ids)
    cut = min(k, len(ids)) - 1
    edge = -np.partition(-rough, cut, axis=1)[:, cut]
    slack = 1e-9 * (np.linalg.norm(asks, axis=1) * np.linalg.norm(rows, axis=1).max())
    q, r = np.nonzero((rough > -np.inf) & ((rough >= (edge - slack)[:, None]) | repeated))
    exact = np.concatenate([(asks[q[i : i + 65536]] * rows[r[i : i + 65536]]).sum(axis=1) for i in range(0, max(len(q), 1), 65536)])
    exact = np.where(np.isnan(exact), -np.inf, exact)
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    if repeated:
        first = np.sort(np.unique(np.column_stack([q, ids[r]]), axis=0, return_index=True)[1])
        q, r, exact = q[first], r[first], exact[first]
    starts = np.searchsorted(q, np.arange(len(queries)))
    won = np.arange(len(q)) - starts[q] < k
    return queries[q[won]], ids[r[won]], exact[won]


def leading(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of what was found in several blocks, ids once at their best score."""
    order = np.lexsort((-scores, ids, q))
    q, ids, scores = q[order], ids[order], scores[order]
    once = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]))[: len(q)]
    q, ids, scores = q[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    won = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[won], ids[won], scores[won]


def _searched(blocks: DataFrame, dims: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's best rows of the blocks it meets in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, ids = None, [], []
        held, size = [], 0

        def merged() -> list[np.ndarray]:
            return list(leading(*(np.concatenate([h[i] for h in held]) for i in range(3)), k))

        def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.column_stack([batch.column(c).to_numpy() for c in ("curve", "block", "kind")])
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1), True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part, group = batch.slice(a, b - a), tuple(at[a][:2])
                if group != now:
                    now, rows, ids = group, [], []
                x, own = matrix(part.column("vector"), dims), part.column("vec_id").to_numpy()
                if at[a][2] == 0:
                    rows.append(x)
                    ids.append(own)
                elif rows:
                    if len(rows) > 1:
                        rows, ids = [np.concatenate(rows)], [np.concatenate(ids)]
                    for i in range(0, len(own), 512):
                        held.append(best_of(own[i : i + 512], x[i : i + 512], rows[0], ids[0], k))
                        size += len(held[-1][0])
                        if size > HELD:
                            held = [merged()]
                            size = len(held[0][0])
                            if 2 * size > HELD:
                                yield batch_of(held[0])
                                held, size = [], 0
        if size:
            yield batch_of(merged())

    return blocks.mapInArrow(lean(run), "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", reach: float = REACH, curves: int = CURVES, block: int = BLOCK, sample: int = SAMPLE, seed: int = 42
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows found nearest to each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("same", F.xxhash64("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, dims, longest = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(F.sqrt(square))).first()
    if not n:
        return spark.createDataFrame([], OUT)
    index = Curves(dims, longest, seed, curves)
    some = rows.where(F.pmod(F.xxhash64("vec_id", "same"), F.lit(max(1, n // sample))) == 0).select("vector").limit(4 * sample).toArrow()
    taken = matrix(some.column("vector").combine_chunks(), dims) if some.num_rows else np.zeros((0, dims))
    share = 1.0
    if len(taken) > 1:
        index.measure(taken)
        share = share_of_places(index, taken, max(1, -(-k * len(taken) // n)), reach)
    width = min(n, max(int(np.ceil(share * n)), 2 * k))

    found, parts = [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    for at in range(0, curves, AT_ONCE):
        table = written(_numbered(_keyed(rows, index, list(range(at, min(at + AT_ONCE, curves))), every), k + 1), "nearest-places")
        sizes = sorted(map(tuple, table.groupBy("curve", "part").agg(F.count_if(F.col("kind") == 0)).collect()))  # one row a curve and range
        starts, total = [], {}
        for c, part, size in sizes:
            starts.append((c, part, total.get(c, 0)))
            total[c] = total.get(c, 0) + size
        ends = F.create_map(*(F.lit(v) for item in total.items() for v in item))[F.col("curve")]
        placed = table.join(F.broadcast(spark.createDataFrame(starts, "curve int, part int, start long")), ["curve", "part"])
        placed = placed.withColumn("place", F.least(F.col("start") + F.col("idx"), ends - 1))
        low, high = F.greatest(F.col("place") - width, F.lit(0)), F.least(F.col("place") + width, ends - 1)
        met = F.when(F.col("kind") == 0, F.array(F.expr(f"place div {block}"))).otherwise(F.sequence(F.floor(low / block), F.floor(high / block)))
        blocks = placed.select("curve", F.explode(met).alias("block"), "kind", "vec_id", "vector")
        blocks = blocks.repartitionByRange(parts, "curve", "block").sortWithinPartitions("curve", "block", "kind", "vec_id")
        found.append(written(_searched(blocks, dims, k), "nearest-found"))
        discard(table)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
