"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints of 64 bits that differ in at most ``distance`` bits are linked. The bits are put into m groups,
correlated bits together; group i gets a threshold t_i with sum(t_i) = distance - m + 1, so that of any two
linked fingerprints the projections on some group differ in at most t_i bits (t_i = -1: never looked at).
Thresholds come from dynamic programming over estimated candidate counts; the m with the least cost is taken.
A fingerprint is looked up under each value within t_i bits of its projection, and candidates are verified.

Equal fingerprints are one class from the start. A value that many fingerprints share (``hot``) isn't joined:
its members are divided by the bits not yet fixed, parts that are still large by the bits left after that, and each part yields a
spanning forest of its links, so what is emitted grows with the members and not with their pairs. No link between classes is lost.

Defined cases: null or empty text has no shingle and fingerprint zero; null doc_id takes part and is never the
smallest unless alone (then component_id is null); repeated rows each give a row; clashing extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh_worker, lean, written

BITS = 64
#: Fingerprints under one value beyond which members are not joined with each other.
HOT = 48
#: Fingerprints of a part beyond which it's divided by further bits, and how often at most.
PART, LEVELS = 4096, 3
#: Cost of a candidate against that of a row looked up, for the choice of groups.
CANDIDATE_COST = 4.0
#: Shingles hashed at a time, so that memory doesn't follow the length of a text.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits: bit b is set if over half of the shingles' XXH64 (seed 42) have it."""
    import xxhash

    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
    if len(split) <= words:
        starts, stops = [0], [len(joined)]
    else:
        stops = ends[words - 1 :] - 1
        starts = np.concatenate(([0], ends[: len(split) - words]))
        starts, stops = starts.tolist(), stops.tolist()
    one, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = slice(at, at + CHUNK)
        hashes = np.array([one(joined[a:b], 42) for a, b in zip(starts[part], stops[part], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(starts)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The signed number whose bit b is set if over half of the hashes have it; zero of none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        raw = np.ascontiguousarray(hashes[at : at + CHUNK].astype("<i8"))
        counts += np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, fp) with fp the fingerprint's bits as a signed long; tag is a hash of the id and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(fps)], ["doc_id", "tag", "fp"])

    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[id_col], docs[text_col]).alias("tag"), docs[text_col].alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, tag long, fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits; one row of bounded size from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            raw = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8"))
            x = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(lean(run), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return out


def group_bits(both: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Bits in groups of about equal size: each group is grown from a free bit by its most correlated free bits."""
    n = max(n, 1)
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    free, out = set(range(BITS)), []
    for g in range(groups):
        size = BITS // groups + (g < BITS % groups)
        own = [min(free, key=lambda b: (spread[b], b))]
        free.discard(own[0])
        while len(own) < size:
            best = max(sorted(free), key=lambda b: corr[b, own].sum())
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def allocate(estimates: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one for each group, that add up to ``total`` at the least estimated cost.

    ``estimates[i][t + 1]`` is the cost of threshold t for group i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in estimates:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(costs, -1):
                if used + t not in then or cost + c < then[used + t][0]:
                    then[used + t] = (cost + c, [*chosen, t])
        best = then
    return best[total]


def _ball(width: int, t: int) -> list[int]:
    return [sum(1 << b for b in chosen) for k in range(t + 1) for chosen in combinations(range(width), k)]


def _gather(fp, bits: list[int]):
    """The bits of fp at the given places, packed; runs of neighbouring bits move together."""
    out, at = None, 0
    while at < len(bits):
        end = at
        while end + 1 < len(bits) and bits[end + 1] == bits[end] + 1:
            end += 1
        width = end - at + 1
        part = F.shiftrightunsigned(fp, bits[at])
        if width < BITS:
            part = part.bitwiseAND(F.lit((1 << width) - 1))
        part = F.shiftleft(part, at) if at else part
        out = part if out is None else out.bitwiseOR(part)
        at = end + 1
    return out


def plan_groups(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is looked at, for distinct ``fps(fp)``."""
    n = fps.count()
    both = bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    ratio = 2 * p * (1 - p) / np.maximum(p * p + (1 - p) ** 2, 1e-9)
    choices = {m: group_bits(both, n, m) for m in range(2, distance + 1)} or {1: [list(range(BITS))]}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), _gather(F.col("fp"), bits).alias("key")) for m, groups in choices.items() for i, bits in enumerate(groups)]
    same = fps.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.m", "k.i", "k.key").count()
    same = {(r["m"], r["i"]): float(r["pairs"]) for r in same.groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1)).alias("pairs")).collect()}
    best = None
    for m, groups in choices.items():
        total = distance - m + 1
        estimates = []
        for i, bits in enumerate(groups):
            costs, grown = [0.0], 1.0
            for t in range(total + m):
                if t:
                    grown += float(ratio[bits].sum()) ** t / np.prod(range(1, t + 1))
                # pairs with equal projections, and what pairs of values a few bits apart add if bits vary freely
                chance = n * n * len(_ball(len(bits), t)) / 2.0 ** len(bits) if t else 0.0
                costs.append(n * (1.0 + len(_ball(len(bits), t))) + CANDIDATE_COST * max(same.get((m, i), 0.0) * (grown if t == 0 else 1.0), chance))
            estimates.append(costs)
        cost, chosen = allocate(estimates, total)
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _forest(distance: int):
    """Spanning forests of the links within runs of equal ``run``: each fingerprint found is searched from once."""

    def links(x: np.ndarray) -> tuple[list, list]:
        a, b, rest = [], [], np.unique(x)
        todo: list = []
        while len(rest):
            if not todo:
                todo, rest = [rest[0]], rest[1:]
            at = todo.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= distance  # of signed numbers it would count the absolute value's bits
            found = rest[near]
            if len(found):
                a.append(np.full(len(found), at, np.int64))
                b.append(found)
                todo.extend(found)
                rest = rest[~near]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done():
            a, b = links(np.concatenate(held)) if held else ([], [])
            if a:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            return None

        for batch in batches:
            keys = batch.column("run").to_numpy()
            values = batch.column("fp").to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if hi == lo:
                    continue
                if key is None or keys[lo] != key:
                    if (out := done()) is not None:
                        yield out
                    held, key = [], keys[lo]
                held.append(values[lo:hi])
        if (out := done()) is not None:
            yield out

    return run


def links(fps: DataFrame, distance: int = 3, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct ``fps(fp)`` that connect whatever is within ``distance`` bits."""
    groups = plan_groups(fps, distance)
    fp = F.col("fp")
    own = [F.struct(F.lit(i).alias("g"), _gather(fp, bits).alias("key")) for i, (bits, _) in enumerate(groups)]
    index = fps.select(fp, F.explode(F.array(*own)).alias("k")).select("fp", "k.g", "k.key")
    probes = []
    for i, (bits, t) in enumerate(groups):
        masks = F.array(*(F.lit(m).cast("long") for m in _ball(len(bits), t)))
        probes.append(fps.select(fp, F.lit(i).alias("g"), F.explode(masks).alias("mask")).select("fp", "g", _gather(fp, bits).bitwiseXOR(F.col("mask")).alias("key")))
    probe = probes[0]
    for more in probes[1:]:
        probe = probe.union(more)
    crowded = written(index.groupBy("g", "key").count().where(F.col("count") > hot).select("g", "key"), "crowded")
    sparse = index.join(crowded, ["g", "key"], "left_anti").withColumnRenamed("fp", "b")
    pairs = probe.withColumnRenamed("fp", "a").join(sparse, ["g", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    edges = pairs.select("a", "b")
    if crowded.limit(1).count():
        # whoever looks there, the members themselves included
        members = written(probe.join(crowded, ["g", "key"]), "members")
        most = members.groupBy("g", "key").count().agg(F.max("count")).first()[0]
        rows = members.select("fp", F.col("g").cast("string").alias("fixed"), F.xxhash64("g", "key").alias("run"))
        known = {str(i): [b for b in range(BITS) if b not in set(bits)] or list(range(BITS)) for i, (bits, _) in enumerate(groups)}
        for part in _divided(rows, known, distance, most):
            n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            part = part.select("fp", "run").repartition(n, "run").sortWithinPartitions("run")
            edges = edges.union(part.mapInArrow(lean(_forest(distance)), "a long, b long"))
    return edges


def _divided(rows: DataFrame, left: dict[str, list[int]], distance: int, most: int) -> Iterator[DataFrame]:
    """``rows(fp, fixed, run)`` cut into parts, given as tables of the same columns: two fingerprints of a run within ``distance`` bits
    agree on one of ``distance + 1`` segments of the bits that aren't fixed, so one part of each division holds both.

    ``fixed`` names the bits a run has fixed and ``left`` lists the others of each name; no run is larger than ``most``. Parts larger than
    PART are divided again, by the bits still left; what is left of them after LEVELS divisions is given as it is.
    """
    for level in range(1, LEVELS + 1):
        cases, then = None, {}
        for name, bits in left.items():
            cuts = [k * len(bits) // (distance + 1) for k in range(distance + 2)]
            segments = [bits[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
            then |= {f"{name}.{s}": [b for b in bits if b not in set(segment)] for s, segment in enumerate(segments)}
            keys = F.array(*(F.struct(F.lit(f"{name}.{s}").alias("fixed"), F.xxhash64("run", F.lit(s), _gather(F.col("fp"), segment)).alias("run")) for s, segment in enumerate(segments)))
            cases = F.when(F.col("fixed") == name, keys) if cases is None else cases.when(F.col("fixed") == name, keys)
        left = {name: bits for name, bits in then.items() if len(bits) > distance}
        rows = rows.select("fp", F.explode(cases).alias("part")).select("fp", "part.*")
        if most <= PART or level == LEVELS or not left:
            yield rows
            return
        rows = written(rows, "parts")
        # runs with too few bits left for another division hold few fingerprints: those near a value in the group's own bits
        large = written(rows.where(F.col("fixed").isin(*left)).groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > PART), "large")
        most = large.agg(F.max("n")).first()[0] or 0
        yield rows.join(large, "run", "left_anti")
        if not most:
            return
        rows = rows.join(large, "run", "left_semi")


def _components(rows: DataFrame, distance: int, hot: int) -> DataFrame:
    """(fp, root) of each distinct fp of ``rows``."""
    classes = written(rows.select("fp").distinct(), "classes")
    roots = written(components(links(classes, distance, hot)), "roots")
    return written(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "named")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row."""
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    named = _components(rows, distance, hot)
    # a class first, so that a component's ids come together as one number for each class
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "root").select("fp", "component_id")
    return rows.join(answer, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, rows: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of ``docs`` the row of the least id of each root; ``rows(doc_id, tag, fp)`` are their classes, ``named(fp, root)`` the classes' roots.

    Of rows that agree in id and text one stays, whichever comes first.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")
    best = rows.groupBy("fp").agg(F.min(order).alias("best")).join(named, "fp").groupBy("root").agg(F.min("best").alias("best"))
    best = best.select(F.col("best.tag").alias("kept tag"), F.col("best.doc_id").alias("kept id"))
    tagged = docs.withColumn("row tag", F.xxhash64(docs[id_col], docs[text_col]))
    kept = tagged.join(best, (tagged["row tag"] == best["kept tag"]) & tagged[id_col].eqNullSafe(best["kept id"]), "left_semi")
    # whole rows are compared only if a row is there twice
    if rows.groupBy("doc_id", "tag").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["row tag", id_col])
    return kept.select(*docs.columns)


def deduplicated(docs: DataFrame, words: int = 3, distance: int = 3, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the least id, null ids last."""
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    named = _components(rows, distance, hot)
    return first_of_each(docs, rows, named, id_col, text_col)
