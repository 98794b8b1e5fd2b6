"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of the whole text, hashed to ``SLOTS``. Slots that chi-squared over the
training rows can't tell from chance are left out, so that a long text isn't a sum of noise; the machine has a weight for
each other slot, however many they are, and a vector of ``RANK`` factors, whose inner products weigh pairs of slots: an
insult together with a group's name counts for more, or less, than the two apart.

The classifier is fitted on at most ``SAMPLE`` labelled documents, those with the least hash of their id, so which are
taken does not depend on how the table is laid out. Every text is scored whole.

Defined cases: null and empty text have no terms and get the score of the bias; a null label is no label; a
document labelled more than once counts as toxic if one label says so; of an id with several texts one is learnt from, that
of the least list of slots; a null doc_id is held out; without labels of both kinds every score is the share of label 1 (0 without labels); repeated rows each give a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_worker, lean

SLOTS = 1 << 20
#: Chi-squared that one slot in a thousand reaches by chance.
TELLING = 10.8
RANK = 4
#: Most labelled documents that the classifier is fitted on.
SAMPLE = 30_000
EPOCHS = 30
WORDS = re.compile(r"\w+")


def _slots():
    """A function from a text to the sorted distinct slots of its terms."""
    import xxhash

    fresh_worker()
    known: dict[str, int] = {}

    def slots(text: str | None) -> np.ndarray:
        if len(known) > 200_000:
            known.clear()
        found = set(WORDS.findall((text or "").lower()))
        for w in [w for w in found if w not in known]:
            known[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) & (SLOTS - 1)
        return np.unique(np.fromiter((known[w] for w in found), np.int32, len(found)))

    return slots


class Machine:
    """Kept slots, bias, weights and factors."""

    def __init__(self, kept: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.kept, self.bias, self.weights, self.factors = kept, bias, weights, factors

    def raw(self, at: np.ndarray) -> float:
        """The score before the logistic function of a row that has the kept slots ``at``."""
        v = self.factors[at]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (s * s - (v * v).sum(axis=0)).sum())


def gradient(slots: np.ndarray, of_row: np.ndarray, y: np.ndarray, weight: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradient of the weighted mean logistic loss by bias, weights and factors; row ``of_row[k]`` has ``slots[k]``."""
    rows, rank = len(y), v.shape[1]

    def by_row(z):
        return np.bincount(of_row, z, rows).astype(w.dtype)

    def by_slot(z):
        return np.bincount(slots, z, len(w)).astype(w.dtype)

    vx = v[slots]
    s = np.stack([by_row(vx[:, f]) for f in range(rank)], axis=1)
    z = bias + by_row(w[slots]) + 0.5 * ((s * s).sum(axis=1) - by_row((vx * vx).sum(axis=1)))
    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / rows
    gx = g[of_row]
    gv = np.stack([by_slot(gx * (s[of_row, f] - vx[:, f])) for f in range(rank)], axis=1)
    return np.array([g.sum()], w.dtype), by_slot(gx), gv


def fit(rows: list[np.ndarray], y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 42) -> Machine:
    """Fit on slot lists and labels with Adam on the logistic loss; the classes weigh the same in sum."""
    y = y.astype(np.float32)
    n, pos = len(y), float(y.sum())
    if not pos or pos == n:
        share = pos / n if n else 0.0
        bias = np.inf if share == 1 else -np.inf
        return Machine(np.zeros(0, np.int32), bias, np.zeros(0, np.float32), np.zeros((0, rank), np.float32))
    slots = np.concatenate(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    a = np.bincount(slots, weights=y[owner], minlength=SLOTS)
    df = np.bincount(slots, minlength=SLOTS).astype(float)
    gap = a * n - df * pos
    chi = np.where((df > 1) & (df < n), gap**2 / np.maximum(df * (n - df) * pos * (n - pos) / n, 1e-9), 0.0)
    best = np.flatnonzero(chi > TELLING).astype(np.int32)
    place = np.full(SLOTS, -1, np.int32)
    place[best] = np.arange(len(best))
    columns = [q[q >= 0] for q in (place[r] for r in rows)]
    rng = np.random.default_rng(seed)
    bias, w, v = np.array([np.log(pos / (n - pos))], np.float32), np.zeros(len(best), np.float32), rng.normal(0, 0.02, (len(best), rank)).astype(np.float32)
    state = {k: [np.zeros_like(z), np.zeros_like(z)] for k, z in (("b", bias), ("w", w), ("v", v))}
    weight = np.where(y > 0, 0.5 * n / pos, 0.5 * n / (n - pos)).astype(np.float32) ** 0.5
    step, rate, decay = 0, 0.05, 2e-4

    def adam(key, value, grad):
        m, s = state[key]
        m += 0.1 * (grad - m)
        s += 0.001 * (grad * grad - s)
        return value - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)

    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 512):
            part = order[at : at + 512]
            of_row = np.repeat(np.arange(len(part)), [len(columns[i]) for i in part])
            gb, gw, gv = gradient(np.concatenate([columns[i] for i in part]), of_row, y[part], weight[part], bias[0], w, v)
            step += 1
            bias, w, v = adam("b", bias, gb), adam("w", w, gw + decay * w), adam("v", v, gv + decay * v)
    return Machine(best, float(bias[0]), w, v)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit on labelled rows whose crc32(id as text) mod 5 isn't 0."""
    key = labels[id_col].cast("string")
    chosen = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("y"), F.crc32(key.cast("binary")).alias("crc"))
    chosen = chosen.where((F.col("crc") % 5 != 0) & F.col("y").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _slots()
        for batch in batches:
            got = pa.array([slots(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("doc_id"), got], ["y", "doc_id", "slots"])

    # at most ``sample`` rows of two numbers: a bound that doesn't grow with the data
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "doc_id")
    got = texts.select("y", "doc_id", "text").mapInArrow(lean(terms), "y int, doc_id long, slots array<int>")
    # one row an id, so that the bound holds for what comes to the driver too
    got = got.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("slots").alias("slots")).orderBy("doc_id").toArrow()
    rows = [np.asarray(r.values.to_numpy(), np.int32) for r in got.column("slots")]
    return fit(rows, got.column("y").to_numpy().astype(np.int64))


def score(docs: DataFrame, machine: Machine, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The given columns of ``docs`` with the score and the prediction of each whole text, called ``names``."""
    kept, bias, weights, factors = machine.kept, machine.bias, machine.weights, machine.factors
    columns = list(columns)
    place_of_text = columns.index(text_col) if text_col in columns else len(columns)
    taken = docs.select(*(docs[c] for c in columns), *([] if text_col in columns else [docs[text_col]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slots = Machine(kept, bias, weights, factors), _slots()
        place = np.full(SLOTS, -1, np.int32)
        place[kept] = np.arange(len(kept))
        for batch in batches:
            z = []
            for text in batch.column(place_of_text):
                at = place[slots(text.as_py())]
                z.append(model.raw(at[at >= 0]))
            s = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*columns, *names])

    schema = T.StructType([*(taken.schema[c] for c in columns), T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return taken.mapInArrow(lean(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    scored = score(docs, learn(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    scored = score(docs, learn(docs, labels), tuple(docs.columns), names=("toxic score", "toxic class"))
    return scored.where(F.col("toxic class") == 0).select(*docs.columns)
