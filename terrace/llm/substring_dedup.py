"""Substring deduplication by super-k-mers: windows of ``window`` words that also start in an earlier document go.

A window's minimiser is the least hash of its ``MER``-word runs. Consecutive windows with one minimiser are a
super-k-mer; equal windows have equal minimisers, so they meet in the minimiser's bucket. A first pass sends nothing
but minimisers: only those met in two documents can hold a shared window, and only their super-k-mers are packed and
sent. Equal packed strings are combined before the shuffle into one with the least document id; in a bucket the
windows of all strings are sorted, which tells equal ones exactly, and each gets the least id of its equals.

A bucket with too many distinct strings to be sorted in one task (a passage in very many different surroundings) is cut
finer by the same steps, with minimisers of more words: those have shorter super-k-mers and more buckets, and with runs of a
whole window each window has a bucket of its own.

Defined cases: null or empty text has no words (its digest is that of no bytes); null doc_id counts as larger than any
other, and null ids as equal; of repeated rows none counts as smaller; words of a text are in no window if it has
fewer than ``window``; clashing extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, is_small, lean, written

WINDOW = 50
MER = 8
#: Windows in one packed string at most; longer runs of one minimiser are cut.
RUN = 256
#: Words of a minimiser, and distinct strings up to which its bucket is sorted at once; what is over goes on to the next.
LEVELS = ((MER, 500), (25, 8_000), (WINDOW, None))
FEW = 200_000
#: Windows sorted together.
SORTED = 20_000
LAST = (1 << 63) - 1
_A = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_A), n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes, by doubling."""
    out, done, part, length = None, 0, words, 1
    count = len(words) - size + 1
    while True:
        if size & length:
            piece = part[done : done + count]
            out = piece.copy() if out is None else out * _power(length) + piece
            done += length
        if length * 2 > size:
            return _mixed(out)
        part = part[: len(part) - length] * _power(length) + part[length:]
        length *= 2


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    length = 1
    while length * 2 <= size:
        x = np.minimum(x[: len(x) - length], x[length:])
        length *= 2
    rest = size - length
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class _Words:
    """Hashes of words, kept between texts."""

    def __init__(self):
        import xxhash

        self.known: dict[bytes, int] = {}
        self.one = xxhash.xxh64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 200_000:
            self.known.clear()
        known, one = self.known, self.one
        for w in set(words):
            if w not in known:
                known[w] = one(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def super_kmers(hashes: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and minimisers."""
    if len(hashes) < window:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    least = sliding_min(run_hashes(hashes, mer), window - mer + 1)
    cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    sizes = np.diff(np.append(cut, len(least)))
    if sizes.max() > RUN:
        more = [np.arange(a, a + n, RUN) for a, n in zip(cut, sizes, strict=True)]
        cut = np.concatenate(more)
        sizes = np.diff(np.append(cut, len(least)))
    return cut.astype(np.int32), sizes.astype(np.int32), least[cut].view(np.int64)


def _scan(window: int, mer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Words()
        for batch in batches:
            n, sha, lists = [], [], ([], [], [])
            for text in batch.column("text"):
                words = split(text.as_py())
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                for held, got in zip(lists, super_kmers(hashed(words), window, mer), strict=True):
                    held.append(got)
            kinds = (pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(sha), *(pa.array(x, pa.list_(k)) for x, k in zip(lists, kinds, strict=True))],
                ["doc_id", "tag", "n_words", "sha", "start", "n", "minimiser"],
            )

    return run


def _pack(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag, text, runs in zip(batch.column("doc"), batch.column("tag"), batch.column("text"), batch.column("runs"), strict=True):
                words, runs = split(text.as_py()), runs.as_py()
                packed = [b" ".join(words[r["start"] : r["start"] + r["n"] + window - 1]) for r in runs]
                m = len(runs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["minimiser"] for r in runs], pa.int64()), pa.array([hashlib.sha256(p).digest() for p in packed], pa.binary()), pa.array(packed, pa.binary()),
                        pa.array([doc.as_py()] * m, pa.int64()), pa.array([tag.as_py()] * m, pa.int64()), pa.array([r["start"] for r in runs], pa.int32()), pa.array([r["n"] for r in runs], pa.int32()),
                    ],
                    ["minimiser", "key", "packed", "doc", "tag", "start", "n"],
                )

    return run


def _least(window: int):
    """For rows sorted by minimiser: the least id of each window of each packed string."""

    def solve(rows: list[tuple]) -> list[np.ndarray]:
        ids: dict[bytes, int] = {}
        views, owner = [], []
        for k, (_, _, packed, _) in enumerate(rows):
            words = packed.split(b" ")
            at = np.array([ids.setdefault(w, len(ids)) for w in words], np.int32)
            view = np.lib.stride_tricks.sliding_window_view(at, window)
            views.append(view)
            owner.append(np.full(len(view), k))
        owner = np.concatenate(owner)
        _, same = np.unique(np.ascontiguousarray(np.concatenate(views)).view(np.dtype((np.void, 4 * window))).ravel(), return_inverse=True)
        docs = np.array([r[3] for r in rows], np.int64)[owner]
        least = np.full(same.max() + 1, LAST, np.int64)
        np.minimum.at(least, same, docs)
        return np.split(least[same], np.flatnonzero(np.diff(owner)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_, size = [], [], 0

        def out(rows, many):
            found: list = [None] * len(rows)
            todo = [k for k, m in enumerate(many) if m]
            for k, got in zip(todo, solve([rows[k] for k in todo]) if todo else [], strict=True):
                found[k] = got
            for k, r in enumerate(rows):
                if found[k] is None:
                    found[k] = np.full(r[2].count(b" ") + 2 - window, r[3], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["minimiser", "key", "least"]
            )

        done: list[tuple] = []
        many: list[bool] = []

        def close():
            nonlocal size
            done.extend(open_)
            many.extend([len(open_) > 1] * len(open_))
            size += sum(r[2].count(b" ") for r in open_)
            open_.clear()

        del held
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("minimiser", "key", "packed", "doc")), strict=True):
                if open_ and row[0] != open_[0][0]:
                    close()
                    if size > SORTED:
                        yield out(done, many)
                        done, many, size = [], [], 0
                open_.append(row)
        close()
        if done:
            yield out(done, many)

    return run


def _spans(window: int):
    """Rows (doc, tag, start, least) to spans of words that windows with a smaller least id cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc, tag, start, least in zip(*(batch.column(c) for c in ("doc", "tag", "start", "least")), strict=True):
                doc, start = doc.as_py(), start.as_py()
                gone = np.flatnonzero(least.values.to_numpy() < doc)
                if len(gone):
                    cuts = np.flatnonzero(np.diff(gone) > 1)
                    for a, b in zip(gone[np.append(0, cuts + 1)], gone[np.append(cuts, len(gone) - 1)], strict=True):
                        for held, x in zip(out, (doc, tag.as_py(), start + int(a), start + int(b) + window), strict=True):
                            held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc", "tag", "lo", "hi"])

    return run


def _keep(words: list[bytes], spans: list[dict]) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        gone[s["lo"]] += 1
        gone[s["hi"]] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n = [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = split(text.as_py())
            left = _keep(words, spans.as_py())
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            n.append(len(words) - len(left))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(kept, pa.string()), pa.array(n, pa.int64())], ["doc", "tag", "kept", "n_removed"])


def _finer(window: int, mer: int):
    """Packed strings to super-k-mers of longer minimisers: (doc, tag, start, n, minimiser)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Words()
        for batch in batches:
            held: list[list[np.ndarray]] = [[], [], [], [], []]
            for packed, *own in zip(*(batch.column(c) for c in ("packed", "doc", "tag", "start")), strict=True):
                doc, tag, start = (x.as_py() for x in own)
                starts, n, minimisers = super_kmers(hashed(packed.as_py().split(b" ")), window, mer)
                for column, x in zip(held, (np.full(len(n), doc), np.full(len(n), tag), starts + np.int32(start), n, minimisers), strict=True):
                    column.append(x)
            if held[0]:
                kinds = (np.int64, np.int64, np.int32, np.int32, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip(held, kinds, strict=True)], ["doc", "tag", "start", "n", "minimiser"])

    return run


def _bucketed(texts: DataFrame, runs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``texts`` with ``runs`` whose minimiser two documents have, (minimiser, key, packed, doc, tag, start, n) of such runs, and each
    string's least doc."""
    shared = runs.groupBy("minimiser").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("minimiser")
    runs = runs.join(shared, "minimiser").groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "n", "minimiser")).alias("runs"))
    texts = written(texts.join(runs, ["doc", "tag"]), "texts")
    packed = texts.mapInArrow(lean(_pack(window)), "minimiser long, key binary, packed binary, doc long, tag long, start int, n int")
    packed = written(packed, "packed")
    return texts, packed, written(packed.groupBy("minimiser", "key", "packed").agg(F.min("doc").alias("doc")), "strings")


def _covered(packed: DataFrame, strings: DataFrame, window: int) -> DataFrame:
    """(doc, tag, lo, hi): spans of windows that ``strings`` show to start in a smaller document too."""
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = strings.repartition(parts, "minimiser").sortWithinPartitions("minimiser")
    least = dealt.mapInArrow(lean(_least(window)), "minimiser long, key binary, least array<long>")
    met = packed.select("minimiser", "key", "doc", "tag", "start").join(least, ["minimiser", "key"])
    return met.select("doc", "tag", "start", "least").mapInArrow(lean(_spans(window)), "doc long, tag long, lo int, hi int")


def removals(docs: DataFrame, window: int = WINDOW, levels: tuple = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc, tag, n_words, sha) of each row, and (doc, tag, kept, n_removed) of each text that loses words."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("tag"), docs["text"].alias("text"))
    scanned = rows.mapInArrow(lean(_scan(window, levels[0][0])), "doc_id long, tag long, n_words long, sha string, start array<int>, n array<int>, minimiser array<long>")
    scanned = written(scanned.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))), "super-k-mers")
    texts = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "tag", "text")
    runs = scanned.select("doc", "tag", F.explode(F.arrays_zip("start", "n", "minimiser")).alias("r")).select("doc", "tag", "r.*")
    texts, packed, strings = _bucketed(texts, runs, window)
    gone, first = None, texts
    for k, (_, most) in enumerate(levels):
        crowded = strings.groupBy("minimiser").count().where(F.col("count") > most if most is not None else F.lit(False)).select("minimiser")
        crowded = written(crowded, "crowded")
        few = F.broadcast(crowded) if is_small(crowded, FEW) else crowded
        spans = written(_covered(packed, strings.join(few, "minimiser", "left_anti"), window), "spans")
        gone = spans if gone is None else gone.union(spans)
        if not crowded.limit(1).count():
            break
        finer = packed.join(few, "minimiser").mapInArrow(lean(_finer(window, levels[k + 1][0])), "doc long, tag long, start int, n int, minimiser long")
        finer = written(finer, "finer")
        discard(packed, strings, crowded)
        again, packed, strings = _bucketed(first.drop("runs"), finer, window)
        discard(finer, again)
    discard(packed, strings, crowded)

    spans = gone.groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    cut = first.select("doc", "tag", "text").dropDuplicates(["doc", "tag"]).join(spans, ["doc", "tag"])
    cut = cut.mapInArrow(lean(_remove), "doc long, tag long, kept string, n_removed long")
    return scanned.select("doc_id", "doc", "tag", "n_words", "sha"), cut


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row."""
    rows, cut = removals(docs, window)
    cut = cut.select("doc", "tag", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha"))
    out = rows.join(cut, ["doc", "tag"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the remaining words, joined by one space, where a text loses words; other texts as they are."""
    _, cut = removals(docs, window)
    keyed = docs.withColumn("doc tag", F.xxhash64("text")).withColumn("doc key", F.coalesce("doc_id", F.lit(LAST)))
    cut = cut.select(F.col("doc").alias("doc key"), F.col("tag").alias("doc tag"), F.col("kept").alias("kept text"))
    out = keyed.join(cut, ["doc key", "doc tag"], "left").withColumn("text", F.coalesce("kept text", "text"))
    return out.select(*docs.columns)
