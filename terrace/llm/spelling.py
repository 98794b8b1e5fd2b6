"""Groups of spelling variants: words that differ by one inserted, deleted or replaced code point.

Words are counted in the JVM and numbered in the order of their code points. Each word then gives a key for itself and
one for each code point left out (one for a run of equal ones): prefix and suffix polynomials over the word, joined, so
all keys of a word cost one pass of NumPy over whole batches. Keys are dealt by their top bits and sorted; runs of one
key and more than one word are candidates, the rest go. Candidates get their strings back, the shortened strings are
compared in place of their keys, and what shares one is near. All other steps carry numbers only.

Words that share a shortened string and the place left out are all near each other. Such a group is counted and its word
of largest n found by aggregates; its pairs are never listed. A group has at most as many members as the alphabet
has letters for each place of the string, whatever the data.

Defined cases: null text has no words; a null doc_id counts as an empty string in ``<doc_id>:<run>``; repeated rows count
again; ties go to the smallest word by code points. A very long run is a word like any other: its keys carry its number and
not its letters. Clashing extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh_worker, lean, written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point.
SPOILT = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Odd multiplier of the polynomials, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bits of a key that choose its partition.
RADIX = 12
#: Code points whose keys are made at a time.
CHUNK = 1 << 18


def spoilt(doc_id: Column, run: Column) -> Column:
    """The run without one code point where the hash of document and run says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SPOILT == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words long and frequent enough."""
    runs = docs.select(docs["doc_id"].alias("doc_id"), F.explode(F.regexp_extract_all(docs["text"], F.lit(RUN), F.lit(0))).alias("run"))
    # a run that can't be long enough after the cut is left out before anything is hashed
    runs = runs.where(F.length("run") >= LEAST_LENGTH).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    word = runs.select(spoilt(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return word.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of SplitMix64, on unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words whose code points follow each other in ``codes``: keys, word numbers, first places left out (-1: none),
    and how many places in a row give the same string.

    The polynomial of a word is the sum of value * BASE**place. Left of the gap it is the prefix's sum, right of it the
    suffix's sum moved one place down by BASE's inverse; both come from one running sum, modulo 2**64.
    """
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - starts[word]
    steps = np.full(int(sizes.max(initial=0)) + 1, BASE, np.uint64)
    steps[0] = 1
    term = mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.cumprod(steps)[place]
    through = np.cumsum(term)
    base = (through - term)[starts]
    total = through[starts + sizes - 1] - base
    begins = np.flatnonzero((place == 0) | np.r_[True, codes[1:] != codes[:-1]])
    own = word[begins]
    prefix = through[begins] - term[begins] - base[own]
    gap = prefix + (total[own] - prefix - term[begins]) * np.uint64(INVERSE)
    spans = np.diff(np.r_[begins, len(codes)])
    none = np.full(len(sizes), -1)
    return mixed(np.concatenate([total, gap])).view(np.int64), np.r_[np.arange(len(sizes)), own], np.r_[none, place[begins]], np.r_[-none, spans]


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """(key, id, at, span): one row for each word itself and for each string that a code point left out gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            texts, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
            a = 0
            while a < len(texts):
                b, held = a + 1, len(texts[a])
                while b < len(texts) and held + len(texts[b]) <= CHUNK:
                    held += len(texts[b])
                    b += 1
                codes = np.frombuffer("".join(texts[a:b]).encode("utf-32-le"), "<u4")
                keys, word, at, span = deletion_keys(codes, np.fromiter(map(len, texts[a:b]), np.int64, b - a))
                for i in range(0, len(keys), CHUNK):
                    part = slice(i, i + CHUNK)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(ids[a:b][word[part]]), pa.array(at[part].astype(np.int32)), pa.array(span[part].astype(np.int32))], ["key", "id", "at", "span"])
                a = b

    return vocabulary.mapInArrow(lean(run), "key long, id long, at int, span int")


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows of keys that more than one word has; keys are dealt by their top bits and sorted."""
    names = ["key", "id", "at", "span"]

    def kept(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, word = rows[:2]
        new_key = np.r_[True, key[1:] != key[:-1]][: len(key)]
        new_word = new_key | np.r_[True, word[1:] != word[:-1]][: len(key)]
        several = (np.bincount(np.cumsum(new_key)[new_word] - 1) > 1)[np.cumsum(new_key) - 1] if len(key) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(x[several]) for x in rows], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the last key so far: more of it may follow
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in names]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if len(now[0]):
                cut = int(np.searchsorted(now[0], now[0][-1]))
                rest = [x[cut:] for x in now]
                yield kept([x[:cut] for x in now])
        if rest is not None:
            yield kept(rest)

    dealt = keyed.repartition(F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key", "id", "at")
    return dealt.mapInArrow(lean(run), "key long, id long, at int, span int")


def _near(vocabulary: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near, and (-n, id) of the one of largest n."""
    whole = F.col("at") < 0
    left = F.when(whole, F.col("word")).otherwise(F.concat(F.substr("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + 2)))
    rows = shared.join(vocabulary, "id").select("id", "at", "span", left.alias("left"), F.struct((-F.col("n")).alias("less"), "id").alias("own"))
    # a word that is the shortened string itself is one deletion away from all that give it; the strings end here
    string = Window.partitionBy("left")
    rows = rows.select("id", "at", "span", "own", F.min(F.struct("id", "at")).over(string).alias("group"), F.max(F.when(whole, F.col("own"))).over(string).alias("short"),
                       F.count_if(~whole).over(string).alias("longer"), F.min(F.when(~whole, F.col("own"))).over(string).alias("long"))
    # words of one string and one place left out differ there alone
    place = Window.partitionBy("group", "place")
    rows = rows.withColumn("place", F.explode(F.sequence("at", F.col("at") + F.col("span") - 1))).withColumns({"here": F.count("*").over(place), "top": F.min("own").over(place)})
    near = F.when(whole, F.col("longer")).otherwise(F.col("here") - 1 + F.when((F.col("place") == F.col("at")) & F.col("short").isNotNull(), 1).otherwise(0))
    # where the top is the word itself no other is larger, so none can be its form
    best = F.when(whole, F.col("long")).otherwise(F.least("top", "short"))
    return rows.groupBy("id").agg(F.sum(near).alias("n_near"), F.min(best).alias("best"))


def _roots(ways: DataFrame) -> DataFrame:
    """(id, root) from (id, root) with one step in it: n grows tenfold at each, so doubling ends after a few rounds."""
    while True:
        ahead = ways.select(F.col("id").alias("root"), F.col("root").alias("then"))
        before, ways = ways, written(ways.join(ahead, "root", "left").select("id", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "spelling-ways")
        discard(before)
        if not ways.where("moved").limit(1).count():
            return ways.select("id", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word."""
    vocabulary = words(docs).repartitionByRange("word").sortWithinPartitions("word")
    vocabulary = written(vocabulary.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    found = written(_near(vocabulary, _shared(_keyed(vocabulary))), "spelling-near")
    chosen = vocabulary.select("id", "n").join(found, "id").where(-F.col("best.less") >= RATIO * F.col("n")).select("id", F.col("best.id").alias("root"))
    ways = written(chosen, "spelling-forms")
    form, root = (vocabulary.select(F.col("id").alias(f"{a}_id"), F.col("word").alias(a), F.col("n").alias(f"{a}_n")) for a in ("form", "root"))
    named = ways.withColumnRenamed("root", "form_id").join(_roots(ways.select("id", "root")), "id").withColumnRenamed("root", "root_id").join(form, "form_id").join(root, "root_id").select("id", "form", "root", "form_n")
    out = vocabulary.join(found.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
