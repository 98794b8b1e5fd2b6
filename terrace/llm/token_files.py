"""Token ids in files of entropy-coded blocks: a static range asymmetric numeral system (rANS).

Texts are encoded with the tokenizers library, an end id follows each document, and documents stand in ascending
id order. The files are a Parquet folder ``blocks``, one row a block, beside ``table`` with the shared frequency
table and ``parts`` with the number of ids before each part. Frequencies of all ids are scaled to 2^``SCALE``.

A block holds up to ``BLOCK`` ids of consecutive documents and decodes by itself. Its ids are dealt to lanes in turn,
each lane is a 64-bit state, and the lanes' 32-bit words are interleaved in one payload, so a block is coded a row of
lanes at a time. Checkpoints (place in the ids, place in the payload, states) let decoding begin inside a block;
crc32 sums guard the payload and the ids. A part is a range of documents written by one task; parts and blocks
are numbered, so all of them can be decoded in any order.

Defined cases: null text counts as empty and gives the end id alone; null doc_id comes first; repeated rows stand
beside each other in an order of their ids, so that an id with very many rows may go on in the next part; a document longer than a block goes on in the next ones; an empty
table gives an empty folder and an empty result; clashing extra columns are not read.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, fresh_worker, is_small, lean, scratch_path, worker_state, written

SCALE = 18
BLOCK = 1 << 18
LANES = 1024
#: Ids between checkpoints inside a block; the first is at its start.
CHECKPOINT = 1 << 17
#: Ids in a part, about.
PART = 8 << 20
LOW = np.uint64(1 << 31)
FEW_PARTS = 100_000
#: Parts in a generation of the per-process cache, and characters of a part in it; what isn't met again in the next generation is forgotten.
HELD, HELD_CHARACTERS = 200_000, 64
#: Bytes of texts that are split together; what splitting holds besides counts in each worker.
TOGETHER = 2 << 20
#: Letters for which lower-casing and letter classes agree between the libraries, and which normalisation leaves alone.
PLAIN = "".join(c for c in map(chr, range(0x41, 0x180)) if c.isalpha() and c not in "ªµºİıŉſ")
#: What parts are cut from here; an apostrophe can begin an ending, so pieces with one are not cut.
MARKS = "".join(c for c in string.punctuation if c != "'")
SAFE = frozenset(PLAIN + string.digits + MARKS)
ONLY_SAFE = f"^[{PLAIN}0-9{re.escape(MARKS)}]*$"
RUNS = f"([{PLAIN}]+|[0-9])"


class _Held:
    """Ids of parts, met in this generation or the one before, as Arrow columns: some tens of bytes a part, where objects in a dict take hundreds."""

    def __init__(self, encode):
        self.encode = encode
        self.parts, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.old = self.parts, self.ids

    def of(self, parts: pa.Array) -> pa.Array:
        """The ids of these parts, all distinct; what isn't held is encoded."""
        if len(self.parts) > HELD:
            self.old = self.parts, self.ids
            self.parts, self.ids = self.parts[:0], self.ids[:0]
        at = pc.index_in(parts, pa.concat_arrays([self.parts, self.old[0]]))
        new = pa.array([self.encode(p) for p in parts.filter(at.is_null()).to_pylist()], pa.binary())
        known, at = len(self.parts) + len(self.old[0]), at.to_numpy(zero_copy_only=False)
        absent = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        at = np.where(absent, known + np.cumsum(absent) - 1, at).astype(np.int64)
        out = pa.concat_arrays([self.ids, self.old[1], new]).take(pa.array(at))
        keep = pa.array((at >= len(self.parts)) & (pc.utf8_length(parts).to_numpy() <= HELD_CHARACTERS))
        self.parts, self.ids = pa.concat_arrays([self.parts, parts.filter(keep)]), pa.concat_arrays([self.ids, out.filter(keep)])
        return out


class Encoder:
    """Ids of whole texts, by the distinct parts of many texts at a time.

    No id of this kind of vocabulary reaches over white space, and in a piece between spaces runs of letters, single digits
    and runs of other characters are encoded apart; so each distinct part is encoded once, by the library's model, and a
    text's ids are those of its parts in turn. Pieces with characters on which that could fail go to the library as they
    are. A vocabulary of another kind is encoded text by text.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        self.dtype = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.by_words = self._splits()
        self.held = _Held(self._part)
        # the byte-to-character table of byte-level vocabularies, as the library itself gives it
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {c: level.pre_tokenize_str(c)[0][0] for c in SAFE}

    def _splits(self) -> bool:
        import json

        spec = json.loads(self.tokenizer.to_str())
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        return steps == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of lower-case letters, a digit, a run of marks, or a piece that isn't cut."""
        if not SAFE.issuperset(part) or "<|" in part:
            return self._whole(part)
        shown = part if part.isascii() else "".join([self.visible[c] for c in part])
        return array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes() if part else b""

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after the other, and where each text's end."""
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        starts = np.append(0, np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False)))
        flat = pieces.flatten().dictionary_encode()
        del pieces
        safe = pc.and_not(pc.match_substring_regex(flat.dictionary, ONLY_SAFE), pc.match_substring(flat.dictionary, "<|"))
        cut = pc.replace_substring_regex(pc.utf8_lower(flat.dictionary), RUNS, r" \1 ")
        parts = pc.split_pattern(pc.if_else(safe, cut, flat.dictionary), " ")
        named = parts.flatten().dictionary_encode()
        # parts in place, so pieces are runs of their bytes; pieces in place, and texts are
        of_piece = _joined(self.held.of(named.dictionary).take(named.indices), parts)
        del cut, parts, named
        of_text = of_piece.take(flat.indices)
        del flat
        width = self.dtype.itemsize
        at = np.frombuffer(of_text.buffers()[1], np.int32)
        ids = np.frombuffer(of_text.buffers()[2], self.dtype, at[len(of_text)] // width) if at[len(of_text)] else np.zeros(0, self.dtype)
        return ids, at[starts[1:]] // width

    def _long(self, text: str) -> np.ndarray:
        """The ids of a text that is too long to be split at once."""
        out, at = [], 0
        while at < len(text):
            stop = at + TOGETHER
            if stop < len(text):
                cuts = [c for c in (text.find(" ", stop), text.find("\n", stop)) if c >= 0]
                stop = min(cuts) + 1 if cuts else len(text)
            out.append(self._together(pa.array([text[at:stop]]))[0])
            at = stop
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the texts, each with the end id, in slices: ids, and the numbers of ids of the slice's texts."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.array([self.end], self.dtype)
        at = 0
        while at < len(texts):
            if not self.by_words or sizes[at] > TOGETHER:
                text = texts[at].as_py()
                ids = self._long(text) if self.by_words else np.frombuffer(self._whole(text), self.dtype)
                yield np.append(ids, end), np.array([len(ids) + 1])
                at += 1
                continue
            held = np.cumsum(sizes[at:])
            stop = at + max(1, int(np.searchsorted(held, TOGETHER, "right")))
            ids, stops = self._together(texts[at:stop])
            yield np.insert(ids, stops, self.end), np.diff(stops, prepend=0) + 1
            at = stop


def _joined(values: pa.Array, lists: pa.Array) -> pa.Array:
    """The binary values of each list as one."""
    starts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    at = np.frombuffer(values.buffers()[1], np.int32)[starts].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at), values.buffers()[2] or pa.py_buffer(b"")])


def _encoder(path: str, end: int) -> Encoder:
    """One encoder a process: a worker that is used again keeps it."""
    held = worker_state()
    if (path, end) not in held:
        held[(path, end)] = Encoder(path, end)
    return held[(path, end)]


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that add up to 2^scale, 1 at least where a count is above 0."""
    total, size = int(counts.sum()), 1 << scale
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    seen = counts > 0
    if int(seen.sum()) > size:
        raise ValueError("more ids than the scale can tell apart")
    freq[seen] = np.maximum(1, np.floor(counts[seen].astype(float) * size / total)).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    order = order[seen[order]]
    while (gap := size - int(freq.sum())) != 0:
        if gap > 0:
            freq[order[: min(gap, len(order))]] += 1
        else:
            can = order[freq[order] > 1][: -gap]
            freq[can] -= 1
    return freq


def pack(ids: np.ndarray, freq: np.ndarray, scale: int = SCALE, lanes: int = LANES, every: int = CHECKPOINT) -> dict:
    """A block: payload and checkpoints."""
    cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    f = freq.astype(np.uint64)
    rows = -(-len(ids) // lanes)
    step = max(1, every // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words, states, sizes = [], [], np.zeros(rows + 1, np.int64)
    for r in range(rows - 1, -1, -1):
        part = ids[r * lanes : (r + 1) * lanes]
        own = x[: len(part)]
        fr = f[part]
        over = own >= (fr << np.uint64(63 - scale))
        words.append(own[over].astype("<u4"))
        sizes[r] = len(words[-1])
        own = np.where(over, own >> np.uint64(32), own)
        q = own // fr
        x[: len(part)] = (q << np.uint64(scale)) + (own - q * fr) + cum[part]
        if r % step == 0:
            states.append((r, x.astype("<u8").tobytes()))
    payload = np.concatenate(words[::-1]).tobytes() if words else b""
    before = np.concatenate(([0], np.cumsum(sizes)))
    marks = [{"at": r * lanes, "word": int(before[r]), "states": s} for r, s in reversed(states)]
    return {"payload": payload, "marks": marks, "payload_crc": zlib.crc32(payload), "ids_crc": zlib.crc32(ids.astype("<u4").tobytes())}


def unpack(payload: bytes, mark: dict, stop: int, tables: tuple, scale: int = SCALE, lanes: int = LANES) -> np.ndarray:
    """The ids from a checkpoint up to the place ``stop``."""
    symbol, f, cum = tables
    words = np.frombuffer(payload, "<u4")
    x, at = np.frombuffer(mark["states"], "<u8").astype(np.uint64), mark["word"]
    out, mask = np.empty(stop - mark["at"], np.uint32), np.uint64((1 << scale) - 1)
    for lo in range(0, len(out), lanes):
        part = x[: min(lanes, len(out) - lo)]
        slot = part & mask
        ids = symbol[slot]
        out[lo : lo + len(part)] = ids
        part[:] = f[ids] * (part >> np.uint64(scale)) + slot - cum[ids]
        low = np.flatnonzero(part < LOW)
        part[low] = (part[low] << np.uint64(32)) | words[at : at + len(low)]
        at += len(low)
    return out


def decoding_tables(freq: np.ndarray) -> tuple:
    cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    return np.repeat(np.arange(len(freq), dtype=np.uint32), freq), freq.astype(np.uint64), cum


def crc_join(first: int, second: int, length: int) -> int:
    """The crc32 of two strings in turn, from that of each and the second's length in bytes."""
    if not length:
        return first

    def times(matrix: list[int], vector: int) -> int:
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector >>= 1
            i += 1
        return out

    # appending one zero bit, squared again and again: 8, 16, 32 ... zero bits
    matrix = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):
        matrix = [times(matrix, v) for v in matrix]
    while length:
        if length & 1:
            first = times(matrix, first)
        matrix = [times(matrix, v) for v in matrix]
        length >>= 1
    return first ^ second


PIECES = "array<struct<no:long,doc_id:long,piece:int,at:int,n:int>>"
BLOCKS = f"part long, block long, start long, n int, payload binary, payload_crc long, ids_crc long, marks array<struct<at:int,word:int,states:binary>>, docs {PIECES}"


def _blocks(freq: np.ndarray, dtype: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        part, no, number, start = TaskContext.get().partitionId(), 0, 0, 0
        held, pieces, size = [], [], 0

        def done():
            nonlocal held, pieces, size, number, start
            ids = np.concatenate(held)
            row = {"part": part, "block": number, "start": start, "n": len(ids), "docs": pieces} | pack(ids, freq)
            number, start, held, pieces, size = number + 1, start + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        entry = pa.struct([("no", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("at", pa.int32()), ("n", pa.int32())])
        mark = pa.struct([("at", pa.int32()), ("word", pa.int32()), ("states", pa.binary())])
        schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("payload", pa.binary()), ("payload_crc", pa.int64()), ("ids_crc", pa.int64()), ("marks", pa.list_(mark)), ("docs", pa.list_(entry))])
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids, piece = np.frombuffer(raw.as_py(), dtype), 0
                while len(ids):
                    take = ids[: block - size]
                    held.append(take)
                    pieces.append({"no": no, "doc_id": doc, "piece": piece, "at": size, "n": len(take)})
                    ids, piece, size = ids[len(take) :], piece + 1, size + len(take)
                    if size == block:
                        yield done()
                no += 1
        if size:
            yield done()

    return run


def tokenized(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text's ids and the end id, as little-endian bytes of the vocabulary's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end)
        width = encoder.dtype.itemsize
        for batch in batches:
            at = 0
            for ids, counts in encoder.encode(batch.column("text")):
                places = np.append(0, np.cumsum(counts) * width).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(places), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(counts)), raw], ["doc_id", "ids"])
                at += len(counts)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), "doc_id long, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 2, block: int = BLOCK, part: int = PART) -> None:
    """Encode ``docs`` and write the folder ``path``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1)
    dtype = "<u4" if vocabulary > 1 << 16 else "<u2"
    rows = written(tokenized(docs, tokenizer, end), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            raw = [r.as_py() for r in batch.column("ids")]
            for at in range(0, len(raw), 256):
                total += np.bincount(np.frombuffer(b"".join(raw[at : at + 256]), dtype), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["id", "n"])

    table = rows.select("ids").mapInArrow(lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for r in table.collect():  # as many rows as the vocabulary has ids
        counts[r["id"]] = r["n"]
    freq = scaled(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    parts = max(1, -(-int(counts.sum()) // part))
    dealt = rows.withColumn("mixed", F.xxhash64("ids")).repartitionByRange(parts, "doc_id", "mixed").sortWithinPartitions("doc_id", "mixed", "ids").select("doc_id", "ids").mapInArrow(lean(_blocks(freq, dtype, block)), BLOCKS)
    with arrow_rows(spark):
        dealt.write.parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.col("n").cast("long")).alias("ids"))
    before = F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes.select("part", "ids", before.alias("before")).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode a folder: (doc_id, start, n_tokens, ids_crc32) for each document."""
    pairs = spark.read.parquet(f"{path}/table").collect()  # as many rows as the vocabulary has ids
    freq = np.zeros(max([r["id"] for r in pairs], default=0) + 1, np.int64)
    for r in pairs:
        freq[r["id"]] = r["freq"]
    parts = spark.read.parquet(f"{path}/parts").select("part", "before")
    parts = F.broadcast(parts) if is_small(parts, FEW_PARTS) else parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decoding_tables(freq)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["payload_crc"]:
                    raise ValueError(f"part {row['part']}, block {row['block']}: the payload is damaged")
                stops = [m["at"] for m in row["marks"][1:]] + [row["n"]]
                ids = np.concatenate([unpack(row["payload"], m, stop, tables) for m, stop in zip(row["marks"], stops, strict=True)]).astype("<u4")
                if zlib.crc32(ids) != row["ids_crc"]:
                    raise ValueError(f"part {row['part']}, block {row['block']}: the ids are damaged")
                d = row["docs"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(d), pa.int64()), pa.array([e["no"] for e in d], pa.int64()), pa.array([e["doc_id"] for e in d], pa.int64()),
                        pa.array([e["piece"] for e in d], pa.int32()), pa.array([row["before"] + row["start"] + e["at"] for e in d], pa.int64()),
                        pa.array([e["n"] for e in d], pa.int64()), pa.array([zlib.crc32(ids[e["at"] : e["at"] + e["n"]]) for e in d], pa.int64()),
                    ],
                    ["part", "no", "doc_id", "piece", "start", "n", "crc"],
                )

    blocks = spark.read.parquet(f"{path}/blocks").join(parts, "part")
    pieces = blocks.mapInArrow(lean(run), "part long, no long, doc_id long, piece int, start long, n long, crc long")
    whole = pieces.groupBy("part", "no").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("pieces")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for pieces in batch.column("pieces").to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = crc_join(crc, p["crc"], 4 * p["n"])
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(lean(join), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write ``docs`` to a folder of the shared scratch space and read it back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end)
    return read_token_files(docs.sparkSession, path)
