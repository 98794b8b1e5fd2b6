"""COCO documents of any length: the elements of their arrays, read by many tasks, each from a range of bytes.

What a byte means depends on all bytes before it: whether it stands in a string, and how deep. A range is therefore scanned once
for each of the three ways it may begin (outside strings, in one, in one after a backslash), which gives one small row a range;
followed from the first range to the last, these rows tell how each range really begins. Tasks then cut elements at
their bounds; an element belongs to the range it begins in, whose task reads on to the element's end.

No cell holds more than one element, and no task more than a chunk and an element. Elements are the objects and arrays in the
arrays of the outermost object; numbers and strings there aren't elements. Bytes need only be UTF-8 (a byte order mark is
allowed). A document that is empty, ends early or closes more than it opened has an error and gives no elements.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scratch
from .streamed import CHUNK, located

#: Bytes of a range: large enough for steady reading, small enough that a document of many gigabytes has many tasks.
RANGE = 32 << 20
#: How a range begins: outside strings, in a string, in a string right after a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
#: Longest name looked for before an array of the outermost object.
NAME = 1 << 16

_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)


def brackets(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the brackets that stand outside strings, +1 for each that opens and -1 for each that closes, and the state
    after the last byte, for bytes that begin in ``state``."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64), state
    b = np.frombuffer(data, np.uint8)
    slash = b == ord("\\")
    # a byte is escaped if an odd number of backslashes stands right before it
    plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(b))))
    # (a run that reaches back to the first byte goes on from a backslash before it)
    run = np.arange(len(b)) - plain + ((plain < 0) & (state == ESCAPED))
    before = np.concatenate(([int(state == ESCAPED)], run[:-1]))
    quotes = (b == ord('"')) & (before % 2 == 0)
    inside = (np.cumsum(quotes) + (state != OUTSIDE)) % 2 == 1
    opens, closes = (b == ord("{")) | (b == ord("[")), (b == ord("}")) | (b == ord("]"))
    at = np.flatnonzero((opens | closes) & ~inside)
    end = OUTSIDE if not inside[-1] else ESCAPED if run[-1] % 2 else INSIDE
    return at, np.where(opens[at], 1, -1), end


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, length, start, end) of the ranges of ``files(path, length)``; an empty file has one."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    rows = files.select("path", "length", F.explode(starts).alias("start"))
    return rows.withColumn("end", F.least(F.col("start") + size, F.col("length")))


def _chunks(stream, start: int, end: int) -> Iterator[bytes]:
    stream.seek(start)
    while start < end and (data := stream.read(min(CHUNK, end - start))):
        start += len(data)
        yield data


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each way to begin: how a range ends, by how much the depth changes, and the least change within."""
    for batch in batches:
        for row in batch.to_pylist():
            where, name = located(row["path"])
            told, states = [[0, 0] for _ in range(3)], [OUTSIDE, INSIDE, ESCAPED]
            with where.open_input_file(name) as stream:
                for data in _chunks(stream, row["start"], row["end"]):
                    for k in range(3):
                        _, step, states[k] = brackets(data, states[k])
                        if len(step):
                            depth = told[k][0] + np.cumsum(step)
                            told[k] = [int(depth[-1]), min(told[k][1], int(depth.min()))]
            yield pa.RecordBatch.from_pylist([row | {"states": states, "depths": [t[0] for t in told], "lows": [t[1] for t in told]}], schema=_SUMMARY)


_SUMMARY = pa.schema([("path", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("states", pa.list_(pa.int32())), ("depths", pa.list_(pa.int64())), ("lows", pa.list_(pa.int64()))])
_ROW = "path string, length long, start long, end long"


def _followed(rows: pd.DataFrame) -> pd.DataFrame:
    """The real beginning of each range of one document, and the document's error."""
    rows = rows.sort_values("start")
    state, depth, low = OUTSIDE, 0, 0
    begins = []
    for states, depths, lows in zip(rows["states"], rows["depths"], rows["lows"], strict=True):
        begins.append((state, depth))
        low = min(low, depth + int(lows[state]))
        state, depth = int(states[state]), depth + int(depths[state])
    error = "closes more than it opened" if low < 0 else "ends early" if depth or state != OUTSIDE else "is empty" if not rows["length"].iloc[0] else None
    return rows[["path", "length", "start", "end"]].assign(state=[b[0] for b in begins], depth=[b[1] for b in begins], error=error)


def begun(files: DataFrame, size: int = RANGE) -> DataFrame:
    """The ranges of ``files`` with state and depth at their beginning and their document's error; written once."""
    small = spread_ranges(ranges(files, size)).mapInArrow(_summaries, f"{_ROW}, states array<int>, depths array<long>, lows array<long>")
    # a group is a document's ranges: one small row for each 32 MB
    return scratch.kept(small.groupBy("path").applyInPandas(_followed, f"{_ROW}, state int, depth long, error string"), "ranges")


def spread_ranges(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")


def name_before(stream, at: int) -> str:
    """The name whose value begins at a place of the outermost object; empty for an outermost array."""
    size = 256
    while True:
        start = max(0, at - size)
        stream.seek(start)
        data = stream.read(at - start)
        # a match at the very start of what was read may be the rest of a longer name
        if (m := _KEY.search(data)) and (m.start() > 0 or start == 0):
            return m[1].decode("utf-8", "replace")
        if start == 0 or size >= NAME:
            return ""
        size *= 4


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            where, name = located(row["path"])
            state, depth, place, found = row["state"], row["depth"], row["start"], []
            with where.open_input_file(name) as stream:
                for data in _chunks(stream, row["start"], row["end"]):
                    at, step, state = brackets(data, state)
                    after = depth + np.cumsum(step)
                    found += [(place + int(i), data[int(i)] == ord("[")) for i in at[(step > 0) & (after == 2)]]
                    depth, place = int(after[-1]) if len(after) else depth, place + len(data)
                told = [{"at": at, "name": name_before(stream, at) if array else None} for at, array in found]
            yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("path", "start", "end", "state", "depth")} | {"sections": told}], schema=_RANGE)


_RANGE = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("state", pa.int32()), ("depth", pa.int64()),
    ("sections", pa.list_(pa.struct([("at", pa.int64()), ("name", pa.string())]))),
])


def cut(read, start: int, end: int, state: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the elements that begin in a range; ``read(place)`` gives the next bytes from a place, none at the end."""
    place, open_at, parts = start, None, []
    while place < end or open_at is not None:
        data = read(place)
        if not data:
            return
        at, step, state = brackets(data, state)
        after = depth + np.cumsum(step)
        marks = np.flatnonzero(((step > 0) & (after == 3)) | ((step < 0) & (after == 2)))
        begin = 0
        for k in marks:
            i = int(at[k])
            if step[k] > 0:
                if place + i >= end:
                    return
                open_at, begin, parts = place + i, i, []
            elif open_at is not None:
                yield open_at, b"".join([*parts, data[begin : i + 1]])
                open_at, parts = None, []
        if open_at is not None:
            parts.append(data[begin:])
        depth, place = int(after[-1]) if len(after) else depth, place + len(data)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            where, name = located(row["path"])
            places, names = [s["at"] for s in row["sections"]], [s["name"] for s in row["sections"]]
            with where.open_input_file(name) as stream:

                def read(place: int, stream=stream) -> bytes:
                    stream.seek(place)
                    return stream.read(CHUNK)

                held, size = [], 0
                for at, text in cut(read, row["start"], row["end"], row["state"], row["depth"]):
                    section = names[bisect_right(places, at) - 1]
                    if section is None:  # a part of an object isn't an element
                        continue
                    held.append({"path": row["path"], "section": section, "at": at, "text": text.decode("utf-8", "replace")})
                    size += len(text)
                    if size > CHUNK:
                        yield pa.RecordBatch.from_pylist(held, schema=_ELEMENT)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=_ELEMENT)


_ELEMENT = pa.schema([("path", pa.string()), ("section", pa.string()), ("at", pa.int64()), ("text", pa.string())])


def elements(files: DataFrame, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(path, section, at, text) of each element of the arrays in the documents ``files(path, length)``, where section is the
    array's name and at the byte the element begins at; and (path, error) of the documents that can't be read."""
    rows = begun(files, size)
    found = spread_ranges(rows.where("error IS NULL")).mapInArrow(_sections, "path string, start long, end long, state int, depth long, sections array<struct<at:long,name:string>>")
    # what begins last before a range goes on in it; these rows hold no text, one a range
    found = scratch.kept(found, "sections").withColumn("last", F.when(F.size("sections") > 0, F.element_at("sections", -1)))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    told = found.withColumn("before", before).withColumn("sections", F.when(F.col("before").isNull(), F.col("sections")).otherwise(F.concat(F.array("before"), "sections")))
    placed = spread_ranges(told.where("size(sections) > 0").drop("last", "before"))
    out = placed.mapInArrow(_elements, "path string, section string, at long, text string")
    return out, rows.where("error IS NOT NULL").select("path", "error").distinct()
