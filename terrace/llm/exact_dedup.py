"""Exact deduplication by a Grace hash: records go to bucket files until a bucket fits an open-addressing table.

1. Each map task runs its rows through a bounded open-addressing table and so sends one text for many copies.
2. The texts that remain are spilled to a table in the shared folder; the sizes of the hash buckets are summed,
   and a bucket over the limit is split again by another hash until it fits (or is one hash value throughout,
   where the table holds each distinct content once).
3. Buckets are dealt out, each goes through a table that compares complete contents.

Copies come together as counts and largest ids only; the ids of a group never meet in one task.

Defined cases: null text counts as empty; null doc_id is smaller than any; of repeated rows with one doc_id
one is kept; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written

#: Bytes of distinct content that one map-side table may hold before it starts anew.
COMBINE_BYTES = 24 << 20
#: Bytes of content in a bucket that fits a table.
BUCKET_BYTES = 32 << 20
#: Levels of splitting; a bucket that still doesn't fit is one content or one 64-bit hash.
LEVELS = 6


class OpenAddressingTable:
    """Linear probing over slots of (hash, content, value); equality is that of complete contents."""

    def __init__(self, slots: int = 1024):
        self.hashes: list = [None] * slots
        self.contents: list = [None] * slots
        self.values: list = [None] * slots
        self.used = 0
        self.bytes = 0

    def put(self, hashed: int, content: bytes, value):
        """The value stored with an equal content, else ``value``, which is stored."""
        mask = len(self.hashes) - 1
        at = hashed & mask
        while (there := self.hashes[at]) is not None:
            if there == hashed and self.contents[at] == content:
                return self.values[at]
            at = (at + 1) & mask
        self.hashes[at], self.contents[at], self.values[at] = hashed, content, value
        self.used += 1
        self.bytes += len(content)
        if self.used * 2 > len(self.hashes):
            self._grow()
        return value

    def _grow(self) -> None:
        old = zip(self.hashes, self.contents, self.values, strict=True)
        size = len(self.hashes) * 2
        self.hashes, self.contents, self.values = [None] * size, [None] * size, [None] * size
        for hashed, content, value in old:
            if hashed is not None:
                at = hashed & (size - 1)
                while self.hashes[at] is not None:
                    at = (at + 1) & (size - 1)
                self.hashes[at], self.contents[at], self.values[at] = hashed, content, value


def _combine(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        row, table = first, OpenAddressingTable()
        for batch in batches:
            rows, local, sent = [], [], []
            for content, hashed in zip(batch.column("content"), batch.column("h").to_pylist(), strict=True):
                content = content.as_py()
                got = table.put(hashed, content, row)
                rows.append(row)
                local.append(got)
                sent.append(content if got == row else None)
                row += 1
                if table.bytes > limit:
                    table = OpenAddressingTable()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sha"), batch.column("h"), pa.array(rows, pa.int64()), pa.array(local, pa.int64()), pa.array(sent, pa.binary())],
                ["doc_id", "sha", "h", "row", "local", "content"],
            )

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leaf, table = None, OpenAddressingTable()
    for batch in batches:
        local, group = [], []
        for at, hashed, content, row in zip(*(batch.column(c) for c in ("leaf", "h", "content", "local")), strict=True):
            if at.as_py() != leaf:
                leaf, table = at.as_py(), OpenAddressingTable()
            local.append(row.as_py())
            group.append(table.put(hashed.as_py(), content.as_py(), row.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(local, pa.int64()), pa.array(group, pa.int64())], ["local", "group"])


def _leaves(sent: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """``sent`` with its bucket, and the number of buckets; only buckets over the limit are split further."""
    total = sent.agg(F.sum("size")).first()[0] or 0
    fan = max(1, -(-total // limit))
    leaves, buckets = sent.withColumn("leaf", F.pmod("h", F.lit(fan).cast("long"))), fan
    for level in range(1, LEVELS):
        large = leaves.groupBy("leaf").agg(F.sum("size").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        large = large.where((F.col("bytes") > 2 * limit) & (F.col("lo") < F.col("hi")))
        large = large.select("leaf", F.ceil(F.col("bytes") / limit).cast("long").alias("fan"))
        more = large.agg(F.sum("fan")).first()[0] or 0
        if not more:
            break
        sub = F.xxhash64("leaf", F.pmod(F.xxhash64("h", F.lit(level)), "fan"))
        leaves = leaves.join(large, "leaf", "left").withColumn("leaf", F.when(F.col("fan").isNull(), F.col("leaf")).otherwise(sub)).drop("fan")
        buckets += more
    return leaves, int(buckets)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", combine_bytes: int = COMBINE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row; of equal texts the largest id stays."""
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.cast("binary").alias("content"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("sha"))
    spilled = rows.mapInArrow(lean(_combine(combine_bytes)), "doc_id long, sha string, h long, row long, local long, content binary")
    spilled = written(spilled, "grace")
    sent = spilled.where("content is not null").select("local", "h", "content", F.length("content").cast("long").alias("size"))
    leaves, buckets = _leaves(sent, bucket_bytes)
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = leaves.select("leaf", "h", "content", "local").repartition(parts, "leaf").sortWithinPartitions("leaf")
    groups = written(dealt.mapInArrow(lean(_match), "local long, group long"), "groups")
    best = F.max(F.struct("doc_id", "row"))
    members = spilled.groupBy("local").agg(F.count("*").alias("n"), best.alias("best"))
    whole = groups.join(members, "local").groupBy("group").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    answer = groups.join(whole, "group").select("local", "group_size", "best")
    return spilled.join(answer, "local").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
