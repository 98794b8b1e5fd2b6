"""Annotation files as a data source: ``spark.read`` and ``spark.readStream`` over folders of YOLO, LabelMe and COCO files.

    load(spark, root, suffixes="json,txt")

Rows are (path, length, modified, text, error), one a file; formats are told and parsed by expressions (``objects``). A partition
is some small folders, or a share of the files of a large one: planning holds a number a folder, and tasks list their own folders again. Conditions
on path or length reach the listing where ``spark.sql.python.filterPushdown.enabled`` is set (``load`` asks the session; Spark
refuses a reader that takes conditions otherwise): folders that can't hold a match get no
task, other files aren't opened. A file that can't be read, isn't UTF-8 or is larger than ``max_file_bytes`` (64 MB; what a
cell should hold; larger COCO documents are for ``coco_ranges``) is a row with an error and without text.

As a stream, the offset is a time of modification: a batch holds the files changed after the last offset up to the new one. Files
count once they are ``settle`` seconds old (2), so no later file has an offset's time; those moved in with times older than the offset
aren't seen. Files aren't expected to change.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from ..functions import text as X
from ..schema import BOX, RING
from . import coco, labelme, yolo
from .files import with_format
from .streamed import located

SCHEMA = "path string, length long, modified timestamp, text string, error string"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("text", pa.string()), ("error", pa.string())])
#: Bytes of a row batch.
BATCH = 8 << 20
#: Files that are worth a task of their own, however small they are.
FILES = 1000


@dataclass
class Share(InputPartition):
    """Of the files of some folders those whose name falls into share ``k`` of ``n``, changed after ``start`` and up to ``end`` (ns)."""

    folders: tuple[str, ...]
    k: int
    n: int
    start: int
    end: int


def _matches(f: Filter, path: str, length: int | None) -> bool:
    """Whether a file can satisfy a condition; with no length, whether a folder of that path can hold one that does."""
    value, name = getattr(f, "value", None), f.attribute[0]
    if name == "length":
        if length is None:
            return True
        return {EqualTo: length == value, GreaterThan: length > value, GreaterThanOrEqual: length >= value, LessThan: length < value, LessThanOrEqual: length <= value}[type(f)] if not isinstance(f, In) else length in value
    if length is None:
        inside = path.rstrip("/") + "/"
        if isinstance(f, StringEndsWith):
            return True
        if isinstance(f, StringStartsWith):
            return inside.startswith(value) or value.startswith(inside)
        return any(v.startswith(inside) for v in (value if isinstance(f, In) else (value,)) if v)
    if isinstance(f, StringStartsWith):
        return path.startswith(value)
    if isinstance(f, StringEndsWith):
        return path.endswith(value)
    return path in value if isinstance(f, In) else path == value


class _Files:
    """What the reader and the stream reader share: options, conditions, listing and reading."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.suffixes = tuple("." + s.strip().lower().lstrip(".") for s in options.get("suffixes", "json,txt").split(","))
        self.group = int(options.get("group_bytes", 64 << 20))
        self.limit = int(options.get("max_file_bytes", 64 << 20))
        self.settle = float(options.get("settle", 2))
        self.conditions: list[Filter] = []

    def keeps(self, path: str, length: int | None) -> bool:
        return all(_matches(f, path, length) for f in self.conditions)

    def folder(self, path: str) -> tuple[list[str], list[tuple[str, int, int]]]:
        """The folders within a folder, and (path, length, time of change) of its annotation files."""
        where, name = located(path)
        prefix = path[: len(path) - len(name)] if "://" in path and not path.startswith("file:") and path.endswith(name) else ""
        folders, files = [], []
        for f in where.get_file_info(fs.FileSelector(name, allow_not_found=True)):
            if f.type == fs.FileType.Directory:
                folders.append(prefix + f.path)
            elif f.path.lower().endswith(self.suffixes):
                files.append((prefix + f.path, f.size or 0, f.mtime_ns or 0))
        return folders, files

    def shares(self, start: int, end: int) -> Iterator[Share]:
        """Partitions of the folders that have files in question; planning keeps no file."""
        left, small, files_of_small, bytes_of_small = [self.root], [], 0, 0
        while left:
            here = left.pop()
            folders, files = self.folder(here)
            left += [f for f in folders if self.keeps(f, None)]
            size = [n for path, n, t in files if start < t <= end and self.keeps(path, n)]
            n = max(-(-sum(size) // self.group), -(-len(size) // FILES))
            if n > 1:
                yield from (Share((here,), k, n, start, end) for k in range(n))
            elif size:
                small, files_of_small, bytes_of_small = [*small, here], files_of_small + len(size), bytes_of_small + sum(size)
                if files_of_small >= FILES or bytes_of_small >= self.group:
                    yield Share(tuple(small), 0, 1, start, end)
                    small, files_of_small, bytes_of_small = [], 0, 0
        if small:
            yield Share(tuple(small), 0, 1, start, end)

    def latest(self) -> int:
        """The last time of change among the files that are old enough."""
        now, last, left = time.time_ns() - int(self.settle * 1e9), 0, [self.root]
        while left:
            folders, files = self.folder(left.pop())
            left += folders
            last = max([last, *(t for _, _, t in files if t <= now)])
        return last

    def read_share(self, share: Share) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, length, changed in (f for folder in share.folders for f in sorted(self.folder(folder)[1])):
            if not share.start < changed <= share.end or zlib.crc32(path.encode()) % share.n != share.k or not self.keeps(path, length):
                continue
            text, error = None, None
            if length > self.limit:
                error = "larger than a cell should hold"
            else:
                try:
                    where, name = located(path)
                    with where.open_input_stream(name) as stream:
                        text = stream.read().decode("utf-8-sig")
                except UnicodeDecodeError:
                    error = "not UTF-8"
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"[:300]
            rows.append({"path": path, "length": length, "modified": changed // 1000, "text": text, "error": error})
            size += len(text or "")
            if size > BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[Share]:
        # a reader without partitions would be asked to read all at once
        return list(self.shares(-1, 1 << 62)) or [Share((self.root,), 0, 1, -1, -1)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.read_share(partition)


class _ConditionReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        told = {"path": (EqualTo, In, StringStartsWith, StringEndsWith), "length": (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)}
        for f in filters:
            if len(f.attribute) == 1 and isinstance(f, told.get(f.attribute[0], ())):
                self.conditions.append(f)
            else:
                yield f


class _StreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": self.latest() or -1}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return list(self.shares(start["changed"], end["changed"])) or [Share((self.root,), 0, 1, -1, -1)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.read_share(partition)

    def commit(self, end: dict) -> None:
        pass


class AnnotationFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annotation_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ConditionReader(self.options) if self.options.get("conditions") == "true" else _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def load(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(AnnotationFiles)
    taken = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("annotation_files").options(conditions=taken, **options).load(root)


def told(rows: DataFrame) -> DataFrame:
    """``rows`` of the source with format (null without text) and disposition: read, empty, unreadable, or unknown format."""
    out = with_format(rows.withColumn("text", F.coalesce("text", F.lit("")))).withColumn("format", F.when(F.col("error").isNull(), F.col("format")))
    lost = F.col("error").isNotNull()
    return out.withColumn("disposition", F.when(lost, "unreadable").when(F.col("format") == "unknown", "unknown format").when(F.col("format") == "empty", "empty").otherwise("read"))


def objects(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, format, ordinal, class_id, class_name, box, polygon, error) of all objects of all formats; from 1 within a file.

    ``sizes(stem, width, height)`` are those of images, for the fractions of YOLO lines; a file whose image has none gives one row
    with an error, as does one that can't be read or told. Files without objects give no rows.
    """
    files = told(rows)
    columns = ["path", "format", "ordinal", "class_id", "class_name", "box", "polygon", "error"]
    lines = files.where("format IN ('yolo_box', 'yolo_polygon', 'mixed')").withColumn("stem", X.stem(F.col("path")))
    sized = lines.join(sizes.select("stem", "width", "height"), "stem", "left")
    boxes = yolo.parse(sized.where("width IS NOT NULL AND height IS NOT NULL").select("path", "text", "width", "height")).withColumn("ordinal", F.col("line").cast("long")).withColumn("format", F.lit("yolo"))
    shapes = labelme.objects(labelme.read(files.where("format = 'labelme'").select("path", "text"))).withColumn("ordinal", F.col("ordinal").cast("long") + 1).withColumn("format", F.lit("labelme")).withColumn("error", F.lit(None).cast("string"))
    docs = files.where("format = 'coco'").select("path", F.from_json("text", coco.DOCUMENT).alias("d"))
    marks = coco.shaped(docs.select("path", F.posexplode("d.annotations").alias("at", "a")).select("path", "at", "a.*"))
    names = docs.select(F.col("path").alias("from"), F.explode("d.categories").alias("c")).select("from", F.col("c.id").alias("cid"), F.col("c.name").alias("class_name"))
    marks = marks.join(names, (F.col("from") == F.col("path")) & (F.col("cid") == F.col("category_id")), "left")
    marks = marks.select("path", F.lit("coco").alias("format"), (F.col("at") + 1).cast("long").alias("ordinal"), (F.col("category_id") - 1).alias("class_id"), "class_name", "box", "polygon", F.when(F.col("class_name").isNull(), "category isn't listed").alias("error"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    why = F.coalesce(F.col("error"), F.when(F.col("disposition") == "unknown format", "unknown format"))
    lost = files.where("disposition IN ('unreadable', 'unknown format')").select("path", "format", why.alias("error"))
    bare = sized.where("width IS NULL OR height IS NULL").select("path", F.lit("yolo").alias("format"), F.lit("no size of its image").alias("error"))
    lost = lost.unionByName(bare).select("path", "format", none("ordinal", "long"), none("class_id", "int"), none("class_name", "string"), none("box", BOX), none("polygon", RING), "error")
    return boxes.select(*columns).unionByName(shapes.select(*columns)).unionByName(marks.select(*columns)).unionByName(lost.select(*columns))
