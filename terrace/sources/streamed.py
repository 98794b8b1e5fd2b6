"""Files of any length: digests, image sizes and verified copies, by streams in tasks.

A listing is rows of path and length, made by tasks (Spark's own file sources leave empty files out and put a whole file in
a cell); tasks open the files themselves and read a chunk at a time. No row, cell or task ever holds a file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch

#: Bytes read at a time.
CHUNK = 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and its place there; ``file:/x`` and plain paths are local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + path[5:].lstrip("/"))
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _below(path: str) -> list[tuple[str, int, bool]]:
    """(path, length, whether it's a folder) of what a folder holds; paths are of the form of the folder's."""
    where, name = located(path)
    prefix = path[: len(path) - len(name)] if "://" in path and not path.startswith("file:") and path.endswith(name) else ""
    found = where.get_file_info(fs.FileSelector(name))
    return [(prefix + f.path, f.size or 0, f.type == fs.FileType.Directory) for f in found]


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, length) of each file below ``root``, of all or of some suffixes, empty ones too; contents aren't read.

    Folders are listed by tasks, one level of the tree a round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = _below(path)
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], ["path", "length", "folder"])

    folders, out = spark.createDataFrame([(root.rstrip("/"),)], "path string"), None
    while True:
        level = scratch.kept(spread(folders).mapInArrow(run, "path string, length long, folder boolean"), "listing")
        files = level.where("NOT folder").select("path", "length")
        out = files if out is None else out.unionByName(files)
        folders = level.where("folder").select("path")
        if not folders.limit(1).count():
            break
    if not suffixes:
        return out
    return out.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*suffixes))


def _by_file(one: Callable[[str], tuple], names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    found = (*one(path), None)
                except (OSError, ValueError) as e:
                    found = (*[None] * len(names), f"{type(e).__name__}: {e}"[:300])
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array([v], t) for v, t in zip(found, [*types, pa.string()], strict=True))], [*row.schema.names, *names, "error"])

    return run


def _digest(path: str) -> tuple[int, str]:
    where, name = located(path)
    state, size = hashlib.sha256(), 0
    with where.open_input_stream(name) as stream:
        while chunk := stream.read(CHUNK):
            state.update(chunk)
            size += len(chunk)
    return size, state.hexdigest()


def spread(files: DataFrame) -> DataFrame:
    """``files`` dealt by their paths' hashes to as many tasks as shuffles have, since a task's work is the length of its files."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def digests(files: DataFrame) -> DataFrame:
    """``files(path, length)`` with size, sha256 and error; what can't be read has an error."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return spread(files).mapInArrow(_by_file(_digest, ["size", "sha256"], [pa.int64(), pa.string()]), f"{kinds}, size long, sha256 string, error string")


class _Bytes:
    """Reads by place from a file, a chunk at a time."""

    def __init__(self, stream):
        self.stream = stream

    def at(self, place: int, n: int) -> bytes:
        self.stream.seek(place)
        out = self.stream.read(n)
        if len(out) < n:
            raise ValueError("file ends in its header")
        return out


def image_size(data: _Bytes) -> tuple[str, int, int]:
    """(format, width, height) from the headers of a PNG, JPEG, BMP or GIF; JPEG segments are stepped over, not read."""
    head = data.at(0, 10)
    if head.startswith(b"\x89PNG\r\n\x1a\n"):
        if data.at(12, 4) != b"IHDR":
            raise ValueError("PNG without IHDR")
        return "png", *struct.unpack(">II", data.at(16, 8))
    if head.startswith(b"BM"):
        if struct.unpack("<I", data.at(14, 4))[0] == 12:
            return "bmp", *struct.unpack("<HH", data.at(18, 4))
        width, height = struct.unpack("<ii", data.at(18, 8))
        return "bmp", width, abs(height)
    if head.startswith((b"GIF87a", b"GIF89a")):
        return "gif", *struct.unpack("<HH", head[6:10])
    if head.startswith(b"\xff\xd8"):
        place = 2
        while True:
            if data.at(place, 1) != b"\xff":
                raise ValueError("JPEG segment expected")
            marker = data.at(place + 1, 1)[0]
            if marker == 0xFF:  # fill
                place += 1
            elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
                place += 2
            elif marker in (0xD9, 0xDA):
                raise ValueError("JPEG without a frame header")
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data.at(place + 5, 4))
                return "jpeg", width, height
            else:
                step = struct.unpack(">H", data.at(place + 2, 2))[0]
                if step < 2:
                    raise ValueError("JPEG segment of no length")
                place += 2 + step
    raise ValueError("not an image of a known kind")


def _size(path: str) -> tuple[str, int, int]:
    where, name = located(path)
    with where.open_input_file(name) as stream:
        kind, width, height = image_size(_Bytes(stream))
    if width < 1 or height < 1:
        raise ValueError("image without extent")
    return kind, width, height


def sizes(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` with format, width, height and error."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return spread(files).mapInArrow(_by_file(_size, ["format", "width", "height"], [pa.string(), pa.int32(), pa.int32()]), f"{kinds}, format string, width int, height int, error string")


def _copy(path: str, target: str, wanted: str) -> str:
    where, name = located(path)
    there, goal = located(target)
    if there.get_file_info(goal).type != fs.FileType.NotFound:
        return "same" if _digest(target)[1] == wanted else "another file is there"
    folder = goal.rpartition("/")[0]
    if folder:
        there.create_dir(folder, recursive=True)
    aside = f"{goal}.{uuid.uuid4().hex}.part"
    state = hashlib.sha256()
    try:
        with where.open_input_stream(name) as source, there.open_output_stream(aside) as sink:
            while chunk := source.read(CHUNK):
                state.update(chunk)
                sink.write(chunk)
        # what was written is read again: a copy counts only as what the disk gives back
        if state.hexdigest() != wanted or _digest_at(there, aside) != wanted:
            return "content differs from its digest"
        there.move(aside, goal)
        return "copied"
    finally:
        if there.get_file_info(aside).type != fs.FileType.NotFound:
            there.delete_file(aside)


def _digest_at(where: fs.FileSystem, name: str) -> str:
    state = hashlib.sha256()
    with where.open_input_stream(name) as stream:
        while chunk := stream.read(CHUNK):
            state.update(chunk)
    return state.hexdigest()


def copied(files: DataFrame) -> DataFrame:
    """``files(path, target, content_sha256)`` with status, after copying each to its target.

    ``copied`` and ``same`` are good. A target with other content is never replaced; a copy whose content isn't that of its
    digest is removed; a task that is run again finds what it has copied. Files that can't be read have an error as status.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (path, target, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "target", "content_sha256")), strict=True)):
                try:
                    status = _copy(path, target, wanted)
                except (OSError, ValueError) as e:
                    status = f"{type(e).__name__}: {e}"[:300]
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([status])], [*row.schema.names, "status"])

    rows = files.select("path", "target", "content_sha256")
    return spread(rows).mapInArrow(run, "path string, target string, content_sha256 string, status string")


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(split, path, length) of files made from the ``parts`` of each row, one after the other, a chunk at a time.

    What is written has another name until it's whole; a task that is run again writes the same file.
    """
    for batch in batches:
        for row in batch.to_pylist():
            there, goal = located(row["path"])
            aside, length = f"{goal}.{uuid.uuid4().hex}.part", 0
            try:
                with there.open_output_stream(aside) as sink:
                    for part in row["parts"]:
                        where, name = located(part)
                        with where.open_input_stream(name) as source:
                            while chunk := source.read(CHUNK):
                                sink.write(chunk)
                                length += len(chunk)
                there.move(aside, goal)
            finally:
                if there.get_file_info(aside).type != fs.FileType.NotFound:
                    there.delete_file(aside)
            yield pa.RecordBatch.from_pylist([{"split": row["split"], "path": row["path"], "length": length}], schema=pa.schema([("split", pa.string()), ("path", pa.string()), ("length", pa.int64())]))
