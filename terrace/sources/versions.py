"""A store of whole versions: staged, verified, committed by one rename, kept, and restored by a further commit.

Below its path a store has

* ``versions/<digest>``: the tables of a version, each a Parquet folder; a version is never changed once it's there,
* ``log/<number>.json``: one small file a commit, which names a version and the one before it. The entry of the highest
  number is what the store holds now.

Publishing writes the tables aside, reads what was written back and compares its digest with that of the rows, moves
the folder to its place, and then commits: the entry is written aside and renamed to the next number. The rename fails
if that number is taken, so of two writers one wins; before it readers see the old version, after it the new one, and
there is nothing between. What a writer that failed has left is a staging folder, or a version no entry names.

Digests don't depend on the order or the partitions of rows, so equal rows are one version, written once.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Lost(ValueError):
    """Another writer has committed since the revision that a write builds on."""


@dataclass(frozen=True)
class Commit:
    number: int
    version: str
    parent: str | None
    note: str


def digest(df: DataFrame) -> str:
    """40 digits for the rows of a table whatever their order: their count, and the sums of two hashes of each."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    first, second = (F.conv(F.substring(F.sha2(text, 256), at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17))
    n, a, b = df.agg(F.count("*"), F.sum(first), F.sum(second)).first()
    return f"{n & 0xFFFFFFFF:08x}{int(a or 0) % (1 << 64):016x}{int(b or 0) % (1 << 64):016x}"


class Store:
    """The versions below one path of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _text(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _move(self, old: str, new: str) -> None:
        """Rename without replacing: fails where ``new`` is there."""
        if self._files.exists(self._at(new)):
            raise Lost(f"{new} is there already")
        context = self._hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._at(old), self._at(new), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Lost(f"{new} is there already") from e
            raise OSError(f"{old} couldn't be moved to {new}: {e.java_exception}") from e

    def history(self) -> list[Commit]:
        """All commits, the first one first."""
        if not self._files.exists(self._at("log")):
            return []
        names = sorted(s.getPath().getName() for s in self._files.listStatus(self._at("log")))
        out = []
        for name in names:
            if name.endswith(".json") and not name.startswith("."):
                entry = json.loads(self._text(f"log/{name}"))
                out.append(Commit(int(name[:-5]), entry["version"], entry["parent"], entry["note"]))
        return out

    def current(self) -> Commit | None:
        return (self.history() or [None])[-1]

    def read(self, table: str, version: str | None = None) -> DataFrame:
        """A table of a version, by default of the present one."""
        if version is None:
            now = self.current()
            if now is None:
                raise ValueError(f"nothing is published at {self.path}")
            version = now.version
        return self.spark.read.parquet(f"{self.path}/versions/{version}/{table}")

    def stage(self, tables: dict[str, DataFrame]) -> str:
        """Write tables aside, compare what is read back with what was to be written, and move them to their version."""
        wanted = {name: digest(df) for name, df in sorted(tables.items())}
        version = digest(self.spark.createDataFrame(list(wanted.items()), "name string, digest string"))
        if self._files.exists(self._at(f"versions/{version}")):
            self.verify(version, wanted)
            return version
        aside = f"staging/{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.mode("errorifexists").parquet(f"{self.path}/{aside}/{name}")
            for name, told in wanted.items():
                if digest(self.spark.read.parquet(f"{self.path}/{aside}/{name}")) != told:
                    raise ValueError(f"{name} changed while it was written")
            self._files.mkdirs(self._at("versions"))
            self._move(aside, f"versions/{version}")
        except Lost:  # another writer has put the same rows there meanwhile
            self.verify(version, wanted)
        finally:
            self._files.delete(self._at(aside), True)
        return version

    def verify(self, version: str, wanted: dict[str, str] | None = None) -> None:
        """Read a version again: its tables have to give its name."""
        found = {s.getPath().getName(): digest(self.read(s.getPath().getName(), version)) for s in self._files.listStatus(self._at(f"versions/{version}"))}
        named = digest(self.spark.createDataFrame(sorted(found.items()), "name string, digest string"))
        if named != version or (wanted is not None and found != wanted):
            raise ValueError(f"version {version} isn't what it was")

    def commit(self, version: str, parent: Commit | None, note: str = "") -> Commit:
        """Make ``version`` the present one; ``Lost`` if the store isn't at ``parent`` any more."""
        now = self.current()
        if (now and now.number) != (parent and parent.number):
            raise Lost(f"{self.path} is at {now and now.number}, not at {parent and parent.number}")
        number = now.number + 1 if now else 1
        entry = {"version": version, "parent": now.version if now else None, "note": note}
        self._files.mkdirs(self._at("log"))
        aside = f"log/.{uuid.uuid4().hex}"
        stream = self._files.create(self._at(aside), False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            self._move(aside, f"log/{number:020d}.json")
        finally:
            self._files.delete(self._at(aside), False)
        return Commit(number, version, entry["parent"], note)

    def publish(self, tables: dict[str, DataFrame], note: str = "", parent: Commit | None | bool = True) -> Commit:
        """Stage and commit. ``parent`` is the commit the tables were made from (None: an empty store; True: the present one)."""
        at = self.current() if parent is True else parent
        return self.commit(self.stage(tables), at, note)

    def rollback(self, to: int | None = None) -> Commit:
        """Commit an earlier version again, by default the one before the present; it's verified first."""
        log = self.history()
        if not log:
            raise ValueError(f"nothing is published at {self.path}")
        target = next((c.version for c in log if c.number == to), None) if to is not None else log[-1].parent
        if target is None:
            raise ValueError("there is no such version to go back to")
        self.verify(target)
        return self.commit(target, log[-1], f"back to {target}")

    def sweep(self) -> list[str]:
        """Remove what failed writers have left: staging folders, and versions that no entry names."""
        named = {c.version for c in self.history()}
        left = [f"staging/{s.getPath().getName()}" for s in self._list("staging")]
        left += [f"versions/{v}" for v in (s.getPath().getName() for s in self._list("versions")) if v not in named]
        for name in left:
            self._files.delete(self._at(name), True)
        return sorted(left)

    def _list(self, name: str):
        return self._files.listStatus(self._at(name)) if self._files.exists(self._at(name)) else []
