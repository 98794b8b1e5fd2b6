"""What the operators share: the scratch folder of the cluster, and connected components."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word where a contract says ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch in jobs that write intermediate tables.
ARROW_ROWS = 2_500


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a folder of our own only where that is unset and all tasks run here."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="terrace-")
        named = _OWN[context.applicationId]
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results not yet read can't be read any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark) + f"/{spark.sparkContext.applicationId}-*")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(where) or []:
        files.delete(status.getPath(), True)


@contextmanager
def arrow_rows(spark: SparkSession, most: int = ARROW_ROWS) -> Iterator[None]:
    """Fewer rows in an Arrow batch while a job of our own runs: buffers for whole texts stand outside the heap on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most if int(before) <= 0 else min(most, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs a reread."""
    path = scratch_path(df.sparkSession, name)
    with arrow_rows(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = [path]
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what ``written`` wrote for these tables; nothing may read them any more."""
    for df in tables:
        spark = df.sparkSession
        for path in getattr(df, "_scratch", []):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that gives memory back: after each batch what Arrow's pool holds unused, at its end what malloc does.

    Workers are used again and wait between tasks; what they hold then counts against the executor.
    """

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, given = pa.default_memory_pool(), 0
        for out in run(batches):
            yield out
            given += out.nbytes
            if given > 1 << 20:
                pool.release_unused()
                given = 0
        pool.release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return freed


def worker_state() -> dict:
    """What a Python worker keeps from one task to the next."""
    return sys.modules.setdefault("terrace_worker_state", types.ModuleType("terrace_worker_state")).__dict__


def fresh_worker() -> None:
    """Forget what an earlier operator left in this worker."""
    sys.modules.pop("terrace_worker_state", None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more of it than that."""
    return df.limit(rows + 1).count() <= rows


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``, both long: rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps; each round is a written table. Every step is an aggregate
    with map-side combine and an equi-join that adaptive execution may split, so a hub node is no single task.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
