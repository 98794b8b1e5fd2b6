"""Tables: Parquet by name, delimited text with either separator, JSON, and single-file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def separator_of(header: str) -> str:
    """``;`` where the header has more of them than commas."""
    return ";" if header.count(";") > header.count(",") else ","


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Every column as a string; the separator is that of the header, a byte order mark is dropped, quoted cells may
    span lines, and a row with more or fewer cells than the header fails."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no header")
    header = first[0][0].removeprefix(BOM)
    sep = separator_of(header)
    names = [n.strip().strip('"') for n in header.split(sep)]
    if missing := sorted(set(columns or []) - set(names)):
        raise ValueError(f"{path} lacks columns: {missing}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.option("sep", sep).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", True)
    return reader.schema(schema).csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", mark: bool = False, replace: bool = False) -> None:
    """One delimited file; for reports, whose rows are few. ``mark`` puts a byte order mark before the header, as spreadsheets
    want it; what is at ``path`` is replaced only where that is asked for."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    mode = "overwrite" if replace else "errorifexists"
    df.coalesce(1).write.mode(mode).option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, replace: bool = False) -> None:
    """JSON lines; what is at ``path`` is replaced only where that is asked for. Refuses NaN and infinity, which JSON can't hold."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    if doubles:
        bad = df.where(" OR ".join(f"isnan(`{c}`) OR abs(`{c}`) = double('inf')" for c in doubles))
        if bad.limit(1).count():
            raise ValueError("not a JSON number")
    df.write.mode("overwrite" if replace else "errorifexists").json(path)


def write_once(df: DataFrame, path: str, keys: list[str]) -> str:
    """Write a table that must not change: ``written``, or ``same`` if equal rows are there; other rows are an error."""
    spark = df.sparkSession
    from py4j.protocol import Py4JJavaError

    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    except Py4JJavaError as e:
        raise ValueError(f"{path} can't be looked at") from e
    if not there:
        df.write.mode("errorifexists").parquet(path)
        return "written"
    old = spark.read.parquet(path).select(*df.columns)
    if old.exceptAll(df).limit(1).count() or df.exceptAll(old).limit(1).count():
        raise ValueError(f"{path} holds other rows")
    return "same"


def append_results(df: DataFrame, path: str, columns: list[str]) -> None:
    """Append to a result log: columns it doesn't know are left out, those that are missing are null."""
    rows = df.select(*(F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))
    rows.write.mode("append").parquet(path)
