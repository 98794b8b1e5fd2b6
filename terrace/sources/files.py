"""Files as rows: a recursive scan with hashes, and the format of annotation files by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# Suffixes of image files.
IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, stem, suffix, size, content_sha256) of each file below ``root`` with one of the suffixes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(F.lower(X.suffix(F.col("path"))).isin(*(f".{s}" for s in suffixes)))
    return files.select("path", X.stem(F.col("path")).alias("stem"), F.lower(X.suffix(F.col("path"))).alias("suffix"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_sha256"))


def texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text) of whole text files, without a byte order mark."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))


def with_format(files: DataFrame) -> DataFrame:
    """``files(path, text)`` with format: labelme, coco, yolo_box, yolo_polygon, empty, mixed or unknown."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda v: F.trim(v) != "")
    counts = F.array_distinct(F.transform(lines, lambda v: F.size(F.split(F.trim(v), r"\s+"))))
    box, polygon = F.exists(counts, lambda n: n == 5), F.exists(counts, lambda n: (n >= 7) & (n % 2 == 1))
    other = F.exists(counts, lambda n: (n != 5) & ~((n >= 7) & (n % 2 == 1)))
    shapes = F.get_json_object("text", "$.shapes").isNotNull() & F.get_json_object("text", "$.imagePath").isNotNull()
    is_json = X.suffix(F.col("path")) == ".json"
    return files.withColumn(
        "format",
        F.when(is_json & shapes, "labelme").when(is_json & F.get_json_object("text", "$.images").isNotNull(), "coco").when(is_json, "unknown")
        .when(F.size(lines) == 0, "empty").when(other, "unknown").when(box & polygon, "mixed").when(box, "yolo_box").otherwise("yolo_polygon"),
    )
