"""Types and fixed vocabularies of the annotation model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
OBJECT = f"struct<class_id:int,class_name:string,box:{BOX},polygon:{RING},shape_type:string>"
IMAGE = f"image_path string, annotation_path string, width int, height int, objects array<{OBJECT}>, source_dataset string"

# Class vocabulary, split names and shares, decisions allowed for each kind of issue.
CLASSES = {0: "tree", 1: "TreeGroup"}
SPLITS = ("train", "val", "test")
SHARES = (0.70, 0.15, 0.15)
ALLOWED = {
    "ANNOTATION_CONFLICT": ("KEEP_A", "KEEP_B", "EXCLUDE"),
    "GEOMETRY": ("KEEP_AS_IS", "AUTO_FIX_APPROVED", "MANUAL_FIX", "EXCLUDE"),
}
# Severities, the status of what repairs itself, kinds of repair with their space, decisions on polygons.
SEVERITY = {"minor/local": "MINOR", "clearly erroneous": "ERRONEOUS", "complex/ambiguous": "AMBIGUOUS"}
REPAIRED = "AUTO_REPAIRED_DUPLICATE_VERTEX"
BOTH_REPAIRS = (("RAW_CONSECUTIVE_DUPLICATE", "raw_pixels"), ("EXPORT_ROUNDING_CONSECUTIVE_DUPLICATE", "generated_pixels_after_8_decimal_normalized_rounding"))
LINKED = ("KEEP_AS_IS", "MANUAL_FIX", "AUTO_FIX_APPROVED", "EXCLUDE")
WAITS = ("MANUAL_FIX", "AUTO_FIX_APPROVED")
#: Columns of the result log, in order; unknown columns of a row are ignored and missing ones are null.
RESULT_COLUMNS = (
    "run_id model split images instances epochs seed image_size batch_size learning_rate precision recall map50 map75 map50_95 ar100 "
    "tree_ap50 tree_ap50_95 group_ap50 group_ap50_95 train_seconds test_seconds ms_per_image size_mb peak_memory_gb device fingerprint note"
).split()


def class_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, k + 1) for k, v in CLASSES.items()], "class_id int, class_name string, category_id int")


def allowed_decisions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, d) for k, ds in ALLOWED.items() for d in ds], "issue_type string, decision string")
