"""Settings of a project, the description of a data set for training, and folders that must not be written to."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import SPLITS
from .tables import BOM

# Sections that settings must have.
SECTIONS = ("input", "dataset", "classes", "models", "training", "evaluation")


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    """Settings from a YAML or JSON file on any file system Spark reads; class numbers become integers, their names strings.

    JSON needs nothing besides; YAML is read where its library is there. Names that begin with an underscore are private: ``public``
    leaves them out.
    """
    text = spark.read.text(path, wholetext=True).first()
    text = (text[0] if text else "").removeprefix(BOM)
    if path.endswith(".json"):
        found = json.loads(text or "{}")
    else:
        import yaml

        found = yaml.safe_load(text) or {}
    if missing := [s for s in SECTIONS if s not in found]:
        raise ValueError(f"settings lack sections: {missing}")
    return found | {"classes": {int(k): str(v) for k, v in found["classes"].items()}, "_path": path}


def public(settings: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in settings.items() if not k.startswith("_")}


def write_description(spark: SparkSession, folder: str, root: str, classes: dict[int, str]) -> None:
    """One text file below ``folder`` that tells where a data set's splits and what its classes are, as YAML; not over another."""
    lines = [f"path: {json.dumps(root)}", *(f"{s}: {s}/images" for s in SPLITS), "names:", *(f"  {k}: {json.dumps(v)}" for k, v in classes.items())]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("errorifexists").text(folder)


def overlapping(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(output, input) of ``outputs(path)`` and ``inputs(path)`` of which one lies in the other or is it.

    Each path meets the other side's by the folders above it, an equi-join; only pairs that overlap are made.
    """

    def above(rows: DataFrame, name: str) -> DataFrame:
        parts = rows.select(F.col("path").alias(name), X.path_parts(F.col("path")).alias("parts"))
        levels = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))
        return parts.select(name, F.array_join("parts", "/").alias("whole"), F.explode(levels).alias("at"))

    out, source = above(outputs, "output"), above(inputs, "input")
    in_source = out.join(source.where("at = whole").select("input", "at"), "at").select("output", "input")
    in_output = source.join(out.where("at = whole").select("output", "at"), "at").select("output", "input")
    return in_source.union(in_output).distinct()
