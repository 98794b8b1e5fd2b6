"""Import of submissions: assignments against tasks, the latest annotation of each, points in pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X

TASKS = (
    "project long, data struct<image:string>, annotations array<struct<id:string,updated_at:string,created_at:string,was_cancelled:boolean,"
    "result array<struct<type:string,original_width:int,original_height:int,value:struct<points:array<array<double>>,polygonlabels:array<string>>>>>>"
)


def latest_annotations(tasks: DataFrame) -> DataFrame:
    """(project, filename, submitted, annotation) of each task: the last annotation that wasn't cancelled, by stamp, then id.

    ``submitted`` tells a task without any annotation from one with an empty one.
    """
    rows = tasks.select("project", X.task_filename(F.col("data.image")).alias("filename"), F.explode_outer(F.filter("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))).alias("a"))
    order = F.struct(X.stamp(F.col("a.updated_at"), F.col("a.created_at")), F.coalesce(F.expr("try_cast(a.id AS bigint)"), F.lit(-1)), F.col("a.id"))
    out = rows.groupBy("project", "filename").agg(F.max_by(F.when(F.col("a").isNotNull(), F.col("a")), F.when(F.col("a").isNotNull(), order)).alias("annotation"))
    return out.withColumn("submitted", F.col("annotation").isNotNull())


def shapes(latest: DataFrame) -> DataFrame:
    """(project, filename, ordinal, label, polygon) of submitted polygons, percent turned into pixels."""
    rows = latest.where("submitted").select("project", "filename", F.posexplode("annotation.result").alias("ordinal", "r")).where("r.type = 'polygonlabels'")
    rows = rows.withColumn("percent", F.transform("r.value.points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select("project", "filename", "ordinal", F.get("r.value.polygonlabels", F.lit(0)).alias("label"), F.expr(G.from_percent("percent", "r.original_width", "r.original_height")).alias("polygon"))


def assignments(plan: DataFrame, state: DataFrame) -> DataFrame:
    """(alias, project, filename) of ``plan(alias, images)`` and ``state(alias, project)``; a plan is small and checked as such by the planner."""
    return plan.join(state, "alias").select("alias", "project", F.explode("images").alias("filename"))


def import_checks(plan: DataFrame, state: DataFrame, latest: DataFrame) -> dict[str, DataFrame]:
    """Tables that should be empty: aliases on one side, images assigned twice in a project, tasks without assignment and the reverse."""
    given = assignments(plan, state)
    return {
        "alias without project": plan.join(state, "alias", "left_anti"),
        "project without alias": state.join(plan, "alias", "left_anti"),
        "alias used twice": state.groupBy("alias").count().where("count > 1"),
        "malformed alias": plan.where(~F.col("alias").rlike(X.ALIAS)),
        "image assigned twice": given.groupBy("project", "filename").count().where("count > 1"),
        "assignment without task": given.join(latest, ["project", "filename"], "left_anti"),
        "task without assignment": latest.join(given, ["project", "filename"], "left_anti"),
    }


def prediction_checks(predictions: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    """Exact coverage of ``expected(filename, image_sha256, width, height)`` by ``predictions`` of the same columns and scores."""
    both = predictions.withColumnsRenamed({"image_sha256": "h2", "width": "w2", "height": "y2"}).join(expected, "filename")
    return {
        "image without prediction record": expected.join(predictions, "filename", "left_anti"),
        "record without image": predictions.join(expected, "filename", "left_anti"),
        "hash or size differs": both.where(~(F.col("h2").eqNullSafe(F.col("image_sha256")) & F.col("w2").eqNullSafe(F.col("width")) & F.col("y2").eqNullSafe(F.col("height")))),
        "unsafe name": predictions.where(~X.safe_name(F.col("filename"))),
        "score out of range": predictions.where(F.exists("predictions", lambda p: F.isnan(p["confidence"]) | ~p["confidence"].between(0, 1))),
    }
