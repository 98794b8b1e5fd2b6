"""Whole builds: from assets and objects to a split, checked and published data set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import audit, decisions, results, rules, splits
from ..sources.versions import Commit, Store


@dataclass
class Build:
    """What a build is made of; nothing is computed before one of the tables is asked for."""

    records: DataFrame
    manifest: DataFrame
    objects: DataFrame
    checks: DataFrame
    fingerprint: DataFrame


def safe_repairs(objects: DataFrame) -> DataFrame:
    """``objects(image_key, ordinal, class_id, polygon)`` with exact consecutive duplicates gone where a valid ring is left, and repair naming it."""
    out = G.with_safe_removal(objects, "polygon")
    done = (F.size("removed") > 0) & ~F.col("refused")
    out = out.withColumn("repair", F.when(done, F.struct(F.lit("RAW_CONSECUTIVE_DUPLICATE").alias("kind"), F.col("removed").alias("removed"), F.size("polygon").alias("before"), F.size("kept").alias("after"))))
    return out.withColumn("polygon", F.when(done, F.col("kept")).otherwise(F.col("polygon"))).drop("kept", "removed", "refused")


def prepare(assets: DataFrame, objects: DataFrame, parent: str | None = None, plan: DataFrame | None = None) -> Build:
    """Audit ``assets``, keep canonical members, split and check.

    ``assets``: content_sha256, scan_ord, annotator, has_path, signature, width, height and, for a split by parent images, the
    ``parent`` column. ``plan(content_sha256, plan)`` settles conflicts: contents kept by a decision count as included,
    those excluded or open don't.
    """
    status = audit.dispositions(assets).select("scan_ord", "status", "canonical")
    records = assets.join(status, "scan_ord")
    if plan is not None:
        chosen = plan.select("content_sha256", F.col("plan").alias("decided"))
        first = records.groupBy("content_sha256").agg(F.min(F.when(F.col("signature").isNotNull(), F.col("scan_ord"))).alias("first"))
        records = records.join(chosen, "content_sha256", "left").join(first, "content_sha256", "left")
        settled = F.when(F.col("decided") == "EXCLUDE", "excluded").when((F.col("decided") == "KEEP") & (F.col("scan_ord") == F.col("first")), "included").when(F.col("decided") == "KEEP", "duplicate")
        records = records.withColumn("status", F.when(F.col("status") == "conflict", F.coalesce(settled, F.lit("conflict"))).otherwise(F.coalesce(F.when(F.col("decided") == "EXCLUDE", F.lit("excluded")), F.col("status")))).drop("decided", "first")
    kept = records.where("status = 'included'").withColumn("image_id", F.substring("content_sha256", 1, 16))
    manifest = splits.grouped(kept, parent) if parent else splits.contiguous(kept, "content_sha256", "scan_ord")
    used = safe_repairs(objects).join(manifest.select(F.col("scan_ord").alias("image_key"), "split", "width", "height", "image_id"), "image_key")
    used = used.withColumn("error", F.expr(G.validity_error("polygon", "width", "height")))
    named = {
        "conflict left": records.where("status = 'conflict'"),
        "image id used twice": manifest.groupBy("image_id").count().where("count > 1"),
        "content in two splits": splits.leakage(manifest, "content_sha256"),
        "invalid polygon": used.where("error IS NOT NULL"),
        "object without image": objects.select(F.col("image_key").alias("scan_ord")).join(assets, "scan_ord", "left_anti"),
    }
    if parent:
        named["parent in two splits"] = splits.leakage(manifest, parent)
    columns = ["image_id", "content_sha256", "annotator", "split", "width", "height"]
    return Build(records, manifest, used, rules.checks(named), results.fingerprint(manifest.select(*columns), "image_id"))


def reviewed(assets: DataFrame, objects: DataFrame, required: DataFrame, answers: DataFrame, strict: bool = False, parent: str | None = None) -> Build:
    """A build after human decisions; refuses while a required row is open or invalid."""
    status = decisions.resolved(decisions.row_status(required, answers, strict))
    told = decisions.gate(status).first()
    if not told["safe_to_build"]:
        raise ValueError(f"decisions are not complete: {told['pending']} pending, {told['invalid']} invalid")
    return prepare(assets, objects, parent, decisions.content_plan(status))


def publish(build: Build, path: str) -> None:
    """Write the build below ``path`` once its checks hold: manifest and objects partitioned by split, then a marker."""
    rules.require(build.checks)
    build.manifest.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/manifest")
    build.objects.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/objects")
    build.fingerprint.coalesce(1).write.mode("errorifexists").json(f"{path}/fingerprint")


def publish_version(build: Build, store: Store, note: str = "") -> Commit:
    """Publish the build as a version of ``store`` once its checks hold; the version before stays and can be restored."""
    rules.require(build.checks)
    return store.publish({"manifest": build.manifest, "objects": build.objects, "fingerprint": build.fingerprint}, note)
