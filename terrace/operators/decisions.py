"""Decision tables: the status of each required row, the plan for each content, and the gate.

``required`` has review_id, issue_type, content_sha256, annotation_a, annotation_b; ``answers`` has review_id,
issue_type, content_sha256, human_decision, selected_annotation, and may hold rows twice or unknown ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ALLOWED


def row_status(required: DataFrame, answers: DataFrame, strict: bool = False, problems: DataFrame | None = None) -> DataFrame:
    """(review_id, issue_type, content_sha256, decision, source, status, errors): COMPLETE, PENDING or INVALID.

    Rows of ``problems(problem)``, such as a changed source, make every row invalid; unknown answers are invalid rows.
    """
    decision = F.trim(F.coalesce("human_decision", F.lit("")))
    one = answers.groupBy("review_id").agg(
        F.count("*").alias("times"),
        F.max_by(F.struct(F.col("issue_type").alias("type"), F.col("content_sha256").alias("content"), decision.alias("decision"), F.trim(F.coalesce("selected_annotation", F.lit(""))).alias("selected")), F.struct("human_decision", "selected_annotation")).alias("x"),
    ).select(F.col("review_id").alias("answer_id"), "times", "x.*")
    both = required.join(one, required["review_id"] == one["answer_id"], "full_outer")
    known, answered = F.col("review_id").isNotNull(), F.col("answer_id").isNotNull()
    d = F.coalesce("decision", F.lit(""))
    allowed = F.lit(False)
    for kind, choices in ALLOWED.items():
        allowed = allowed | ((F.col("issue_type") == kind) & d.isin(*choices))
    source = F.when(d == "KEEP_A", F.col("annotation_a")).when(d == "KEEP_B", F.col("annotation_b"))
    errors = [
        (~known, "not in the catalog"),
        (known & ~answered, "no answer"),
        (known & answered & ~(F.col("content").eqNullSafe(F.col("content_sha256")) & F.col("type").eqNullSafe(F.col("issue_type"))), "answers another case"),
        (known & (F.col("times") > 1), "answered twice"),
        (known & (d != "") & ~allowed, "choice not offered here"),
        (known & (F.coalesce("selected", F.lit("")) != "") & ~d.isin("KEEP_A", "KEEP_B", "MANUAL_FIX"), "selection without use"),
        (known & d.isin("KEEP_A", "KEEP_B") & source.isNull(), "chosen side is empty"),
        (known & source.isNotNull() & (F.col("selected") != "") & (F.col("selected") != source), "selection is the other side"),
    ]
    if strict:
        errors.append((known & (F.col("issue_type") == "GEOMETRY") & (d != "") & (d != "EXCLUDE"), "bad geometry must be excluded"))
    found = F.array_compact(F.array(*(F.when(c, F.lit(e)) for c, e in errors)))
    out = both.select(
        F.coalesce("review_id", F.concat(F.lit("UNKNOWN:"), "answer_id")).alias("review_id"), F.coalesce("issue_type", F.lit("UNKNOWN")).alias("issue_type"), "content_sha256",
        d.alias("decision"), source.alias("source"), answered.alias("answered"), found.alias("found"),
    )
    if problems is not None:
        told = problems.agg(F.array_sort(F.collect_list("problem")).alias("problems"))  # one row
        out = out.crossJoin(F.broadcast(told)).withColumn("found", F.concat("found", "problems"))
        poisoned = F.size("problems") > 0
    else:
        poisoned = F.lit(False)
    status = F.when((F.size("found") > 0) & (F.col("answered") | poisoned), "INVALID").when((F.size("found") > 0) | (F.col("decision") == ""), "PENDING").otherwise("COMPLETE")
    return out.select("review_id", "issue_type", "content_sha256", "decision", "source", status.alias("status"), F.array_join("found", "; ").alias("errors"))


def content_plan(status: DataFrame) -> DataFrame:
    """(content_sha256, plan, source): of contents all of whose rows are complete; EXCLUDE wins, KEEP choices must agree."""
    known = status.where("issue_type <> 'UNKNOWN'")
    out = known.groupBy("content_sha256").agg(
        F.bool_and(F.col("status") == "COMPLETE").alias("complete"), F.bool_or(F.col("decision") == "EXCLUDE").alias("exclude"),
        F.min("source").alias("s0"), F.max("source").alias("s1"),
    )
    plan = F.when(~F.col("complete"), "INCOMPLETE").when(F.col("exclude"), "EXCLUDE").when(F.col("s0") != F.col("s1"), "INVALID").otherwise("KEEP")
    out = out.withColumn("plan", plan)
    return out.select("content_sha256", "plan", F.when(F.col("plan") == "KEEP", F.col("s0")).alias("source"))


def resolved(status: DataFrame) -> DataFrame:
    """``status`` after the second pass: rows of a content whose choices disagree become invalid."""
    bad = content_plan(status).where("plan = 'INVALID'").select("content_sha256", F.lit(True).alias("disagree"))
    out = status.join(bad, "content_sha256", "left")
    clash = F.coalesce("disagree", F.lit(False)) & (F.col("issue_type") != "UNKNOWN")
    return out.select(
        "review_id", "issue_type", "content_sha256", "decision", "source",
        F.when(clash, "INVALID").otherwise(F.col("status")).alias("status"), F.when(clash, "choices for one content differ").otherwise(F.col("errors")).alias("errors"),
    )


def gate(status: DataFrame) -> DataFrame:
    """One row: counts of statuses, and whether all rows are complete."""
    out = status.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("COMPLETE", "PENDING", "INVALID")))
    return out.withColumn("safe_to_build", (F.col("pending") == 0) & (F.col("invalid") == 0))


def unresolved(status: DataFrame, repaired: DataFrame) -> DataFrame:
    """Rows still open: less those repaired, and less geometry rows of contents that a conflict covers already."""
    left = status.join(repaired.select("review_id"), "review_id", "left_anti")
    covered = left.where("issue_type = 'ANNOTATION_CONFLICT'").select("content_sha256").distinct()
    geometry = left.where("issue_type = 'GEOMETRY'").join(covered, "content_sha256", "left_anti")
    return left.where("issue_type <> 'GEOMETRY'").unionByName(geometry)
