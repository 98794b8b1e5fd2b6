"""The plan of an annotation: a fold over its repairs in a fixed order, every vertex with its place in the source.

For each annotation, in this order:

1. a manual copy, where an answer names one whose record of origin holds, takes the place of all shapes, and no other repair follows;
2. exact consecutive duplicates go from raw rings that the catalog calls safe;
3. a single proper crossing of slight severity, approved in an answer, is undone by turning vertices round;
4. rings move to the edge and are serialised, and duplicates that rounding has made go from the safe ones.

What is left has to be valid, but for self-intersections of shapes that an answer keeps as they are. All steps are
expressions over rings in the JVM (the rounding of coordinates is an Arrow function); joins are by annotation and shape.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schema import BOTH_REPAIRS, CLASSES, REPAIRED, SEVERITY
from .review import generated

# Kinds of repair beside the two of duplicate vertices.
MANUAL, UNCROSSED = "HUMAN_MANUAL_COPY", "APPROVED_SINGLE_CROSSING_2OPT"
EVENT = "struct<step:int,repair_type:string,review_id:string,before:int,after:int,places:array<int>>"


@dataclass
class Plan:
    """``shapes``: annotation, shape_index, label, polygon, places, exception, events. ``problems``: annotation, shape_index,
    review_id, problem; an annotation with one has no usable plan. ``events``: one row for each repair, in order of step."""

    shapes: DataFrame
    problems: DataFrame

    @property
    def events(self) -> DataFrame:
        return self.shapes.select("annotation", "shape_index", F.explode("events").alias("e")).select("annotation", "shape_index", "e.*")

    @property
    def usable(self) -> DataFrame:
        return self.shapes.join(self.problems.select("annotation").distinct(), "annotation", "left_anti")


def chosen_copies(sources: DataFrame, asked: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotation, copy) of manual copies that may be used, and the problems of the others.

    ``sources``: annotation, annotation_sha256, content_sha256. ``asked``: review_id, annotation, selected. ``copies``: copy, its
    copy_sha256 as it is now, and its record: original_annotation, original_annotation_sha256, fixed_annotation_sha256, content.
    """
    record = copies.select(F.col("copy").alias("selected"), "copy_sha256", "original_annotation", "original_annotation_sha256", "fixed_annotation_sha256", F.col("content_sha256").alias("copied_content"))
    rows = asked.join(sources, "annotation").join(record, "selected", "left")
    fits = (F.col("original_annotation") == F.col("annotation")) & (F.col("original_annotation_sha256") == F.col("annotation_sha256")) & (F.col("fixed_annotation_sha256") == F.col("copy_sha256")) & (F.col("copied_content") == F.col("content_sha256"))
    problem = F.when(F.col("selected") == "", "no copy is named").when(F.col("copy_sha256").isNull(), "no such copy").when(~F.coalesce(fits, F.lit(False)), "the copy's record doesn't hold")
    rows = rows.withColumn("problem", problem)
    each = rows.groupBy("annotation").agg(F.min("selected").alias("copy"), F.max("selected").alias("other"), F.max(F.col("problem").isNotNull()).alias("bad"))
    split = each.where("copy <> other").select("annotation", F.lit(None).cast("string").alias("review_id"), F.lit("rows name different copies").alias("problem"))
    problems = rows.where("problem IS NOT NULL").select("annotation", "review_id", "problem").unionByName(split)
    return each.where("NOT bad AND copy = other").select("annotation", "copy"), problems


def _event(step: int, kind: str, review: Column, before: str, after: str, places: Column) -> Column:
    return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("repair_type"), review.alias("review_id"), F.size(before).alias("before"), F.size(after).alias("after"), places.alias("places")).cast(EVENT)


def _without_duplicates(rows: DataFrame, when: Column, step: int, kind: str) -> DataFrame:
    """Rows with exact consecutive duplicates gone where ``when`` holds; places of those that went are an event."""
    out = G.settled(G.with_safe_removal(rows.withColumn("now", F.col("polygon")), "now"), "kept", "removed", "refused")
    acts = when & (F.size("removed") > 0)
    event = _event(step, kind, F.lit(None).cast("string"), "polygon", "kept", F.transform("removed", lambda i: F.get("places", i)))
    out = out.withColumn("events", F.when(acts & ~F.col("refused"), F.array_append("events", event)).otherwise(F.col("events")))
    out = out.withColumn("problem", F.coalesce("problem", F.when(acts & F.col("refused"), "ring has another fault")))
    left = F.filter("places", lambda _, i: ~F.array_contains("removed", i))
    out = out.withColumn("places", F.when(acts & ~F.col("refused"), left).otherwise(F.col("places"))).withColumn("polygon", F.when(acts & ~F.col("refused"), F.col("kept")).otherwise(F.col("polygon")))
    return G.settled(out.drop("now", "kept", "removed", "refused"), "polygon", "places", "events", "problem")


def _uncrossed(rows: DataFrame) -> DataFrame:
    """Rows with the only crossing undone where an answer approves it."""
    asked = F.col("decision") == "AUTO_FIX_APPROVED"
    out = G.settled(G.with_uncross(rows.withColumn("now", F.when(asked, F.col("polygon"))), "now"), "n_crossings", "fixed")
    differs = F.filter(F.sequence(F.lit(0), F.greatest(F.size("polygon") - 1, F.lit(0))), lambda i: F.get("polygon", i) != F.get("fixed", i))
    out = G.settled(out.withColumn("moved", F.when(F.col("fixed").isNotNull(), differs)), "moved")
    first, last = F.array_min("moved"), F.array_max("moved")
    turned = F.concat(F.slice("places", 1, first), F.reverse(F.slice("places", first + 1, last - first + 1)), F.slice("places", last + 2, F.greatest(F.size("places") - last - 1, F.lit(0))))
    wrong = F.when(~F.col("severity").eqNullSafe(F.lit(SEVERITY["minor/local"])), "only slight crossings are undone").when(F.col("n_crossings") != 1, "more or less than one crossing").when(F.col("fixed").isNull(), "turning vertices round doesn't give a simple ring")
    out = out.withColumn("problem", F.coalesce("problem", F.when(asked, wrong)))
    done = asked & wrong.isNull()
    event = _event(3, UNCROSSED, F.col("review_id"), "polygon", "fixed", F.slice("places", first + 1, last - first + 1))
    out = out.withColumn("events", F.when(done, F.array_append("events", event)).otherwise(F.col("events"))).withColumn("places", F.when(done, turned).otherwise(F.col("places"))).withColumn("polygon", F.when(done, F.col("fixed")).otherwise(F.col("polygon")))
    return G.settled(out.drop("now", "n_crossings", "fixed", "moved"), "polygon", "places", "events", "problem")


def planned(shapes: DataFrame, catalog: DataFrame, answers: DataFrame, copies: DataFrame, copied: DataFrame, sizes: DataFrame) -> Plan:
    """The plans of all annotations of ``shapes``.

    ``shapes``: annotation, annotation_sha256, content_sha256, shape_index, label, polygon, width, height. ``catalog``: review_id,
    annotation, shape_index, severity, review_status of polygons (one row a shape). ``answers``: review_id, human_decision,
    selected_annotation. ``copies``: see ``chosen_copies``; ``copied``: copy, shape_index, label, polygon, width, height.
    ``sizes``: content_sha256 and the image's image_width, image_height.
    """
    told = answers.select("review_id", F.trim(F.coalesce("human_decision", F.lit(""))).alias("decision"), F.trim(F.coalesce("selected_annotation", F.lit(""))).alias("selected"))
    rows = catalog.join(told, "review_id", "left").select("review_id", "annotation", "shape_index", "severity", (F.col("review_status") == REPAIRED).alias("safe"), F.coalesce("decision", F.lit("")).alias("decision"), F.coalesce("selected", F.lit("")).alias("selected"))
    sources = shapes.select("annotation", "annotation_sha256", "content_sha256").distinct()
    asked = rows.where("decision = 'MANUAL_FIX' AND NOT safe").select("review_id", "annotation", "selected")
    chosen, refused = chosen_copies(sources, asked, copies)
    own = shapes.join(chosen.select("annotation", F.lit(True).alias("manual")), "annotation", "left").where("manual IS NULL").select("annotation", "content_sha256", "shape_index", "label", "polygon", "width", "height", F.lit(None).cast("string").alias("copy"))
    theirs = copied.join(chosen, "copy").join(sources, "annotation").select("annotation", "content_sha256", "shape_index", "label", "polygon", "width", "height", "copy")
    all_ = own.unionByName(theirs).join(rows.select("review_id", "annotation", "shape_index", "severity", "safe", "decision"), ["annotation", "shape_index"], "left").join(sizes, "content_sha256", "left")
    manual = F.col("copy").isNotNull()
    all_ = all_.withColumns({"decision": F.when(manual, "").otherwise(F.coalesce("decision", F.lit(""))), "safe": ~manual & F.coalesce("safe", F.lit(False))})
    names = [v.lower() for v in CLASSES.values()]
    problem = F.when(~(F.col("width").eqNullSafe(F.col("image_width")) & F.col("height").eqNullSafe(F.col("image_height"))), "size isn't the image's").when(~F.coalesce(F.lower(F.trim("label")).isin(*names), F.lit(False)), "label isn't known")
    places = F.when(~manual & (F.size("polygon") > 0), F.sequence(F.lit(0), F.size("polygon") - 1))
    first = F.when(manual & (F.col("shape_index") == 1), F.array(_event(1, MANUAL, F.lit(None).cast("string"), "polygon", "polygon", F.lit(None)))).otherwise(F.array().cast(f"array<{EVENT}>"))
    all_ = G.settled(all_.withColumns({"problem": problem, "places": places, "events": first}), "polygon", "places", "events", "problem")
    all_ = _without_duplicates(all_, F.col("safe"), 2, BOTH_REPAIRS[0][0])
    all_ = _uncrossed(all_)
    all_ = generated(all_, "polygon", "polygon")
    all_ = _without_duplicates(all_, F.col("safe"), 4, BOTH_REPAIRS[1][0])
    exception = F.col("decision") == "KEEP_AS_IS"
    error = F.expr(G.validity_error("polygon", "width", "height"))
    all_ = G.settled(all_.withColumn("error", error), "error").withColumn("exception", exception)
    all_ = all_.withColumn("problem", F.coalesce("problem", F.when(F.col("error").isNotNull() & ~(F.col("exception") & (F.col("error") == "edges cross")), F.col("error"))))
    out = G.settled(all_.select("annotation", "content_sha256", "shape_index", "label", "polygon", "places", "exception", "events", "review_id", "problem"), "problem")
    problems = out.where("problem IS NOT NULL").select("annotation", "shape_index", "review_id", "problem").unionByName(refused.select("annotation", F.lit(None).cast("int").alias("shape_index"), "review_id", "problem"))
    return Plan(out.drop("review_id", "problem"), problems)
