"""Review work: what people must decide about conflicts and polygons, what repairs settle by themselves, and what is left.

Shapes have annotation, annotation_sha256, content_sha256, shape_index (from 1), label, polygon, width and height. All of it
is joins and aggregates; only the serialised coordinates need an Arrow function, for their exact rounding.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.arrow import round8_all
from ..schema import BOTH_REPAIRS, LINKED, REPAIRED, SEVERITY, WAITS
from . import matching

CHECK = ("category", "consecutive", "closing", "elsewhere", "invalid")


def serialised(polygon: Column, width: Column, height: Column) -> Column:
    """Points as they come back from label text: as shares of the image, rounded to 8 decimals, times its size."""
    points = F.arrays_zip(
        round8_all(F.transform(polygon, lambda p: p["x"] / width)).alias("x"), round8_all(F.transform(polygon, lambda p: p["y"] / height)).alias("y")
    )
    return F.transform(points, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y")))


def generated(shapes: DataFrame, polygon: str = "polygon", to: str = "generated") -> DataFrame:
    """``shapes`` with the polygon moved to the edge where it's at most a pixel off, then serialised."""
    out = shapes.withColumn(to, F.expr(G.clamp(polygon, "width", "height")))
    return G.settled(out.withColumn(to, serialised(F.col(to), F.col("width"), F.col("height"))), to)


def _checked(shapes: DataFrame, ring: str, to: str) -> DataFrame:
    kept = shapes.columns
    out = G.with_geometry(shapes, ring).select(*kept, F.struct(*CHECK, F.size("crossings").alias("crossings")).alias(to))
    return G.settled(out, to)


def geometry_rows(shapes: DataFrame) -> DataFrame:
    """Review rows of polygons with repeated vertices or an invalid ring, raw, moved to the edge or serialised.

    (review_id, issue_type, annotation, annotation_sha256, content_sha256, shape_index, label, raw, normalized, serialized,
    assessment, recommended): ids are ``G-``, 16 digits of the annotation's digest and the shape's index.
    """
    out = shapes.withColumn("moved", F.expr(G.clamp("polygon", "width", "height")))
    out = G.settled(out.withColumn("written", serialised(F.col("moved"), F.col("width"), F.col("height"))), "moved", "written")
    for ring, to in (("polygon", "raw"), ("moved", "normalized"), ("written", "serialized")):
        out = _checked(out, ring, to)
    checks = [F.col(c) for c in ("raw", "normalized", "serialized")]
    flagged, valid, crossed, doubled = F.lit(False), F.lit(True), F.lit(False), F.lit(False)
    for c in checks:
        flagged, valid = flagged | (c["category"] != "") | c["invalid"], valid & ~c["invalid"]
        crossed, doubled = crossed | (c["crossings"] > 0), doubled | (c["consecutive"] > 0)
    action = F.when((F.col("raw.category") == "A") & valid, "LIKELY_VALID_CLOSING_VERTEX").when(doubled & valid, "SAFE_REMOVE_DUPLICATE_VERTEX").otherwise("MANUAL_GEOMETRY_REPAIR")
    out = out.where(flagged).withColumn("assessment", F.when(crossed, "complex/ambiguous").otherwise("")).withColumn("recommended", action)
    name = F.concat(F.lit("G-"), F.substring("annotation_sha256", 1, 16), F.lit("-"), F.col("shape_index").cast("string"))
    return out.select(name.alias("review_id"), F.lit("GEOMETRY").alias("issue_type"), "annotation", "annotation_sha256", "content_sha256", "shape_index", "label", *checks, "assessment", "recommended")


def conflict_rows(members: DataFrame, conflicts: DataFrame, sections: Mapping[str, frozenset[str]] | None = None) -> DataFrame:
    """A review row for each pair of sources of a content in ``conflicts(content_sha256)``; what is asked for is every pair.

    ``members`` has content_sha256, place (its order in the content), annotation and annotator. Ids are ``C-``, 16 digits of the
    content's digest and the pair's number. The section is the one whose set of names, in lower case, the content's annotators
    are, or ``Other``.
    """
    used = members.join(conflicts.select("content_sha256").distinct(), "content_sha256", "left_semi")
    pairs = matching.pairs_in_groups(used, "content_sha256", "place")
    section = F.lit("Other")
    for name, people in (sections or {}).items():
        section = F.when(F.col("names") == F.array(*(F.lit(p) for p in sorted(people))), name).otherwise(section)
    kinds = used.groupBy("content_sha256").agg(F.sort_array(F.collect_set(F.lower("annotator"))).alias("names")).select("content_sha256", section.alias("section"))
    for side, at in (("a", "first"), ("b", "second")):
        one = used.select("content_sha256", F.col("place").alias(at), F.col("annotation").alias(f"annotation_{side}"), F.col("annotator").alias(f"annotator_{side}"))
        pairs = pairs.join(one, ["content_sha256", at])
    name = F.concat(F.lit("C-"), F.substring("content_sha256", 1, 16), F.lit("-"), F.col("pair").cast("string"))
    out = pairs.join(kinds, "content_sha256")
    return out.select(name.alias("review_id"), F.lit("ANNOTATION_CONFLICT").alias("issue_type"), "content_sha256", "pair", "section", "annotation_a", "annotator_a", "annotation_b", "annotator_b", F.lit("REVIEW_BOTH").alias("recommended"))


def annotation_stats(shapes: DataFrame) -> DataFrame:
    """(annotation, tree_count, treegroup_count, polygons, area): areas are summed one by one, not of their union."""
    label = F.lower(F.trim("label"))
    return shapes.groupBy("annotation").agg(
        F.count_if(label == "tree").alias("tree_count"), F.count_if(label == "treegroup").alias("treegroup_count"), F.count("polygon").alias("polygons"), F.sum(F.expr(G.area("polygon"))).alias("area")
    )


def repair_events(shapes: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs of ``cases(review_id, annotation, annotation_sha256, shape_index)``, and what can't be done.

    Exact consecutive duplicates go from the raw ring, then from the ring as it's written; each is an event (review_id,
    annotation, shape_index, repair_type, space, before, after, removed, polygon). The second table has (review_id, problem):
    the source is missing or has another digest, the ring has another fault as well, or nothing was there to remove.
    """
    keys = ["annotation", "shape_index"]
    source = shapes.select(*keys, F.col("annotation_sha256").alias("digest"), "polygon", "width", "height")
    rows = cases.select("review_id", *keys, "annotation_sha256").join(source, keys, "left")
    known = rows.where(F.col("annotation_sha256").eqNullSafe(F.col("digest")))
    raw = G.settled(G.with_safe_removal(known, "polygon"), "kept", "removed", "refused").withColumnsRenamed({"kept": "raw_kept", "removed": "raw_removed", "refused": "raw_refused"})
    done = G.settled(G.with_safe_removal(generated(raw, "raw_kept"), "generated"), "kept", "removed", "refused")
    good = done.where("NOT raw_refused AND NOT refused")
    each = [F.struct(F.lit(kind).alias("repair_type"), F.lit(space).alias("space"), F.size(a).alias("before"), F.size(b).alias("after"), F.col(c).alias("removed"), F.col(b).alias("polygon"))
            for (kind, space), a, b, c in zip(BOTH_REPAIRS, ("polygon", "generated"), ("raw_kept", "kept"), ("raw_removed", "removed"), strict=True)]
    events = good.select("review_id", *keys, F.explode(F.filter(F.array(*each), lambda e: F.size(e["removed"]) > 0)).alias("e")).select("review_id", *keys, "e.*")
    stale = rows.where(~F.col("annotation_sha256").eqNullSafe(F.col("digest"))).select("review_id", F.when(F.col("digest").isNull(), "source is missing").otherwise("source has changed").alias("problem"))
    faulty = done.where("raw_refused OR refused").select("review_id", F.lit("ring has another fault").alias("problem"))
    idle = good.where("size(raw_removed) = 0 AND size(removed) = 0").select("review_id", F.lit("nothing to remove").alias("problem"))
    return events, stale.unionByName(faulty).unionByName(idle)


def geometry_status(geometry: DataFrame, repaired: DataFrame) -> DataFrame:
    """``geometry`` with severity (of a self-intersection, else empty) and review_status."""
    done = repaired.select("review_id").distinct().withColumn("done", F.lit(True))
    severity = F.lit("")
    for told, name in SEVERITY.items():
        severity = F.when(F.col("assessment") == told, name).otherwise(severity)
    out = geometry.withColumn("severity", severity).join(done, "review_id", "left")
    return out.withColumn("review_status", F.when(F.col("done"), REPAIRED).otherwise("UNRESOLVED")).drop("done")


def overlap_rows(conflicts: DataFrame, geometry: DataFrame) -> DataFrame:
    """Polygons whose content is in conflict too, with the choices of a source that settle them.

    (content_sha256, conflict_review_id, geometry_review_id, removes, choices, geometry_status): a side settles a polygon if it's
    another annotation without any flagged polygon. Of several conflict rows of a content the last pair counts.
    """
    last = conflicts.groupBy("content_sha256").agg(F.max_by(F.struct("review_id", "annotation_a", "annotation_b"), "pair").alias("c"))
    flagged = geometry.select(F.col("annotation").alias("flagged")).distinct()
    for side in ("a", "b"):
        marks = flagged.select(F.col("flagged").alias(f"f{side}"))
        last = last.join(marks, F.col(f"c.annotation_{side}") == F.col(f"f{side}"), "left")
    both = geometry.join(last, "content_sha256")
    clean = [F.when(F.col(f"f{s}").isNull() & (F.col(f"c.annotation_{s}") != F.col("annotation")), f"KEEP_{s.upper()}") for s in ("a", "b")]
    out = both.withColumn("choices", F.concat_ws(";", *clean))
    return out.select("content_sha256", F.col("c.review_id").alias("conflict_review_id"), F.col("review_id").alias("geometry_review_id"), (F.col("choices") != "").alias("removes"), "choices", F.col("review_status").alias("geometry_status"))


def unresolved_rows(conflicts: DataFrame, geometry: DataFrame) -> DataFrame:
    """(review_id, issue_type, content_sha256, severity, linked): conflicts with the self-intersections of their content, and
    polygons that are neither repaired nor covered by a conflict. ``geometry`` has severity and review_status."""
    crossed = geometry.where("severity <> ''").groupBy("content_sha256").agg(
        F.array_join(F.sort_array(F.collect_set("review_id")), ";").alias("linked"), F.array_join(F.sort_array(F.collect_set("severity")), ";").alias("severity")
    )
    first = conflicts.select("review_id", "issue_type", "content_sha256").join(crossed, "content_sha256", "left").fillna("", ["linked", "severity"])
    alone = geometry.where(F.col("review_status") != REPAIRED).join(conflicts.select("content_sha256").distinct(), "content_sha256", "left_anti")
    columns = ["review_id", "issue_type", "content_sha256", "severity", "linked"]
    return first.select(*columns).unionByName(alone.withColumn("linked", F.lit("")).select(*columns))


def workload(conflicts: DataFrame, geometry: DataFrame) -> DataFrame:
    """(measure, value): how much there is to review, by recommendation, kind of repeated vertex and severity."""
    kind = F.when(F.col("raw.category") == "A", "closing vertex only").when(F.col("raw.category") == "B", "consecutive duplicate").when(F.col("raw.category") != "", "other repeated vertex")
    bad = F.when((F.col("raw.category") != "") & F.col("raw.invalid"), "repeated and invalid")
    each = F.array(F.concat(F.lit("recommended "), "recommended"), kind, bad, F.when(F.col("severity") != "", F.concat(F.lit("severity "), "severity")))
    told = geometry.select(F.explode(F.array_compact(each)).alias("measure")).union(conflicts.select(F.concat(F.lit("recommended "), "recommended")))
    told = told.union(unresolved_rows(conflicts, geometry).select(F.lit("unresolved rows")))
    return told.groupBy("measure").agg(F.count("*").alias("value"))


def source_plan(catalog: DataFrame, answers: DataFrame, repaired: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source selection first, then the polygons of the chosen source: (plans, rows, problems). Nothing is built from it.

    ``catalog``: review_id, issue_type, content_sha256, annotation_a, annotation_b. ``answers``: review_id, human_decision,
    selected_annotation, geometry_decisions (null, or a JSON object from ids of polygons of the content to decisions).
    A decision is one of the fixed names, ``KEEP_PATH:`` with a path, or empty.

    plans: (content_sha256, status, source, pending): EXCLUDED, AWAITING_SOURCE_SELECTION, INCONSISTENT, PENDING or REVIEW_RESOLVED.
    rows: (review_id, content_sha256, decision, chosen, pending). problems: (review_id, problem) of answers that can't be used.
    """
    given = answers.select("review_id", F.trim(F.coalesce("human_decision", F.lit(""))).alias("decision"), F.trim(F.coalesce("selected_annotation", F.lit(""))).alias("selected"), F.lit(None).cast("string").alias("by"))
    text = F.trim(F.coalesce("geometry_decisions", F.lit("")))
    noted = answers.where(text != "").select(F.col("review_id").alias("by"), F.from_json(text, "map<string,string>").alias("m"))
    linked = noted.where("m IS NOT NULL").select("by", F.explode("m").alias("review_id", "decision")).select("review_id", "decision", F.lit("").alias("selected"), "by")
    told = given.unionByName(linked)
    times = told.groupBy("review_id").agg(F.count("*").alias("times"), F.max_by(F.struct("decision", "selected", "by"), F.struct("decision", "selected")).alias("x")).select("review_id", "times", "x.*")
    parents = catalog.select(F.col("review_id").alias("by"), F.col("content_sha256").alias("by_content"))
    rows = catalog.join(times, "review_id", "left").join(parents, "by", "left").fillna("", ["decision", "selected"])
    d, is_path, geometric = F.col("decision"), F.startswith(F.col("decision"), F.lit("KEEP_PATH:")), F.col("issue_type") == "GEOMETRY"
    path = F.trim(F.substring(d, 11, 1 << 20))
    rows = rows.withColumn("chosen", F.when(d == "KEEP_A", F.col("annotation_a")).when(d == "KEEP_B", F.col("annotation_b")).when(is_path, F.when(path != "", path)).when(d == "GEOMETRY_FIXED_COPY", F.when(F.col("selected") != "", F.col("selected"))))
    picks = is_path | d.isin("KEEP_A", "KEEP_B", "GEOMETRY_FIXED_COPY")
    wrong = (
        F.when(F.col("times") > 1, "answered twice")
        .when((d != "") & ~picks & ~d.isin(*LINKED), "no such decision")
        .when(F.col("by").isNotNull() & (~geometric | ~F.col("by_content").eqNullSafe(F.col("content_sha256")) | ~d.isin(*LINKED)), "linked answer doesn't fit its row")
        .when(~geometric & d.isin(*(x for x in LINKED if x != "EXCLUDE")), "decision is for polygons")
        .when((F.col("selected") != "") & ((d == "") | d.isin(*LINKED)), "selection without use")
        .when(picks & F.col("chosen").isNull(), "nothing is chosen")
        .when((F.col("selected") != "") & (F.col("selected") != F.col("chosen")), "selection is another source")
    )
    rows = rows.withColumn("problem", wrong)
    strange = told.join(catalog, "review_id", "left_anti").select("review_id", F.lit("not in the catalog").alias("problem"))
    unread = noted.where("m IS NULL").select(F.col("by").alias("review_id"), F.lit("linked answers aren't a JSON object").alias("problem"))
    problems = rows.where("problem IS NOT NULL").select("review_id", "problem").unionByName(strange).unionByName(unread)
    conflict = ~geometric
    by = rows.groupBy("content_sha256").agg(
        F.bool_or(d == "EXCLUDE").alias("out"), F.count_if(conflict).alias("asked"), F.count_if(conflict & F.col("chosen").isNotNull()).alias("told"),
        F.min(F.when(conflict, F.col("chosen"))).alias("s0"), F.max(F.when(conflict, F.col("chosen"))).alias("s1"), F.min("annotation_a").alias("only"),
    )
    by = by.withColumn("source", F.when(F.col("out") | (F.col("told") < F.col("asked")) | (F.col("s0") != F.col("s1")), F.lit(None)).otherwise(F.coalesce("s0", "only")))
    done = repaired.select("review_id").distinct().withColumn("done", F.lit(True))
    rows = rows.join(by, "content_sha256").join(done, "review_id", "left")
    own = geometric & (F.col("annotation_a") == F.col("source"))
    open_ = F.when(F.col("out"), False).when(conflict, F.col("chosen").isNull()).otherwise(F.coalesce(own & F.col("done").isNull() & ((d == "") | d.isin(*WAITS)), F.lit(False)))
    strays = F.coalesce(own & picks & (d != "GEOMETRY_FIXED_COPY") & (F.col("chosen") != F.col("source")), F.lit(False))
    rows = rows.withColumn("pending", open_).withColumn("strays", strays)
    open_rows = rows.groupBy("content_sha256").agg(F.sort_array(F.collect_set(F.when(F.col("pending"), F.col("review_id")))).alias("open"), F.bool_or("strays").alias("strays"))
    plans = by.join(open_rows, "content_sha256")
    status = (
        F.when(F.col("out"), "EXCLUDED").when(F.col("told") < F.col("asked"), "AWAITING_SOURCE_SELECTION").when((F.col("s0") != F.col("s1")) | F.col("strays"), "INCONSISTENT")
        .when(F.size("open") > 0, "PENDING").otherwise("REVIEW_RESOLVED")
    )
    return plans.select("content_sha256", status.alias("status"), "source", F.array_join("open", ";").alias("pending")), rows.select("review_id", "content_sha256", "decision", "chosen", "pending"), problems
