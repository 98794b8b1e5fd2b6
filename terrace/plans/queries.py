"""The registered queries: each applies an operator to the derived annotation tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from .. import scratch
from ..operators import annotation_plan as plans
from ..operators import audit, decisions, evaluation, improvement, label_overlap, matching, merging, reconcile, results, review, rules, splits
from ..schema import class_dimension
from ..sources import fixtures
from ..sources.tables import read_table
from ..sources.versions import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# -- matching and audit -------------------------------------------------------------------------------------------


@query
def asset_match_status(spark, d):
    return matching.match(read_table(spark, d, "documents"), read_table(spark, d, "labels"), "doc_id").groupBy("status").agg(F.count("*").alias("n"))


@query
def missing_annotations(spark, d):
    return read_table(spark, d, "documents").join(read_table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query
def orphan_annotations(spark, d):
    return read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality", "toxic")


@query
def folder_stem_match(spark, d):
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    images = docs.select(F.col("source").alias("folder"), (F.col("doc_id") % 50).cast("string").alias("stem"), F.col("doc_id").cast("string").alias("path"))
    notes = labels.join(docs, "doc_id").select(F.col("source").alias("folder"), (F.col("doc_id") % 50).cast("string").alias("stem"), F.col("doc_id").cast("string").alias("path"))
    return matching.match_in_folders(images, notes).select("folder", "stem", "n_images", "n_annotations", "status")


@query
def content_dup_groups(spark, d):
    return audit.duplicate_groups(fixtures.assets(spark, d))


@query
def annotation_conflicts(spark, d):
    return audit.conflicts(fixtures.assets(spark, d))


@query
def canonical_selection(spark, d):
    return audit.dispositions(fixtures.assets(spark, d))


@query
def disposition_counts(spark, d):
    return audit.disposition_counts(fixtures.assets(spark, d))


@query
def audit_gate(spark, d):
    return audit.gate(fixtures.assets(spark, d))


@query
def conflict_pairs(spark, d):
    docs = read_table(spark, d, "documents").select(F.sha2("text", 256).alias("content_sha256"), "doc_id")
    return matching.pairs_in_groups(docs, "content_sha256", "doc_id")


@query
def exclusion_reasons(spark, d):
    rows = fixtures.assets(spark, d)
    why = X.reasons((~F.col("has_path"), "missing annotation"), (F.col("signature").isNull() & F.col("has_path"), "invalid annotation"), (F.col("annotator") == "src0", "unsupported label"), (F.col("scan_ord") % 13 == 0, "dimensions differ"))
    return rows.select("scan_ord", why.alias("reason")).where("reason <> ''")


@query
def exclusion_histogram(spark, d):
    return exclusion_reasons(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query
def folder_rollup(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("source").alias("annotator"), F.col("lang").alias("folder"), "n_chars")
    return audit.folder_rollup(docs, "folder", "n_chars")


@query
def tile_parent_groups(spark, d):
    rows = fixtures.manifest(spark, d).select(X.tile_parent(F.col("asset_name")).alias("parent"))
    return audit.tile_parents(rows, "parent")


@query
def multiplicity_profile(spark, d):
    return audit.multiplicity(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def snapshot_diff(spark, d):
    docs = read_table(spark, d, "documents")
    before = docs.where("doc_id % 17 <> 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    now = docs.where("doc_id % 19 <> 0").select("doc_id", F.when(F.col("doc_id") % 23 == 0, F.lit("changed")).otherwise(F.sha2("text", 256)).alias("digest"))
    return matching.snapshot_diff(before, now, "doc_id", "digest")


@query
def historical_versions(spark, d):
    """Each document with the number of rows that hold its text, the first and the last of them, and the ids of all others."""
    docs = read_table(spark, d, "documents").select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("h"))
    held = docs.groupBy("h").agg(F.count("*").alias("versions"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    others = F.transform(F.filter("ids", lambda i: i != F.col("doc_id")), lambda i: i.cast("string"))
    return docs.join(held, "h").select("doc_id", "versions", "first", "last", F.array_join(others, ",").alias("others"))


# -- rules and statistics -----------------------------------------------------------------------------------------


@query
def validation_issues(spark, d):
    rings = fixtures.rings(spark, d)
    one = F.struct((F.col("label") % 3).cast("int").alias("class_id"), F.expr(G.box("ring")).alias("box"), F.expr("if(label = 9, slice(ring, 1, 2), ring)").alias("polygon"))
    none = F.expr("label = 8")
    images = rings.select(F.col("vec_id").alias("key"), F.lit(700).alias("width"), F.lit(700).alias("height"), F.when(none, F.array().cast(f"array<{rings.select(one.alias('o')).schema['o'].dataType.simpleString()}>")).otherwise(F.array(one)).alias("objects"))
    return rules.object_issues(images).select("key", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), "status")


@query
def label_exclusion(spark, d):
    rings = fixtures.rings(spark, d)
    o = F.struct(F.concat(F.lit(" Class"), (F.col("label") % 4).cast("string")).alias("class_name"), F.when(F.col("vec_id") % 5 == 0, "Circle").otherwise("polygon").alias("shape_type"))
    images = rings.groupBy(F.expr("vec_id div 3").alias("key")).agg(F.collect_list(o).alias("objects"))
    return rules.excluded_images(images, ("class3",), ("circle",)).select("key", "matched")


@query
def dataset_statistics(spark, d):
    return results.statistics(fixtures.manifest(spark, d))


@query
def counts_by_split(spark, d):
    rows = splits.contiguous(fixtures.manifest(spark, d), "shuffle_key", "image_id")
    return rows.groupBy("split", "source_dataset").agg(F.count("*").alias("images"), F.sum("number_of_objects").alias("objects"), F.max("number_of_objects").alias("most"))


@query
def duplicates_between_folders(spark, d):
    """Documents as assets of their source's folder and language: groups that lie in more than one folder."""
    rows = fixtures.assets(spark, d).join(read_table(spark, d, "documents").select(F.col("doc_id").alias("scan_ord"), F.col("lang").alias("folder")), "scan_ord")
    return audit.duplicates_between(rows, "folder")


@query
def class_counts_by_split(spark, d):
    """Rings as objects of images, five an image: instances of each class in each split."""
    rings = fixtures.rings(spark, d).select(F.expr("vec_id div 5").alias("image_id"), F.when(F.col("label") < 8, F.col("label") % 2).otherwise(9).cast("int").alias("class_id"))
    images = rings.select("image_id").distinct().withColumn("split", F.when(F.col("image_id") % 10 < 7, "train").when(F.col("image_id") % 10 < 9, "val").otherwise("test"))
    return audit.class_counts(images, rings, class_dimension(spark))


@query
def reused_split(spark, d):
    """A manifest with the split of an earlier build, written once."""
    rows = fixtures.manifest(spark, d)
    frozen = scratch.kept(splits.contiguous(rows, "shuffle_key", "image_id").select("image_id", "split"), "frozen")
    return splits.reused(rows, "image_id", frozen).select("image_id", "split")


@query
def size_distribution(spark, d):
    return fixtures.manifest(spark, d).groupBy("width", "height").agg(F.count("*").alias("n"))


@query
def object_histogram(spark, d):
    rows = fixtures.manifest(spark, d)
    return rows.select(F.width_bucket(F.col("number_of_objects").cast("double"), F.lit(0.0), F.lit(40.0), F.lit(30)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query
def class_distribution_zero_filled(spark, d):
    objects = read_table(spark, d, "embeddings").select(F.col("label").cast("long").alias("class_id"))
    return results.class_distribution(objects, spark.range(15).select(F.col("id").alias("class_id")))


@query
def label_counts_by_folder(spark, d):
    docs = read_table(spark, d, "documents")
    out = results.label_counts(docs, "source", "lang")
    return out.select("source", F.concat_ws(",", F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))).alias("counts"))


@query
def integrity_checks(spark, d):
    docs, labels, lines = read_table(spark, d, "documents"), read_table(spark, d, "labels"), read_table(spark, d, "lineitem")
    return rules.checks(
        {
            "duplicate document id": docs.groupBy("doc_id").count().where("count > 1"),
            "label without document": labels.join(docs.select("doc_id"), "doc_id", "left_anti"),
            "line key used twice": lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
            "text repeated": docs.groupBy(F.sha2("text", 256)).count().where("count > 1"),
        }
    )


# -- geometry -----------------------------------------------------------------------------------------------------


@query
def ring_area_bbox(spark, d):
    rows = fixtures.rings(spark, d).withColumn("b", F.expr(G.box("ring")))
    return rows.select("vec_id", F.round(F.expr(G.area("ring")), 6).alias("area"), "b.x1", "b.y1", "b.x2", "b.y2")


@query
def ring_canonical_key(spark, d):
    rows = fixtures.rings(spark, d).withColumn("turned", F.expr("if(vec_id % 2 = 0, reverse(ring), concat(slice(ring, 3, 3), slice(ring, 1, 2)))"))
    key = rows.withColumn("k", F.expr(G.ring_key("turned")))
    first, second = F.get("k", F.lit(0)), F.get("k", F.lit(1))
    return key.select("vec_id", F.size("k").alias("n"), first["x"].alias("x0"), first["y"].alias("y0"), second["x"].alias("x1"), second["y"].alias("y1"))


@query
def ring_self_intersections(spark, d):
    rows = fixtures.rings(spark, d).withColumn("c", F.expr(G.crossings("ring")))
    return rows.select("vec_id", F.size("c").cast("long").alias("crossings"), F.expr(G.intersects_itself("ring")).alias("crosses"))


@query
def ring_geometry_class(spark, d):
    rows = fixtures.rings(spark, d).withColumn("ring", F.expr(
        "CASE vec_id % 4 WHEN 0 THEN ring WHEN 1 THEN concat(ring, slice(ring, 1, 1)) WHEN 2 THEN concat(slice(ring, 1, 2), slice(ring, 2, 4)) ELSE concat(slice(ring, 1, 3), slice(ring, 1, 1), slice(ring, 4, 2)) END"))
    return G.with_geometry(rows).select("vec_id", "category", "consecutive", "closing", "elsewhere", F.size("crossings").alias("n_crossings"), "invalid", "recommended")


@query
def ring_validity(spark, d):
    return fixtures.rings(spark, d).select("vec_id", F.coalesce(F.expr(G.validity_error("ring", "600", "1024")), F.lit("valid")).alias("verdict"))


@query
def uncross_two_opt(spark, d):
    out = G.with_uncross(fixtures.rings(spark, d))
    return out.select("vec_id", F.col("n_crossings").cast("long").alias("n_crossings"), F.col("fixed").isNotNull().alias("fixable"), F.round(F.expr(G.area("fixed")), 6).alias("area"))


@query
def remove_consecutive_vertices(spark, d):
    rows = read_table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", F.floor(F.col("value") / 50).cast("double").alias("v")))).alias("e"))
    rings = rows.select("user_id", F.transform("e", lambda e: F.struct(e["v"].alias("x"), F.lit(0.0).alias("y"))).alias("ring"))
    out = rings.withColumn("kept", F.expr(G.distinct_neighbours("ring")))
    return out.select("user_id", F.size("ring").alias("n"), F.size("kept").alias("kept"), F.concat_ws(",", F.expr("transform(filter(sequence(0, size(ring) - 1), i -> i > 0 AND ring[i] = ring[i - 1]), i -> CAST(i AS STRING))")).alias("removed"))


@query
def percent_to_pixel(spark, d):
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(2)]
    rows = read_table(spark, d, "embeddings").select("vec_id", F.array(F.struct(((e[0] + 1) * 50).alias("x"), ((e[1] + 1) * 50).alias("y"))).alias("p"))
    q = F.get(F.expr(G.from_percent("p", "1200", "300")), F.lit(0))
    return rows.select("vec_id", q["x"].alias("x"), q["y"].alias("y"))


@query
def bbox_convert(spark, d):
    rows = fixtures.boxes(spark, d).withColumn("s", F.expr(G.corners_to_sides("box"))).withColumn("c", F.expr(G.crop("box", "1024", "1024")))
    s = [F.get("s", F.lit(i)) for i in range(4)]
    back = F.expr(G.center_to_corners("s[0] + s[2] / 2", "s[1] + s[3] / 2", "s[2]", "s[3]"))
    return rows.select("vec_id", s[2].alias("w"), s[3].alias("h"), F.col("c.x1").alias("crop_x1"), F.col("c.y2").alias("crop_y2"), F.round(back["x2"], 6).alias("x2"))


@query
def clamp_edges(spark, d):
    rows = fixtures.rings(spark, d).withColumn("p", F.expr(G.clamp(G.scaled("ring", "1.0", "1.0"), "640", "480")))
    return rows.select("vec_id", F.posexplode("p").alias("i", "q")).select("vec_id", "i", "q.x", "q.y")


# -- decisions ----------------------------------------------------------------------------------------------------


def _required(spark, d):
    labels = read_table(spark, d, "labels").join(read_table(spark, d, "documents"), "doc_id")
    kind = F.when(F.col("quality") == 1, "ANNOTATION_CONFLICT").otherwise("GEOMETRY")
    return labels.select(F.concat(F.lit("R-"), F.col("doc_id").cast("string")).alias("review_id"), kind.alias("issue_type"), F.concat(F.lit("c"), (F.col("doc_id") % 60).cast("string")).alias("content_sha256"),
                         F.concat(F.lit("a"), (F.col("doc_id") % 2).cast("string")).alias("annotation_a"), F.when(F.col("doc_id") % 5 != 0, F.lit("b")).alias("annotation_b"), "doc_id")


def _answers(spark, d):
    r = _required(spark, d).where("doc_id % 29 <> 0")
    choice = F.expr("CASE doc_id % 7 WHEN 0 THEN 'EXCLUDE' WHEN 1 THEN 'KEEP_A' WHEN 2 THEN 'KEEP_B' WHEN 3 THEN 'KEEP_AS_IS' WHEN 4 THEN ' ' WHEN 5 THEN 'KEEP_A' ELSE 'AUTO_FIX_APPROVED' END")
    rows = r.select("review_id", "issue_type", F.expr("if(doc_id % 31 = 0, 'other', content_sha256)").alias("content_sha256"), choice.alias("human_decision"), F.expr("if(doc_id % 37 = 0, 'a0', '')").alias("selected_annotation"), "doc_id")
    return rows.unionByName(rows.where("doc_id % 41 = 0")).unionByName(rows.where("doc_id % 43 = 0").withColumn("review_id", F.concat(F.lit("X"), "review_id"))).drop("doc_id")


@query
def decision_row_status(spark, d):
    out = decisions.row_status(_required(spark, d).drop("doc_id"), _answers(spark, d))
    return out.select("review_id", "issue_type", "status", "errors")


@query
def decision_content_plan(spark, d):
    return decisions.content_plan(decisions.row_status(_required(spark, d).drop("doc_id"), _answers(spark, d)))


@query
def decision_resolved(spark, d):
    return decisions.resolved(decisions.row_status(_required(spark, d).drop("doc_id"), _answers(spark, d))).groupBy("status").agg(F.count("*").alias("n"))


@query
def decision_gate(spark, d):
    return decisions.gate(decisions.row_status(_required(spark, d).drop("doc_id"), _answers(spark, d)))


# -- splits, identity, export -------------------------------------------------------------------------------------


@query
def split_contiguous(spark, d):
    return splits.contiguous(fixtures.manifest(spark, d), "shuffle_key", "image_id").select("image_id", "split")


@query
def split_grouped(spark, d):
    rows = fixtures.manifest(spark, d).select("image_id", X.parent_group(F.col("asset_name")).alias("parent"))
    return splits.grouped(rows, "parent").select("image_id", "parent", "split")


@query
def split_group_leakage(spark, d):
    rows = splits.contiguous(fixtures.manifest(spark, d), "shuffle_key", "image_id")
    return splits.leakage(rows, "source_dataset").select("source_dataset", "splits", "n")


@query
def split_intersect(spark, d):
    rows = splits.contiguous(fixtures.manifest(spark, d), "shuffle_key", "image_id")
    return rows.where("split = 'train'").select("content_sha256").intersect(rows.where("split = 'test'").select("content_sha256"))


@query
def set_except(spark, d):
    rows = splits.contiguous(fixtures.manifest(spark, d), "shuffle_key", "image_id")
    return rows.where("split = 'val'").select("content_sha256").exceptAll(rows.where("split = 'train'").select("content_sha256"))


@query
def set_equality(spark, d):
    rows = fixtures.manifest(spark, d).select("image_id")
    labelled = read_table(spark, d, "labels").select(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16).alias("image_id"))
    return matching.same_sets(rows, labelled)


@query
def prefix_collisions(spark, d):
    return fixtures.manifest(spark, d).groupBy(F.substring("content_sha256", 1, 2).alias("prefix")).agg(F.count_distinct("content_sha256").alias("n")).where("n > 1")


@query
def coco_ids(spark, d):
    from ..sources import coco

    rows = splits.contiguous(fixtures.manifest(spark, d), "shuffle_key", "image_id")
    return coco.numbered_images(rows).select("image_id", "split", "coco_id")


@query
def coco_documents_read(spark, d):
    """Rings written as one COCO document a split, and read back by ranges of bytes."""
    from ..sources import coco, coco_ranges

    number = F.expr("vec_id div 5")
    rings = fixtures.rings(spark, d).withColumns({"image_id": F.concat(F.lit("i"), number.cast("string")), "ordinal": F.col("vec_id") % 5 + 1, "class_id": (F.col("label") % 2).cast("int")})
    images = rings.select("image_id", F.when(number % 3 == 0, "train").when(number % 3 == 1, "val").otherwise("test").alias("split"), F.concat("image_id", F.lit(".png")).alias("file_name"), F.lit(1000).alias("width"), F.lit(1000).alias("height")).distinct()
    written, _ = coco.write(images, rings.select("image_id", "ordinal", "class_id", F.col("ring").alias("polygon")), scratch.path(spark, "coco"))
    found, _ = coco_ranges.elements(written, 1 << 16)
    found = scratch.kept(found, "elements")
    named = coco.section(found, "images").select("path", F.col("id").alias("image"), "canonical_image_id")
    marks = coco.shaped(coco.section(found, "annotations")).join(named.withColumnRenamed("image", "image_id"), ["path", "image_id"])
    split = F.regexp_extract("path", "([a-z]+)[.]json$", 1).alias("split")
    return marks.select(split, "id", "image_id", "canonical_image_id", "category_id", F.size("polygon").alias("vertices"), F.round("box.x1", 6).alias("x1"), F.round("area", 5).alias("area"))


@query
def annotation_files_read(spark, d):
    """Rings written as YOLO and LabelMe files, fifty a file, and read back by the data source of annotation files."""
    from ..sources import annotation_files, yolo

    folder = F.expr("vec_id div 50")
    rings = fixtures.rings(spark, d).select(folder.alias("folder"), (F.col("vec_id") % 50).alias("ordinal"), "label", F.col("ring").alias("polygon"))
    root = scratch.path(spark, "annotations")
    lines = rings.where("folder % 2 = 0").select(F.col("folder").alias("key"), "ordinal", (F.col("label") % 2).cast("int").alias("class_id"), "polygon", F.lit(1024).alias("width"), F.lit(1024).alias("height"))
    lines = yolo.label_lines(lines).select(F.col("key").alias("folder"), "ordinal", F.col("label").alias("value"))
    lines.repartition("folder").sortWithinPartitions("folder", "ordinal").select("folder", "value").write.partitionBy("folder").text(f"{root}/yolo")
    one = F.struct(F.when(F.col("label") % 2 == 0, "Tree").otherwise("TreeGroup").alias("label"), F.lit("polygon").alias("shape_type"), F.transform("polygon", lambda p: F.array(p["x"], p["y"])).alias("points"))
    docs = rings.where("folder % 2 = 1").groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", one.alias("s")))), lambda r: r["s"]).alias("shapes"))
    docs.withColumns({"imagePath": F.lit("a.png"), "imageWidth": F.lit(1024), "imageHeight": F.lit(1024)}).repartition("folder").write.partitionBy("folder").json(f"{root}/labelme")
    found = scratch.kept(annotation_files.load(spark, root), "files")
    stems = found.select(X.stem(F.col("path")).alias("stem")).distinct().select("stem", F.lit(1024).alias("width"), F.lit(1024).alias("height"))
    rows = annotation_files.objects(found, stems)
    number = F.regexp_extract("path", "folder=([0-9]+)", 1).cast("long").alias("folder")
    return rows.select(number, "format", "ordinal", "class_id", F.size("polygon").alias("vertices"), F.round("box.x1", 5).alias("x1"), F.round("box.y2", 5).alias("y2"))


@query
def coco_annotation_rows(spark, d):
    rows = fixtures.rings(spark, d).withColumn("error", F.expr(G.polygon_error("ring", "900", "900")))
    b = F.expr(G.box("ring"))
    return rows.select("vec_id", F.coalesce("error", F.lit("ok")).alias("error"), F.when(F.col("error").isNull(), b["x2"] - b["x1"]).alias("w"), F.when(F.col("error").isNull(), F.round(F.expr(G.area("ring")), 6)).alias("area"))


@query
def dataset_fingerprint(spark, d):
    rows = fixtures.manifest(spark, d).select("image_id", "content_sha256", "source_dataset", "width", "height", "number_of_objects")
    return results.fingerprint(rows, "image_id")


# -- evaluation and results ---------------------------------------------------------------------------------------


@query
def bbox_iou_pairs(spark, d):
    det = fixtures.boxes(spark, d)
    out = evaluation.overlaps(det.where("NOT is_truth"), det.where("is_truth"))
    return out.select("image_id", "category_id", "det_id", "truth_id", F.round("iou", 9).alias("iou"))


@query
def coco_greedy_match(spark, d):
    det = fixtures.boxes(spark, d)
    return evaluation.greedy_matches(det.where("NOT is_truth"), det.where("is_truth"))


@query
def coco_summary(spark, d):
    det = fixtures.boxes(spark, d)
    out = evaluation.summary(det.where("NOT is_truth"), det.where("is_truth"), categories=spark.range(1, 4).select(F.col("id").cast("int").alias("category_id")))
    return out.select("category_id", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@query
def pr_curve_ap(spark, d):
    det = fixtures.boxes(spark, d).where("NOT is_truth").select("category_id", "score", F.col("vec_id").alias("det_id"), (F.col("vec_id") % 3 != 0).alias("hit"))
    positives = det.groupBy("category_id").agg(F.count("*").alias("n"))
    out = evaluation.average_precision(det, ["category_id"], positives)
    return out.select("category_id", F.round("ap", 9).alias("ap"), F.round("ar", 9).alias("ar"))


@query
def confidence_filter(spark, d):
    return fixtures.boxes(spark, d).where("NOT is_truth AND score >= 0.1").select("vec_id", "image_id", "score")


@query
def top_k_detections(spark, d):
    return evaluation.top_detections(fixtures.boxes(spark, d).where("NOT is_truth"), 2).select("image_id", "category_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query
def first_by_name(spark, d):
    return fixtures.manifest(spark, d).orderBy("asset_name").limit(25).select("asset_name", "image_id")


@query
def most_crowded_image(spark, d):
    return fixtures.manifest(spark, d).groupBy("source_dataset").agg(F.max_by("image_id", F.struct("number_of_objects", "image_id")).alias("image_id"), F.max("number_of_objects").alias("most"))


def _runs(spark, d, shift):
    ev = read_table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("v"))
    return ev.select(F.col("event_type").alias("model"), (F.col("n") / 1000 + shift).alias("map50"), (F.col("v") / 1e6).alias("map50_95"))


@query
def metric_deltas(spark, d):
    out = results.compare(_runs(spark, d, 0.0), _runs(spark, d, 0.25), ["model"], ["map50", "map50_95"])
    return out.select("model", "metric", F.round("value", 9).alias("value"), F.round("delta", 9).alias("delta"), "within")


@query
def compare_models(spark, d):
    rows = _runs(spark, d, 0.0).withColumn("note", F.lit("x"))
    return results.optional(rows, ["model", "map50", "map75", "map50_95"]).select("model", F.round("map50", 9).alias("map50"), F.round("map50_95", 9).alias("map50_95"))


@query
def milliseconds_per_item(spark, d):
    ev = read_table(spark, d, "events").groupBy("user_id").agg(F.sum(F.floor("value")).cast("double").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("n"))
    return ev.select("user_id", F.round(results.per_item(F.col("total"), F.col("n")), 6).alias("ms"))


# -- review -------------------------------------------------------------------------------------------------------


def _reviewed(spark, d, content=fixtures.FEW):
    """Conflict rows of every fourth content, a role these tables are given here, and rows of polygons, of which those that the
    geometry finds to mend themselves are repaired."""
    shapes = fixtures.shapes(spark, d, content)
    members = shapes.select("content_sha256", F.col("number").alias("place"), "annotation", F.concat(F.lit("p"), (F.col("number") % 3).cast("string")).alias("annotator")).distinct()
    conflicts = review.conflict_rows(members, members.where("CAST(substring(content_sha256, 2) AS INT) % 4 = 0"), {"first two": frozenset({"p0", "p1"})})
    geometry = review.geometry_rows(shapes)
    return conflicts, review.geometry_status(geometry, geometry.where("recommended = 'SAFE_REMOVE_DUPLICATE_VERTEX'"))


@query
def review_conflict_rows(spark, d):
    return _reviewed(spark, d, fixtures.MANY)[0].drop("issue_type", "recommended")


@query
def review_geometry_rows(spark, d):
    rows = review.geometry_rows(fixtures.shapes(spark, d))
    return rows.select("review_id", "content_sha256", "label", F.col("raw.category").alias("category"), F.col("raw.invalid").alias("invalid"), "assessment", "recommended")


@query
def review_overlaps(spark, d):
    return review.overlap_rows(*_reviewed(spark, d, fixtures.MANY))


@query
def review_unresolved(spark, d):
    return review.unresolved_rows(*_reviewed(spark, d, fixtures.MANY))


@query
def review_workload(spark, d):
    return review.workload(*_reviewed(spark, d, fixtures.MANY))


@query
def annotation_stats(spark, d):
    out = review.annotation_stats(fixtures.shapes(spark, d))
    return out.withColumn("area", F.round("area", 5))


@query
def duplicate_vertex_repairs(spark, d):
    shapes = fixtures.shapes(spark, d)
    events, _ = review.repair_events(shapes, review.geometry_rows(shapes).where("recommended = 'SAFE_REMOVE_DUPLICATE_VERTEX'"))
    return events.select("review_id", "repair_type", "space", "before", "after", F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"))


@query
def source_selection_plan(spark, d):
    conflicts, geometry = _reviewed(spark, d)
    columns = ["review_id", "issue_type", "content_sha256", "annotation_a", "annotation_b"]
    catalog = conflicts.where("pair = 1").select(*columns).unionByName(geometry.select("review_id", "issue_type", "content_sha256", F.col("annotation").alias("annotation_a"), F.lit(None).cast("string").alias("annotation_b")))
    number = F.expr("CAST(substring(content_sha256, 2) AS INT)")
    answers = catalog.select("review_id", F.when(F.col("issue_type") == "GEOMETRY", F.when(number % 3 == 0, "KEEP_AS_IS").when(number % 7 == 0, "EXCLUDE").otherwise("")).when(number % 8 == 0, "KEEP_B").when(number % 5 == 0, "").otherwise("KEEP_A").alias("human_decision"), F.lit("").alias("selected_annotation"), F.lit(None).cast("string").alias("geometry_decisions"))
    plans, _, _ = review.source_plan(catalog, answers, geometry.where("review_status <> 'UNRESOLVED'"))
    return plans.select("content_sha256", "status", "source")


# -- versions, answers written back, plans, reconciliation --------------------------------------------------------


@query
def published_versions(spark, d):
    """Two manifests are published, then the first is restored: what each commit of the history holds."""
    store = Store(spark, scratch.path(spark, "store"))
    rows = fixtures.manifest(spark, d).select("image_id", "content_sha256", "source_dataset", "number_of_objects")
    store.publish({"manifest": rows}, "first")
    store.publish({"manifest": rows.withColumn("number_of_objects", F.col("number_of_objects") + 1)}, "second")
    store.rollback()
    present, out = store.current().version, None
    for c in store.history():
        told = store.read("manifest", c.version).groupBy("source_dataset").agg(F.count("*").alias("n"), F.sum("number_of_objects").alias("objects"))
        told = told.select(F.lit(c.number).alias("number"), F.lit(c.version == present).alias("present"), "source_dataset", "n", "objects")
        out = told if out is None else out.unionByName(told)
    return out


@query
def merged_answers(spark, d):
    """Two writers change cells and remove rows of one table of answers: the three-way merge with its conflicts."""
    docs = read_table(spark, d, "documents")
    n = F.col("doc_id")
    base = docs.select("doc_id", n.cast("string").alias("review_id"), F.when(n % 4 == 0, "").when(n % 4 == 1, "KEEP_A").when(n % 4 == 2, "KEEP_B").otherwise("EXCLUDE").alias("human_decision"), F.lit("").alias("selected_annotation"), F.col("lang").alias("notes"))
    mine = base.where(n % 11 != 3).withColumn("human_decision", F.when(n % 5 == 0, "EXCLUDE").otherwise(F.col("human_decision")))
    theirs = base.where(n % 13 != 5).withColumn("human_decision", F.when(n % 7 == 0, "KEEP_A").otherwise(F.col("human_decision"))).withColumn("notes", F.when(n % 3 == 0, "seen").otherwise(F.col("notes")))
    rows = merging.merged(*(t.drop("doc_id") for t in (base, mine, theirs)))
    return rows.select("review_id", "human_decision", "notes", F.array_join(F.transform("conflicts", lambda c: c["cell"]), ",").alias("cells"), "gone")


@query
def annotation_plan(spark, d):
    """Shapes with faults, answers by annotation, and manual copies of which half have a stale record: each shape's plan."""
    shapes = fixtures.shapes(spark, d)
    rows = review.geometry_rows(shapes)
    status = F.when(F.col("recommended") == "SAFE_REMOVE_DUPLICATE_VERTEX", "AUTO_REPAIRED_DUPLICATE_VERTEX").otherwise("UNRESOLVED")
    catalog = rows.select("review_id", "annotation", "shape_index", F.when(F.col("assessment") != "", "MINOR").otherwise("").alias("severity"), status.alias("review_status"))
    number = F.substring("annotation", 2, 20).cast("long")
    choice = F.when(number % 6 == 1, "MANUAL_FIX").when(number % 3 == 0, "KEEP_AS_IS").when(number % 3 == 2, "AUTO_FIX_APPROVED").otherwise("EXCLUDE")
    answers = catalog.where("review_status = 'UNRESOLVED'").select("review_id", choice.alias("human_decision"), F.when(number % 6 == 1, F.concat(F.lit("copy/"), "annotation")).otherwise("").alias("selected_annotation"))
    twins = shapes.where(number % 6 == 1).withColumn("copy", F.concat(F.lit("copy/"), "annotation"))
    digest = F.sha2("copy", 256)
    copies = twins.select("copy", digest.alias("copy_sha256"), F.col("annotation").alias("original_annotation"), F.col("annotation_sha256").alias("original_annotation_sha256"), F.when(number % 12 == 7, "stale").otherwise(digest).alias("fixed_annotation_sha256"), "content_sha256").distinct()
    box = G.box("polygon")
    corners = f"transform(array({box}), b -> array(named_struct('x', b.x1, 'y', b.y1), named_struct('x', b.x2, 'y', b.y1), named_struct('x', b.x2, 'y', b.y2), named_struct('x', b.x1, 'y', b.y2)))[0]"
    copied = twins.select("copy", "shape_index", "label", F.expr(corners).alias("polygon"), "width", "height")
    sizes = shapes.select("content_sha256", F.col("width").alias("image_width"), F.col("height").alias("image_height")).distinct()
    plan = plans.planned(shapes, catalog, answers, copies, copied, sizes)
    told = plan.problems.where("shape_index IS NOT NULL").select("annotation", "shape_index", "problem")
    out = plan.shapes.join(told, ["annotation", "shape_index"], "left")
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda v: v.cast("string")), ","), F.lit(""))
    return out.select("annotation", "shape_index", F.size("polygon").alias("vertices"), joined("places").alias("places"), F.array_join(F.transform("events", lambda e: e["repair_type"]), ",").alias("repairs"), F.coalesce("problem", F.lit("")).alias("problem"))


@query
def reconciled_sides(spark, d):
    """Manifest, listed images, annotations and label lines of the rings, each side broken in places: what is found."""
    n = F.col("vec_id")
    rows = fixtures.rings(spark, d).withColumns({"split": F.when(F.expr("vec_id div 5 % 3 = 0"), "train").when(F.expr("vec_id div 5 % 3 = 1"), "val").otherwise("test"), "image_id": F.concat(F.lit("i"), F.expr("vec_id div 5").cast("string")), "ordinal": n % 5 + 1})
    images = rows.groupBy("split", "image_id").agg(F.count("*").alias("total"), F.expr("min(vec_id) div 5").alias("k"))
    content = F.sha2("image_id", 256)
    manifest = images.where("k % 43 <> 10").select("split", "image_id", content.alias("content_sha256"), F.lit(1024).alias("width"), F.lit(1024).alias("height"), F.when(F.expr("k % 41 = 9"), F.col("total") + 1).otherwise(F.col("total")).alias("total"))
    listed = images.where("k % 47 <> 11").select("split", "image_id", F.when(F.expr("k % 53 = 12"), 1000).otherwise(1024).alias("width"), F.lit(1024).alias("height"), F.when(F.expr("k % 59 <> 13"), content).alias("file_sha256"))
    flat = F.flatten(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    marked = rows.where("vec_id % 23 <> 5").select("split", "image_id", n.alias("id"), F.when(n % 19 == 4, 3).otherwise((F.col("label") % 2 + 1).cast("int")).alias("category_id"), F.array(flat).alias("segmentation"), F.expr(G.corners_to_sides(f"({G.box('ring')})")).alias("bbox"), (F.expr(G.area("ring")) + F.when(n % 17 == 3, 1).otherwise(0)).alias("area"))
    pushed = "if(vec_id % 37 = 8, concat(array(named_struct('x', ring[0].x + 1, 'y', ring[0].y)), slice(ring, 2, 4)), ring)"
    lines = rows.where("vec_id % 29 <> 6").select("split", "image_id", "ordinal", F.when(n % 31 == 7, 1 - F.col("label") % 2).otherwise(F.col("label") % 2).cast("int").alias("class_id"), F.expr(pushed).alias("polygon"), F.lit(None).cast("string").alias("error"))
    return reconcile.findings(manifest, listed, marked, lines, rows.where("vec_id % 2 = 0").select("split", "image_id", "ordinal"))


@query
def split_random(spark, d):
    """A seeded random split; every tenth number of objects is frozen as val."""
    rows = fixtures.manifest(spark, d)
    frozen = rows.where("number_of_objects % 10 = 0").select("image_id", F.lit("val").alias("split"))
    return splits.randomised(rows, "image_id", frozen=frozen).select("image_id", "split")


@query
def label_box_overlaps(spark, d):
    """Pairs of boxes of one image that share an area."""
    rows = fixtures.boxes(spark, d).select("image_id", F.col("vec_id").alias("object_id"), "box")
    return label_overlap.overlaps(rows, crowd=4)


@query
def best_and_patience(spark, d):
    """Events as steps of a run each user has: the best value so far, and when five steps brought none better."""
    rows = read_table(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("v"))
    return improvement.best_so_far(rows, "user_id", "event_id", "v", 5)


# -- submissions, names, search -----------------------------------------------------------------------------------


@query
def latest_submission(spark, d):
    ev = read_table(spark, d, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return matching.latest(ev, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query
def json_props_extract(spark, d):
    ev = read_table(spark, d, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.expr("try_parse_json(props) IS NOT NULL").alias("is_json"))


@query
def url_task_filename(spark, d):
    return read_table(spark, d, "pages").select("page_id", X.task_filename(F.col("url")).alias("name"), X.safe_name(F.coalesce(X.task_filename(F.col("url")), F.lit(""))).alias("safe"))


@query
def linked_projects(spark, d):
    """Addresses of pages as bases of links, some with names, queries, fragments or other schemes: those that may be linked."""
    n = F.col("page_id")
    base = F.when(n % 7 == 0, F.concat("url", F.lit("?q=1"))).when(n % 7 == 1, F.concat("url", F.lit("//"))).when(n % 7 == 2, F.regexp_replace("url", "://", "://me:word@")).when(n % 7 == 3, F.regexp_replace("url", "^[a-z]+:", "ftp:")).when(n % 7 == 4, F.concat("url", F.lit("#x"))).otherwise(F.col("url"))
    return read_table(spark, d, "pages").select("page_id", X.project_link(base, n).alias("link"))


@query
def output_overlaps(spark, d):
    """Folders of pages as outputs and some as protected inputs, written with detours: pairs of which one lies in the other."""
    path = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    rows = read_table(spark, d, "pages").select("page_id", path.alias("p"))
    outputs = rows.select(F.concat(F.lit("/out/../"), F.replace("p", F.lit("/"), F.lit("/./x/../"))).alias("path"))
    inputs = rows.where("page_id % 9 = 0").select(F.when(F.col("page_id") % 2 == 0, F.concat("p", F.lit("/deep//er"))).otherwise(F.col("p")).alias("path"))
    from ..sources import settings

    return settings.overlapping(outputs, inputs)


@query
def accent_insensitive_search(spark, d):
    return read_table(spark, d, "documents").where(X.mentions(F.col("text"), "EAUOUON")).select("doc_id", "lang")


@query
def name_parts(spark, d):
    rows = fixtures.manifest(spark, d).select("image_id", F.concat(F.lit("Raw\\Dir/"), "asset_name", F.lit(".Tile.PNG")).alias("path"))
    return rows.select("image_id", X.basename(F.col("path")).alias("base"), X.stem(F.col("path")).alias("stem"), X.suffix(F.col("path")).alias("suffix"), X.parent_group(F.concat("image_id", F.lit("_12.png"))).alias("parent"), X.short_id(F.col("path")).alias("id"))


@query
def iso_stamps(spark, d):
    rows = read_table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, "").otherwise("soon").alias("s"))
    return rows.select("event_id", F.unix_seconds(X.stamp(F.col("s"))).alias("seconds"))
