"""SQL for an independent engine that gives the same rows as the queries, from the base tables alone."""

from __future__ import annotations

ASSET = """asset AS (SELECT doc_id AS scan_ord, sha256(text) AS content_sha256, source AS annotator, doc_id % 11 <> 0 AS has_path,
  CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id % 3 AS VARCHAR) END AS signature FROM documents)"""
GROUPS = (
    ASSET
    + """, grp AS (SELECT content_sha256, count(*) AS members, count(DISTINCT annotator) AS annotators, count(DISTINCT signature) AS sigs, count(signature) AS eligible,
  count(*) FILTER (WHERE signature IS NULL AND has_path) AS unsigned_, min(scan_ord) FILTER (WHERE signature IS NOT NULL) AS canonical FROM asset GROUP BY content_sha256),
cf AS (SELECT *, members > 1 AND (sigs > 1 OR (unsigned_ > 0 AND eligible > 0)) AS conflict FROM grp),
disp AS (SELECT scan_ord, a.content_sha256, annotator, CASE WHEN signature IS NULL THEN 'excluded' WHEN conflict THEN 'conflict'
  WHEN scan_ord <> canonical THEN 'duplicate' ELSE 'included' END AS status, canonical AS c FROM asset a JOIN cf USING (content_sha256))"""
)
RING = """ring AS (SELECT vec_id, label, i, (CAST(embedding[2 * i + 1] AS DOUBLE) + 1) * 512 AS x, (CAST(embedding[2 * i + 2] AS DOUBLE) + 1) * 512 AS y FROM embeddings, range(5) t(i))"""
LISTS = RING + """, rl AS (SELECT vec_id, label, list({'x': x, 'y': y} ORDER BY i) AS p FROM ring GROUP BY vec_id, label)"""
DET = """det AS (SELECT vec_id, vec_id // 10 AS image_id, CAST(label % 2 + 1 AS INTEGER) AS category_id, vec_id % 2 = 0 AS is_truth, abs(CAST(embedding[5] AS DOUBLE)) AS score,
  (CAST(embedding[1] AS DOUBLE) + 1) * 512 AS x1, (CAST(embedding[2] AS DOUBLE) + 1) * 512 AS y1,
  (CAST(embedding[1] AS DOUBLE) + 1) * 512 + 100 + 400 * abs(CAST(embedding[3] AS DOUBLE)) AS x2, (CAST(embedding[2] AS DOUBLE) + 1) * 512 + 100 + 400 * abs(CAST(embedding[4] AS DOUBLE)) AS y2 FROM embeddings)"""
MANIFEST = """man AS (SELECT *, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS image_id, sha256(text) AS content_sha256, source AS source_dataset, 1024 AS width, 1024 AS height,
  CAST(n_chars % 40 AS INTEGER) AS number_of_objects, 'frame' || doc_id % 97 || '_' || doc_id AS asset_name,
  row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS rn, count(*) OVER () AS n FROM documents))"""
PARENTS = r"SELECT image_id, lower(regexp_replace(asset_name, '_\d+$', '')) AS parent FROM man"


def _cross(a: str, b: str, c: str) -> str:
    return f"(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"


def _on(a: str, b: str, c: str) -> str:
    return f"({_cross(a, b, c)} = 0 AND {c}.x BETWEEN least({a}.x, {b}.x) AND greatest({a}.x, {b}.x) AND {c}.y BETWEEN least({a}.y, {b}.y) AND greatest({a}.y, {b}.y))"


_PROPER = f"({_cross('e.a', 'e.b', 'f.a')} * {_cross('e.a', 'e.b', 'f.b')} < 0 AND {_cross('f.a', 'f.b', 'e.a')} * {_cross('f.a', 'f.b', 'e.b')} < 0)"
_MEET = f"({_PROPER} OR {_on('e.a', 'e.b', 'f.a')} OR {_on('e.a', 'e.b', 'f.b')} OR {_on('f.a', 'f.b', 'e.a')} OR {_on('f.a', 'f.b', 'e.b')})"
_BACK = f"(f.k = e.k + 1 AND e.a <> f.a AND {_on('e.a', 'e.b', 'f.b')} AND f.b <> e.b)"


def _crossings(name: str, lists: str) -> str:
    """CTEs: edges of ``lists(vec_id, p)`` and pairs of them that meet."""
    return f"""{name}_e AS (SELECT vec_id, len(p) AS n, k, p[k] AS a, p[k % len(p) + 1] AS b FROM {lists}, range(1, 12) t(k) WHERE k <= len(p)),
{name} AS (SELECT e.vec_id, e.k AS i, f.k AS j, {_PROPER} AS proper, f.k = e.k + 1 AS back FROM {name}_e e JOIN {name}_e f ON e.vec_id = f.vec_id AND f.k > e.k
  WHERE (f.k > e.k + 1 AND NOT (e.k = 1 AND f.k = e.n) AND {_MEET}) OR {_BACK})"""


def _area(p: str) -> str:
    return f"abs(list_sum([{p}[k].x * {p}[k % len({p}) + 1].y - {p}[k % len({p}) + 1].x * {p}[k].y FOR k IN range(1, len({p}) + 1)])) / 2"


#: Greedy matches of detections with truths: one level of the recursion for each rank.
MATCHES = (
    DET
    + """, lv AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold),
tp AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, vec_id) AS rank FROM det WHERE NOT is_truth QUALIFY rank <= 100),
pr AS (SELECT d.vec_id AS det_id, t.vec_id AS truth_id, greatest(0, least(d.x2, t.x2) - greatest(d.x1, t.x1)) * greatest(0, least(d.y2, t.y2) - greatest(d.y1, t.y1)) AS i, (d.x2 - d.x1) * (d.y2 - d.y1) AS a, (t.x2 - t.x1) * (t.y2 - t.y1) AS b
  FROM tp d JOIN det t USING (image_id, category_id) WHERE t.is_truth),
nr AS (SELECT det_id, list({'iou': i / (a + b - i), 'truth_id': truth_id} ORDER BY i / (a + b - i) DESC, truth_id DESC) AS near FROM pr WHERE i > 0 GROUP BY det_id),
fo AS (SELECT image_id, category_id, CAST(rank AS INTEGER) AS rank, vec_id AS det_id, score, near FROM tp LEFT JOIN nr ON vec_id = det_id),
ml AS (SELECT DISTINCT image_id, category_id, threshold, 0 AS rank, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS truth_id, CAST([] AS BIGINT[]) AS used FROM fo, lv
  UNION ALL SELECT image_id, category_id, threshold, rank, det_id, score, truth_id, list_append(used, truth_id) FROM (SELECT fo.*, threshold, used, list_filter(near, lambda c: c.iou >= threshold AND NOT coalesce(list_contains(used, c.truth_id), false))[1].truth_id AS truth_id
    FROM ml JOIN fo ON fo.image_id = ml.image_id AND fo.category_id = ml.category_id AND fo.rank = ml.rank + 1)),
mt AS (SELECT * FROM ml WHERE rank > 0)"""
)

_REQUIRED = """req AS (SELECT 'R-' || doc_id AS review_id, CASE WHEN quality = 1 THEN 'ANNOTATION_CONFLICT' ELSE 'GEOMETRY' END AS issue_type, 'c' || doc_id % 60 AS content_sha256,
  'a' || doc_id % 2 AS annotation_a, CASE WHEN doc_id % 5 <> 0 THEN 'b' END AS annotation_b, doc_id FROM labels JOIN documents USING (doc_id)),
an0 AS (SELECT review_id, issue_type, CASE WHEN doc_id % 31 = 0 THEN 'other' ELSE content_sha256 END AS content, CASE doc_id % 7 WHEN 0 THEN 'EXCLUDE' WHEN 1 THEN 'KEEP_A' WHEN 2 THEN 'KEEP_B'
  WHEN 3 THEN 'KEEP_AS_IS' WHEN 4 THEN '' WHEN 5 THEN 'KEEP_A' ELSE 'AUTO_FIX_APPROVED' END AS decision, CASE WHEN doc_id % 37 = 0 THEN 'a0' ELSE '' END AS selected, doc_id FROM req WHERE doc_id % 29 <> 0),
an AS (SELECT * FROM an0 UNION ALL SELECT * FROM an0 WHERE doc_id % 41 = 0 UNION ALL SELECT 'X' || review_id, issue_type, content, decision, selected, doc_id FROM an0 WHERE doc_id % 43 = 0),
one AS (SELECT review_id AS answer_id, count(*) AS times, any_value(issue_type) AS type, any_value(content) AS content, any_value(decision) AS decision, any_value(selected) AS selected FROM an GROUP BY review_id),
bo AS (SELECT r.*, o.*, CASE o.decision WHEN 'KEEP_A' THEN annotation_a WHEN 'KEEP_B' THEN annotation_b END AS source,
  (issue_type = 'ANNOTATION_CONFLICT' AND o.decision IN ('KEEP_A', 'KEEP_B', 'EXCLUDE')) OR (issue_type = 'GEOMETRY' AND o.decision IN ('KEEP_AS_IS', 'AUTO_FIX_APPROVED', 'MANUAL_FIX', 'EXCLUDE')) AS allowed
  FROM req r FULL JOIN one o ON r.review_id = o.answer_id),
er AS (SELECT *, concat_ws('; ', CASE WHEN review_id IS NULL THEN 'not in the catalog' END, CASE WHEN answer_id IS NULL THEN 'no answer' END,
  CASE WHEN review_id IS NOT NULL AND answer_id IS NOT NULL AND (content <> content_sha256 OR type <> issue_type) THEN 'answers another case' END,
  CASE WHEN review_id IS NOT NULL AND times > 1 THEN 'answered twice' END,
  CASE WHEN review_id IS NOT NULL AND decision <> '' AND NOT allowed THEN 'choice not offered here' END,
  CASE WHEN review_id IS NOT NULL AND selected <> '' AND decision NOT IN ('KEEP_A', 'KEEP_B', 'MANUAL_FIX') THEN 'selection without use' END,
  CASE WHEN review_id IS NOT NULL AND decision IN ('KEEP_A', 'KEEP_B') AND source IS NULL THEN 'chosen side is empty' END,
  CASE WHEN review_id IS NOT NULL AND source IS NOT NULL AND selected <> '' AND selected <> source THEN 'selection is the other side' END) AS errors FROM bo),
st AS (SELECT coalesce(review_id, 'UNKNOWN:' || answer_id) AS review_id, coalesce(issue_type, 'UNKNOWN') AS issue_type, content_sha256, coalesce(decision, '') AS decision, source,
  CASE WHEN errors <> '' AND answer_id IS NOT NULL THEN 'INVALID' WHEN errors <> '' OR coalesce(decision, '') = '' THEN 'PENDING' ELSE 'COMPLETE' END AS status, errors FROM er),
cp AS (SELECT content_sha256, CASE WHEN NOT bool_and(status = 'COMPLETE') THEN 'INCOMPLETE' WHEN bool_or(decision = 'EXCLUDE') THEN 'EXCLUDE' WHEN min(source) <> max(source) THEN 'INVALID' ELSE 'KEEP' END AS plan,
  min(source) AS s FROM st WHERE issue_type <> 'UNKNOWN' GROUP BY content_sha256)"""

_RUNS = """r AS (SELECT event_type AS model, count(*) / 1000.0::DOUBLE AS map50, sum(floor(value)) / 1e6::DOUBLE AS map50_95 FROM events GROUP BY event_type)"""

SQL = {
    "asset_match_status": "SELECT CASE WHEN l.doc_id IS NULL THEN 'missing_annotation' WHEN d.doc_id IS NULL THEN 'orphan_annotation' ELSE 'matched' END AS status, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1",
    "missing_annotations": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "orphan_annotations": "SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "folder_stem_match": """WITH a AS (SELECT source AS folder, CAST(doc_id % 50 AS VARCHAR) AS stem, count(*) AS n FROM documents GROUP BY ALL),
b AS (SELECT source AS folder, CAST(doc_id % 50 AS VARCHAR) AS stem, count(*) AS m FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
SELECT folder, stem, coalesce(n, 0) AS n_images, coalesce(m, 0) AS n_annotations, CASE WHEN m IS NULL THEN 'missing_annotation' WHEN n IS NULL THEN 'orphan_annotation' WHEN n = 1 AND m = 1 THEN 'matched' ELSE 'ambiguous' END AS status
FROM a FULL JOIN b USING (folder, stem)""",
    "content_dup_groups": f"WITH {GROUPS} SELECT content_sha256, members, annotators < members AS within_annotator, annotators > 1 AS between_annotators FROM grp WHERE members > 1",
    "annotation_conflicts": f"WITH {GROUPS} SELECT content_sha256, members, CASE WHEN sigs > 1 THEN 'signatures differ' ELSE 'a member without a valid annotation' END AS reason FROM cf WHERE conflict",
    "canonical_selection": f"WITH {GROUPS} SELECT scan_ord, content_sha256, annotator, status, CASE WHEN status = 'duplicate' THEN c END AS canonical FROM disp",
    "disposition_counts": f"WITH {GROUPS} SELECT status, count(*) AS n FROM disp GROUP BY status",
    "audit_gate": f"WITH {GROUPS} SELECT count(*) FILTER (WHERE status = 'conflict') AS conflicts, count(*) FILTER (WHERE status = 'included') AS included, count(*) FILTER (WHERE status = 'conflict') = 0 AND count(*) FILTER (WHERE status = 'included') >= 3 AS safe_to_build FROM disp",
    "conflict_pairs": "SELECT sha256(a.text) AS content_sha256, a.doc_id AS first, b.doc_id AS second, row_number() OVER (PARTITION BY a.text ORDER BY a.doc_id, b.doc_id) AS pair FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id",
    "exclusion_reasons": f"""WITH {ASSET}, w AS (SELECT scan_ord, unnest([CASE WHEN NOT has_path THEN 'missing annotation' END, CASE WHEN signature IS NULL AND has_path THEN 'invalid annotation' END, CASE WHEN annotator = 'src0' THEN 'unsupported label' END, CASE WHEN scan_ord % 13 = 0 THEN 'dimensions differ' END]) AS r FROM asset)
SELECT scan_ord, string_agg(r, '; ' ORDER BY r) AS reason FROM w WHERE r IS NOT NULL GROUP BY scan_ord""",
    "folder_rollup": "SELECT source AS annotator, lang AS folder, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, GROUPING(source, lang) AS level FROM documents GROUP BY ROLLUP (source, lang)",
    "tile_parent_groups": f"WITH {MANIFEST} SELECT regexp_extract(asset_name, '^(.+)_\\d+$', 1) AS parent, count(*) AS tiles FROM man GROUP BY 1 HAVING count(*) > 1",
    "multiplicity_profile": "SELECT times, count(*) AS n_keys FROM (SELECT count(*) AS times FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY times",
    "snapshot_diff": """WITH b AS (SELECT doc_id, sha256(text) AS d FROM documents WHERE doc_id % 17 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'changed' ELSE sha256(text) END AS e FROM documents WHERE doc_id % 19 <> 0)
SELECT doc_id, CASE WHEN e IS NULL THEN 'missing' WHEN d IS NULL THEN 'added' ELSE 'changed' END AS change FROM b FULL JOIN n USING (doc_id) WHERE d IS DISTINCT FROM e""",
    "historical_versions": """WITH g AS (SELECT text, count(*) AS versions, min(doc_id) AS first, max(doc_id) AS last, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY text)
SELECT doc_id, versions, first, last, coalesce(array_to_string(list_filter(ids, lambda i: i <> doc_id), ','), '') AS others FROM documents d JOIN g ON d.text IS NOT DISTINCT FROM g.text""",
    "validation_issues": f"""WITH {RING}, b AS (SELECT vec_id AS key, label, min(x) FILTER (WHERE TRUE) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM ring GROUP BY ALL),
o AS (SELECT *, [CASE WHEN label % 3 = 2 THEN 'ERROR_INVALID_CLASS' END, CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'ERROR_ZERO_OR_INVALID_BOX' END, CASE WHEN x1 < 0 OR y1 < 0 OR x2 > 700 OR y2 > 700 THEN 'ERROR_OUT_OF_BOUNDS' END, CASE WHEN label = 9 THEN 'ERROR_SHORT_POLYGON' END] AS s FROM b WHERE label <> 8),
u AS (SELECT key, unnest(s) AS status FROM o)
SELECT key, 0 AS ordinal, status FROM u WHERE status IS NOT NULL UNION ALL SELECT key, -1, 'VALID' FROM o WHERE len(list_filter(s, lambda x: x IS NOT NULL)) = 0 UNION ALL SELECT key, -1, 'VALID_EMPTY_IMAGE' FROM b WHERE label = 8""",
    "label_exclusion": """WITH o AS (SELECT vec_id // 3 AS key, lower(trim(' Class' || label % 4)) AS c, CASE WHEN vec_id % 5 = 0 THEN 'circle' ELSE 'polygon' END AS s FROM embeddings),
m AS (SELECT DISTINCT key, v FROM (SELECT key, c AS v FROM o WHERE c = 'class3' UNION ALL SELECT key, s FROM o WHERE s = 'circle')) SELECT key, string_agg(v, ';' ORDER BY v) AS matched FROM m GROUP BY key""",
    "dataset_statistics": f"""WITH {MANIFEST}, s AS (SELECT count(*)::DOUBLE AS images, sum(number_of_objects)::DOUBLE AS objects, avg(number_of_objects) AS mean, median(number_of_objects)::DOUBLE AS median, min(number_of_objects)::DOUBLE AS least, max(number_of_objects)::DOUBLE AS most FROM man)
SELECT measure, value FROM (UNPIVOT s ON images, objects, mean, median, least, most INTO NAME measure VALUE value)""",
    "duplicates_between_folders": "SELECT sha256(text) AS content_sha256, count(*) AS members, count(DISTINCT source) < count(*) AS within_annotator, count(DISTINCT source) > 1 AS between_annotators, count(DISTINCT lang) > 1 AS between_folders FROM documents GROUP BY 1 HAVING count(*) > 1",
    "class_counts_by_split": """WITH o AS (SELECT vec_id // 5 AS image_id, CASE WHEN vec_id // 5 % 10 < 7 THEN 'train' WHEN vec_id // 5 % 10 < 9 THEN 'val' ELSE 'test' END AS split, CASE WHEN label < 8 THEN label % 2 ELSE 9 END AS class_id FROM embeddings),
i AS (SELECT split, count(*) AS images, max(n) AS most FROM (SELECT split, image_id, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1)
SELECT split, class_name, images, (SELECT count(*) FROM o WHERE o.split = i.split AND o.class_id = c.class_id) AS instances, most FROM i, (VALUES (0, 'tree'), (1, 'TreeGroup')) c(class_id, class_name)""",
    "reused_split": f"WITH {MANIFEST} SELECT image_id, split FROM man",
    "linked_projects": r"""SELECT page_id, CASE WHEN page_id % 7 IN (0, 2, 3, 4) OR contains(url, '?') OR contains(url, '#') THEN NULL ELSE rtrim(url, '/') || '/projects/' || page_id || '/data' END AS link FROM pages""",
    "output_overlaps": r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages), f AS (SELECT *, trim(regexp_replace(p, '/+', '/', 'g'), '/') AS w FROM u),
o AS (SELECT '/out/../' || replace(p, '/', '/./x/../') AS output, w FROM f), i AS (SELECT CASE WHEN page_id % 2 = 0 THEN p || '/deep//er' ELSE p END AS input, CASE WHEN page_id % 2 = 0 THEN w || '/deep/er' ELSE w END AS w FROM f WHERE page_id % 9 = 0)
SELECT DISTINCT output, input FROM o, i WHERE starts_with(o.w || '/', i.w || '/') OR starts_with(i.w || '/', o.w || '/')""",
    "counts_by_split": f"WITH {MANIFEST} SELECT split, source_dataset, count(*) AS images, CAST(sum(number_of_objects) AS BIGINT) AS objects, max(number_of_objects) AS most FROM man GROUP BY ALL",
    "size_distribution": f"WITH {MANIFEST} SELECT width, height, count(*) AS n FROM man GROUP BY ALL",
    "object_histogram": f"WITH {MANIFEST} SELECT CAST(floor(number_of_objects / (40.0::DOUBLE / 30)) AS BIGINT) + 1 AS bin, count(*) AS n FROM man GROUP BY 1",
    "class_distribution_zero_filled": "SELECT c AS class_id, count(label) AS n FROM range(15) t(c) LEFT JOIN embeddings ON label = c GROUP BY c",
    "label_counts_by_folder": "SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source",
    "integrity_checks": """WITH v AS (SELECT 'duplicate document id' AS k, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS n
UNION ALL SELECT 'label without document', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'line key used twice', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'text repeated', (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1))) SELECT k AS "check", n AS violations, n = 0 AS ok FROM v""",
    "ring_area_bbox": f"WITH {LISTS} SELECT vec_id, round({_area('p')}, 6) AS area, list_min([v.x FOR v IN p]) AS x1, list_min([v.y FOR v IN p]) AS y1, list_max([v.x FOR v IN p]) AS x2, list_max([v.y FOR v IN p]) AS y2 FROM rl",
    "ring_canonical_key": f"""WITH {LISTS}, t AS (SELECT vec_id, unnest(list_concat([p[k:5] || p[1 : k - 1] FOR k IN range(1, 6)], [list_reverse(p)[k:5] || list_reverse(p)[1 : k - 1] FOR k IN range(1, 6)])) AS q FROM rl),
m AS (SELECT vec_id, min([[v.x, v.y] FOR v IN q]) AS k FROM t GROUP BY vec_id)
SELECT vec_id, len(k)::INTEGER AS n, k[1][1] AS x0, k[1][2] AS y0, k[2][1] AS x1, k[2][2] AS y1 FROM m""",
    "ring_self_intersections": f"WITH {LISTS}, {_crossings('cr', 'rl')} SELECT vec_id, count(i) AS crossings, coalesce(bool_or(NOT back), false) AS crosses FROM rl LEFT JOIN cr USING (vec_id) GROUP BY vec_id",
    "ring_geometry_class": f"""WITH {LISTS}, {_crossings('cr', 'rl')}, a AS (SELECT vec_id, {_area('p')} AS area FROM rl),
c AS (SELECT vec_id, count(i) AS n FROM rl LEFT JOIN cr USING (vec_id) GROUP BY vec_id),
-- a repeat elsewhere: the first vertex stands again after the third
r4 AS (SELECT vec_id, p[1:3] || p[1:1] || p[4:5] AS p FROM rl WHERE vec_id % 4 = 3), {_crossings('cq', 'r4')}, c4 AS (SELECT vec_id, count(i) AS n FROM r4 LEFT JOIN cq USING (vec_id) GROUP BY vec_id),
f AS (SELECT vec_id, vec_id % 4 AS m, CASE WHEN vec_id % 4 = 3 THEN c4.n ELSE c.n END AS n_crossings, area FROM c JOIN a USING (vec_id) LEFT JOIN c4 USING (vec_id)),
g AS (SELECT vec_id, m, CASE m WHEN 0 THEN '' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS category, CASE WHEN m = 2 THEN 1 ELSE 0 END AS consecutive, m = 1 AS closing, m = 3 AS elsewhere, CAST(n_crossings AS INTEGER) AS n_crossings, area = 0 OR m = 3 OR n_crossings > 0 AS invalid FROM f)
SELECT vec_id, category, consecutive, closing, elsewhere, n_crossings, invalid, CASE WHEN category = 'A' AND NOT invalid THEN 'CLOSING_VERTEX_ONLY' WHEN consecutive > 0 AND NOT invalid THEN 'SAFE_REMOVE_DUPLICATE_VERTEX' ELSE 'MANUAL_REVIEW' END AS recommended FROM g""",
    "ring_validity": f"""WITH {LISTS}, {_crossings('cr', 'rl')}, x AS (SELECT vec_id, bool_or(NOT back) AS hit FROM cr GROUP BY vec_id)
SELECT vec_id, CASE WHEN list_max([v.x FOR v IN p]) > 600 OR list_max([v.y FOR v IN p]) > 1024 OR list_min([v.x FOR v IN p]) < 0 OR list_min([v.y FOR v IN p]) < 0 THEN 'point off the image' WHEN {_area('p')} <= 0 THEN 'no area'
  WHEN coalesce(hit, false) THEN 'edges cross' ELSE 'valid' END AS verdict FROM rl LEFT JOIN x USING (vec_id)""",
    "uncross_two_opt": f"""WITH {LISTS}, {_crossings('cr', 'rl')}, c AS (SELECT vec_id, count(i) AS n, any_value(i) AS i, any_value(j) AS j, any_value(proper) AS proper FROM rl LEFT JOIN cr USING (vec_id) GROUP BY vec_id),
fx AS (SELECT vec_id, p[1:i] || list_reverse(p[i + 1 : j]) || p[j + 1 : len(p)] AS p FROM rl JOIN c USING (vec_id) WHERE n = 1 AND proper), {_crossings('cq', 'fx')},
ok AS (SELECT vec_id, {_area('p')} AS area FROM fx WHERE vec_id NOT IN (SELECT vec_id FROM cq))
SELECT vec_id, n AS n_crossings, area IS NOT NULL AND area > 0 AS fixable, round(area, 6) AS area FROM c LEFT JOIN ok USING (vec_id)""",
    "remove_consecutive_vertices": """WITH e AS (SELECT user_id, floor(value / 50) AS v, row_number() OVER w - 1 AS i, lag(floor(value / 50)) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE last IS NULL OR v <> last) AS INTEGER) AS kept, coalesce(string_agg(i, ',' ORDER BY i) FILTER (WHERE v = last), '') AS removed FROM e GROUP BY user_id""",
    "percent_to_pixel": "SELECT vec_id, (CAST(embedding[1] AS DOUBLE) + 1) * 50 * 1200 / 100 AS x, (CAST(embedding[2] AS DOUBLE) + 1) * 50 * 300 / 100 AS y FROM embeddings",
    "bbox_convert": f"WITH {DET} SELECT vec_id, x2 - x1 AS w, y2 - y1 AS h, greatest(0, x1 - 20) AS crop_x1, least(1024, y2 + 20) AS crop_y2, round(x2, 6) AS x2 FROM det",
    "clamp_edges": f"WITH {RING}, q AS (SELECT vec_id, CAST(i AS INTEGER) AS i, x, y, x BETWEEN -1 AND 641 AND y BETWEEN -1 AND 481 AS near FROM ring) SELECT vec_id, i, CASE WHEN near THEN least(greatest(x, 0), 640) ELSE x END AS x, CASE WHEN near THEN least(greatest(y, 0), 480) ELSE y END AS y FROM q",
    "decision_row_status": f"WITH {_REQUIRED} SELECT review_id, issue_type, status, errors FROM st",
    "decision_content_plan": f"WITH {_REQUIRED} SELECT content_sha256, plan, CASE WHEN plan = 'KEEP' THEN s END AS source FROM cp",
    "decision_resolved": f"WITH {_REQUIRED} SELECT CASE WHEN plan = 'INVALID' AND issue_type <> 'UNKNOWN' THEN 'INVALID' ELSE status END AS status, count(*) AS n FROM st LEFT JOIN cp USING (content_sha256) GROUP BY 1",
    "decision_gate": f"WITH {_REQUIRED}, g AS (SELECT count(*) FILTER (WHERE status = 'COMPLETE') AS complete, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'INVALID') AS invalid FROM st) SELECT *, pending = 0 AND invalid = 0 AS safe_to_build FROM g",
    "split_contiguous": f"WITH {MANIFEST} SELECT image_id, split FROM man",
    "split_grouped": f"""WITH RECURSIVE {MANIFEST},
gr AS (SELECT parent, count(*) AS n FROM ({PARENTS}) GROUP BY parent),
od AS (SELECT parent, n, row_number() OVER (ORDER BY n DESC, md5('42:' || parent), parent) AS i, count(*) OVER () AS c, sum(n) OVER () AS t FROM gr),
st AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS s, 0.7::DOUBLE * max(t) AS a, 0.15::DOUBLE * max(t) AS b, 0.15::DOUBLE * max(t) AS d, 0 AS ua, 0 AS ub, 0 AS ud FROM od
  UNION ALL SELECT q.i, q.n, q.s, q.a - CASE WHEN q.s = 'train' THEN q.n ELSE 0 END, q.b - CASE WHEN q.s = 'val' THEN q.n ELSE 0 END, q.d - CASE WHEN q.s = 'test' THEN q.n ELSE 0 END,
    greatest(q.ua, CAST(q.s = 'train' AS INT)), greatest(q.ub, CAST(q.s = 'val' AS INT)), greatest(q.ud, CAST(q.s = 'test' AS INT))
  FROM (SELECT od.i, od.n, st.a, st.b, st.d, ua, ub, ud,
          CASE WHEN od.c - st.i = 3 - ua - ub - ud THEN CASE WHEN ua = 0 AND (ub = 1 OR a >= b) AND (ud = 1 OR a >= d) THEN 'train' WHEN ub = 0 AND (ud = 1 OR b >= d) THEN 'val' ELSE 'test' END
               ELSE CASE WHEN a >= b AND a >= d THEN 'train' WHEN b >= d THEN 'val' ELSE 'test' END END AS s
        FROM st JOIN od ON od.i = st.i + 1) q),
ct AS (SELECT n, count(*) FILTER (WHERE s = 'train') AS tr, count(*) FILTER (WHERE s = 'val') AS va FROM st WHERE i > 0 GROUP BY n),
pl AS (SELECT parent, CASE WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'val' ELSE 'test' END AS split FROM (SELECT parent, n, row_number() OVER (PARTITION BY n ORDER BY i) AS r FROM od) JOIN ct USING (n))
SELECT image_id, parent, split FROM ({PARENTS}) JOIN pl USING (parent)""",
    "split_group_leakage": f"WITH {MANIFEST} SELECT source_dataset, count(DISTINCT split) AS splits, count(*) AS n FROM man GROUP BY source_dataset HAVING count(DISTINCT split) > 1",
    "split_intersect": f"WITH {MANIFEST} SELECT content_sha256 FROM man WHERE split = 'train' INTERSECT SELECT content_sha256 FROM man WHERE split = 'test'",
    "set_except": f"WITH {MANIFEST} SELECT content_sha256 FROM man WHERE split = 'val' EXCEPT ALL SELECT content_sha256 FROM man WHERE split = 'train'",
    "set_equality": f"WITH {MANIFEST}, l AS (SELECT DISTINCT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS image_id FROM labels), c AS (SELECT count(*) FILTER (WHERE l.image_id IS NULL) AS only_left, count(*) FILTER (WHERE m.image_id IS NULL) AS only_right FROM man m FULL JOIN l ON m.image_id = l.image_id) SELECT *, only_left = 0 AND only_right = 0 AS equal FROM c",
    "prefix_collisions": "SELECT substr(sha256(text), 1, 2) AS prefix, count(DISTINCT text) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT text) > 1",
    "coco_ids": f"WITH {MANIFEST} SELECT image_id, split, row_number() OVER (PARTITION BY split ORDER BY image_id) AS coco_id FROM man",
    "coco_documents_read": f"""WITH {LISTS}, im AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY canonical_image_id) AS image_id FROM (SELECT DISTINCT 'i' || vec_id // 5 AS canonical_image_id, CASE vec_id // 5 % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM embeddings)),
m AS (SELECT vec_id, label, p, {_area('p')} AS area FROM rl WHERE len(list_filter(p, lambda v: NOT (v.x BETWEEN 0 AND 1000 AND v.y BETWEEN 0 AND 1000))) = 0)
SELECT split, row_number() OVER (PARTITION BY split ORDER BY canonical_image_id, vec_id) AS id, image_id, canonical_image_id, CAST(label % 2 + 1 AS INTEGER) AS category_id, len(p) AS vertices, round(list_min([v.x FOR v IN p]), 6) AS x1, round(area, 5) AS area
FROM m JOIN im ON canonical_image_id = 'i' || vec_id // 5 WHERE area > 0""",
    "annotation_files_read": f"""WITH {LISTS}, r AS (SELECT vec_id // 50 AS folder, vec_id % 50 + 1 AS ordinal, CAST(label % 2 AS INTEGER) AS class_id, p, vec_id // 50 % 2 = 0 AS y FROM rl)
SELECT folder, CASE WHEN y THEN 'yolo' ELSE 'labelme' END AS format, ordinal, class_id, len(p) AS vertices, round(list_min([CASE WHEN y THEN round(v.x / 1024, 8) * 1024 ELSE v.x END FOR v IN p]), 5) AS x1, round(list_max([CASE WHEN y THEN round(v.y / 1024, 8) * 1024 ELSE v.y END FOR v IN p]), 5) AS y2 FROM r""",
    "coco_annotation_rows": f"""WITH {LISTS}, m AS (SELECT vec_id, p, list_max([v.x FOR v IN p]) - list_min([v.x FOR v IN p]) AS w, list_max([v.y FOR v IN p]) - list_min([v.y FOR v IN p]) AS h, {_area('p')} AS area, len(list_filter(p, lambda v: NOT (v.x BETWEEN 0 AND 900 AND v.y BETWEEN 0 AND 900))) AS outside FROM rl),
e AS (SELECT *, CASE WHEN outside > 0 THEN 'point off the image' WHEN area <= 0 OR w <= 0 OR h <= 0 THEN 'no area' ELSE 'ok' END AS error FROM m)
SELECT vec_id, error, CASE WHEN error = 'ok' THEN w END AS w, CASE WHEN error = 'ok' THEN round(area, 6) END AS area FROM e""",
    "dataset_fingerprint": f"WITH {MANIFEST} SELECT sha256(string_agg(content_sha256 || chr(31) || height || chr(31) || image_id || chr(31) || number_of_objects || chr(31) || source_dataset || chr(31) || width, chr(10) ORDER BY image_id)) AS fingerprint FROM man",
    "bbox_iou_pairs": f"""WITH {DET}, p AS (SELECT d.image_id, d.category_id, d.vec_id AS det_id, t.vec_id AS truth_id, greatest(0, least(d.x2, t.x2) - greatest(d.x1, t.x1)) * greatest(0, least(d.y2, t.y2) - greatest(d.y1, t.y1)) AS i, (d.x2 - d.x1) * (d.y2 - d.y1) AS a, (t.x2 - t.x1) * (t.y2 - t.y1) AS b
FROM det d JOIN det t USING (image_id, category_id) WHERE NOT d.is_truth AND t.is_truth) SELECT image_id, category_id, det_id, truth_id, round(i / (a + b - i), 9) AS iou FROM p WHERE i > 0""",
    "pr_curve_ap": f"""WITH {DET}, s AS (SELECT category_id, score, vec_id, vec_id % 3 <> 0 AS hit FROM det WHERE NOT is_truth), n AS (SELECT category_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT category_id, score, vec_id, count(*) FILTER (WHERE hit) OVER w / n::DOUBLE AS recall, count(*) FILTER (WHERE hit) OVER w / CAST(count(*) OVER w AS DOUBLE) AS prec FROM s JOIN n USING (category_id) WINDOW w AS (PARTITION BY category_id ORDER BY score DESC, vec_id)),
g AS (SELECT n.category_id, i, (SELECT coalesce(max(prec), 0) FROM c WHERE c.category_id = n.category_id AND c.recall >= i * 0.01::DOUBLE) AS v FROM n, range(101) t(i))
SELECT category_id, round(sum(v) / 101, 9) AS ap, round((SELECT max(recall) FROM c WHERE c.category_id = g.category_id), 9) AS ar FROM g GROUP BY category_id""",
    "coco_greedy_match": f"WITH RECURSIVE {MATCHES} SELECT image_id, category_id, threshold, det_id, score, rank, truth_id FROM mt",
    "coco_summary": f"""WITH RECURSIVE {MATCHES}, n AS (SELECT category_id, count(*) AS n FROM det WHERE is_truth GROUP BY 1), nl AS (SELECT * FROM n, lv),
c AS (SELECT category_id, threshold, count(truth_id) OVER w / n::DOUBLE AS recall, count(truth_id) OVER w / CAST(count(*) OVER w AS DOUBLE) AS prec FROM mt JOIN n USING (category_id) WINDOW w AS (PARTITION BY category_id, threshold ORDER BY score DESC, det_id)),
s AS (SELECT nl.category_id, nl.threshold, i, coalesce(max(prec), 0) AS v FROM nl CROSS JOIN range(101) t(i) LEFT JOIN c ON c.category_id = nl.category_id AND c.threshold = nl.threshold AND c.recall >= i * 0.01::DOUBLE GROUP BY ALL),
a AS (SELECT category_id, threshold, sum(v) / 101 AS ap FROM s GROUP BY ALL),
r AS (SELECT category_id, count(truth_id) FILTER (WHERE rank <= 1) AS h1, count(truth_id) FILTER (WHERE rank <= 10) AS h10, count(truth_id) FILTER (WHERE rank <= 100) AS h100 FROM mt GROUP BY 1),
e AS (SELECT n.category_id, (SELECT avg(ap) FROM a WHERE a.category_id = n.category_id) AS ap, (SELECT ap FROM a WHERE a.category_id = n.category_id AND threshold = 0.5) AS ap50,
  (SELECT ap FROM a WHERE a.category_id = n.category_id AND threshold = 0.75) AS ap75, coalesce(h1, 0) / (n * 10.0::DOUBLE) AS ar1, coalesce(h10, 0) / (n * 10.0::DOUBLE) AS ar10, coalesce(h100, 0) / (n * 10.0::DOUBLE) AS ar100 FROM n LEFT JOIN r USING (category_id)),
o AS (SELECT k.category_id, ap, ap50, ap75, ar1, ar10, ar100 FROM (SELECT unnest([1, 2, 3])::INTEGER AS category_id) k LEFT JOIN e USING (category_id) UNION ALL SELECT NULL, avg(ap), avg(ap50), avg(ap75), avg(ar1), avg(ar10), avg(ar100) FROM e)
SELECT category_id, round(ap, 9) AS ap, round(ap50, 9) AS ap50, round(ap75, 9) AS ap75, round(ar1, 9) AS ar1, round(ar10, 9) AS ar10, round(ar100, 9) AS ar100 FROM o""",
    "confidence_filter": f"WITH {DET} SELECT vec_id, image_id, score FROM det WHERE NOT is_truth AND score >= 0.1::DOUBLE",
    "top_k_detections": f"WITH {DET} SELECT image_id, category_id, vec_id, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, vec_id) AS rank FROM det WHERE NOT is_truth QUALIFY rank <= 2",
    "first_by_name": f"WITH {MANIFEST} SELECT asset_name, image_id FROM man ORDER BY asset_name LIMIT 25",
    "most_crowded_image": f"WITH {MANIFEST} SELECT source_dataset, max_by(image_id, (number_of_objects, image_id)) AS image_id, max(number_of_objects) AS most FROM man GROUP BY 1",
    "metric_deltas": f"WITH {_RUNS} SELECT model, 'map50' AS metric, round(map50, 9) AS value, round(map50 - (map50 + 0.25::DOUBLE), 9) AS delta, false AS within FROM r UNION ALL SELECT model, 'map50_95', round(map50_95, 9), 0, true FROM r",
    "compare_models": f"WITH {_RUNS} SELECT model, round(map50, 9) AS map50, round(map50_95, 9) AS map50_95 FROM r",
    "milliseconds_per_item": "SELECT user_id, round(CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN sum(floor(value)) * 1000 / count(*) FILTER (WHERE event_type = 'purchase') END, 6) AS ms FROM events GROUP BY user_id",
    "latest_submission": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "json_props_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS is_json FROM events",
    "url_task_filename": r"""WITH n AS (SELECT page_id, split_part(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', -1) AS name FROM pages) SELECT page_id, name, regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9_. -]*\.(?i:jpe?g)$') AND NOT contains(name, '..') AS safe FROM n""",
    "accent_insensitive_search": "SELECT doc_id, lang FROM documents WHERE contains(lower(strip_accents(text)), 'eauouon')",
    "name_parts": f"WITH {MANIFEST} SELECT image_id, asset_name || '.Tile.PNG' AS base, asset_name || '.Tile' AS stem, '.PNG' AS suffix, image_id AS parent, substr(sha256('Raw\\Dir/' || asset_name || '.Tile.PNG'), 1, 16) AS id FROM man",
    "iso_stamps": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN 1 THEN 0 END AS seconds FROM events",
}
SQL["exclusion_histogram"] = f"SELECT reason, count(*) AS n FROM ({SQL['exclusion_reasons']}) GROUP BY reason"

_CLASSES = SQL["ring_geometry_class"]
#: Contents of annotations: three annotations or two each, or as many as there are over forty contents.
_FEW, _MANY = "vec_id // 40 * 3 + vec_id // 5 % 8 // 3", "vec_id // 5 % 40"


def _geometry(content: str) -> str:
    return f"""ge AS (SELECT vec_id, 'a' || vec_id // 5 AS annotation, 'G-' || substr(sha256('a' || vec_id // 5), 1, 16) || '-' || (vec_id % 5 + 1) AS review_id, 'c' || ({content}) AS content_sha256, CASE WHEN e.label % 2 = 0 THEN 'Tree' ELSE 'TreeGroup' END AS label, category, invalid,
  CASE WHEN n_crossings > 0 THEN 'complex/ambiguous' ELSE '' END AS assessment, CASE WHEN n_crossings > 0 THEN 'AMBIGUOUS' ELSE '' END AS severity,
  CASE WHEN category = 'A' AND NOT invalid THEN 'LIKELY_VALID_CLOSING_VERTEX' WHEN consecutive > 0 AND NOT invalid THEN 'SAFE_REMOVE_DUPLICATE_VERTEX' ELSE 'MANUAL_GEOMETRY_REPAIR' END AS recommended
  FROM ({_CLASSES}) JOIN embeddings e USING (vec_id) WHERE category <> '' OR invalid),
gs AS (SELECT *, CASE WHEN recommended = 'SAFE_REMOVE_DUPLICATE_VERTEX' THEN 'AUTO_REPAIRED_DUPLICATE_VERTEX' ELSE 'UNRESOLVED' END AS review_status FROM ge)"""


def _conflicts(content: str) -> str:
    return f"""me AS (SELECT DISTINCT vec_id // 5 AS number, {content} AS content FROM embeddings WHERE ({content}) % 4 = 0),
nm AS (SELECT content, list_sort(list(DISTINCT number % 3)) = [0, 1] AS two FROM me GROUP BY content),
co AS (SELECT 'C-c' || content || '-' || pair AS review_id, 'c' || content AS content_sha256, pair, CASE WHEN two THEN 'first two' ELSE 'Other' END AS section, 'a' || a AS annotation_a, 'p' || a % 3 AS annotator_a, 'a' || b AS annotation_b, 'p' || b % 3 AS annotator_b
  FROM (SELECT a.content, a.number AS a, b.number AS b, row_number() OVER (PARTITION BY a.content ORDER BY a.number, b.number) AS pair FROM me a JOIN me b ON a.content = b.content AND a.number < b.number) JOIN nm USING (content))"""


_GEOMETRY, _CONFLICTS = _geometry(_FEW), _conflicts(_FEW)
_UNRESOLVED = """un AS (SELECT review_id, 'ANNOTATION_CONFLICT' AS issue_type, co.content_sha256, coalesce(severity, '') AS severity, coalesce(linked, '') AS linked
  FROM co LEFT JOIN (SELECT content_sha256, 'AMBIGUOUS' AS severity, string_agg(review_id, ';' ORDER BY review_id) AS linked FROM gs WHERE severity <> '' GROUP BY 1) USING (content_sha256)
  UNION ALL SELECT review_id, 'GEOMETRY', content_sha256, severity, '' FROM gs WHERE review_status = 'UNRESOLVED' AND content_sha256 NOT IN (SELECT content_sha256 FROM co))"""
SQL |= {
    "review_conflict_rows": f"WITH {_conflicts(_MANY)} SELECT * FROM co",
    "review_geometry_rows": f"WITH {_GEOMETRY} SELECT review_id, content_sha256, label, category, invalid, assessment, recommended FROM ge",
    "review_overlaps": f"""WITH {_geometry(_MANY)}, {_conflicts(_MANY)}, la AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY pair DESC) = 1),
o AS (SELECT gs.content_sha256, la.review_id AS conflict_review_id, gs.review_id AS geometry_review_id, review_status AS geometry_status, concat_ws(';', CASE WHEN annotation_a <> annotation AND annotation_a NOT IN (SELECT annotation FROM gs) THEN 'KEEP_A' END, CASE WHEN annotation_b <> annotation AND annotation_b NOT IN (SELECT annotation FROM gs) THEN 'KEEP_B' END) AS choices FROM gs JOIN la USING (content_sha256))
SELECT *, choices <> '' AS removes FROM o""",
    "review_unresolved": f"WITH {_geometry(_MANY)}, {_conflicts(_MANY)}, {_UNRESOLVED} SELECT * FROM un",
    "review_workload": f"""WITH {_geometry(_MANY)}, {_conflicts(_MANY)}, {_UNRESOLVED}, m AS (SELECT 'recommended REVIEW_BOTH' AS measure FROM co UNION ALL SELECT 'recommended ' || recommended FROM gs UNION ALL SELECT 'severity ' || severity FROM gs WHERE severity <> '' UNION ALL SELECT 'unresolved rows' FROM un
  UNION ALL SELECT CASE category WHEN 'A' THEN 'closing vertex only' WHEN 'B' THEN 'consecutive duplicate' ELSE 'other repeated vertex' END FROM gs WHERE category <> '' UNION ALL SELECT 'repeated and invalid' FROM gs WHERE category <> '' AND invalid) SELECT measure, count(*) AS value FROM m GROUP BY 1""",
    "source_selection_plan": f"""WITH {_GEOMETRY}, {_CONFLICTS}, cat AS (SELECT content_sha256, annotation_a AS a, annotation_b AS b, true AS conflict, false AS done FROM co WHERE pair = 1 UNION ALL SELECT content_sha256, annotation, NULL, false, review_status <> 'UNRESOLVED' FROM gs),
d AS (SELECT *, CASE WHEN NOT conflict THEN CASE WHEN k % 3 = 0 THEN 'KEEP_AS_IS' WHEN k % 7 = 0 THEN 'EXCLUDE' ELSE '' END WHEN k % 8 = 0 THEN 'KEEP_B' WHEN k % 5 = 0 THEN '' ELSE 'KEEP_A' END AS decision FROM (SELECT *, CAST(substr(content_sha256, 2) AS INTEGER) AS k FROM cat)),
s AS (SELECT content_sha256, bool_or(decision = 'EXCLUDE') AS out, bool_or(conflict AND decision = '') AS waits, coalesce(min(CASE WHEN conflict THEN CASE decision WHEN 'KEEP_A' THEN a WHEN 'KEEP_B' THEN b END END), min(a)) AS pick FROM d GROUP BY 1),
o AS (SELECT DISTINCT content_sha256 FROM d JOIN s USING (content_sha256) WHERE NOT conflict AND a = pick AND NOT done AND decision = '')
SELECT content_sha256, CASE WHEN out THEN 'EXCLUDED' WHEN waits THEN 'AWAITING_SOURCE_SELECTION' WHEN content_sha256 IN (FROM o) THEN 'PENDING' ELSE 'REVIEW_RESOLVED' END AS status, CASE WHEN NOT out AND NOT waits THEN pick END AS source FROM s""",
    "annotation_stats": f"""WITH {LISTS}, r AS (SELECT vec_id, label, CASE vec_id % 4 WHEN 0 THEN p WHEN 1 THEN p || p[1:1] WHEN 2 THEN p[1:2] || p[2:5] ELSE p[1:3] || p[1:1] || p[4:5] END AS p FROM rl)
SELECT 'a' || vec_id // 5 AS annotation, count(*) FILTER (WHERE label % 2 = 0) AS tree_count, count(*) FILTER (WHERE label % 2 = 1) AS treegroup_count, count(*) AS polygons, round(sum({_area('p')}), 5) AS area FROM r GROUP BY 1""",
    "duplicate_vertex_repairs": f"""WITH {_GEOMETRY} SELECT review_id, 'RAW_CONSECUTIVE_DUPLICATE' AS repair_type, 'raw_pixels' AS space, 6 AS before, 5 AS after, '2' AS removed FROM ge WHERE recommended = 'SAFE_REMOVE_DUPLICATE_VERTEX'""",
}


def _split_of(k: str) -> str:
    return f"CASE {k} % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END"


#: One round of the permutation: halves of ``half`` bits change places, one mixed with a hash of the other.
_ROUND = "((a & mask) << half) | xor(a >> half, CAST('0x' || substr(md5('42:' || k || ':' || (a & mask)), 1, 15) AS BIGINT) & mask)"
SQL |= {
    "published_versions": f"""WITH {MANIFEST}, s AS (SELECT source_dataset, count(*) AS n, sum(number_of_objects) AS o FROM man GROUP BY 1)
SELECT number, number <> 2 AS present, source_dataset, n, CAST(o + CASE WHEN number = 2 THEN n ELSE 0 END AS BIGINT) AS objects FROM s, (SELECT unnest([1, 2, 3]) AS number)""",
    "merged_answers": """WITH b AS (SELECT doc_id AS i, CAST(doc_id AS VARCHAR) AS review_id, ['', 'KEEP_A', 'KEEP_B', 'EXCLUDE'][doc_id % 4 + 1] AS bd, lang AS bn, doc_id % 11 <> 3 AS m, doc_id % 13 <> 5 AS t FROM documents),
c AS (SELECT *, CASE WHEN i % 5 = 0 THEN 'EXCLUDE' ELSE bd END AS md, CASE WHEN i % 7 = 0 THEN 'KEEP_A' ELSE bd END AS td, CASE WHEN i % 3 = 0 THEN 'seen' ELSE bn END AS tn FROM b),
f AS (SELECT *, m AND t AND md <> bd AND td <> bd AND md <> td AS clash, (NOT m AND t AND (td <> bd OR tn IS DISTINCT FROM bn)) OR (m AND NOT t AND md <> bd) AS lost FROM c)
SELECT review_id, CASE WHEN m AND t THEN CASE WHEN md <> bd AND NOT clash THEN md ELSE td END WHEN m THEN md WHEN t THEN td END AS human_decision, CASE WHEN t THEN tn WHEN m THEN bn END AS notes,
  CASE WHEN clash THEN 'human_decision' WHEN lost THEN 'row' ELSE '' END AS cells, CASE WHEN lost THEN NOT t ELSE NOT (m AND t) END AS gone FROM f""",
    "annotation_plan": f"""WITH {_GEOMETRY}, {LISTS}, {_crossings('cr', 'rl')},
one AS (SELECT vec_id, any_value(i) AS i, any_value(j) AS j FROM cr WHERE vec_id % 4 = 0 GROUP BY 1 HAVING count(*) = 1 AND bool_and(proper)),
fx AS (SELECT vec_id, p[1:i] || list_reverse(p[i + 1 : j]) || p[j + 1 :] AS p, i, j FROM one JOIN rl USING (vec_id)), {_crossings('fc', 'fx')},
ok AS (SELECT vec_id, i, j FROM fx WHERE vec_id NOT IN (SELECT vec_id FROM fc)),
s AS (SELECT e.vec_id, e.vec_id // 5 AS number, e.vec_id % 4 AS k, 'a' || e.vec_id // 5 AS annotation, CAST(e.vec_id % 5 + 1 AS INTEGER) AS shape_index, gs.review_id IS NOT NULL AS flagged, coalesce(review_status = 'AUTO_REPAIRED_DUPLICATE_VERTEX', false) AS safe,
  coalesce(severity, '') <> '' AS slight, n_crossings, e.vec_id IN (SELECT vec_id FROM cr WHERE NOT back) AS crossed, ok.i, ok.j
  FROM embeddings e JOIN ({_CLASSES}) c USING (vec_id) LEFT JOIN gs USING (vec_id) LEFT JOIN ok USING (vec_id)),
u AS (SELECT *, bool_or(flagged AND NOT safe AND number % 12 = 1) OVER (PARTITION BY number) AS used FROM s),
a AS (SELECT *, flagged AND NOT safe AND number % 3 = 2 AS fix, flagged AND NOT safe AND number % 3 = 0 AS keep FROM u),
w AS (SELECT *, fix AND slight AND n_crossings = 1 AND i IS NOT NULL AS fixed FROM a)
SELECT annotation, shape_index, CASE WHEN used THEN 4 WHEN k = 0 OR safe THEN 5 ELSE 6 END AS vertices,
  CASE WHEN used THEN '' WHEN safe THEN '0,1,3,4,5' WHEN fixed THEN array_to_string(range(0, i) || list_reverse(range(i, j)) || range(j, 5), ',') WHEN k = 0 THEN '0,1,2,3,4' ELSE '0,1,2,3,4,5' END AS places,
  CASE WHEN used THEN CASE WHEN shape_index = 1 THEN 'HUMAN_MANUAL_COPY' ELSE '' END WHEN safe THEN 'RAW_CONSECUTIVE_DUPLICATE' WHEN fixed THEN 'APPROVED_SINGLE_CROSSING_2OPT' ELSE '' END AS repairs,
  CASE WHEN used OR safe OR fixed THEN '' WHEN fix THEN CASE WHEN NOT slight THEN 'only slight crossings are undone' WHEN n_crossings <> 1 THEN 'more or less than one crossing' ELSE 'turning vertices round doesn''t give a simple ring' END
    WHEN k >= 2 THEN 'vertex used twice' WHEN crossed AND NOT keep THEN 'edges cross' ELSE '' END AS problem FROM w""",
    "reconciled_sides": f"""WITH {LISTS}, lp AS (SELECT vec_id, label, CASE WHEN vec_id % 37 = 8 THEN [{{'x': p[1].x + 1, 'y': p[1].y}}] || p[2:5] ELSE p END AS p, p AS ring FROM rl), {_crossings('lc', 'lp')},
an AS (SELECT vec_id, vec_id // 5 AS k, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS ordinal, CASE WHEN vec_id % 19 = 4 THEN 3 ELSE label % 2 + 1 END AS category, p AS ring, vec_id % 17 <> 3 AS agrees FROM rl WHERE vec_id % 23 <> 5),
li AS (SELECT vec_id, vec_id // 5 AS k, vec_id % 5 + 1 AS ordinal, CASE WHEN vec_id % 31 = 7 THEN 1 - label % 2 ELSE label % 2 END AS class_id, p, vec_id IN (SELECT vec_id FROM lc WHERE NOT back) AS crossed FROM lp WHERE vec_id % 29 <> 6),
im AS (SELECT vec_id // 5 AS k, count(*) AS total FROM embeddings GROUP BY 1), na AS (SELECT k, count(*) AS a FROM an GROUP BY 1), nl AS (SELECT k, count(*) AS n FROM li GROUP BY 1),
i AS (SELECT k, k % 43 <> 10 AS m, k % 47 <> 11 AS l, total + CASE WHEN k % 41 = 9 THEN 1 ELSE 0 END AS total, coalesce(a, 0) AS a, coalesce(n, 0) AS n FROM im LEFT JOIN na USING (k) LEFT JOIN nl USING (k)),
o AS (SELECT k, ordinal, an.vec_id IS NOT NULL AS has_a, li.vec_id IS NOT NULL AS has_l, category, class_id, agrees, ring, p, crossed AND NOT (k * 5 + ordinal - 1) % 2 = 0 AS bad FROM an FULL JOIN li USING (k, ordinal)),
f AS (SELECT k, NULL AS ordinal, 'manifest' AS side, 'image isn''t in it' AS problem FROM i WHERE NOT m AND l UNION ALL SELECT k, NULL, 'images', 'image isn''t listed' FROM i WHERE m AND NOT l
  UNION ALL SELECT k, NULL, 'annotations', 'image is unknown' FROM i WHERE NOT m AND NOT l AND a > 0 UNION ALL SELECT k, NULL, 'labels', 'image is unknown' FROM i WHERE NOT m AND NOT l AND n > 0
  UNION ALL SELECT k, NULL, 'images', 'size differs' FROM i WHERE m AND l AND k % 53 = 12 UNION ALL SELECT k, NULL, 'images', 'content differs' FROM i WHERE m AND l AND k % 59 = 13
  UNION ALL SELECT k, NULL, CASE WHEN a = n THEN 'manifest' WHEN total = n THEN 'annotations' WHEN total = a THEN 'labels' ELSE 'all' END, 'number of objects' FROM i WHERE m AND NOT (a = n AND total = a)
  UNION ALL SELECT k, ordinal, 'labels', 'line is missing' FROM o WHERE NOT has_l UNION ALL SELECT k, ordinal, 'annotations', 'annotation is missing' FROM o WHERE NOT has_a
  UNION ALL SELECT k, ordinal, 'labels', 'edges cross' FROM o WHERE has_l AND bad UNION ALL SELECT k, ordinal, 'annotations', 'box or area isn''t its ring''s' FROM o WHERE has_a AND NOT agrees
  UNION ALL SELECT k, ordinal, 'annotations', 'category isn''t known' FROM o WHERE has_a AND category = 3 UNION ALL SELECT k, ordinal, 'annotations, labels', 'class differs' FROM o WHERE has_a AND has_l AND category < 3 AND category - 1 <> class_id
  UNION ALL SELECT k, ordinal, CASE WHEN agrees THEN 'annotations, labels' ELSE 'annotations' END, 'ring differs' FROM o WHERE has_a AND has_l AND NOT bad AND ring <> p)
SELECT {_split_of('k')} AS split, 'i' || k AS image_id, CAST(ordinal AS BIGINT) AS ordinal, side, problem FROM f""",
    "split_random": f"""WITH {MANIFEST}, new AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS r, count(*) OVER () AS n FROM man WHERE number_of_objects % 10 <> 0),
h AS (SELECT *, CAST(greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2) AS BIGINT) AS half FROM new), q AS (SELECT *, (1::BIGINT << half) - 1 AS mask FROM h),
f AS (SELECT *, list_reduce(list_prepend(r, [0, 1, 2, 3]::BIGINT[]), lambda a, k: {_ROUND}) AS first FROM q),
w AS (SELECT *, list_reduce(list_prepend(first, range(96)), lambda z, s: CASE WHEN z >= n THEN list_reduce(list_prepend(z, [0, 1, 2, 3]::BIGINT[]), lambda a, k: {_ROUND}) ELSE z END) AS place FROM f)
SELECT image_id, CASE WHEN place < floor(n * 0.7) THEN 'train' WHEN place < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM w UNION ALL SELECT image_id, 'val' FROM man WHERE number_of_objects % 10 = 0""",
    "label_box_overlaps": f"""WITH {DET}, p AS (SELECT p.image_id, p.vec_id AS a, q.vec_id AS b, (least(p.x2, q.x2) - greatest(p.x1, q.x1)) AS w, (least(p.y2, q.y2) - greatest(p.y1, q.y1)) AS h, (p.x2 - p.x1) * (p.y2 - p.y1) AS s, (q.x2 - q.x1) * (q.y2 - q.y1) AS t
  FROM det p JOIN det q ON p.image_id = q.image_id AND p.vec_id < q.vec_id) SELECT image_id, a, b, w * h / (s + t - w * h) AS iou FROM p WHERE w > 0 AND h > 0""",
    "best_and_patience": """WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS value, row_number() OVER u AS place, max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, value IS NOT NULL AND (before IS NULL OR value > before) AS improved FROM e),
s AS (SELECT *, place - coalesce(max(place) FILTER (WHERE improved) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS since FROM i)
SELECT user_id, event_id, value, greatest(value, before) AS best, improved, since, max(since) OVER (PARTITION BY user_id ORDER BY event_id) >= 5 AS stopped FROM s""",
}
