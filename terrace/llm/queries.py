"""The queries of this package and, where SQL can express them, their equivalents for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .html_text import main_text
from .line_dedup import line_dedup
from .mixing import mixed_sizes
from .nearest import nearest
from .prefix_trie import prefix_trie
from .secrets import secret_scan
from .simhash import near_duplicates
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .suffix_array import longest_runs
from .token_files import round_trip
from .toxicity import toxicity


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents"))


def op3_line_dedup_lone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents"), lone=True)


def op3_longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_runs(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("tag")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_mixing, op3_line_dedup, op4_substring_dedup, op5_html_text, op6_secrets, op7_toxicity, op8_exact_dedup, op9_decontamination, op10_token_files, op11_nearest, op12_prefix_trie, op13_spelling)}


def variants() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Further queries of the same operators, beside the one of each."""
    return {f.__name__: f for f in (op3_line_dedup_lone, op3_longest_runs)}


def _apportion(name: str, parties: str, within: str, key: str) -> str:
    """CTEs for seats by highest quotients among ``parties(within, key, votes, most, seats)``."""
    own = f"PARTITION BY {within}" if within else ""
    comma = f"{within}, " if within else ""
    return f"""
{name}_p AS (SELECT *, sum(votes) OVER ({own}) AS t_, count(*) OVER ({own}) / 2.0::DOUBLE AS p_ FROM {parties}),
{name}_b AS (SELECT *, CAST(least(greatest(ceil(votes * (seats - p_) / t_ - 0.5) - 1, 0), most) AS BIGINT) AS lo_,
                    CAST(least(ceil(votes * (seats + p_) / t_ + 0.5) + 1, most) AS BIGINT) AS hi_ FROM {name}_p),
{name}_r AS (SELECT *, seats - sum(lo_) OVER ({own}) AS rest_ FROM {name}_b),
{name}_o AS (SELECT {comma}{key}, votes, rest_, unnest(range(lo_, hi_)) AS k_ FROM {name}_r),
{name}_w AS (SELECT *, row_number() OVER ({own} ORDER BY votes / (2 * k_ + 1) DESC, {key}, k_) AS at_ FROM {name}_o),
{name}_c AS (SELECT {comma}{key}, count(*) AS won_ FROM {name}_w WHERE at_ <= rest_ GROUP BY ALL),
{name} AS (SELECT {comma}{key}, lo_ + coalesce(won_, 0) AS got FROM {name}_r LEFT JOIN {name}_c USING ({comma}{key}))"""


SQL = {
    "op2_mixing": rf"""
WITH rows_ AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS s FROM rows_ GROUP BY source),
wt AS (SELECT *, (s - 1) % 3 + 1 AS w, 3 * source_size AS most FROM src),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
       FROM wt WINDOW b AS (ORDER BY most / CAST(w AS DOUBLE), s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT source, s, source_size, least(CAST(most AS DOUBLE), w * (SELECT level FROM lv WHERE level <= most / CAST(w AS DOUBLE) ORDER BY most / CAST(w AS DOUBLE), s LIMIT 1)) AS target FROM lv),
pl AS (SELECT r.doc_id, r.size, t.s, t.source_size, t.target,
              CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % greatest(1, CAST(ceil(t.source_size / 200000.0) AS BIGINT)) AS shard
       FROM rows_ r JOIN tg t ON r.source IS NOT DISTINCT FROM t.source),
st AS (SELECT *, CAST(sum(size) OVER o AS BIGINT) AS stop_, row_number() OVER o AS r FROM pl
       WINDOW o AS (PARTITION BY s, shard ORDER BY md5('43:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cut AS (SELECT s, shard, CAST(sum(size) AS BIGINT) AS words, shard // 256 AS team,
               CAST(greatest(ceil(sum(size) / 256.0), least(sum(size), 64)) AS BIGINT) AS blocks FROM pl GROUP BY s, shard HAVING sum(size) > 0),
v1 AS (SELECT s, blocks, target * blocks / source_size AS votes, 3 * blocks AS most FROM (SELECT s, CAST(sum(blocks) AS BIGINT) AS blocks FROM cut GROUP BY s) JOIN tg USING (s)),
p1 AS (SELECT s, votes, most, CAST(round(sum(votes) OVER ()) AS BIGINT) AS seats FROM v1),
{_apportion("a1", "p1", "", "s")},
p2 AS (SELECT s, team, CAST(sum(blocks) AS DOUBLE) AS votes, 3 * CAST(sum(blocks) AS BIGINT) AS most, any_value(got) AS seats FROM cut JOIN a1 USING (s) GROUP BY s, team),
{_apportion("a2", "p2", "s", "team")},
p3 AS (SELECT s, team, shard, CAST(blocks AS DOUBLE) AS votes, 3 * blocks AS most, got AS seats FROM cut JOIN a2 USING (s, team)),
{_apportion("a3", "p3", "s, team", "shard")},
bl AS (SELECT s, shard, words, blocks, got AS quota, unnest(range(blocks)) AS k FROM cut JOIN a3 USING (s, team, shard)),
bt AS (SELECT s, shard, k, k * words // blocks AS from_, (k + 1) * words // blocks AS to_,
              quota // blocks + CASE WHEN row_number() OVER (PARTITION BY s, shard ORDER BY md5('44:' || s || ':' || shard || ':' || k)) <= quota % blocks THEN 1 ELSE 0 END AS times FROM bl)
SELECT st.doc_id, st.size, st.source_size, st.target,
       CAST(coalesce(sum((least(stop_, to_) - greatest(stop_ - size, from_)) * times) FILTER (WHERE least(stop_, to_) > greatest(stop_ - size, from_)), 0) AS BIGINT) AS taken
FROM st LEFT JOIN bt ON st.s = bt.s AND st.shard = bt.shard AND bt.from_ < st.stop_ AND bt.to_ > st.stop_ - st.size
GROUP BY st.s, st.shard, st.r, st.doc_id, st.size, st.source_size, st.target
""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
}
SQL["op9_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[p : p + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS l FROM bw),
dw AS (SELECT doc_id, p, l, w[p : p + l - 1] AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT doc_id, p, l, item_id FROM dw JOIN bw USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM hit, range(10) r(o) WHERE o < l GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
SQL["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS k FROM win),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS a FROM h) WHERE a < doc_id),
g AS (SELECT doc_id, list(DISTINCT p + o) AS gone FROM f, range(50) r(o) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def _spans(kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
SELECT doc_id, text_row, '{kind}' AS kind, CAST(list_sum(g[1:i]) + coalesce(list_sum([len(x) FOR x IN m[1 : i - 1]]), 0) AS BIGINT) AS a_, m[i] AS hit, n[i] AS inner_
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, text_row, [len(x) FOR x IN string_split_regex(t, '{pattern}')] AS g, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS n FROM d))
WHERE len(n[i]) >= {least}"""


_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0), ("hub", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
SQL["op6_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS text_row FROM documents),
s AS ({' UNION ALL '.join(_spans(*k) for k in _KINDS)}),
o AS (SELECT *, coalesce(a_, 0) AS a, list_position(['assign', 'access', 'hex', 'pem', 'hub'], kind) AS ord_ FROM s),
c AS (SELECT text_row, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(kind || ':' || a || ':' || (a + len(hit)), ',' ORDER BY a, ord_) FILTER (WHERE ord_ <= 3) AS base,
             string_agg(kind || ':' || a || ':' || (a + len(hit)), ',' ORDER BY a, ord_) AS spans FROM o GROUP BY text_row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (text_row)
"""
SQL["op3_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
r AS (SELECT doc_id, p, l[p] || chr(10) || l[p + 1] AS k FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS p FROM d)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS c FROM r) WHERE c > 1),
g AS (SELECT doc_id, list(DISTINCT p + o) AS gone FROM f, range(2) t(o) GROUP BY doc_id)
SELECT doc_id, len(l) AS n_lines, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN l ELSE list_filter(l, lambda x, i: NOT list_contains(gone, i)) END, chr(10))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
_LONGEST = r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, dense_rank() OVER (ORDER BY l[p]) AS c FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM d)),
grow AS (SELECT doc_id, p, 1 AS n, c AS k, m FROM (SELECT *, count(*) OVER (PARTITION BY c) AS m FROM w) WHERE m > 1
         UNION ALL SELECT doc_id, p, n, k, m FROM (
             SELECT grow.doc_id, grow.p, grow.n + 1 AS n, dense_rank() OVER (ORDER BY grow.k, w.c) AS k, count(*) OVER (PARTITION BY grow.k, w.c) AS m
             FROM grow JOIN w ON w.doc_id = grow.doc_id AND w.p = grow.p + grow.n) WHERE m > 1),
top AS (SELECT doc_id, n AS longest_run, m AS run_copies FROM grow WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) = 1)
SELECT doc_id, len(l) AS n_lines, coalesce(longest_run, 0) AS longest_run, coalesce(run_copies, 0) AS run_copies FROM d LEFT JOIN top USING (doc_id)
"""
VARIANT_SQL = {"op3_line_dedup_lone": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
r AS (SELECT doc_id, p, 2 AS n, l[p] || chr(10) || l[p + 1] AS k FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS p FROM d)
      UNION ALL SELECT doc_id, p, 1, l[p] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM d) WHERE regexp_matches(l[p], '[^\x20\x09-\x0D]')),
f AS (SELECT doc_id, p, n FROM (SELECT doc_id, p, n, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, p) AS c FROM r) WHERE c > 1),
g AS (SELECT doc_id, list(DISTINCT p + o) AS gone FROM f, range(2) t(o) WHERE o < n GROUP BY doc_id)
SELECT doc_id, len(l) AS n_lines, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN l ELSE list_filter(l, lambda x, i: NOT list_contains(gone, i)) END, chr(10))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
""", "op3_longest_runs": _LONGEST}


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8, four bits a step; the table follows from the polynomial."""

    def step(n: int) -> int:
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        return n

    table = ", ".join(str(step(n)) for n in range(16))
    digits = f"list_transform(range(0, 2 * octet_length(encode({text}))), lambda i: CAST(strpos('0123456789ABCDEF', substr(hex(encode({text})), CAST(i + 2 - 2 * (i % 2) AS BIGINT), 1)) - 1 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda a, n: xor(a >> 4, ([{table}]::BIGINT[])[CAST((xor(a, n) & 15) + 1 AS BIGINT)])), 4294967295)"


SQL["op12_prefix_trie"] = rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
                  md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, {_crc32('CAST(c AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c.c, 0 AS own, t.p, t.k, t.w FROM c JOIN t ON t.c = c.c - c.c % 20 AND t.p <= c.h UNION ALL SELECT c.c, 1, t.p, t.k, t.w FROM c JOIN t ON t.c = c.c AND t.p > c.h),
s AS (SELECT c, list(k ORDER BY own, p) AS ks, list(w ORDER BY own, p) AS ws FROM r GROUP BY c),
a AS (SELECT c.c, coalesce(ks, []) AS ks, coalesce(ws, []) AS ws FROM c LEFT JOIN s USING (c)),
m AS (SELECT c, d, ks[1:d] AS pre, CASE WHEN d > 0 THEN ks[1 : d - 1] END AS up, coalesce(ws[d], 0) AS w, d = len(ks) AS ends FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM a)),
n AS (SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY pre, d),
k AS (SELECT up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, u.conv_id AS parent_conv_id FROM n LEFT JOIN k ON n.pre = k.up LEFT JOIN n u ON n.up = u.pre),
b AS (SELECT pre[1:g] AS pre, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS g FROM f) GROUP BY 1)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM f JOIN b USING (pre)
"""
SQL["op13_spelling"] = f"""
WITH RECURSIVE q AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7),
g AS (SELECT doc_id, run, count(*) AS times FROM q GROUP BY ALL),
h AS (SELECT *, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM g),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)),
e AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.s = b.s AND a.i = b.i AND a.word <> b.word UNION SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.s UNION SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.s),
l AS (SELECT word, count(*) AS n_near, max(m) AS form_n, arg_min(other, (-m, other)) AS form FROM e GROUP BY word),
v AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN l USING (word)),
p AS (SELECT word, form AS root FROM v WHERE form IS NOT NULL UNION ALL SELECT p.word, v.form FROM p JOIN v ON v.word = p.root WHERE v.form IS NOT NULL),
t AS (SELECT p.word, p.root FROM p JOIN v ON v.word = p.root WHERE v.form IS NULL)
SELECT v.word, v.form, coalesce(t.root, v.word) AS root, v.n, v.n_near, v.form_n FROM v LEFT JOIN t USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return SQL | VARIANT_SQL
