"""Nearest vectors, the prefix trie and spelling variants against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import nearest as N
from terrace.llm import prefix_trie as P
from terrace.llm import spelling as S

VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"


def plain_nearest(rows, k=20, every=20):
    """{query: [(score, id)]} over all rows, ids once."""
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and good(v)]
    out = {}
    for q, x in rows:
        if q % every:
            continue
        best = out.setdefault(q, {})
        for i, y in rows:
            if i != q:
                n = min(len(x), len(y))
                best[i] = max(best.get(i, -np.inf), float((x[:n] * y[:n]).sum()))
    return {q: sorted(((-s, i) for i, s in best.items()))[:k] for q, best in out.items()}


def by_query(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((-r["score"], r["vec_id"]))
    return out


def test_nearest_recall_and_scores(spark, data):
    vectors = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.1/embeddings.parquet")
    got = by_query(N.nearest(vectors, block=128, sample=512))
    want = plain_nearest([(r[0], r[1]) for r in vectors.select("vec_id", "embedding").collect()])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): s for q in want for s, i in want[q]}
    for q, found in got.items():
        assert found == sorted(found)
        assert all(abs(exact[q, i] - s) < 1e-12 for s, i in found if (q, i) in exact)


def test_nearest_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).round(2).tolist(), 0) for i in range(45)]
    rows += [(100 + i, rows[0][1], 0) for i in range(50)]  # copies beyond k: the smallest ids count
    rows += [(200, [1.0, 2.0], 0), (None, [1.0] * 5, 0), (220, None, 0), (240, [0.0] * 5, 0), (260, [1.0, None, 1.0, 1.0, 1.0], 0), (280, [float("nan")] + [1.0] * 4, 0), (300, [float("inf")] + [1.0] * 4, 0), (320, [], 0)]
    rows += [(20, rows[3][1], 1), rows[7], rows[7]]  # ids that stand more than once
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = by_query(N.nearest(df, block=16))
    want = plain_nearest([(i, np.float32(v).tolist() if v and None not in v else v) for i, v, _ in rows])
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])
    clash = df.select("*", *(F.lit("x").alias(n) for n in ("vector", "same", "key", "kind", "rank", "score", "curve", "block")))
    assert by_query(N.nearest(clash, block=16)) == got
    assert N.nearest(df.limit(0)).collect() == [] and N.nearest(df.where("vec_id % 20 = 1")).collect() == []
    assert by_query(N.nearest(df.where("vec_id = 40"))) == {}


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_what_blocks_find_is_merged_in_their_task(spark, monkeypatch, most):
    monkeypatch.setattr(N, "HELD", most)
    rng = np.random.default_rng(5)
    data = [(0, b, 0, 1000 * b + i, rng.normal(size=4).tolist()) for b in range(10) for i in range(40)]
    data += [(0, b, 0, 7, [0.5, 0.5, 0.5, 0.5]) for b in range(10)]  # found in every block
    asks = [(0, b, 1, q, [1.0, 1.0, 1.0, float(q)]) for b in range(10) for q in (20, 40)]
    df = spark.createDataFrame(data + asks, "curve int, block long, kind int, vec_id long, vector array<double>")
    found = N._searched(df.coalesce(1).sortWithinPartitions("curve", "block", "kind", "vec_id"), 4, 5).collect()
    if most > 60:
        assert len(found) == 2 * 5  # not once a block
    for q in (20, 40):
        want = sorted({(-float(np.dot(v, [1.0, 1.0, 1.0, float(q)])), i) for _, _, _, i, v in data})[:5]
        best = sorted({(-r["score"], r["vec_id"]) for r in found if r["query_id"] == q})[:5]
        assert [i for _, i in best] == [i for _, i in want]


def test_hilbert_steps_to_a_neighbour():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1).T
    keys = N.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [v[2:] for v in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * words
        ends = ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def random_turns(n, seed):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randrange(0, 7)):
            rows.append((c, None if draw.random() < 0.05 else t, draw.choice(["user", "assistant", None, ""]), draw.choice(["a", "a b", "b  c\td", None, "", "é 日"])))
    return rows


@pytest.mark.parametrize("path", [2, 1024])
def test_trie_is_the_plain_trie(spark, monkeypatch, path):
    monkeypatch.setattr(P, "PATH", path)
    monkeypatch.setattr(P, "PIECE", 7)
    rows = random_turns(150, 5) + [(400, t, "user", "same " * (t % 3)) for t in range(300)] + [(401, t, "user", "same " * (t % 3)) for t in range(280)]
    rows += [(-25, 1, "user", "x"), (-25, 0, "user", "y"), (None, 0, "user", "z"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)  # ranges far shorter than the longest conversation
    try:
        assert sorted(map(repr, map(tuple, P.prefix_trie(df).collect()))) == plain_trie(rows)
        clash = df.select("*", *(F.lit("x").alias(n) for n in ("conv", "depth", "h1", "lo", "mark", "value", "place", "part", "words")))
        assert sorted(map(repr, map(tuple, P.prefix_trie(clash).collect()))) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_no_rows_and_of_turnless_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert P.prefix_trie(none).collect() == []
    # a conversation all of whose turns are replaced and whose base is absent has no turns: it ends at the root
    c = next(c for c in range(21, 200) if zlib.crc32(str(c).encode()) % 4 == 1 and c % 20)
    rows = [(c, 0, "user", "gone")]
    assert sorted(map(repr, map(tuple, P.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()))) == plain_trie(rows)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_variants(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    shortened, near = defaultdict(list), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            shortened[i, w[:i] + w[i + 1 :]].append(w)
    for (_, s), group in shortened.items():
        for a in group:
            near[a] |= {b for b in group if b != a}
            if s in n:
                near[a].add(s)
                near[s].add(a)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(map(repr, out))


def test_variants_are_the_plain_variants(spark, docs, extra):
    draw = random.Random(7)
    stems = ["aaaaaaaa", "abababab", "straßenz", "ÀÉñøünde", "language", "internal"]
    rows = []
    for i in range(400):
        words = []
        for stem in draw.choices(stems, [1, 1, 2, 2, 200, 20], k=12):
            if draw.random() < 0.1:
                at = draw.randrange(len(stem))
                stem = draw.choice([stem[:at] + stem[at + 1 :], stem[:at] + draw.choice("abé") + stem[at + 1 :], stem[:at] + draw.choice("ab") + stem[at:]])
            words.append(draw.choice([stem, stem.upper()]))
        rows.append((i, draw.choice([" ", "-", "1"]).join(words)))
    rows += [(None, "nullable nullable Nullable"), (900, None), (901, ""), (902, "x" * 3000 + " " + "x" * 2999 + " ok " + "x" * 3000), (903, "x" * 2999 + " " + "x" * 3001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(repr, map(tuple, S.spelling_variants(df).collect())))
    assert got == plain_variants(rows)
    assert sum("None" not in g for g in got) > 5
    assert sorted(map(repr, map(tuple, S.spelling_variants(docs).collect()))) == plain_variants([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(repr, S.spelling_variants(extra).collect())) == sorted(map(repr, S.spelling_variants(docs).collect()))
    assert S.spelling_variants(docs.limit(0)).collect() == []


def test_roots_follow_long_chains(spark):
    ways = spark.createDataFrame([(i, i + 1) for i in range(17)], "id long, root long")
    assert {tuple(r) for r in S._roots(ways).collect()} == {(i, 17) for i in range(17)}


def test_colliding_keys_are_told_apart_by_their_strings(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "abcdefgh qrstuvwx abcdefgx mnopqrst") for i in range(3)], "doc_id long, text string")
    want = sorted(map(repr, S.spelling_variants(docs).collect()))
    monkeypatch.setattr(S, "deletion_keys", lambda codes, sizes, real=S.deletion_keys: (real(codes, sizes)[0] & 3, *real(codes, sizes)[1:]))
    assert sorted(map(repr, S.spelling_variants(docs).collect())) == want
