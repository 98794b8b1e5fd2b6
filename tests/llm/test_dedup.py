"""SimHash, exact, line and substring deduplication against brute force and on odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrace.llm import exact_dedup as E
from terrace.llm import line_dedup as L
from terrace.llm import simhash as S
from terrace.llm import substring_dedup as B
from terrace.llm import suffix_array as A
from terrace.llm.common import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints_and_components(docs, extra, rows):
    got = S.near_duplicates(docs).collect()
    source = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in source]
    want = plain_components([r["doc_id"] for r in source], fps)
    assert sorted(map(repr, [(r["doc_id"], f"{f:016x}", c) for r, f, c in zip(source, fps, want)])) == sorted(map(repr, map(tuple, got)))
    assert rows(S.near_duplicates(extra)) == rows(S.near_duplicates(docs))


def test_spark_hash_is_the_fingerprint_hash(spark):
    assert spark.sql("SELECT xxhash64('a b c') h").first()["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("hot,part,levels", [(2, 4096, 3), (48, 4096, 3), (2, 2, 3), (2, 9, 2)])
def test_links_lose_nothing(spark, hot, part, levels, monkeypatch):
    """Random, clustered and chained fingerprints; with ``hot`` 2 nearly every value is crowded, with a small ``part`` divided again."""
    monkeypatch.setattr(S, "PART", part)
    monkeypatch.setattr(S, "LEVELS", levels)
    rng = random.Random(hot)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for base in list(fps)[:12]:
        for _ in range(15):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    chain = rng.getrandbits(64)
    for b in range(0, 60, 3):
        chain ^= 7 << b
        fps.add(chain)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = S.links(table, 3, hot)
    for r in edges.collect():
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    want = plain_components(signed, fps)
    assert [roots.get(f, f) for f in signed] == want


def test_divided_runs_keep_each_link_in_one(spark, monkeypatch):
    """A dense cloud: every pair within three bits shares a run after each number of divisions, and the runs get smaller."""
    monkeypatch.setattr(S, "PART", 4)
    rng = random.Random(5)
    fps = sorted({sum(1 << b for b in rng.sample(range(13), rng.randint(0, 4))) for _ in range(120)})
    table = spark.createDataFrame([(f, "x", 1) for f in fps], "fp long, fixed string, run long")
    near = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    for levels in (1, 2, 3):
        monkeypatch.setattr(S, "LEVELS", levels)
        runs: dict = {}
        for part in S._divided(table, {"x": list(range(13))}, 3, len(fps)):
            for r in part.collect():
                runs.setdefault(r["run"], set()).add(r["fp"])
        assert near <= {(a, b) for members in runs.values() for a in members for b in members if a < b}


def test_plan_adds_up():
    both = np.eye(64) * 10 + 5
    for m in (1, 2, 3):
        groups = S.group_bits(both, 20, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
    cost, chosen = S.allocate([[0, 5, 50], [0, 9, 10], [0, 1, 2]], 1)
    assert sum(chosen) == 1 and chosen == [-1, 1, 1] and cost == 12


def test_one_of_each_group_stays(docs, extra, none):
    kept = S.deduplicated(docs).collect()
    assert [r["doc_id"] for r in kept if r["text"] and r["text"].startswith("One two")] == [1]
    components = {r["component_id"] for r in S.near_duplicates(docs).collect()}
    assert len(kept) == len(components)
    assert S.deduplicated(extra).count() == len(kept) and S.deduplicated(extra).columns == extra.columns
    assert S.deduplicated(none).count() == 0 and S.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def plain_exact(source):
    groups = {}
    for r in source:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            stays = i == best and left
            left -= bool(stays)
            out.append((i, best, len(ids), bool(stays), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 20), (16, 40)])
def test_exact(docs, extra, none, rows, limits):
    want = plain_exact(docs.collect())
    assert rows(E.exact_dedup(docs, combine_bytes=limits[0], bucket_bytes=limits[1])) == want
    assert rows(E.exact_dedup(extra, combine_bytes=limits[0], bucket_bytes=limits[1])) == want
    assert E.exact_dedup(none).count() == 0


def test_table_compares_contents():
    t = E.OpenAddressingTable(4)
    got = [t.put(7, str(i % 50).encode(), i) for i in range(300)]  # all of one hash
    assert got == [i % 50 for i in range(300)] and t.used == 50


def plain_substring(source, window=50):
    first = {}
    texts = []
    for r in source:
        words = (r["text"] or "").encode().split()
        key = r["doc_id"] if r["doc_id"] is not None else B.LAST
        texts.append((r["doc_id"], key, words))
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, key), key)
    out = []
    for doc, key, words in texts:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < key:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("hot", [0, 1, 500])
def test_substring(docs, extra, none, rows, hot, monkeypatch):
    """At 0 every bucket goes through all levels, at 1 the shared ones."""
    monkeypatch.setattr(B.removals, "__defaults__", (B.WINDOW, ((8, hot), (25, min(hot, 1) if hot < 500 else 8000), (50, None))))
    want = plain_substring(docs.collect())
    assert rows(B.substring_dedup(docs)) == want
    if hot == 500:
        assert rows(B.substring_dedup(extra)) == want
        assert B.substring_dedup(none).count() == 0
        assert B.deduplicated(extra).columns == extra.columns and B.deduplicated(extra).count() == extra.count()


def test_super_kmers_cover_each_window_once():
    rng = np.random.default_rng(1)
    for n in (49, 50, 51, 400, 3000):
        h = rng.integers(0, 50 if n == 400 else 1 << 62, n).astype(np.uint64)
        start, count, _ = B.super_kmers(h, 50, 8)
        assert sum(count) == max(0, n - 49) and list(start) == list(np.cumsum([0, *count[:-1]]) if len(count) else [])
    same = B.super_kmers(np.zeros(3000, np.uint64), 50, 8)
    assert max(same[1]) <= B.RUN
    x = rng.integers(0, 100, 200)
    assert (B.sliding_min(x, 43) == [x[i : i + 43].min() for i in range(158)]).all()


def plain_lines(source, least):
    seen, out = {}, {}
    for key, r in sorted({((r["doc_id"] if r["doc_id"] is not None else L.LAST), r["text"] or "", r["doc_id"], r["text"]): r for r in source}.items(), key=lambda x: x[0][0]):
        lines = key[1].split("\n")
        gone = set()
        for i in range(len(lines) - least + 1):
            run = tuple(lines[i : i + least])
            if run in seen:
                gone.update(range(i, i + least))
            seen.setdefault(run, key[0])
        out[key[2], key[3]] = (len(lines), len(gone), hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in gone).encode()).hexdigest())
    return sorted(repr((r["doc_id"], *out[r["doc_id"], r["text"]])) for r in source)


@pytest.mark.parametrize("least", [1, 2, 3, 8])
def test_lines(spark, extra, none, rows, least):
    rng = random.Random(least)
    data = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(50, None), (51, ""), (None, "a\nb\nc\na\nb\nc"), (3000, "x\n" * 300), (3000, "x\n" * 300)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(L.line_dedup(docs, least)) == plain_lines(docs.collect(), least)
    if least == 2:
        assert L.line_dedup(none).count() == 0
        assert L.deduplicated(extra).count() == extra.count()
        assert L.deduplicated(docs).where("doc_id = 50").first()["text"] is None
        assert L.deduplicated(docs.select("*", F.lit(1).alias("rank"))).count() == len(data)


def test_lone_lines(spark, same):
    """A repeated line goes though its neighbours differ; a blank one only as part of a run; the query is held against its SQL."""
    from terrace.llm import queries as Q

    data = [(1, "a\nsame line\nb\n\nc"), (2, "d\nsame line\ne\n\nf"), (3, "x\n\nc"), (4, " \nsame line"), (5, " \ng\n\nc")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.deduplicated(docs, lone=True).collect()}
    assert got == {1: data[0][1], 2: "d\ne\n\nf", 3: "x", 4: " ", 5: " \ng"}
    same(Q.variants()["op3_line_dedup_lone"], Q.oracle_sql()["op3_line_dedup_lone"])


def plain_longest(source, least):
    """Every run of every length, by plain counting."""
    texts = {(r["doc_id"], r["text"]): (r["text"] or "").split("\n") for r in source}
    begins = Counter(tuple(x[i:j]) for x in texts.values() for i in range(len(x)) for j in range(i + least, len(x) + 1))

    def top(x):
        places = ((n, i) for n in range(len(x), least - 1, -1) for i in range(len(x) - n + 1))
        return next(((n, begins[tuple(x[i : i + n])]) for n, i in places if begins[tuple(x[i : i + n])] > 1), (0, 0))

    out = {k: (k[0], len(x), *top(x)) for k, x in texts.items()}
    return sorted(repr(out[r["doc_id"], r["text"]]) for r in source)


@pytest.mark.parametrize("least", [2, 3])
def test_longest_runs(spark, none, rows, same, least):
    rng = random.Random(least)
    data = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(50, None), (51, ""), (None, "a\nb\nc\na\nb\nc"), (52, "x\n" * 60), (52, "x\n" * 60)]
    data += [(60 + i, "\n".join(f"long {j}" for j in range(i, 40 - i % 7)) + "\n" + rng.choice("abc")) for i in range(12)]
    # repeated lines on both sides of a line that occurs once
    data += [(93, "u\nv\nonce 93\np\nq\nr\ns"), (94, "u\nv\nonce 94\np\nq\nonce\nr\ns\nt"), (95, "u\nv\nw\nonce 95\nq\nr\ns"), (96, "w\nu\nv\nw\n")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(A.longest_runs(docs, least)) == plain_longest(docs.collect(), least)
    if least == 2:
        from terrace.llm import queries as Q

        assert A.longest_runs(none).count() == 0
        same(Q.variants()["op3_longest_runs"], Q.oracle_sql()["op3_longest_runs"])
