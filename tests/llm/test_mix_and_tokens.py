"""Mixing and token files: targets, whole documents, exact round trips; and the pipeline that ends in them."""

import gc
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrace.llm import mixing as M
from terrace.llm import token_files as K

WORDS = public_tokenizers.path("word_bpe_49k.json")
ENCODER = K.Encoder(WORDS, 2)


def plain_targets(sizes):
    """By code point, null last; weights 1, 2, 3; water filling."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        heavy = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / heavy > 3 * sizes[s]] if heavy else []
        if not over:
            return out | {s: left * w[s] / heavy for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            free.discard(s)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        s = rng.choice(["a", "a", "a", "a", "b", "Z", "é", None])
        n = rng.choice([0, 1, 5, 40, 300])
        rows.append((i, " ".join(f"w{j}" for j in range(n)) if n else rng.choice([None, "", "  "]), s))
    rows += [(9000, "tiny text", "rare"), (9001, None, "void"), (None, "x y z", "a"), (5, "again", "b"), (5, "again", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken(spark, corpus):
    rows = M.mixed_sizes(corpus).collect()
    assert len(rows) == corpus.count()
    source = {}
    for r in corpus.collect():
        source[r["source"]] = source.get(r["source"], 0) + len((r["text"] or "").split())
    want = plain_targets(source)
    by_size = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_size.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for s, n in source.items():
        key = next(k for k in by_size if k[0] == n and abs(k[1] - want[s]) < 1e-6)
        assert abs(sum(by_size[key]) - want[s]) <= max(0.02 * want[s], 3)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, M.mixed_sizes(corpus.repartition(7)).collect()), key=repr)


def test_highest_quotients(spark):
    """Seats by the listed quotients only, against all of them."""
    rng = random.Random(3)
    for case in range(6):
        votes = [rng.choice([0, 1, 7, 50.5, rng.random() * 1000]) for _ in range(rng.randint(1, 12))]
        seats = rng.randint(0, 60) if sum(votes) else 0
        rows = [(k, float(v), seats, 10_000) for k, v in enumerate(votes)]
        got = {r["k"]: r["got"] for r in M.apportion(spark.createDataFrame(rows, "k long, votes double, seats long, most long"), [], "k").collect()}
        best = sorted(((-v / (2 * j + 1), k) for k, v in enumerate(votes) if v for j in range(seats)))[:seats]
        assert got == {k: sum(x == k for _, x in best) for k in range(len(votes))}, case


def plain_mix(spark, docs, **sizes):
    """Texts of the mix: every row's words cut in a plain loop by the parts that the plan names."""
    held = docs.collect()
    rows = [(r["doc_id"], str(r["doc_id"]) if r["doc_id"] is not None else "null:" + hashlib.md5((r["text"] or "").encode()).hexdigest(), r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), k) for k, r in enumerate(held)]
    plan = M.mix_rows(spark.createDataFrame(rows, "doc_id long, key string, source string, size long, tag long"), **sizes).collect()
    assert sorted(p["tag"] for p in plan) == list(range(len(held)))
    out = []
    for p in plan:
        text = held[p["tag"]]["text"]
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        spans = [tuple(x) for x in p["parts"]]
        assert sum((b - a) * t for a, b, t in spans) == p["taken"] and all(0 <= a < b <= p["size"] and t <= 3 for a, b, t in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        for copy in range(1, max((t for _, _, t in spans), default=0) + 1):
            own = [w for a, b, t in spans if t >= copy for w in words[a:b]]
            out.append((p["doc_id"], text if len(own) == len(words) else " ".join(own)))
    return sorted(out, key=repr)


def test_mix_rows_are_what_was_taken(spark, corpus, docs, extra, none):
    for given in (corpus, docs):  # the texts of repeated rows are equal, so whichever of them a plan meets
        out = M.mixed(given)
        assert out.columns == given.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == plain_mix(spark, given)
    cut = M.mixed(docs).select("doc_id", "text", "n_chars").collect()
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    assert M.mixed(corpus).agg(F.sum(M.word_count(F.col("text")))).first()[0] == M.mixed_sizes(corpus).agg(F.sum("taken")).first()[0]
    assert M.mixed(extra).columns == extra.columns and M.mixed(none).count() == 0 and M.mixed_sizes(none).count() == 0
    assert M.mixed_sizes(docs).count() == docs.count()
    assert M.mixed_sizes(docs.where("text IS NULL")).agg(F.sum("taken"), F.max("target")).first() == (0, 0.0)


def test_mix_of_rows_with_maps(spark):
    """Rows are told apart by their number, so columns that can't be hashed or compared go through."""
    rows = [(k % 4, " ".join(f"w{j}" for j in range(300)), "ab"[k % 2], {"k": k}) for k in range(12)]
    out = M.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>"))
    assert {r["more"]["k"] for r in out.collect()} <= set(range(12)) and out.count() > 0


@pytest.mark.parametrize("n,lanes,every", [(0, 4, 8), (1, 4, 8), (7, 4, 4), (5000, 16, 64), (5000, 16, 1 << 20)])
def test_coder_round_trip(n, lanes, every):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 300).astype(np.uint16)
    counts = np.bincount(ids, minlength=400)
    freq = K.scaled(counts)
    if n:
        assert freq.sum() == 1 << K.SCALE and (freq[counts > 0] > 0).all()
    tables = K.decoding_tables(freq)
    b = K.pack(ids, freq, lanes=lanes, every=every)
    stops = [m["at"] for m in b["marks"][1:]] + [n]
    parts = [K.unpack(b["payload"], m, s, tables, lanes=lanes) for m, s in zip(b["marks"], stops)]
    assert np.array_equal(np.concatenate(parts) if parts else np.zeros(0), ids)
    if n == 5000 and every == 64:
        assert len(parts) > 50 and np.array_equal(parts[17], ids[stops[16] : stops[17]])  # from the middle


def test_crc_of_joined_parts():
    a, b = b"12345678", bytes(range(250)) * 3
    assert K.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and K.crc_join(7, 0, 0) == 7


def plain_tokens(source):
    t = Tokenizer.from_file(WORDS)
    out = []
    for r in source:
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    return out


def test_ids_are_the_library_s(spark, data):
    e = K.Encoder(WORDS, 2)
    assert e.by_words
    t = e.tokenizer
    odd = ["", " ", "It's 'll DON'T x's", "É́ ǅ İstanbul ſ K ﬁ", "a.b,c;d:e!f?...", "12 3a4 ½ ²", "日本語 テスト", "\U0001f600\U0001f600 é ́x", "a b c\x1cd\x85e", "<|endoftext|> x <|startoftext|>y", "tab\tsep\r\nline", "w" * 3000, "A.B. C.,", "x'", "'s"]
    odd += [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(120).collect()]
    ids = encoded(e, odd)
    for text, got in zip(odd, ids, strict=True):
        assert got == t.encode(text or "", add_special_tokens=False).ids + [2], text[:80]


def encoded(e, texts):
    """Lists of ids from the slices that an encoder gives."""
    return [p.tolist() for ids, counts in e.encode(pa.array(texts, pa.string())) for p in np.split(ids, np.cumsum(counts)[:-1])]


TEXTS = st.lists(st.one_of(st.text(max_size=60), st.text(alphabet=st.sampled_from(list("aAbZ09'\"<|>.,- \n\t\r\x0b\x1c\x85\xa0\u2028\u3000éÉe\u0301ſİıßΣςǅﬁ日本가\u1100\u1161½²\U0001f600")), max_size=80), st.none()), max_size=8)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_of_any_text_are_the_library_s(texts):
    e = ENCODER
    for got, text in zip(encoded(e, texts), texts, strict=True):
        assert got == e.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(K, "TOGETHER", 50)
    texts = [" ".join(f"word{i}" for i in range(200)), "x" * 300, "", "a b\nc " * 30 + "y" * 80, None, "tail"]
    for got, text in zip(encoded(ENCODER, texts), texts, strict=True):
        assert got == ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_parts_are_held_in_tens_of_bytes():
    e, words = K.Encoder(WORDS, 2), [f"q{i:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(60_000)]
    gc.collect()
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        for _ in e.encode(pa.array([" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)])):
            pass
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert held < 60 * len(words), f"{held / len(words):.0f} bytes a part"


def test_ids_over_generations_of_held_parts(monkeypatch):
    monkeypatch.setattr(K, "HELD", 20)
    monkeypatch.setattr(K, "TOGETHER", 100)
    e = K.Encoder(WORDS, 2)
    texts = [" ".join(f"{'abcdefgh'[j % 8]}{'klmnopqrstuvwxyz'[(i * j) % 16]}ed" for j in range(i % 23)) for i in range(200)] + ["x" * 70 + " x", None, ""]
    for got, text in zip(encoded(e, texts), texts, strict=True):
        assert got == e.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    for parts in (e.held.parts, e.held.old[0]):
        assert len(parts) == len(set(parts.to_pylist())) < 20 + 100 and max(map(len, parts.to_pylist())) <= K.HELD_CHARACTERS


def test_token_files(spark, docs, extra, none, tmp_path):
    want = sorted(plain_tokens(docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, block in ((docs, 1 << 18), (extra, 50)):
        path = str(tmp_path / f"t{block}")
        K.write_token_files(d, path, WORDS, block=block, part=2000)
        got = sorted(map(tuple, K.read_token_files(spark, path).collect()), key=lambda r: r[1])
        assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
        assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(want, key=repr)
        assert [r[0] for r in got] == [r[0] for r in want]
    assert K.round_trip(none, WORDS).count() == 0


def test_damage_is_seen(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    K.write_token_files(docs, path, WORDS)
    bad = spark.read.parquet(f"{path}/blocks").withColumn("payload", F.concat("payload", F.lit(b"\0")))
    bad.write.parquet(f"{path}-bad/blocks")
    for t in ("table", "parts"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{path}-bad/{t}")
    with pytest.raises(Exception, match="damaged"):
        K.read_token_files(spark, f"{path}-bad").collect()


def test_pipeline(spark, data):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"] and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before, kept = docs, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, data).cache()
        assert after.columns == docs.columns
        if name != "mixing":
            assert after.exceptAll(before).count() == 0  # rows as they were
            kept.append(after.count())
        before = after
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    last = P.STAGES[-1][1](spark, before, data).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in last) == sorted(plain_tokens(before.collect()))
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), data).count() == 0, name


def plain_near_duplicates(rows):
    """Ids of the first of each component; sets of five words linked at 4/5."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


@pytest.mark.parametrize("every,block", [(1, 3), (8, 2000)])
def test_near_duplicates_of_the_pipeline(spark, monkeypatch, every, block):
    """Copies with words changed, on both sides of 0.8; chains of copies; a passage in many texts; odd texts."""
    import corpus_pipeline as P
    from terrace.llm import jaccard as J

    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(900)}"
    passage = [f"p{i}" for i in range(30)]
    texts = ["", None, " \n", "one two", "One  two", "one two three", "a a a a a a a a a"]
    for k in range(40):
        base = [word() for _ in range(rng.choice([5, 9, 24, 60, 200]))] + (passage if k % 2 else [])
        for _ in range(rng.choice([1, 3, 12])):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = word()
            if rng.random() < 0.3:
                base += [word() for _ in range(len(base) // 9)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_near_duplicates(rows)
    out = P.drop_near_duplicates(spark, docs, None) if every > 1 else J.deduplicated(docs, every=every)
    assert sorted(r["doc_id"] for r in out.collect()) == want and len(want) < len(rows) - 20


def test_fingerprints_link_near_duplicates_of_the_pipeline(spark, monkeypatch):
    """The search over fingerprints links near copies without the set join, after whole sets have been compared."""
    import corpus_pipeline as P
    from terrace.llm import jaccard as J
    from terrace.llm import simhash as S

    rng = random.Random(8)
    rows, near = [], set()
    for k in range(30):
        base = [f"w{rng.randrange(900)}" for _ in range(300)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:-1], "other"]))]
        own = [S.fingerprint_of(J.shingles(t)) for _, t in rows[-2:]]
        if ((own[0] ^ own[1]) & (2**64 - 1)).bit_count() <= J.DISTANCE:
            near.add(2 * k + 1)
    rows += [(100, "one"), (101, "two"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(J, "shared_shingles", lambda sets, real=J.shared_shingles: real(sets).limit(0))
    monkeypatch.setattr(J, "fingerprint_of", lambda hashes, real=S.fingerprint_of: 5 if len(hashes) < 2 else real(hashes))  # equal ones of other texts
    kept = {r["doc_id"] for r in P.drop_near_duplicates(spark, docs, None).collect()}
    assert len(near) > 20 and kept == {i for i, _ in rows} - near
