"""The polygon kernel against plain loops, and what must hold for any ring."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrace.functions import arrow as A
from terrace.functions import geometry as G
from terrace.schema import RING

SQUARE = [(1, 1), (12, 1), (12, 12), (1, 12)]
BOW = [(1, 1), (12, 12), (1, 12), (12, 1)]


def table(spark, rings):
    rows = [(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, f"i int, ring {RING}")


def meets(a, b, c, d):
    def cross(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def on(p, q, r):
        return cross(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    proper = cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0
    return proper or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b)


def test_crossings_equal_a_plain_loop(spark):
    rng = random.Random(7)
    rings = [[(rng.randint(0, 5), rng.randint(0, 5)) for _ in range(rng.randint(0, 8))] for _ in range(400)]
    got = {r["i"]: r["c"] for r in table(spark, rings).select("i", F.expr(G.intersects_itself("ring")).alias("c")).collect()}
    for i, p in enumerate(rings):
        n, want = len(p), False
        for j in range(n):
            for k in range(j + 2, n):
                if not (j == 0 and k == n - 1):
                    want |= meets(p[j], p[(j + 1) % n], p[k], p[(k + 1) % n])
        assert got[i] == want, p


def test_ring_key_is_free_of_start_and_direction(spark):
    rng = random.Random(3)
    rings = []
    for _ in range(60):
        p = [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(rng.randint(1, 6))]
        k = rng.randrange(len(p))
        rings += [p, (p[k:] + p[:k])[::-1]]
    rows = table(spark, rings).select("i", F.expr(G.ring_key("ring")).alias("k")).orderBy("i").collect()
    for i, p in enumerate(rings):
        q = p[:-1] if p[0] == p[-1] else p
        want = min([q[j:] + q[:j] for j in range(len(q))] + [q[::-1][j:] + q[::-1][:j] for j in range(len(q))]) if q else []
        assert [(v["x"], v["y"]) for v in rows[i]["k"]] == want


@pytest.mark.parametrize(
    "ring,error",
    [
        (SQUARE, None), ([], "under three vertices"), (SQUARE[:2], "under three vertices"), ([(1, 1), (math.nan, 2), (3, 3)], "coordinate not finite"), ([(1, 1), (math.inf, 2), (3, 3)], "coordinate not finite"),
        ([(1, 1), (17, 1), (3, 3)], "point off the image"), ([(1, 1), (2, 2), (3, 3)], "no area"), (BOW, "no area"),
        ([(1, 1), (12, 1), (12, 12), (1, 1), (1, 12)], "vertex used twice"), ([(1, 1), (12, 12), (12, 1), (1, 9)], "edges cross"),
    ],
)
def test_validity(spark, ring, error):
    assert table(spark, [ring]).select(F.expr(G.validity_error("ring", "16", "16"))).first()[0] == error


@pytest.mark.parametrize(
    "ring,category,invalid,consecutive",
    [
        (SQUARE, "", False, 0), ([*SQUARE, SQUARE[0]], "A", False, 0), ([SQUARE[0], *SQUARE], "B", False, 1), ([(1, 1), (12, 1), (12, 12), (1, 1), (1, 12)], "C", True, 0),
        (BOW, "", True, 0), ([(1, 1), (9, 1), (5, 1), (5, 8)], "", True, 0), ([(1, 1), (math.nan, 1), (5, 8)], "D", True, 0),
    ],
)
def test_classes(spark, ring, category, invalid, consecutive):
    r = G.with_geometry(table(spark, [ring])).first()
    assert (r["category"], r["invalid"], r["consecutive"]) == (category, invalid, consecutive)


def test_backtrack_is_named(spark):
    r = G.with_geometry(table(spark, [[(1, 1), (9, 1), (5, 1), (5, 8)]])).first()
    assert "backtrack" in [c["kind"] for c in r["crossings"]]


def test_safe_removal_and_uncross(spark):
    r = G.with_safe_removal(table(spark, [[SQUARE[0], SQUARE[0], *SQUARE[1:]], [BOW[0], BOW[0], *BOW[1:]]])).orderBy("i").collect()
    assert r[0]["removed"] == [1] and not r[0]["refused"] and len(r[0]["kept"]) == 4
    assert r[1]["refused"]
    u = G.with_uncross(table(spark, [BOW, SQUARE])).orderBy("i").collect()
    assert [tuple(p) for p in u[0]["fixed"]] == [(1, 1), (1, 12), (12, 12), (12, 1)] and u[1]["fixed"] is None


def test_names_in_sql(spark):
    assert G.register(spark) == sorted(G.FUNCTIONS)
    table(spark, [SQUARE]).createOrReplaceTempView("r")
    row = spark.sql("SELECT ring_area(ring) a, ring_box(ring).x2 x, ring_validity_error(ring, 16, 16) e, size(ring_key(ring)) n, box_iou(ring_box(ring), ring_box(ring)) i FROM r").first()
    assert (row["a"], row["x"], row["e"], row["n"], row["i"]) == (121.0, 12.0, None, 4, 1.0)


def test_round8_is_that_of_binary_values(spark):
    rng = random.Random(5)
    xs = [rng.randint(0, 1024_000) / 1000 / 1024 for _ in range(2000)] + [0.5 / 1e8, 1.5 / 1e8, -2.5e-8]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", A.round8(F.col("x")).alias("r"))
    assert [r["r"] for r in df.orderBy("i").collect()] == [round(x, 8) for x in xs]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.randoms(use_true_random=False))
def test_run_lengths(h, w, rng):
    a = np.array([[rng.randint(0, 1) for _ in range(w)] for _ in range(h)])
    b = np.array([[rng.randint(0, 1) for _ in range(w)] for _ in range(h)])
    ca, cb = A.rle_counts(a), A.rle_counts(b)
    assert (A.rle_mask(ca, h, w) == a).all()
    union = (a | b).sum()
    assert A.rle_iou(ca, cb) == (pytest.approx((a & b).sum() / union) if union else None)


def test_mask_columns(spark):
    df = spark.createDataFrame([([8, 8], [1.0, 1.0, 5.0, 5.0], [3.0, 3.0, 7.0, 7.0]), ([8, 8], None, [0.0, 0.0, 1.0, 1.0])], "s array<int>, a array<double>, b array<double>")
    got = [r[0] for r in df.select(A.mask_iou(A.box_mask(F.col("s"), F.col("a")), A.box_mask(F.col("s"), F.col("b")))).collect()]
    assert got[0] == pytest.approx(4 / 28) and got[1] is None
