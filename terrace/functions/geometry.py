"""The polygon kernel as SQL expressions: all of it stays in the JVM, and Catalyst sees through it.

Each function takes SQL text (a column, or a lambda's variable) and gives SQL text; ``F.expr`` makes a column of it, and
``register`` gives the same expressions names for SQL. A ring is ``array<struct<x double, y double>>``.
Comparisons with zero are exact: tolerances would make classes depend on the scale of the coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BOX, RING


def turned(p: str) -> str:
    """The ring with its first vertex last."""
    return f"concat(slice({p}, 2, greatest(size({p}) - 1, 0)), slice({p}, 1, 1))"


def twice_area(p: str) -> str:
    return f"aggregate(zip_with({p}, {turned(p)}, (a_, b_) -> a_.x * b_.y - b_.x * a_.y), 0D, (s_, v_) -> s_ + v_)"


def area(p: str) -> str:
    return f"abs({twice_area(p)}) / 2"


def box(p: str) -> str:
    xs, ys = f"transform({p}, v_ -> v_.x)", f"transform({p}, v_ -> v_.y)"
    return f"named_struct('x1', array_min({xs}), 'y1', array_min({ys}), 'x2', array_max({xs}), 'y2', array_max({ys}))"


def unclosed(p: str) -> str:
    """Without one closing vertex."""
    return f"if(size({p}) > 0 AND {p}[0] = {p}[size({p}) - 1], slice({p}, 1, size({p}) - 1), {p})"


def distinct_neighbours(p: str) -> str:
    """Without vertices equal to the one before."""
    return f"filter({p}, (v_, i_) -> i_ = 0 OR v_ <> {p}[i_ - 1])"


def without_wrap(p: str) -> str:
    """Without a last vertex equal to the first, where there is more than one."""
    return f"if(size({p}) > 1 AND {p}[0] = {p}[size({p}) - 1], slice({p}, 1, size({p}) - 1), {p})"


def ring_key(p: str) -> str:
    """The least of all rotations in both directions, of a ring without its closing vertex; empty for empty."""
    turns = "transform(sequence(1, size({q})), k_ -> concat(slice({q}, k_, size({q}) - k_ + 1), slice({q}, 1, k_ - 1)))"
    q = unclosed(p)
    return f"if(size({q}) = 0, {q}, array_min(concat({turns.format(q=q)}, {turns.format(q=f'reverse({q})')})))"


def cross(a: str, b: str, c: str) -> str:
    return f"(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"


def on(a: str, b: str, c: str) -> str:
    """c lies on the segment from a to b."""
    return f"({cross(a, b, c)} = 0 AND {c}.x BETWEEN least({a}.x, {b}.x) AND greatest({a}.x, {b}.x) AND {c}.y BETWEEN least({a}.y, {b}.y) AND greatest({a}.y, {b}.y))"


def properly_cross(a: str, b: str, c: str, d: str) -> str:
    return f"({cross(a, b, c)} * {cross(a, b, d)} < 0 AND {cross(c, d, a)} * {cross(c, d, b)} < 0)"


def meet(a: str, b: str, c: str, d: str) -> str:
    """Segments ab and cd cross or touch."""
    return f"({properly_cross(a, b, c, d)} OR {on(a, b, c)} OR {on(a, b, d)} OR {on(c, d, a)} OR {on(c, d, b)})"


def _corner(p: str, i: str) -> str:
    return f"{p}[({i}) % size({p})]"


def crossings(p: str) -> str:
    """(i, j, kind) of edges, counted from 1, that meet without being neighbours, or turn back on the edge before."""
    a, b, c, d = _corner(p, "i_"), _corner(p, "i_ + 1"), _corner(p, "j_"), _corner(p, "j_ + 1")
    apart = f"j_ > i_ + 1 AND NOT (i_ = 0 AND j_ = size({p}) - 1) AND {meet(a, b, c, d)}"
    back = f"j_ = i_ + 1 AND {a} <> {c} AND {on(a, b, d)} AND {d} <> {b}"
    inner = f"transform(filter(sequence(i_ + 1, size({p}) - 1), j_ -> ({apart}) OR ({back})), j_ -> named_struct('i', i_ + 1, 'j', j_ + 1, 'kind', if(j_ = i_ + 1, 'backtrack', 'crossing_or_touch')))"
    return f"if(size({p}) < 2, array(), flatten(transform(sequence(0, size({p}) - 2), i_ -> {inner})))"


def intersects_itself(p: str) -> str:
    """Edges that are not neighbours meet; stops at the first that does."""
    a, b, c, d = _corner(p, "i_"), _corner(p, "i_ + 1"), _corner(p, "j_"), _corner(p, "j_ + 1")
    inner = f"exists(sequence(i_ + 2, size({p}) - 1), j_ -> NOT (i_ = 0 AND j_ = size({p}) - 1) AND {meet(a, b, c, d)})"
    return f"if(size({p}) < 3, false, exists(sequence(0, size({p}) - 3), i_ -> {inner}))"


def finite(p: str) -> str:
    return f"forall({p}, v_ -> NOT isnan(v_.x) AND NOT isnan(v_.y) AND abs(v_.x) < double('inf') AND abs(v_.y) < double('inf'))"


def polygon_error(p: str, w: str, h: str) -> str:
    """The first rule that an exported polygon breaks, or null."""
    b = box(p)
    inside = f"forall({p}, v_ -> v_.x BETWEEN 0 AND {w} AND v_.y BETWEEN 0 AND {h})"
    return (
        f"CASE WHEN size({p}) < 3 THEN 'under three vertices' WHEN NOT {finite(p)} THEN 'coordinate not finite' WHEN NOT {inside} THEN 'point off the image' "
        f"WHEN {area(p)} <= 0 OR {b}.x2 <= {b}.x1 OR {b}.y2 <= {b}.y1 THEN 'no area' END"
    )


def validity_error(p: str, w: str, h: str) -> str:
    """``polygon_error``, then repeated vertices and self-intersection of the ring; null if valid."""
    q = unclosed(p)
    return f"coalesce({polygon_error(p, w, h)}, CASE WHEN size(array_distinct({q})) < size({q}) THEN 'vertex used twice' WHEN {intersects_itself(q)} THEN 'edges cross' END)"


def two_opt(p: str, i: str, j: str) -> str:
    """The ring with vertices i + 1 to j, counted from 1, in reverse: undoes a crossing of edges i and j."""
    return f"concat(slice({p}, 1, {i}), reverse(slice({p}, {i} + 1, {j} - {i})), slice({p}, {j} + 1, greatest(size({p}) - {j}, 0)))"


def clamp(p: str, w: str, h: str) -> str:
    """Points at most a pixel outside go to the edge, if both coordinates are within the margin."""
    return f"transform({p}, v_ -> if(v_.x BETWEEN -1 AND {w} + 1 AND v_.y BETWEEN -1 AND {h} + 1, named_struct('x', least(greatest(v_.x, 0D), double({w})), 'y', least(greatest(v_.y, 0D), double({h}))), v_))"


def scaled(p: str, sx: str, sy: str) -> str:
    return f"transform({p}, v_ -> named_struct('x', v_.x * {sx}, 'y', v_.y * {sy}))"


def from_percent(p: str, w: str, h: str) -> str:
    return f"transform({p}, v_ -> named_struct('x', v_.x * {w} / 100, 'y', v_.y * {h} / 100))"


def center_to_corners(cx: str, cy: str, w: str, h: str) -> str:
    return f"named_struct('x1', {cx} - {w} / 2, 'y1', {cy} - {h} / 2, 'x2', {cx} + {w} / 2, 'y2', {cy} + {h} / 2)"


def corners_to_sides(b: str) -> str:
    """x, y, width, height."""
    return f"array({b}.x1, {b}.y1, {b}.x2 - {b}.x1, {b}.y2 - {b}.y1)"


def crop(b: str, w: str, h: str, margin: int = 20) -> str:
    """The box with a margin, cut at the image."""
    return f"named_struct('x1', greatest(0D, {b}.x1 - {margin}), 'y1', greatest(0D, {b}.y1 - {margin}), 'x2', least(double({w}), {b}.x2 + {margin}), 'y2', least(double({h}), {b}.y2 + {margin}))"


def box_iou(a: str, b: str) -> str:
    inter = f"(greatest(0D, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0D, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    size = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
    return f"try_divide({inter}, {size.format(a)} + {size.format(b)} - {inter})"


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these columns computed here: a generator stands between, so that filters and columns further on read the
    values and the optimiser doesn't put the whole kernel in the place of each reference."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("settled")).select(*rest, "settled.*")


def with_geometry(df: DataFrame, ring: str = "ring") -> DataFrame:
    """``df`` with closing, consecutive, clean, elsewhere, crossings, category and invalid of its ring.

    Columns are added in steps, so that the quadratic test reads the cleaned ring once.
    """
    out = df.withColumn("closing", F.expr(f"size({ring}) > 1 AND {ring}[0] = {ring}[size({ring}) - 1]"))
    out = out.withColumn("is_finite", F.expr(finite(ring))).withColumn("open_ring", F.expr(f"if(closing, slice({ring}, 1, size({ring}) - 1), {ring})"))
    out = out.withColumn("clean", F.expr(distinct_neighbours("open_ring"))).withColumn("clean", F.expr(without_wrap("clean")))
    out = out.withColumn("consecutive", F.expr("if(is_finite, size(open_ring) - size(clean), 0)")).withColumn("elsewhere", F.expr("size(array_distinct(clean)) < size(clean)"))
    out = out.withColumn("crossings", F.expr(f"if(is_finite, {crossings('clean')}, array())"))
    repeated = f"size(array_distinct({ring})) < size({ring})"
    out = out.withColumn("category", F.expr(f"CASE WHEN NOT is_finite THEN 'D' WHEN NOT ({repeated}) THEN '' WHEN elsewhere THEN 'C' WHEN consecutive > 0 THEN 'B' WHEN closing THEN 'A' ELSE 'D' END"))
    invalid = f"NOT is_finite OR size(array_distinct(clean)) < 3 OR {area('clean')} = 0 OR elsewhere OR size(crossings) > 0"
    out = out.withColumn("invalid", F.expr(invalid)).withColumn("closing", F.expr("closing AND is_finite"))
    return out.withColumn("recommended", F.expr("CASE WHEN category = 'A' AND NOT invalid THEN 'CLOSING_VERTEX_ONLY' WHEN consecutive > 0 AND NOT invalid THEN 'SAFE_REMOVE_DUPLICATE_VERTEX' ELSE 'MANUAL_REVIEW' END"))


def with_safe_removal(df: DataFrame, ring: str = "ring") -> DataFrame:
    """``df`` with kept, removed (places from 0) and refused: exact consecutive duplicates go if a valid ring is left."""
    out = df.withColumn("kept", F.expr(distinct_neighbours(ring)))
    out = out.withColumn("removed", F.expr(f"filter(sequence(0, greatest(size({ring}) - 1, 0)), i_ -> i_ > 0 AND {ring}[i_] = {ring}[i_ - 1])"))
    names = out.columns
    tested = with_geometry(out.withColumn("kept_ring", F.col("kept")), "kept_ring")
    return tested.withColumn("refused", F.expr("size(removed) > 0 AND invalid")).select(*names, "refused")


def with_uncross(df: DataFrame, ring: str = "ring") -> DataFrame:
    """``df`` with fixed: the ring with its only proper crossing undone, where that gives a simple polygon; else null."""
    names = df.columns
    out = with_geometry(df, ring).withColumn("one", F.expr("if(size(crossings) = 1, crossings[0], null)"))
    a, b, c, d = (_corner(ring, f"coalesce(one.{e}, 1) - 1 + {k}") for e in ("i", "j") for k in (0, 1))
    out = out.withColumn("fixed", F.expr(f"if(one IS NOT NULL AND {properly_cross(a, b, c, d)}, {two_opt(ring, 'one.i', 'one.j')}, null)"))
    out = out.select(*names, "fixed", F.size("crossings").alias("n_crossings"))
    tested = with_geometry(out, "fixed")
    return tested.withColumn("fixed", F.expr("if(fixed IS NOT NULL AND NOT invalid AND category = '', fixed, null)")).select(*names, "n_crossings", "fixed")


#: Names under which the kernel is known to SQL: parameters, type, body.
FUNCTIONS = {
    "ring_area": (f"p {RING}", "double", area("p")),
    "ring_box": (f"p {RING}", BOX, box("p")),
    "ring_key": (f"p {RING}", RING, ring_key("p")),
    "ring_polygon_error": (f"p {RING}, w int, h int", "string", polygon_error("p", "w", "h")),
    "ring_validity_error": (f"p {RING}, w int, h int", "string", validity_error("p", "w", "h")),
    "ring_clamp": (f"p {RING}, w int, h int", RING, clamp("p", "w", "h")),
    "ring_from_percent": (f"p {RING}, w int, h int", RING, from_percent("p", "w", "h")),
    "box_iou": (f"a {BOX}, b {BOX}", "double", box_iou("a", "b")),
}


def register(spark: SparkSession) -> list[str]:
    """Give the kernel names in SQL; returns them."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters.replace('struct<', 'STRUCT<')}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
