"""The few functions that SQL expressions can't give bit for bit: binary rounding and run-length masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _round8(values: pa.Array) -> pa.Array:
    """Rounds the exact binary value to 8 decimals, half to even, as decimal text of the value would not."""
    return pa.array([None if v is None else round(v, 8) for v in values.to_pylist()], pa.float64())


def round8(x: Column) -> Column:
    return F.arrow_udf(_round8, "double")(x)


def _round8_all(values: pa.Array) -> pa.Array:
    flat = _round8(values.flatten())
    ends = np.concatenate(([0], np.cumsum(np.nan_to_num(values.value_lengths().to_numpy(zero_copy_only=False)))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat, mask=values.is_null())


def round8_all(xs: Column) -> Column:
    """``round8`` of each of an array's values."""
    return F.arrow_udf(_round8_all, "array<double>")(xs)


def rle_counts(mask: np.ndarray) -> list[int]:
    """Lengths of runs of 0 and 1 in turn, 0 first, down the columns."""
    flat = np.asarray(mask, np.uint8).ravel(order="F")
    cuts = np.flatnonzero(np.diff(flat)) + 1
    counts = np.diff(np.concatenate(([0], cuts, [len(flat)])))
    return ([0] if len(flat) and flat[0] else []) + counts.tolist()


def rle_mask(counts: list[int], height: int, width: int) -> np.ndarray:
    values = np.arange(len(counts)) % 2
    return np.repeat(values, counts).astype(np.uint8).reshape((height, width), order="F")


def rle_iou(a: list[int], b: list[int]) -> float | None:
    """Of two masks of one size, without unpacking them."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    ends = np.union1d(ends_a, ends_b)
    sizes = np.diff(np.concatenate(([0], ends)))
    in_a = np.searchsorted(ends_a, ends, "left") % 2 == 1
    in_b = np.searchsorted(ends_b, ends, "left") % 2 == 1
    union = int(sizes[in_a | in_b].sum())
    return int(sizes[in_a & in_b].sum()) / union if union else None


def _iou(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else rle_iou(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def mask_iou(a: Column, b: Column) -> Column:
    """Of two columns of run lengths."""
    return F.arrow_udf(_iou, "double")(a, b)


def _box_runs(size: pa.Array, box: pa.Array) -> pa.Array:
    out = []
    for s, b in zip(size.to_pylist(), box.to_pylist(), strict=True):
        if s is None or b is None:
            out.append(None)
            continue
        mask = np.zeros((s[0], s[1]), np.uint8)
        mask[max(0, int(b[1])) : max(0, int(b[3])), max(0, int(b[0])) : max(0, int(b[2]))] = 1
        out.append(rle_counts(mask))
    return pa.array(out, pa.list_(pa.int64()))


def box_mask(size: Column, box: Column) -> Column:
    """Run lengths of the mask that a box [x1, y1, x2, y2] fills in an image of [height, width]."""
    return F.arrow_udf(_box_runs, "array<bigint>")(size, box)
