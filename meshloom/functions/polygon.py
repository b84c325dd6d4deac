"""Polygons in small Arrow-backed functions: interior points and intersection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Ring = np.ndarray


def rings(parts) -> list[Ring]:
    """Arrays of vertices of each part."""
    return [np.array([(p["x"], p["y"]) for p in part], float) for part in (() if parts is None else parts) if len(part) > 2]


def crossings(ring: Ring, y: float) -> np.ndarray:
    """Where a horizontal line crosses a ring."""
    a, b = ring, np.roll(ring, -1, axis=0)
    hit = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[hit], b[hit]
    return a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])


def contains(shape: list[Ring], x: float, y: float) -> bool:
    """Whether a point is inside, by the even-odd rule over all rings."""
    return sum(int((crossings(r, y) > x).sum()) for r in shape) % 2 == 1


def interior_point(shape: list[Ring]) -> tuple[float, float] | None:
    """A point inside: the middle of the widest stretch, on a line half-way up between the vertices around the middle."""
    if not shape:
        return None
    ys = np.unique(np.concatenate([r[:, 1] for r in shape]))
    if len(ys) < 2:
        return None
    middle = (ys[0] + ys[-1]) / 2
    k = min(max(int(np.searchsorted(ys, middle)), 1), len(ys) - 1)
    y = (ys[k - 1] + ys[k]) / 2
    x = np.sort(np.concatenate([crossings(r, y) for r in shape]))
    widths = x[1::2] - x[: len(x) // 2 * 2 : 2]
    if not len(widths):
        return None
    at = int(widths.argmax())
    return float((x[2 * at] + x[2 * at + 1]) / 2), float(y)


def _cross(a: Ring, b: Ring) -> bool:
    """Whether an edge of one ring crosses an edge of the other."""
    p, r = a, np.roll(a, -1, axis=0) - a
    q, s = b, np.roll(b, -1, axis=0) - b
    d = r[:, None, 0] * s[None, :, 1] - r[:, None, 1] * s[None, :, 0]
    w = q[None, :, :] - p[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[..., 0] * s[None, :, 1] - w[..., 1] * s[None, :, 0]) / d
        u = (w[..., 0] * r[:, None, 1] - w[..., 1] * r[:, None, 0]) / d
    return bool(((d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any())


def intersects(a: list[Ring], b: list[Ring]) -> bool:
    """Whether two shapes share a point: edges that cross, or a vertex of one inside the other."""
    if not a or not b:
        return False
    p, q = np.concatenate(a), np.concatenate(b)
    if (p.max(axis=0) < q.min(axis=0)).any() or (q.max(axis=0) < p.min(axis=0)).any():
        return False
    return contains(b, *a[0][0]) or contains(a, *b[0][0]) or any(_cross(x, y) for x in a for y in b)


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def representative_point(parts: pd.Series) -> pd.DataFrame:
    """A point inside of each polygon; null coordinates for an empty one."""
    found = [interior_point(rings(p)) or (None, None) for p in parts]
    return pd.DataFrame(found, columns=["x", "y"], dtype=float)


@F.pandas_udf(T.BooleanType())
def polygons_intersect(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two polygons share a point."""
    return pd.Series([intersects(rings(x), rings(y)) for x, y in zip(a, b)], dtype=bool)
