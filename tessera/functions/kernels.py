"""Sequential geometry on one feature at a time, as small Arrow-batched functions: simplify, clip, label point, stitch.

Points are (n, 2) arrays of doubles. Each step looks at the result of the one before, which column expressions can't.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

POINTS = "array<struct<x:double,y:double>>"


def simplify(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that Douglas-Peucker keeps, ascending; the first of the farthest points is split at. No recursion."""
    if len(pts) < 3:
        return np.arange(len(pts))
    keep, todo = {0, len(pts) - 1}, [(0, len(pts) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = _off(pts[a + 1 : b], pts[a], pts[b])
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.array(sorted(keep))


def _off(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of points from the stretch a-b."""
    v = b - a
    n = float(v @ v)
    t = np.clip((p - a) @ v / n, 0, 1) if n else np.zeros(len(p))
    return np.hypot(*(p - a - t[:, None] * v).T)


def simplify_ring(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept of an open ring: it is split at the point farthest from the first, and each half simplified."""
    if len(pts) < 4:
        return np.arange(len(pts))
    far = int(np.argmax(np.hypot(*(pts - pts[0]).T)))
    one = simplify(pts[: far + 1], tolerance)
    two = far + simplify(np.vstack([pts[far:], pts[:1]]), tolerance)
    return np.array(sorted({*one.tolist(), *two.tolist()} - {len(pts)}))


def levels(pts: np.ndarray, tolerances: list[float]) -> np.ndarray:
    """For each point the first level (of falling tolerances) that shows it; levels nest by construction."""
    out, kept = np.full(len(pts), len(tolerances)), np.arange(len(pts))
    for level in range(len(tolerances) - 1, -1, -1):
        kept = kept[simplify(pts[kept], tolerances[level])]
        out[kept] = level
    return out


def clip_ring(pts: np.ndarray, width: float, height: float) -> np.ndarray:
    """An open ring cut to [0, width] x [0, height], side by side; cut points are rounded half up to whole units."""
    for axis, limit, sign in ((0, 0.0, 1), (0, width, -1), (1, 0.0, 1), (1, height, -1)):
        out = []
        for a, b in zip(pts, np.roll(pts, -1, axis=0)):
            ina, inb = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                cut = np.floor(a + (limit - a[axis]) / (b[axis] - a[axis]) * (b - a) + 0.5)
                cut[axis] = limit
                out.append(cut)
        pts = np.array(out).reshape(-1, 2)
    return pts


def inside(p: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd rule for many points."""
    odd = np.zeros(len(p), bool)
    for r in rings:
        a, b = r, np.roll(r, -1, axis=0)
        up = (a[None, :, 1] > p[:, 1, None]) != (b[None, :, 1] > p[:, 1, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[None, :, 0] + (p[:, 1, None] - a[None, :, 1]) * (b[:, 0] - a[:, 0])[None] / (b[:, 1] - a[:, 1])[None]
        odd ^= (up & (p[:, 0, None] < x)).sum(axis=1) % 2 == 1
    return odd


def label_point(rings: list[np.ndarray], rounds: int = 3, side: int = 17) -> np.ndarray | None:
    """The inner point farthest from all edges, by a grid search that is refined around the best; null if no point is inside."""
    pts = np.vstack(rings)
    low, high, best = pts.min(axis=0), pts.max(axis=0), None
    for _ in range(rounds):
        grid = np.stack(np.meshgrid(*[np.linspace(l, h, side + 2)[1:-1] for l, h in zip(low, high)]), axis=-1).reshape(-1, 2)
        grid = grid[inside(grid, rings)]
        if not len(grid):
            break
        d = np.full(len(grid), np.inf)
        for r in rings:
            for a, b in zip(r, np.roll(r, -1, axis=0)):
                d = np.minimum(d, _off(grid, a, b))
        if d.max() <= 1e-9 * float(np.abs(high - low).max()):
            break  # a ring without area has points on it, but none inside
        best, reach = grid[int(np.argmax(d))], (high - low) / (side + 1)
        low, high = best - reach, best + reach
    return best


def stitch(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Lines joined end to end, from the longest on: its end is extended, then its beginning, each line used once."""
    length = lambda l: float(np.hypot(*np.diff(l, axis=0).T).sum())
    left = sorted(range(len(lines)), key=lambda i: (-length(lines[i]), i))
    out = []
    while left:
        line = lines[left.pop(0)]
        for end in (-1, 0):
            while True:
                found = next((i for i in left if (lines[i][0] == line[end]).all() or (lines[i][-1] == line[end]).all()), None)
                if found is None:
                    break
                left.remove(found)
                more = lines[found] if (lines[found][0] == line[end]).all() else lines[found][::-1]
                line = np.vstack([line, more[1:]]) if end else np.vstack([more[:0:-1], line])
        out.append(line)
    return out


def _points(values: pa.StructArray) -> np.ndarray:
    """Points of a batch as (n, 2) doubles, nulls as NaN: no object a point."""
    x, y = values.flatten()
    return np.column_stack([v.to_numpy(zero_copy_only=False).astype(float) for v in (x, y)]).reshape(-1, 2)


def _bounds(lists: pa.ListArray) -> list[tuple[int, int] | None]:
    """Where the values of each list lie in lists.values; None for a null list."""
    ends, there = lists.offsets.to_numpy().tolist(), lists.is_valid().to_pylist()
    return [(a, b) if ok else None for a, b, ok in zip(ends, ends[1:], there)]


def simplified(line: Column, tolerance: float, ring: bool = False) -> Column:
    """A line, or open ring, without the points that stray less than the tolerance."""

    @arrow_udf(POINTS)
    def apply(s: pa.Array) -> pa.Array:
        pick, pts = simplify_ring if ring else simplify, _points(s.values)
        kept = [np.zeros(0, np.int64) if at is None else at[0] + pick(pts[at[0] : at[1]], tolerance) for at in _bounds(s)]
        ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), s.values.take(pa.array(np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int64))), mask=s.is_null())

    return apply(line)


def clipped(ring: Column, width: float, height: float) -> Column:
    @arrow_udf(POINTS)
    def apply(s: pa.Array) -> pa.Array:
        pts = _points(s.values)
        cut = [np.zeros((0, 2)) if at is None else clip_ring(pts[at[0] : at[1]], width, height) for at in _bounds(s)]
        ends, xy = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32), np.vstack([*cut, np.zeros((0, 2))])
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(xy[:, k]) for k in (0, 1)], ["x", "y"]), mask=s.is_null())

    return apply(ring)


def labelled_at(rings: Column) -> Column:
    """Struct (x, y) of the label point; nulls inside if there is none."""

    @arrow_udf("x double, y double")
    def apply(s: pa.Array) -> pa.Array:
        pts, inner = _points(s.values.values), _bounds(s.values)
        shapes = [None if at is None else [pts[k[0] : k[1]] for k in inner[at[0] : at[1]]] for at in _bounds(s)]
        found = [label_point(r) if r else None for r in shapes]
        return pa.StructArray.from_arrays([pa.array([None if p is None else float(p[k]) for p in found], pa.float64()) for k in (0, 1)], ["x", "y"])

    return apply(rings)
