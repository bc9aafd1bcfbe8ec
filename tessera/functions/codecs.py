"""Whole numbers, points and shapes as bytes: seven bits a byte, low ones first, signs folded into the lowest bit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

POINTS = ArrayType(StructType([StructField("x", LongType()), StructField("y", LongType())]))


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2, ... as 0, 1, 2, 3, ..."""
    return F.when(v >= 0, v * 2).otherwise(-v * 2 - 1)


def packed(values: Column) -> Column:
    """Binary of an array of whole numbers from 0 up; a negative one raises."""

    def hexed(v: Column) -> Column:
        v = F.when(v >= 0, v).otherwise(F.raise_error(F.format_string("%d is below 0", v)).cast("long"))
        parts = F.filter(F.sequence(F.lit(0), F.lit(8)), lambda i: (i == 0) | (F.expr("0L") < F.call_function("shiftright", v, i * 7)))
        byte = lambda i: F.call_function("shiftright", v, i * 7).bitwiseAND(F.lit(127)) + F.when(i < F.size(parts) - 1, 128).otherwise(0)
        return F.array_join(F.transform(parts, lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")

    return F.unhex(F.array_join(F.transform(values, hexed), ""))


def packed_uints(values: Column) -> Column:
    """A list with its length in front."""
    return packed(F.concat(F.array(F.size(values).cast("long")), values))


def _line(points: Column) -> Column:
    step = lambda p, i, k: p[k] - F.get(points, i - 1)[k]
    later = F.transform(points, lambda p, i: F.when(i == 0, F.array(p["x"], p["y"])).otherwise(F.array(zigzag(step(p, i, "x")), zigzag(step(p, i, "y")))))
    return F.concat(F.array(F.size(points).cast("long")), F.flatten(later))


def packed_shapes(shapes: Column) -> Column:
    """Shapes, each its number of points, the first point and the steps to the others; first points must not be negative."""
    return packed(F.concat(F.array(F.size(shapes).cast("long")), F.flatten(F.transform(shapes, _line))))


def packed_points(points: Column) -> Column:
    return packed_shapes(F.array(points))


def numbers(data: bytes) -> np.ndarray:
    """All numbers of a packed block; ValueError where the last one is cut off."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if len(b) and (not len(ends) or ends[-1] != len(b) - 1):
        raise ValueError("the data ends inside a number")
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1) if len(b) else np.zeros(0, np.int64)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts) if len(starts) else np.zeros(0, np.int64)


def uints_of(data: bytes) -> np.ndarray:
    n = numbers(data)
    if not len(n) or n[0] != len(n) - 1:
        raise ValueError("the length does not fit the data")
    return n[1:]


def shape_arrays(data: bytes) -> list[np.ndarray]:
    """The shapes of a packed block, each as (n, 2) whole numbers."""
    n, at, out = numbers(data), 1, []
    for _ in range(int(n[0]) if len(n) else 0):
        count = int(n[at])
        xy = n[at + 1 : at + 1 + 2 * count].reshape(-1, 2).copy()
        if len(xy) != count:
            raise ValueError("the data ends inside a shape")
        xy[1:] = np.where(xy[1:] % 2 == 0, xy[1:] // 2, -(xy[1:] + 1) // 2)
        out.append(np.cumsum(xy, axis=0))
        at += 1 + 2 * count
    if not len(n) or at != len(n):
        raise ValueError("data is left over")
    return out


def shapes_of(data: bytes) -> list[list[dict[str, int]]]:
    return [[{"x": x, "y": y} for x, y in xy.tolist()] for xy in shape_arrays(data)]


def _lists(parts: list, values: pa.Array, mask: pa.Array | None = None) -> pa.ListArray:
    """The values dealt to lists as long as the parts."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=mask)


def _structs(shapes: list[np.ndarray]) -> pa.StructArray:
    xy = np.vstack([*shapes, np.zeros((0, 2), np.int64)])
    return pa.StructArray.from_arrays([pa.array(xy[:, k], pa.int64()) for k in (0, 1)], ["x", "y"])


# No object is made a number or a point: a batch of long lists stays as large as its numbers.
@arrow_udf(ArrayType(LongType()))
def unpacked_uints(data: pa.Array) -> pa.Array:
    found = [np.zeros(0, np.int64) if d is None else uints_of(d) for d in data.to_pylist()]
    return _lists(found, pa.array(np.concatenate([*found, np.zeros(0, np.int64)]), pa.int64()), data.is_null())


@arrow_udf(ArrayType(POINTS))
def unpacked_shapes(data: pa.Array) -> pa.Array:
    found = [[] if d is None else shape_arrays(d) for d in data.to_pylist()]
    flat = [xy for shapes in found for xy in shapes]
    return _lists(found, _lists(flat, _structs(flat)), data.is_null())


@arrow_udf(POINTS)
def unpacked_points(data: pa.Array) -> pa.Array:
    found = [np.zeros((0, 2), np.int64) if d is None else (shape_arrays(d) or [np.zeros((0, 2), np.int64)])[0] for d in data.to_pylist()]
    return _lists(found, _structs(found), data.is_null())
