"""Choices in order of rank that exclude each other: nested shapes, and labels placed where no larger one is.

Both are greedy by rank, and both are found in rounds for all rows at once instead of one row after the other: a row is decided as soon as
nothing before it that could exclude it is open. The outcome is that of the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bounding_box, close_ring, point_in_rings, steps
from .lineage import release, written
from .spatial import box_join, buckets_of_box


def greedy_kept(items: DataFrame, beats: DataFrame, id_col: str) -> DataFrame:
    """(id, kept): an item is kept unless one that is kept beats it; beats(a, b) has no cycles, as it follows an order.

    Rounds follow the longest series of items each of which hangs on the one before.
    """
    open_ = written(items.select(F.col(id_col).alias("_id")).distinct(), "open")
    live = written(beats.select("a", "b").distinct(), "beats")
    done: list[DataFrame] = []
    while open_.limit(1).count():
        now = written(open_.join(live.select(F.col("b").alias("_id")).distinct(), "_id", "left_anti"), "kept")
        if not now.limit(1).count():
            raise ValueError("the items beat each other in a circle")
        gone = written(live.join(now.select(F.col("_id").alias("a")), "a", "left_semi").select(F.col("b").alias("_id")).distinct(), "dropped")
        done += [now.select(F.col("_id").alias(id_col), F.lit(True).alias("kept")), gone.select(F.col("_id").alias(id_col), F.lit(False).alias("kept"))]
        open_ = written(open_.join(now, "_id", "left_anti").join(gone, "_id", "left_anti"), "open", after=open_)
        # What is dropped beats nothing any more, and what is decided needs no beating.
        left = live.join(gone.select(F.col("_id").alias("a")), "a", "left_anti").join(gone.select(F.col("_id").alias("b")), "b", "left_anti")
        live = written(left, "beats", after=live)
    release(open_, live)
    if not done:
        return items.select(id_col, F.lit(True).alias("kept")).limit(0)
    return reduce(DataFrame.unionByName, done)


def inside_points(rings: Column, box: Column, n: int = 8) -> Column:
    """Array of the centres of an n x n split of the box that lie inside the rings."""
    at = lambda low, high, k: low + (high - low) * (k + 0.5) / n
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    grid = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct(at(box["xmin"], box["xmax"], i).alias("x"), at(box["ymin"], box["ymax"], j).alias("y")))))
    return F.filter(grid, lambda p: point_in_rings(p["x"], p["y"], rings))


def nested(shapes: DataFrame, id_col: str, rings: str, size: str, bucket: float, share: float = 0.9, margin: float = 1.0, n: int = 8) -> DataFrame:
    """(inner, outer): shapes whose box lies in that of a larger one, but for a margin, with at least `share` of their inner points in its rings.

    Of equal sizes the smaller id counts as the larger shape. Shapes without a ring or an inner point are in none. Candidates meet by the
    middle of the inner box in bucketed boxes.
    """
    boxes = F.transform(rings, bounding_box)
    widest = F.aggregate(boxes, F.get(boxes, F.lit(0)), lambda a, b: F.struct(
        F.least(a["xmin"], b["xmin"]).alias("xmin"), F.least(a["ymin"], b["ymin"]).alias("ymin"), F.greatest(a["xmax"], b["xmax"]).alias("xmax"), F.greatest(a["ymax"], b["ymax"]).alias("ymax")))
    s = shapes.where(F.size(rings) > 0).select(F.col(id_col).alias("id"), F.col(rings).alias("rings"), F.col(size).alias("size"), widest.alias("box"))
    s = written(s.withColumn("points", inside_points(F.col("rings"), F.col("box"), n)), "shapes")
    middle = s.select(F.col("id").alias("inner"), *[((F.col(f"box.{v}min") + F.col(f"box.{v}max")) / 2).alias(f"{v}{e}") for e in ("min", "max") for v in "xy"])
    wide = s.select(F.col("id").alias("outer"), *[(F.col(f"box.{v}{e}") + (margin if e == "max" else -margin)).alias(f"{v}{e}") for e in ("min", "max") for v in "xy"])
    met = box_join(middle, wide, bucket, "inner", "outer")
    a, b = (s.select(F.col("id").alias(k), F.struct(*cols).alias(f"_{k}")) for k, cols in (("inner", ("size", "box", "points")), ("outer", ("size", "box", "rings"))))
    both = met.join(a, "inner").join(b, "outer")
    p, q = F.col("_inner"), F.col("_outer")
    later = (p["size"] < q["size"]) | ((p["size"] == q["size"]) & (F.col("inner") > F.col("outer")))
    held = F.size(F.filter("_inner.points", lambda x: point_in_rings(x["x"], x["y"], F.col("_outer.rings"))))
    fits = (F.size("_inner.points") > 0) & (held >= F.lit(share) * F.size("_inner.points") - 1e-9)
    box = [(F.col(f"_inner.box.{v}min") >= F.col(f"_outer.box.{v}min") - margin) & (F.col(f"_inner.box.{v}max") <= F.col(f"_outer.box.{v}max") + margin) for v in "xy"]
    return both.where(later & box[0] & box[1]).where(fits).select("inner", "outer")


def _first_held(inner: pa.Table, outer: pa.Table, share: float, margin: float) -> pa.Table:
    """(inner, outer): the first of the outer shapes, from the largest on, that holds each inner one, if any does."""
    inner, outer = inner.combine_chunks(), outer.sort_by([("size", "descending"), ("id", "ascending")]).combine_chunks()
    box, wide = ([t[k].to_numpy() for k in ("xmin", "ymin", "xmax", "ymax")] for t in (inner, outer))

    def flat(column):
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        ends = lists.offsets.to_numpy()
        return ends, [v.to_numpy(zero_copy_only=False) for v in lists.values.flatten()]

    if not len(inner) or not len(outer):
        return pa.table({"inner": inner["id"].slice(0, 0), "outer": outer["id"].slice(0, 0)})
    (ends, (px, py)), (edge, (ax, ay, bx, by)) = flat(inner["points"]), flat(outer["edges"])
    open_, found = np.flatnonzero(np.diff(ends) > 0), np.full(len(inner), -1)
    for k in range(len(outer)):
        low = [w[k] - margin for w in wide[:2]]
        high = [w[k] + margin for w in wide[2:]]
        fits = open_[(box[0][open_] >= low[0]) & (box[1][open_] >= low[1]) & (box[2][open_] <= high[0]) & (box[3][open_] <= high[1])]
        if not len(fits):
            continue
        n = ends[fits + 1] - ends[fits]
        at = np.repeat(ends[fits] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        x, y, odd = px[at], py[at], np.zeros(len(at), bool)
        for e in range(edge[k], edge[k + 1]):
            if ay[e] != by[e]:
                odd ^= ((ay[e] > y) != (by[e] > y)) & (x < (bx[e] - ax[e]) * (y - ay[e]) / (by[e] - ay[e]) + ax[e])
        inside = np.bincount(np.repeat(np.arange(len(fits)), n), odd, len(fits))
        held = fits[inside >= share * n - 1e-9]
        found[held] = k
        open_ = np.setdiff1d(open_, held, assume_unique=True)
    got = np.flatnonzero(found >= 0)
    return pa.table({"inner": inner["id"].take(pa.array(got)), "outer": outer["id"].take(pa.array(found[got]))})


def without_nested(
    shapes: DataFrame, id_col: str, rings: str, size: str, bucket: float, share: float = 0.9, margin: float = 1.0, n: int = 8, first: int = 2000,
) -> DataFrame:
    """(id, kept, outer): from the largest on, a shape is left out if it lies in one that is kept; outer is the largest such (null if kept).

    Shapes are taken by size in batches of growing number, about `first` in the first one. Those that lie in a shape kept before are left out at once: they meet the
    kept ones by buckets, largest first, and stop at the first that holds them. Pairs are only formed among the others of a batch.
    """
    there = shapes.where((F.size(rings) > 0) & F.col(size).isNotNull() & F.col(id_col).isNotNull())
    corner = {k: F.flatten(rings)[k] for k in "xy"}
    edges = F.transform(F.flatten(F.transform(rings, lambda r: steps(close_ring(r)))), lambda e: F.struct(e["a"]["x"].alias("ax"), e["a"]["y"].alias("ay"), e["b"]["x"].alias("bx"), e["b"]["y"].alias("by")))
    box = [f(corner[k]).alias(f"{k}{m}") for f, m in ((F.array_min, "min"), (F.array_max, "max")) for k in "xy"]
    s = there.select(F.col(id_col).alias("id"), F.col(rings).alias("rings"), F.col(size).alias("size"), edges.alias("edges"), *box)
    s = written(s.withColumn("points", inside_points(F.col("rings"), F.struct("xmin", "ymin", "xmax", "ymax"), n)), "shapes")
    total = s.count()
    parts = [first * 2**k / total for k in range(64) if first * 2**k < total] if total else []
    cuts = sorted(set(s.agg(F.percentile_approx("size", [1 - p for p in parts], 10_000)).first()[0] or []), reverse=True) if parts else []
    held = f"inner {dict(s.dtypes)['id']}, outer {dict(s.dtypes)['id']}"
    by = [F.floor(((F.col(f"{k}min") + F.col(f"{k}max")) / 2) / bucket).alias(f"_b{k}") for k in "xy"]
    flat = s.select("id", "size", "xmin", "ymin", "xmax", "ymax", "points", *by)
    touched = F.explode(buckets_of_box(F.col("xmin") - margin, F.col("ymin") - margin, F.col("xmax") + margin, F.col("ymax") + margin, bucket)).alias("_b")
    dealt = written(s.select("id", "size", "xmin", "ymin", "xmax", "ymax", "edges", touched).select("*", F.col("_b.bx").alias("_bx"), F.col("_b.by").alias("_by")).drop("_b"), "dealt")
    done: list[DataFrame] = []
    for low, high in zip([*cuts, None], [None, *cuts]):
        some = [F.lit(True) if low is None else F.col("size") >= F.lit(low), F.lit(True) if high is None else F.col("size") < F.lit(high)]
        batch, out = s.where(some[0] & some[1]), None
        if done:
            kept = reduce(DataFrame.unionByName, done).where("kept").select(F.col(id_col).alias("id"))
            inner, outer = flat.where(some[0] & some[1]).groupBy("_bx", "_by"), dealt.join(kept, "id", "left_semi").groupBy("_bx", "_by")
            out = written(inner.cogroup(outer).applyInArrow(lambda a, b: _first_held(a, b, share, margin), held), "held")
            done.append(out.select(F.col("inner").alias(id_col), F.lit(False).alias("kept"), "outer"))
            batch = batch.join(out.select(F.col("inner").alias("id")), "id", "left_anti")
        rest = _without_nested_at_once(written(batch.select(F.col("id").alias(id_col), "rings", "size"), "batch"), id_col, "rings", "size", bucket, share=share, margin=margin, n=n)
        done.append(written(rest, "kept"))
    found = reduce(DataFrame.unionByName, done)
    # Shapes that can neither hold nor lie in one.
    return found.unionByName(shapes.select(id_col).distinct().join(found.select(id_col), id_col, "left_anti").select(id_col, F.lit(True).alias("kept"), F.lit(None).cast(dict(s.dtypes)["id"]).alias("outer")))


def _without_nested_at_once(shapes: DataFrame, id_col: str, rings: str, size: str, bucket: float, **options) -> DataFrame:
    """without_nested() of few shapes, by all their pairs."""
    pairs = written(nested(shapes, id_col, rings, size, bucket, **options), "nested")
    found = written(greedy_kept(shapes, pairs.select(F.col("outer").alias("a"), F.col("inner").alias("b")), id_col), "kept")
    by = pairs.join(found.where("kept").select(F.col(id_col).alias("outer")), "outer").join(shapes.select(F.col(id_col).alias("outer"), F.col(size).alias("_size")), "outer")
    first = by.groupBy(F.col("inner").alias(id_col)).agg(F.min_by("outer", F.struct((-F.col("_size")).alias("s"), "outer")).alias("outer"))
    return found.join(first, id_col, "left").select(id_col, "kept", "outer")


def label_discs(x: Column, y: Column, angle: Column, width: Column, size: Column) -> Column:
    """Array of discs (x, y, r) in a row along a label's baseline, from one end to the other."""
    n = F.greatest(F.lit(1), F.ceil(width / (size * 0.9)))
    along = lambda k: -width / 2 + width * k / n
    return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: F.struct(
        (x + along(k) * F.cos(angle)).alias("x"), (y + along(k) * F.sin(angle)).alias("y"), (size * 0.62 + 2).alias("r")))


def clear_of(discs: Column, keep_out: Sequence[tuple[float, float, float, float]], screen: tuple[float, float, float, float] | None) -> Column:
    """Whether no disc touches an area (left, top, right, bottom) to keep out of, and all lie wholly on the screen or wholly off it."""
    touches = lambda d, a: (d["x"] + d["r"] > a[0]) & (d["x"] - d["r"] < a[2]) & (d["y"] + d["r"] > a[1]) & (d["y"] - d["r"] < a[3])
    ok = F.lit(True)
    if keep_out:
        ok = ~F.exists(discs, lambda d: reduce(lambda a, b: a | b, [touches(d, area) for area in keep_out]))
    if screen is not None:
        inside = lambda d: (d["x"] - d["r"] >= screen[0]) & (d["x"] + d["r"] <= screen[2]) & (d["y"] - d["r"] >= screen[1]) & (d["y"] + d["r"] <= screen[3])
        off = lambda d: (d["x"] + d["r"] <= screen[0]) | (d["x"] - d["r"] >= screen[2]) | (d["y"] + d["r"] <= screen[1]) | (d["y"] - d["r"] >= screen[3])
        ok &= F.forall(discs, inside) | F.forall(discs, off)
    return ok


def placed(labels: DataFrame, frame: str, id_col: str, order: Sequence[Column], discs: str, bucket: float, most: int | None = None) -> DataFrame:
    """(frame, id): labels in order, each kept if none of its discs overlaps a disc of one kept before in its frame; of these the first `most`.

    In each round the first open label of every bucket that its discs touch is kept, if it is that in all of them, and open labels
    that it overlaps are dropped. Kept labels are apart, so a bucket holds few of them: no pairs of labels are formed.
    Labels without discs, or with a null place, are left out. `order` must tell any two labels of a frame apart.
    """
    w = lambda c: F.floor(c / bucket)
    touched = F.array_distinct(F.flatten(F.transform(discs, lambda d: F.flatten(F.transform(F.sequence(w(d["x"] - d["r"]), w(d["x"] + d["r"])), lambda i: F.transform(
        F.sequence(w(d["y"] - d["r"]), w(d["y"] + d["r"])), lambda j: F.struct(i.alias("i"), j.alias("j"))))))))
    real = (F.size(discs) > 0) & F.forall(discs, lambda d: d["x"].isNotNull() & d["y"].isNotNull() & d["r"].isNotNull())
    ranked = labels.where(real).select(F.col(frame).alias("f"), F.col(id_col).alias("id"), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("rank"), F.col(discs).alias("discs"), touched.alias("b"))
    open_, kept = written(ranked, "open"), []
    while open_.limit(1).count():
        spread = open_.select("f", "id", "rank", F.explode("b").alias("k"))
        first = spread.groupBy("f", "k").agg(F.min(F.struct("rank", "id")).alias("top"))
        wins = spread.join(first, ["f", "k"]).groupBy("f", "id").agg(F.min((F.col("top.id") == F.col("id")).cast("int")).alias("all")).where("all = 1").select("f", "id")
        now = written(open_.join(wins, ["f", "id"], "left_semi"), "placed")
        kept.append(now)
        there = now.select("f", F.explode("b").alias("k"), F.col("id").alias("by"), F.col("discs").alias("taken"))
        rest = open_.join(wins, ["f", "id"], "left_anti")
        close = lambda a, b: F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)) < F.pow(a["r"] + b["r"], F.lit(2))
        hit = rest.select("f", "id", "discs", F.explode("b").alias("k")).join(there, ["f", "k"]).where(F.exists("discs", lambda a: F.exists("taken", lambda b: close(a, b)))).select("f", "id").distinct()
        open_ = written(rest.join(hit, ["f", "id"], "left_anti"), "open", after=open_)
    release(open_)
    if not kept:
        return labels.select(frame, id_col).limit(0)
    out = reduce(DataFrame.unionByName, [k.select("f", "id", "rank") for k in kept])
    if most is not None:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("f").orderBy("rank"))).where(F.col("n") <= most)
    return out.select(F.col("f").alias(frame), F.col("id").alias(id_col))
