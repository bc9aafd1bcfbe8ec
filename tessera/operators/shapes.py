"""Drawn shapes against a map: how much of each changes what is there, and the cells of a shape in waves by height."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import close_ring, steps
from .grid import bilinear
from .spatial import rasterise

#: Runs of a band of shape_effect(), about.
RUNS_OF_BAND = 300_000


def _boxes(df: DataFrame, id_col: str, rings: str, *more: str) -> DataFrame:
    xs, ys = (F.transform(F.flatten(rings), lambda p: p[k]) for k in ("x", "y"))
    box = df.select(id_col, *more, F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
    return box.where("xmin is not null and ymin is not null and xmax is not null and ymax is not null")


def shape_effect(
    shapes: DataFrame, land: DataFrame, shape_id: str, land_id: str, on_sea: Column, size: float, least: float = 0.2, most: int = 200, rings: str = "rings", land_rings: str = "rings",
) -> DataFrame:
    """(shape_id, inside, changed): points of a lattice over each shape's box that lie in it, and those of them that are land, or that are none where on_sea.

    The lattice has a step of `least`, or more for a large shape, so that at most about most + 1 points lie along a side; both are judged by the even-odd rule.
    Of a shape, an edge gives a row of the lattice the place up to which points lie before it, places are summed by row, and runs between places are inside by the
    parity of what lies beyond them. Runs and the edges of the land meet in bands at most `size` high, lower ones where there are more runs, so no shape meets a land:
    a point is land by the parity of the edges beyond it. Ids are unique; a shape without points has 0 and 0.
    """
    kind = shapes.schema[shape_id].dataType.simpleString()
    ring = F.flatten(F.transform("_r", lambda r: steps(close_ring(r))))
    span = F.greatest(F.lit(least), F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / most)
    box = _boxes(shapes.select(F.col(shape_id).alias("_s"), F.col(rings).alias("_r")), "_s", "_r", "_r")
    frame = box.repartition("_s").withColumn("_step", span).select(
        "_s", "_r", F.col("xmin").alias("_x0"), F.col("ymin").alias("_y0"), "_step",
        F.floor((F.col("xmax") - F.col("xmin")) / F.col("_step")).alias("_nx"), F.floor((F.col("ymax") - F.col("ymin")) / F.col("_step")).alias("_ny"),
    )
    own = frame.select("*", F.explode(ring).alias("e")).select("*", *[F.col(f"e.{k}.{v}").alias(f"{k}{v}") for k in "ab" for v in "xy"]).drop("e", "_r").where("ay <> by")
    # Crossings of edges with rows of the lattice, as the number of points before them, counted by place.
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    first = F.greatest(F.lit(0), F.floor((low - F.col("_y0")) / F.col("_step")) - 1)
    last = F.least(F.col("_ny"), F.ceil((high - F.col("_y0")) / F.col("_step")) + 1)
    rows = own.where(first <= last).withColumn("_j", F.explode(F.sequence(first, last))).withColumn("_y", F.col("_y0") + F.col("_j") * F.col("_step"))
    rows = rows.where((F.col("ay") > F.col("_y")) != (F.col("by") > F.col("_y")))
    rows = rows.withColumn("_x", (F.col("bx") - F.col("ax")) * (F.col("_y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    at = F.greatest(F.lit(0), F.least(F.col("_nx") + 1, F.ceil((F.col("_x") - F.col("_x0")) / F.col("_step"))))
    point = lambda i: F.col("_x0") + i * F.col("_step")
    # Rounding may put the place one off; what counts is whether a point lies before the crossing.
    at = F.when((at > 0) & (point(at - 1) >= F.col("_x")), at - 1).when((at <= F.col("_nx")) & (point(at) < F.col("_x")), at + 1).otherwise(at)
    places = rows.select("_s", "_j", "_y", "_x0", "_step", at.alias("_p")).where("_p > 0").groupBy("_s", "_j", "_y", "_x0", "_step", "_p").agg(F.count(F.lit(1)).alias("_in"))
    beyond = Window.partitionBy("_s", "_j").orderBy(F.desc("_p"))
    runs = places.select("_s", "_y", "_x0", "_step", F.coalesce(F.lead("_p").over(beyond), F.lit(0)).alias("_from"), "_p", (F.sum("_in").over(beyond) % 2 == 1).alias("inside")).where("inside").drop("inside")
    about = box.agg(F.count(F.lit(1)).alias("n"), (F.max("ymax") - F.min("ymin")).alias("h")).first()
    height = max(min(float(size), (about.h or 0.0) / max(1.0, about.n * (most + 1) / RUNS_OF_BAND)), float(size) / 2**16)
    ground = land.select(F.col(land_rings).alias("_r")).select(F.explode(ring).alias("e")).select(*[F.col(f"e.{k}.{v}").alias(f"{k}{v}") for k in "ab" for v in "xy"]).where("ay <> by")
    edges = ground.select("*", F.explode(F.sequence(F.floor(low / height), F.floor(high / height))).alias("_b"))

    def kernel(mine: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"_s": [], "inside": [], "_land": []})
        return pd.DataFrame({"_s": mine["_s"], "inside": mine["_p"] - mine["_from"], "_land": _land_of_runs(mine, there)}).groupby("_s", as_index=False).sum()

    met = runs.withColumn("_b", F.floor(F.col("_y") / height)).groupBy("_b").cogroup(edges.groupBy("_b")).applyInPandas(kernel, f"_s {kind}, inside long, _land long")
    sums = met.groupBy("_s").agg(F.sum("inside").alias("inside"), F.sum("_land").alias("_land"))
    out = shapes.select(F.col(shape_id).alias("_s"), F.coalesce(on_sea, F.lit(False)).alias("_sea")).join(sums, "_s", "left")
    n, k = (F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("inside", "_land"))
    return out.select(F.col("_s").alias(shape_id), n.alias("inside"), F.when(F.col("_sea"), n - k).otherwise(k).alias("changed"))


def _land_of_runs(runs: pd.DataFrame, edges: pd.DataFrame) -> np.ndarray:
    """How many points of each run have an odd number of edges beyond them. Runs are taken in narrow bands, in which most edges pass from bottom to top.

    Edges of about one width in a band are in order: those that begin beyond a point are counted at once, and only those about the point and those that end in the band are held against it.
    """
    y, x0, step = (runs[k].to_numpy(float) for k in ("_y", "_x0", "_step"))
    start, stop = runs["_from"].to_numpy(np.int64), runs["_p"].to_numpy(np.int64)
    ax, ay, bx, by = (edges[k].to_numpy(float) for k in ("ax", "ay", "bx", "by"))
    low, high, land = np.minimum(ay, by), np.maximum(ay, by), np.zeros(len(y), np.int64)
    if not len(ax):
        return land
    turn = np.argsort(y, kind="stable")
    ends = int(((low > y[turn[0]]) & (low <= y[turn[-1]])).sum() + ((high > y[turn[0]]) & (high <= y[turn[-1]])).sum())
    # Fewer bands make more edges that end in one, more bands sort edges more often; a step of sorting takes about 20 times as long.
    bands = int(np.clip(np.sqrt(float((stop - start).sum()) * ends / (20.0 * len(ax))), 1 + (stop - start).sum() // 1_000_000, len(y)))
    for of in np.array_split(turn, bands):
        counts = stop[of] - start[of]
        of_run = np.repeat(np.arange(len(of)), counts)
        px = x0[of][of_run] + (np.arange(len(of_run)) - np.repeat(np.cumsum(counts) - counts - start[of], counts)) * step[of][of_run]
        py, odd = y[of][of_run], np.zeros(len(of_run), np.int64)
        bottom, top = y[of[0]], y[of[-1]]
        whole, met = (low <= bottom) & (high > top), (low <= top) & (high > bottom)
        part = np.flatnonzero(met & ~whole)
        at_once = max(1, 2_000_000 // max(1, len(px)))
        for k in range(0, len(part), at_once):
            e = part[k : k + at_once, None]
            over = (ay[e] > py) != (by[e] > py)
            odd += (over & (px < (bx[e] - ax[e]) * (py - ay[e]) / (by[e] - ay[e]) + ax[e])).sum(0)
        w = np.flatnonzero(whole)
        at = lambda v: (bx[w] - ax[w]) * (v - ay[w]) / (by[w] - ay[w]) + ax[w]
        near, far = at(bottom), at(top)
        # Crossings between lie between those at bottom and top, but for rounding.
        pad = 1e-9 * (1 + np.abs(ax[w]) + np.abs(bx[w]))
        left, right = np.minimum(near, far) - pad, np.maximum(near, far) + pad
        width = np.frexp(right - left)[1]
        if len(w):
            width = np.maximum(width, np.frexp((left.max() - left.min()) / len(w))[1])
        for size in np.unique(width):
            mine = np.flatnonzero(width == size)
            mine = mine[np.argsort(left[mine])]
            begins = left[mine]
            a, b = np.searchsorted(begins, px - (right[mine] - begins).max() - pad.max()), np.searchsorted(begins, px, "right")
            odd += len(mine) - b
            total = np.concatenate([[0], np.cumsum(b - a)])
            for lo, hi in _parts(total, 2_000_000):
                n = (b - a)[lo:hi]
                p = np.repeat(np.arange(lo, hi), n)
                e = w[mine[np.arange(len(p)) - np.repeat(total[lo:hi] - total[lo] - a[lo:hi], n)]]
                hit = px[p] < (bx[e] - ax[e]) * (py[p] - ay[e]) / (by[e] - ay[e]) + ax[e]
                odd[lo:hi] += np.bincount(p[hit] - lo, minlength=hi - lo)
        land[of] = np.bincount(of_run, odd % 2, len(of)).astype(np.int64)
    return land


def _parts(total: np.ndarray, most: int):
    """Ranges of items with at most so much each, or one item; total is their running sum from 0."""
    lo = 0
    while lo < len(total) - 1:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def height_waves(
    shapes: DataFrame, land: DataFrame, heights: DataFrame, shape_id: str, rings: str, height: str, cell: float, height_cell: float, size: tuple[int, int], top: float, low: float, below: float = 2.5, bands: int = 32,
) -> DataFrame:
    """(shape_id, r, c, wave, band) of the cells with their centre in a shape, on land and no higher than top: wave 1 above low, wave 2 from there down.

    Bands order the cells of a wave from the highest: from top to low in the first, over `below` in the second. Heights are blended between the centres of
    a grid of size (rows, columns), from whose rim on they stay as they are; where none of those around is known a cell is in no wave.
    """
    cells = rasterise(shapes.select(F.col(shape_id).alias("_s"), F.col(rings).alias("_r")), "_s", "_r", cell)
    cells = cells.join(land.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct(), ["r", "c"], "left_semi")
    at = lambda k, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col(k) + 0.5) * cell / height_cell - 0.5))
    known = bilinear(cells.select("_s", "r", "c"), heights, at("c", size[1]), at("r", size[0]), height, "_h").where(F.col("_h") <= top)
    h, last = F.col("_h"), bands - 1
    band = F.when(h > low, (top - h) / (top - low)).otherwise((low - h) / below) * last
    return known.select(F.col("_s").alias(shape_id), "r", "c", F.when(h > low, 1).otherwise(2).alias("wave"), F.greatest(F.lit(0), F.least(F.lit(last), F.floor(band + 0.5))).cast("int").alias("band"))
