"""Embedding near-dedup by collision counting on sorted one-dimensional projections.

For unit vectors at cosine c, the difference of their projections on a Gaussian direction is
normal with deviation sqrt(2 - 2c). A pair collides in a projection if one lies in the window of
half-width `window` centred at the other. Of m projections, pairs at the threshold collide in at
least `need` with the wanted probability; closer pairs more often. As a wanted pair misses at most
m - need projections, it collides in one of the first m - need + 1 at least: those are sorted for
candidates, and the collisions over all m are counted for the pairs in their windows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, split_blocks, written
from .graph import Forest, connected_components
from .runs import over_runs

SEED = 20_240_607
#: Queries whose windows are counted at a time in a block.
TILE = 256


def collision_probability(cosine: float, window: float) -> float:
    far = math.sqrt(max(0.0, 2 - 2 * cosine))
    return 1.0 if far == 0 else math.erf(window / far / math.sqrt(2))


def calibrated_count(cosine: float, window: float, projections: int, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall` at least."""
    p = collision_probability(cosine, window)
    at_least = 0.0
    for need in range(projections, 0, -1):
        at_least += math.comb(projections, need) * p**need * (1 - p) ** (projections - need)
        if at_least >= recall:
            return need
    return 1


@functools.lru_cache(maxsize=8)
def directions(dim: int, projections: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, projections))


def _unit(packed: pd.Series, dim: int) -> np.ndarray:
    """Unit rows in double precision of packed vectors, whose width tells single from double precision."""
    data = b"".join(packed)
    x = np.frombuffer(data, "<f4" if len(data) == 4 * dim * len(packed) else "<f8").reshape(len(packed), dim).astype(np.float64)
    # First by a power of two, which rounds nothing, so that no square over- or underflows.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def embedding_groups(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93,
    projections: int = 16, window_deviations: float = 3.3, recall: float = 0.9995, block_rows: int = 1024,
) -> DataFrame:
    """Near-duplicate vectors -> one row for each row: id, n_links, component_id, kept.

    Rows are compared if their labels are equal and not null and their vectors are of one length;
    they link at a cosine of `cosine` or more, in double precision. Null, empty or zero vectors and
    those with null or non-finite components link with nothing, and so do rows with a null id (whose
    component_id and kept are null). Equal vectors of a label count as linked and are searched once.
    A row's n_links counts rows, so an id that is repeated with one vector links with its repeats.
    kept is id = component_id. Other columns are ignored. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    # -0.0 + 0.0 is 0.0, so that equal vectors have equal bytes.
    rows = rows.withColumn("v", F.when(fit, F.transform("v", lambda x: x + F.lit(0.0))))
    keyed = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.unhex(F.substring(F.sha2(F.to_json(F.struct("label", "v")), 256), 1, 32))))
    keyed = written(keyed, "vectors")
    distinct = written(
        keyed.where("v is not null").groupBy("h").agg(
            F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")
        ),
        "distinct",
    )
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    found = written(pairs(distinct, single, cosine, projections, window_deviations, recall, block_rows), "links")
    groups = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("g").alias("h")).agg(F.sum("n").alias("others"))
    known = written(
        distinct.select("h", "node", "copies").join(counts, "h", "left").join(groups, "node", "left").select(
            "h", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")
        ),
        "known",
    )
    out = keyed.select("id", "h").join(known, "h", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def pairs(distinct: DataFrame, single: bool, cosine: float, projections: int, window_deviations: float, recall: float, block_rows: int) -> DataFrame:
    """distinct(h, node, copies, label, v; single: v has single precision) -> links (a, b) that span every linked group, and counts (g, n) of linked rows.

    Each lead projection is cut into cells as wide as a window; a vector goes to its own cell, and as a
    guest to the next. Cells are cut into blocks of bounded size. A pair is judged in the first
    lead projection where it collides, so each is counted once. A block returns one count for
    each of its vectors and a spanning forest of its links, never the pairs.
    """
    window = window_deviations * math.sqrt(2 - 2 * cosine)
    need = calibrated_count(cosine, window, projections, recall)
    leads = projections - need + 1

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["dim"] = pdf["v"].map(len).astype("int32")
            for dim, part in pdf.groupby("dim"):
                packed = part["v"].map(lambda v: np.ascontiguousarray(v, "<f4" if single else "<f8").tobytes())
                cells = np.floor(_unit(packed, dim) @ directions(dim, projections)[:, :leads] / window).astype(np.int32)
                for lead in range(leads):
                    for guest in (False, True):
                        yield part[["h", "node", "copies", "label", "dim"]].assign(
                            v=packed, lead=np.int32(lead), cell=cells[:, lead] + np.int32(guest), guest=guest
                        )

    label = distinct.schema["label"].dataType.simpleString()
    cast = distinct.schema["copies"].dataType.simpleString()
    placed = distinct.select("h", "node", "copies", "label", "v").mapInPandas(
        project, f"h binary, node long, copies {cast}, label {label}, dim int, v binary, lead int, cell int, guest boolean"
    )
    by = ["label", "dim", "lead", "cell"]
    dealt = split_blocks(placed, by, "h", block_rows)
    by += ["_bi", "_bj"]
    dealt = dealt.repartition(shuffle_parts(distinct.sparkSession), *by).sortWithinPartitions(*by)

    def kernel(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
        out = [x for a, b in zip(starts[:-1], starts[1:]) if b - a > 1 and (x := block(frame.iloc[a:b])) is not None]
        return pd.concat(out, ignore_index=True) if out else None

    def block(pdf: pd.DataFrame) -> pd.DataFrame | None:
        guest = pdf["guest"].to_numpy(bool)
        if guest.all():
            return None
        lead, dim = int(pdf["lead"].iloc[0]), int(pdf["dim"].iloc[0])
        unit = _unit(pdf["v"], dim)
        h = unit @ directions(dim, projections)
        # The sorted projection: windows are ranges of rows.
        order = np.argsort(h[:, lead], kind="stable")
        unit, h, guest = unit[order], np.ascontiguousarray(h[order].T), guest[order]
        h32 = h.astype(np.float32)  # counts may differ by rounding; a little slack keeps them whole
        node, copies, side = (pdf[c].to_numpy()[order] for c in ("node", "copies", "_side"))
        across = pdf["_bi"].iloc[0] != pdf["_bj"].iloc[0]
        wide, n = np.float32(window * (1 + 1e-5)), len(order)
        others, forest, links = np.zeros(n, np.int64), Forest(n), []
        for q in range(0, n, TILE):
            e = min(q + TILE, n)
            stop = int(np.searchsorted(h[lead], h[lead, e - 1] + window, "right"))
            if stop <= q + 1:
                continue
            hit = np.abs(h32[lead, q:e, None] - h32[lead, None, q:stop]) <= wide
            hit &= np.arange(q, e)[:, None] < np.arange(q, stop)[None]
            hit &= ~(guest[q:e, None] & guest[None, q:stop])
            if across:
                hit &= side[q:e, None] != side[None, q:stop]
            for earlier in range(lead):  # judged there
                hit &= np.abs(h32[earlier, q:e, None] - h32[earlier, None, q:stop]) > wide
            i, j = np.nonzero(hit)
            missed = np.full(len(i), lead, np.int8)
            for m in range(lead + 1, projections):
                missed += np.abs(h32[m, q + i] - h32[m, q + j]) > wide
                if m % 3 == 0:
                    live = missed <= projections - need
                    i, j, missed = i[live], j[live], missed[live]
            live = missed <= projections - need
            i, j = q + i[live], q + j[live]
            for s in range(0, len(i), 1 << 15):
                a, b = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                a, b = a[near], b[near]
                if len(a):
                    others += np.bincount(a, copies[b], n).astype(np.int64) + np.bincount(b, copies[a], n).astype(np.int64)
                    kept = forest.add(a, b)
                    links.append(np.stack([node[a[kept]], node[b[kept]]], axis=1))
        if not links:
            return None
        some = np.flatnonzero(others)
        ab = np.concatenate(links)
        return pd.DataFrame({
            "a": pd.array(np.concatenate([ab[:, 0], node[some]]), "Int64"),
            "b": pd.array([*ab[:, 1].tolist(), *[None] * len(some)], "Int64"),
            "g": [*[None] * len(ab), *pdf["h"].to_numpy()[order][some]],
            "n": np.concatenate([np.zeros(len(ab), np.int64), others[some]]),
        })

    return dealt.mapInPandas(over_runs(by, kernel), "a long, b long, g binary, n long")
