"""Graph operators: components, patches, constrained grouping and label propagation."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import release, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node long, component long): the smallest id reachable.

    Large-star and small-star steps in turn. Each is a minimum per node (partial aggregation) and a join, so a node
    with very many edges is spread by partial sums and skew-join splitting, and no component is held in one task.
    Only nodes with an edge to another node are returned; self-loops, repeats and null ends are dropped. Raises if
    max_rounds (far above log of any size) do not suffice, rather than return a partial answer.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    for _ in range(max_rounds):
        # Stars: every a has one b, and no b is itself an a.
        heads = e.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        multi = heads.where("n > 1").limit(1)
        chained = e.join(heads.select(F.col("a").alias("b")), "b", "left_semi").select("b").limit(1)
        if not multi.select("a").unionByName(chained.select(F.col("b").alias("a"))).take(1):
            centres = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
        large, low = _large_star(e)
        e = written(_small_star(large), "edges", after=e)
        release(low)
    raise RuntimeError("connected components did not converge")


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new edges, and the table that they read beside e."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    low = written(low, "low")
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), low


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def labelled(nodes: DataFrame, edges: DataFrame, id_col: str, out: str = "component") -> DataFrame:
    """nodes with the component of each, its own id where it has no edge."""
    found = connected_components(edges).withColumnRenamed("node", id_col).withColumnRenamed("component", "_component")
    return nodes.join(found, id_col, "left").withColumn(out, F.coalesce("_component", id_col)).drop("_component")


def constrained_groups(items: DataFrame, links: DataFrame, id_col: str, tags: tuple[str, str]) -> DataFrame:
    """(id, grp): links are joined in order of (priority, a, b) unless a group would mix two values of a tag.

    The outcome depends on the order, so the links of a plain component pass one task in that order; components are spread over tasks.
    Links are sorted by Spark and pass in batches: a task holds a few numbers for each member of one component, and no links.
    A null tag never conflicts. The group's id is its smallest member.
    """
    nodes = labelled(items.where(F.col(id_col).isNotNull()), links.select("a", "b"), id_col)
    coded = written(nodes.select("component", F.col(id_col).cast("long").alias("a"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(tags)]), "members")
    for i in (0, 1):
        # A task holds a number for a tag and not its text.
        codes = written(coded.select(f"t{i}").where(F.col(f"t{i}").isNotNull()).distinct().withColumn(f"k{i}", F.monotonically_increasing_id()), "codes")
        coded = coded.join(codes, f"t{i}", "left").withColumn(f"k{i}", F.coalesce(f"k{i}", F.lit(-1).cast("long"))).drop(f"t{i}")
    zero, last = F.lit(0).cast("long"), F.lit(None).cast(links.schema["priority"].dataType)
    tagged = coded.groupBy("component", "a").agg(F.min(F.struct("k0", "k1")).alias("k")).select("component", F.lit(0).alias("kind"), last.alias("priority"), "a", zero.alias("b"), "k.*")
    where = nodes.select(F.col(id_col).alias("a"), "component").distinct()
    rows = links.where("b is not null").join(where, "a").select("component", F.lit(1).alias("kind"), "priority", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), zero.alias("k0"), zero.alias("k1"))
    both = tagged.unionByName(rows)
    ranked = both.repartition("component").sortWithinPartitions("component", "kind", F.asc_nulls_last("priority"), "a", "b")

    def kernel(batches):
        now, parts, held = None, [], None
        for batch in batches:
            component, kind = batch["component"].to_numpy(), batch["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero((component[1:] != component[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(batch)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                part = batch.iloc[low:high]
                if component[low] != now:
                    if now is not None:
                        yield from _grouped(held or _members(parts))
                    now, parts, held = component[low], [], None
                if kind[low] == 0:
                    parts.append(part[["a", "k0", "k1"]])
                    continue
                if held is None:
                    held, parts = _members(parts), []
                _join(held, part["a"].to_numpy(np.int64), part["b"].to_numpy(np.int64))
        if now is not None:
            yield from _grouped(held or _members(parts))

    found = ranked.select("component", "kind", "a", "b", "k0", "k1").mapInPandas(kernel, "id long, grp long")
    return found.unionByName(items.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("grp"))).withColumnRenamed("id", id_col)


def _members(parts: list[pd.DataFrame]) -> tuple[np.ndarray, array, array, array]:
    """Ids of a component in order, and by their places the roots and the codes of the two tags, -1 where there is none."""
    own = [np.concatenate([p[k].to_numpy(np.int64) for p in parts]) for k in ("a", "k0", "k1")]
    return own[0], *[array("q", x.tobytes()) for x in (np.arange(len(own[0]), dtype=np.int64), *own[1:])]


def _join(held: tuple[np.ndarray, array, array, array], a: np.ndarray, b: np.ndarray) -> None:
    ids, root, s, t = held

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    places = [np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (a, b)]
    if any((ids[p] != x).any() for p, x in zip(places, (a, b))):
        raise ValueError("a link has an end that is no item")
    for x, y in zip(*[p.tolist() for p in places]):
        x, y = find(x), find(y)
        if x == y or (s[x] != s[y] and s[x] >= 0 and s[y] >= 0) or (t[x] != t[y] and t[x] >= 0 and t[y] >= 0):
            continue
        x, y = (x, y) if x < y else (y, x)
        root[y] = x
        s[x], t[x] = max(s[x], s[y]), max(t[x], t[y])


def _grouped(held: tuple[np.ndarray, array, array, array], size: int = 100_000):
    ids, root = held[0], np.frombuffer(held[1], np.int64)
    while (root[root] != root).any():
        root = root[root]
    for k in range(0, len(ids), size):
        yield pd.DataFrame({"id": ids[k : k + size], "grp": ids[root[k : k + size]]})


def propagate(nodes: DataFrame, edges: DataFrame, id_col: str, label: str, max_rounds: int = 1000) -> DataFrame:
    """Nodes without a label take the smallest label of their neighbours, round after round, until none changes.

    All nodes of a round change at once, so the answer does not depend on order: the label of the nearest labelled node, the
    smallest one at equal distance.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = written(nodes.select(id_col, label), "labels")
    for _ in range(max_rounds):
        offered = both.join(state.where(F.col(label).isNotNull()).withColumnRenamed(id_col, "b"), "b").groupBy("a").agg(F.min(label).alias("_offer"))
        nxt = state.join(offered.withColumnRenamed("a", id_col), id_col, "left").select(
            id_col, F.coalesce(label, "_offer").alias(label), (F.col(label).isNull() & F.col("_offer").isNotNull()).alias("_moved")
        )
        nxt = written(nxt, "labels")
        moved = nxt.where("_moved").limit(1).count()
        state = nxt.drop("_moved")
        if not moved:
            return state
    raise RuntimeError("label propagation did not come to rest")


def per_group(df: DataFrame, key: str, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A sequential kernel for each group whose steps depend on each other; groups are spread over tasks."""
    return df.groupBy(key).applyInPandas(kernel, schema)


def flood(nodes: DataFrame, edges: DataFrame, id_col: str, seeds: DataFrame) -> DataFrame:
    """Nodes that can be reached from any seed."""
    parts = labelled(nodes, edges, id_col, "_part")
    hit = parts.join(seeds.select(id_col), id_col, "left_semi").select("_part").distinct()
    return parts.join(hit, "_part", "left_semi").drop("_part")


def shortest_hops(nodes: DataFrame, edges: DataFrame, id_col: str, seeds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, hops, via): least number of edges from a seed and the smallest neighbour on a shortest way; breadth first, one round a hop.

    Following `via` from any node gives a shortest path.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    front = written(seeds.select(F.col(id_col), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("via")).distinct(), "front")
    done = front
    for hop in range(1, max_rounds):
        step = both.join(front.select(F.col(id_col).alias("b")), "b").groupBy("a").agg(F.min("b").alias("via"))
        fresh = step.select(F.col("a").alias(id_col), F.lit(hop).alias("hops"), "via").join(done.select(id_col), id_col, "left_anti").join(nodes.select(id_col), id_col, "left_semi")
        front = written(fresh, "front")
        if not front.limit(1).count():
            return done
        done = written(done.unionByName(front), "reached")
    raise RuntimeError("the search did not come to rest")


def absorb_small(grid: DataFrame, id_col: str, chosen: str, least: int, parts_of, rounds: int = 4, touching=None) -> DataFrame:
    """Patches of a yes/no grid with under `least` cells are flipped, all at once, for a few rounds or until none is left.

    parts_of(grid) adds the column `_part` that tells patches apart, and may add `_size`, the number of their cells, which otherwise is counted. touching(grid) gives the ids of cells
    beside a cell of the other value: a patch without one has nothing to join, and stays.
    """
    parts = None
    for _ in range(rounds):
        if touching is not None:
            grid = written(grid, "grid")
        # Without touching() nothing but this round reads the cells of the one before.
        parts = written(parts_of(grid), "parts", after=parts if touching is None else None)
        rest = [c for c in parts.columns if c not in ("_part", "_size")]
        if "_size" in parts.columns and touching is None:
            if not parts.where(F.col("_size") < least).limit(1).count():
                return parts.select(rest)
            grid = parts.withColumn(chosen, F.col(chosen) != (F.col("_size") < least)).select(rest)
            continue
        if "_size" in parts.columns:
            small = parts.where(F.col("_size") < least).select("_part").distinct().withColumn("_small", F.lit(True))
        else:
            small = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least).select("_part", F.lit(True).alias("_small"))
        if touching is not None:
            beside = parts.join(touching(grid).select(id_col), id_col, "left_semi").select("_part").distinct()
            small = small.join(beside, "_part", "left_semi")
        if not small.limit(1).count():
            return parts.select(rest)
        grid = parts.join(small, "_part", "left").withColumn(chosen, F.col(chosen) != F.coalesce("_small", F.lit(False))).select(rest)
    return grid
