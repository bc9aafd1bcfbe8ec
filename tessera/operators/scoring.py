"""Scores and first classes of the cells of a grid: rules over several features, smoothed inside a mask with their spread kept, and noise."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import cell_noise
from ..functions.scalar import clamp
from .grid import masked_blur, twice_blurred
from .lineage import written

#: Weights of the features of the two rules; fixed values.
FOREST = {"tree": 3.0, "crop": -1.5, "built": -2.0, "height": 0.4, "rough": 0.4, "river_far": 0.6, "wet": 0.5, "pollen": 1.0}
CONIFER = {"sandy": 1.0, "wet": 0.8, "north": 0.3, "pollen": 1.0}


class Ground(NamedTuple):
    """Limits of ground_class(), in per cent, metres and km."""

    marsh: float
    dune_bare: float
    dune_sea: float
    heath: float
    heath_height: float
    heath_moss: float


def unit(x: Column) -> Column:
    """x held between 0 and 1, a null as 0."""
    return F.when(x.isNotNull(), clamp(x, 0.0, 1.0)).otherwise(0.0)


def ground_class(marsh: Column, bare: Column, moss: Column, height: Column, sea: Column, limits: Ground) -> Column:
    """marsh, heath (dunes by the sea, bare or mossy ground that lies high or has much moss) or open. A null meets no limit; a null share of bare or moss counts as none."""
    bare, moss = F.coalesce(bare, F.lit(0)), F.coalesce(moss, F.lit(0))
    dune = (bare >= limits.dune_bare) & (sea <= limits.dune_sea)
    heath = (bare + moss >= limits.heath) & (F.coalesce(height >= limits.heath_height, F.lit(False)) | (moss >= limits.heath_moss))
    return F.when(marsh >= limits.marsh, "marsh").when(dune | heath, "heath").otherwise("open")


def smoothed_with_noise(cells: DataFrame, raw: str, mask: Column, radius: int, noise: float, seed: int, out: str) -> DataFrame:
    """cells with raw smoothed by two box means inside the mask, brought back to raw's mean and deviation, and with noise by cell added; 0 outside the mask.

    The spread is kept so that cuts by a threshold follow the score and not the threshold. Where the smoothed values don't vary only their mean is
    moved. radius 0 doesn't smooth. All cells of the grid must be present, unique by r and c; a null in raw inside the mask is no part of any mean and has the noise alone.
    """
    inside = F.coalesce(mask, F.lit(False)) & F.col(raw).isNotNull()
    g = written(cells.withColumn("_on", F.coalesce(mask, F.lit(False))).withColumn("_raw", F.when(inside, F.col(raw).cast("double"))), "score")
    soft = smoothed(g.where("_raw is not null").select("r", "c", "_raw"), "_raw", radius, "_value")
    lifted = F.coalesce("_value", F.lit(0.0)) + noise * cell_noise(F.col("c"), F.col("r"), seed)
    return g.join(soft.drop("_raw"), ["r", "c"], "left").withColumn(out, F.when(F.col("_on"), lifted).otherwise(0.0)).select(*cells.columns, out)


def smoothed(cells: DataFrame, raw: str, radius: int, out: str) -> DataFrame:
    """cells(r, c, raw), none null, with raw smoothed by two box means over the cells there are and brought back to raw's mean and deviation."""
    if radius == 0:
        return cells.withColumn(out, F.col(raw))
    g = written(twice_blurred(cells, raw, radius, "_soft"), "score")
    s = g.agg(F.avg(raw).alias("m"), F.stddev_pop(raw).alias("d"), F.avg("_soft").alias("sm"), F.stddev_pop("_soft").alias("sd")).first()
    k = s.d / s.sd if s.sd else 1.0
    return g.withColumn(out, F.lit(s.m or 0.0) + (F.col("_soft") - F.lit(s.sm or 0.0)) * F.lit(k)).drop("_soft")


def weighted(terms: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted sum of the terms, in the order of the weights; a null term adds nothing."""
    return sum((weights[k] * F.coalesce(terms[k], F.lit(0.0)) for k in weights), F.lit(0.0))


def forest_rule(tree: str, crop: str) -> Column:
    """Sum of the weighted features of forest_scores(); tree and crop name the means around a cell."""
    half = lambda k, mean: (F.coalesce(F.col(k), F.lit(0.0)) + F.coalesce(F.col(mean), F.lit(0.0))) / 200
    terms = {
        "tree": half("tree", tree), "crop": half("crop", crop), "built": F.col("built") / 100, "height": unit(F.col("height") / 250), "rough": unit(F.col("rough") / 25),
        "river_far": unit(F.coalesce(F.col("river_km"), F.lit(float("inf"))) / 10), "wet": F.col("wet") / 100, "pollen": F.col("pollen"),
    }
    return weighted(terms, FOREST)


def forest_scores(cells: DataFrame, land: Column, eligible: Column, blur: int, smooth: int, noise: float, seed: int, out: str) -> DataFrame:
    """cells with how likely each was forest, from tree, crop, built and wet (per cent), height and rough (metres), river_km and pollen (a share).

    Trees and crops count half by the cell and half by the land within `blur` cells. Only the order inside an area means anything.
    """
    g = masked_blur(masked_blur(cells, "tree", land, blur, "_tree"), "crop", land, blur, "_crop")
    scored = g.withColumn("_score", forest_rule("_tree", "_crop")).select(*cells.columns, "_score")
    return smoothed_with_noise(scored, "_score", eligible, smooth, noise, seed, out).drop("_score")


def conifer_rule(low: float, coast: float, outwash: float) -> Column:
    """Sum of the weighted features of conifer_scores()."""
    far = lambda k: F.coalesce(F.col(k), F.lit(float("inf")))
    flat = unit(1 - F.col("height") / low) * unit(1 - F.col("rough") / 15)
    terms = {"sandy": flat * F.greatest(unit(1 - far("sea_km") / coast), unit(far("river_km") / outwash)), "wet": F.col("wet") / 100, "north": unit((F.col("lat") - 54) / 6), "pollen": F.col("pollen")}
    return weighted(terms, CONIFER)


def conifer_scores(cells: DataFrame, forest: Column, low: float, coast: float, outwash: float, smooth: int, noise: float, seed: int, out: str) -> DataFrame:
    """cells with how likely each forest cell was conifer: poor sandy ground (low, flat, by the sea within `coast` or away from rivers by `outwash`), wet ground, the north and pollen.

    From height and rough (metres), sea_km, river_km (null: none), wet (per cent), lat (degrees) and pollen (a share).
    """
    scored = cells.withColumn("_score", conifer_rule(low, coast, outwash))
    return smoothed_with_noise(scored, "_score", forest, smooth, noise, seed, out).drop("_score")
