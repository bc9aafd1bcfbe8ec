"""Rules on tagged features: which rows become river ways or lakes, what was made later, what is large enough."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import record_id
from .scalar import start_year

#: Least sizes: km of a river and square km of a lake, and those that suffice with a Wikidata id.
RIVER_KM, RIVER_WIKIDATA_KM, LAKE_KM2, LAKE_WIKIDATA_KM2 = 40.0, 15.0, 20.0, 5.0
#: Values of `water` that are lakes, and keys that tell of a flooded mine, in order of precedence. Fixed values.
LAKE_VALUES = ("lake", "lagoon", "oxbow")
MINE_KEYS = ("old_resource", "was:resource", "resource")


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _filled(c: Column) -> Column:
    return _is(c != "")


def row_tags(raw: Column, name: Column, common: Column, wikidata: Column) -> Column:
    """The raw tag map with `name`, `name:xx` and `wikidata` from fields of their own, which win; empty ones are left out."""
    one = lambda k, v: F.when(_filled(v), F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,string>"))
    named = F.transform_keys(F.map_filter(F.coalesce(common, F.create_map().cast("map<string,string>")), lambda k, v: _filled(v)), lambda k, v: F.concat(F.lit("name:"), k))
    out = F.coalesce(raw, F.create_map().cast("map<string,string>"))
    for extra in (one("name", name), named, one("wikidata", wikidata)):
        out = F.map_zip_with(out, extra, lambda k, a, b: F.coalesce(b, a))
    return out


def reservoir(tags: Column) -> Column:
    return _is(tags["water"] == "reservoir") | _is(tags["landuse"] == "reservoir") | tags["reservoir_type"].isNotNull()


def made_after(tags: Column, year: int = 1219) -> Column:
    """Which tag shows that a lake was made after the year, as `key=value`; null if none does."""
    shown = lambda k: F.concat(F.lit(f"{k}="), tags[k])
    quarry = [F.when(_is(tags[k] == "quarry"), shown(k)) for k in ("lake", "was:lake")]
    mine = [F.when(_filled(tags[k]), shown(k)) for k in MINE_KEYS]
    return F.coalesce(*quarry, *mine, F.when(start_year(tags["start_date"]) > year, shown("start_date")))


def large_enough(name: Column, wikidata: Column, size: Column, least: float, least_known: float) -> Column:
    """The keep rule of rivers (by length) and lakes (by area): a name, and the size, a smaller one with a Wikidata id."""
    return _filled(name) & (_is(size >= least) | (wikidata.isNotNull() & _is(size >= least_known)))


def worth_fetching(tags: Column, box_km2: Column) -> Column:
    """Whether a lake in a box of that area could pass the keep rule; the box is no smaller than the lake."""
    return (_filled(tags["wikidata"]) & (box_km2 >= LAKE_WIKIDATA_KM2)) | (_filled(tags["name"]) & (box_km2 >= LAKE_KM2))


def wanted_row(subtype: Column, cls: Column, overlaps: Column, box_km2: Column, least_km2: float = 0.4) -> Column:
    """Rows of a scan to take: a water subtype that overlaps the window, a river as such or any other by its box."""
    known = _is(subtype.isin("lake", "water", "reservoir", "river"))
    return known & _is(overlaps) & (_is(cls == "river") | _is(box_km2 >= least_km2))


def river_way(subtype: Column, cls: Column, geometry: Column, osm: Column, points: Column) -> Column:
    """Id of the one way that a river row stands for, else null: drawn as a line of two points or more, from one source."""
    only = record_id(F.when(F.size(osm) == 1, F.get(osm, F.lit(0))))
    fits = _is(subtype == "river") & _is(cls == "river") & _is(geometry == "LineString") & _is(only["kind"] == "way") & _is(points >= 2)
    return F.when(fits, only["id"])


def lake_candidate(subtype: Column, geometry: Column, osm: Column, tags: Column) -> Column:
    """`kind/id` of the one area that a polygon row stands for if it is mapped as a lake or a reservoir, else null."""
    only = record_id(F.when(F.size(osm) == 1, F.get(osm, F.lit(0))))
    mapped = _is(tags["natural"] == "water") | (_is(tags["natural"] == "bay") & _is(tags["water"] == "lagoon"))
    dam = _is(subtype == "reservoir") | _is(tags["water"] == "reservoir")
    lake = dam | tags["water"].isNull() | _is(tags["water"].isin(*LAKE_VALUES))
    area = _is(geometry.isin("Polygon", "MultiPolygon")) & _is(subtype.isin("lake", "water", "reservoir"))
    return F.when(area & mapped & lake & _is(only["kind"] != "node"), F.concat_ws("/", only["kind"], only["id"]))


def newest_release(prefix: Column, root: str = "release") -> Column:
    """Aggregate: the newest of prefixes such as `release/2026-09-23.1/`, by date and then by number; others don't count."""
    part = lambda g: F.regexp_extract(prefix, rf"^{root}/(\d{{4}}-\d{{2}}-\d{{2}})\.(\d+)/$", g)
    key = F.when(part(1) != "", F.struct(part(1).alias("date"), part(2).cast("long").alias("n")))
    best = F.max(key)
    return F.when(best.isNotNull(), F.concat_ws(".", best["date"], best["n"].cast("string")))


def outward(low: Column, high: Column, step: int = 20) -> tuple[Column, Column]:
    """Both ends of a range rounded outwards to steps of 1 / step."""
    return F.floor(low * step) / step, F.ceil(high * step) / step


def box_centre(low: Column, high: Column) -> Column:
    """Middle of a range to two decimals, halves up: a key that can be checked by eye."""
    return F.floor((low + high) / 2 * 100 + 0.5) / 100
