"""Rules on tagged features, with parts standing for features, and codecs over tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import geometry as gm
from ..functions import waters as wt
from ..operators import features as ft
from .registry import query, table
from .spatial import TRACK_SQL, _tracks

#: Columns of a feature, in SQL that both engines read.
FIELDS = {
    "id": "p_partkey", "subtype": "CASE p_partkey % 5 WHEN 0 THEN 'lake' WHEN 1 THEN 'water' WHEN 2 THEN 'reservoir' WHEN 3 THEN 'river' ELSE 'ocean' END",
    "cls": "CASE WHEN p_partkey % 5 = 3 AND p_size % 4 <> 0 THEN 'river' ELSE 'stream' END", "geometry": "CASE WHEN p_partkey % 5 = 3 THEN 'LineString' WHEN p_size % 7 = 0 THEN 'Point' ELSE 'Polygon' END",
    "name": "CASE WHEN p_size % 6 <> 0 THEN p_name ELSE '' END", "wikidata": "CASE WHEN p_partkey % 4 = 0 THEN concat('Q', CAST(p_partkey AS VARCHAR(20))) END",
    "nat": "CASE WHEN p_size % 9 = 0 THEN 'bay' WHEN p_size % 11 <> 0 THEN 'water' END",
    "water": "CASE p_size % 8 WHEN 0 THEN 'lagoon' WHEN 1 THEN 'harbour' WHEN 2 THEN 'lake' WHEN 3 THEN 'reservoir' WHEN 4 THEN 'oxbow' END",
    "landuse": "CASE WHEN p_partkey % 13 = 0 THEN 'reservoir' END", "kind": "CASE WHEN p_partkey % 17 = 0 THEN 'pumped' END",
    "start": "CASE p_partkey % 6 WHEN 0 THEN '1956;1977' WHEN 1 THEN '1100' WHEN 2 THEN 'C12' END", "mine": "CASE WHEN p_partkey % 19 = 0 THEN 'coal' END",
    "was": "CASE WHEN p_partkey % 23 = 0 THEN 'quarry' END", "rid": "concat(CASE p_size % 3 WHEN 0 THEN 'w' WHEN 1 THEN 'r' ELSE 'n' END, CAST(p_partkey AS VARCHAR(20)), '@2')",
    "size": "p_retailprice / 40", "box": "p_retailprice / 90",
}
FEATURE_SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in FIELDS.items()) + " FROM part"
KEYS = {"natural": "nat", "water": "water", "landuse": "landuse", "reservoir_type": "kind", "start_date": "start", "resource": "mine", "was:lake": "was"}


def _features(spark, sf):
    p = table(spark, sf, "part").selectExpr(*[f"{sql} AS {name}" for name, sql in FIELDS.items()])
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in KEYS.items()]), lambda x: x["v"].isNotNull())
    raw = F.map_from_entries(pairs)
    tags = wt.row_tags(raw, F.col("name"), F.create_map(F.lit("en"), F.col("name")), F.col("wikidata"))
    return p.withColumn("tags", tags).withColumn("osm", F.when(F.col("id") % 29 == 0, F.array("rid", "rid")).otherwise(F.array("rid")))


_DAM = "(coalesce(water = 'reservoir', FALSE) OR coalesce(landuse = 'reservoir', FALSE) OR kind IS NOT NULL)"
_MADE = "CASE WHEN was = 'quarry' THEN 'was:lake=quarry' WHEN mine IS NOT NULL THEN 'resource=' || mine WHEN try_cast(regexp_extract(start, '\\b(\\d{3,4})\\b', 1) AS INT) > 1219 THEN 'start_date=' || start END"
_KIND = "CASE substr(rid, 1, 1) WHEN 'w' THEN 'way' WHEN 'r' THEN 'relation' ELSE 'node' END"


@query(f"SELECT id, {_DAM} AS reservoir, {_MADE} AS made FROM ({FEATURE_SQL})")
def reservoirs(spark, sf):
    """Reservoirs by their tags, and what shows that a lake was made later."""
    return _features(spark, sf).select("id", wt.reservoir(F.col("tags")).alias("reservoir"), wt.made_after(F.col("tags")).alias("made"))


@query(f"""
SELECT id, name <> '' AND (size >= 40 OR (wikidata IS NOT NULL AND size >= 15)) AS river, name <> '' AND (size >= 20 OR (wikidata IS NOT NULL AND size >= 5)) AS lake,
  (wikidata IS NOT NULL AND box >= 5) OR (name <> '' AND box >= 20) AS fetch, subtype <> 'ocean' AND id % 3 <> 0 AND (cls = 'river' OR box >= 12) AS wanted FROM ({FEATURE_SQL})
""")
def keep_rules(spark, sf):
    """Size rules of rivers and lakes, lakes worth fetching by their box, and rows of a scan to take."""
    name, wikidata, size, tags = (F.col(c) for c in ("name", "wikidata", "size", "tags"))
    return _features(spark, sf).select(
        "id", wt.large_enough(name, wikidata, size, wt.RIVER_KM, wt.RIVER_WIKIDATA_KM).alias("river"), wt.large_enough(name, wikidata, size, wt.LAKE_KM2, wt.LAKE_WIKIDATA_KM2).alias("lake"),
        wt.worth_fetching(tags, F.col("box")).alias("fetch"), wt.wanted_row(F.col("subtype"), F.col("cls"), F.col("id") % 3 != 0, F.col("box"), 12.0).alias("wanted"),
    )


@query(f"""
SELECT id, CASE WHEN subtype = 'river' AND cls = 'river' AND geometry = 'LineString' AND id % 29 <> 0 AND {_KIND} = 'way' AND id % 7 >= 2 THEN id END AS way,
  CASE WHEN geometry = 'Polygon' AND subtype IN ('lake', 'water', 'reservoir') AND (nat = 'water' OR (nat = 'bay' AND water = 'lagoon'))
    AND (subtype = 'reservoir' OR water IS NULL OR water IN ('reservoir', 'lake', 'lagoon', 'oxbow')) AND id % 29 <> 0 AND {_KIND} <> 'node' THEN {_KIND} || '/' || id END AS lake FROM ({FEATURE_SQL})
""")
def feature_rows(spark, sf):
    """River rows that stand for one way, and polygon rows that stand for one lake."""
    c = F.col
    return _features(spark, sf).select(
        "id", wt.river_way(c("subtype"), c("cls"), c("geometry"), c("osm"), c("id") % 7).alias("way"), wt.lake_candidate(c("subtype"), c("geometry"), c("osm"), c("tags")).alias("lake")
    )


@query(f"""
SELECT id, len(list_filter([nat, water, landuse, kind, start, mine, was, wikidata, nullif(name, ''), nullif(name, '')], lambda x: x IS NOT NULL))::INT AS n, nullif(name, '') AS name,
  nullif(name, '') AS en, wikidata FROM ({FEATURE_SQL})
""")
def row_tag_maps(spark, sf):
    """Tag maps put together from raw tags and the fields that were taken out of them."""
    t = F.col("tags")
    return _features(spark, sf).select("id", F.size(t).alias("n"), t["name"].alias("name"), t["name:en"].alias("en"), t["wikidata"].alias("wikidata"))


@query("""
SELECT p_brand AS brand, arg_max(v, row(d, n)) AS newest FROM (SELECT p_brand, '2026-0' || (1 + p_size % 9) || '-1' || (p_partkey % 10) AS d, p_partkey % 12 AS n, d || '.' || n AS v FROM part WHERE p_partkey % 7 <> 0) GROUP BY 1
""")
def newest_releases(spark, sf):
    """The newest release of each brand among well-formed names."""
    name = "concat('release/2026-0', 1 + p_size % 9, '-1', p_partkey % 10, CASE WHEN p_partkey % 7 = 0 THEN '-' ELSE '.' END, p_partkey % 12, '/') AS prefix"
    p = table(spark, sf, "part").selectExpr("p_brand AS brand", name)
    return p.groupBy("brand").agg(wt.newest_release(F.col("prefix")).alias("newest"))


@query(f"""
WITH t AS (SELECT user_id, min(x) / 7 AS x0, max(x) / 7 AS x1, min(y) / 7 AS y0, max(y) / 7 AS y1 FROM ({TRACK_SQL}) GROUP BY 1)
SELECT user_id, floor(x0 * 20) / 20 AS low, ceil(x1 * 20) / 20 AS high, floor((x0 + x1) / 2 * 100 + 0.5) / 100 AS cx, floor((y0 + y1) / 2 * 100 + 0.5) / 100 AS cy FROM t
""")
def windows_of_tracks(spark, sf):
    """Windows rounded outwards and box centres as keys."""
    e = table(spark, sf, "events").groupBy("user_id").agg(*[f(v).alias(n) for f, v, n in (
        (F.min, F.col("value") / 7, "x0"), (F.max, F.col("value") / 7, "x1"), (F.min, F.hour("ts") / 7, "y0"), (F.max, F.hour("ts") / 7, "y1"))])
    low, high = wt.outward(F.col("x0"), F.col("x1"))
    return e.select("user_id", low.alias("low"), high.alias("high"), wt.box_centre(F.col("x0"), F.col("x1")).alias("cx"), wt.box_centre(F.col("y0"), F.col("y1")).alias("cy"))


_LEB = "array_to_string(list_transform(range(greatest(1, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 ELSE 4 END)), lambda i: printf('%02X', ((v >> (7 * i)::INT) & 127) + CASE WHEN (v >> (7 * (i + 1))::INT) > 0 THEN 128 ELSE 0 END)), '')"


@query(f"""
WITH t AS (SELECT user_id, n, floor(x * 10)::BIGINT AS x, y::BIGINT AS y FROM ({TRACK_SQL})), s AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM t WINDOW w AS (PARTITION BY user_id ORDER BY n)),
z AS (SELECT user_id, n, unnest([0, 1]) AS k, unnest([CASE WHEN dx IS NULL THEN x WHEN dx >= 0 THEN dx * 2 ELSE -dx * 2 - 1 END, CASE WHEN dy IS NULL THEN y WHEN dy >= 0 THEN dy * 2 ELSE -dy * 2 - 1 END]) AS v FROM s),
h AS (SELECT user_id, -2 AS n, 0 AS k, 1::BIGINT AS v FROM t GROUP BY 1 UNION ALL SELECT user_id, -1, 0, count(*) FROM t GROUP BY 1 UNION ALL SELECT * FROM z)
SELECT user_id, string_agg({_LEB}, '' ORDER BY n, k) AS packed, TRUE AS same FROM h GROUP BY 1
""")
def packed_tracks(spark, sf):
    """Tracks as bytes: count, first point, folded steps; and whether they unpack to what they were."""
    whole = F.transform("line", lambda p: F.struct(F.floor(p["x"] * 10).alias("x"), p["y"].cast("long").alias("y")))
    t = _tracks(spark, sf).select("user_id", whole.alias("line")).withColumn("b", codecs.packed_points(F.col("line")))
    return t.withColumn("back", codecs.unpacked_points("b")).select("user_id", F.hex("b").alias("packed"), F.col("back").eqNullSafe(F.col("line")).alias("same"))


@query(f"""
WITH v AS (SELECT l_orderkey, -1 AS k, count(*) AS v FROM lineitem GROUP BY 1
  UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice), floor(l_extendedprice * 3)::BIGINT FROM lineitem)
SELECT l_orderkey, string_agg({_LEB}, '' ORDER BY k) AS packed, TRUE AS same FROM v GROUP BY 1
""")
def packed_lists(spark, sf):
    """The lines of an order as bytes and back."""
    point = F.struct("l_linenumber", F.floor(F.col("l_extendedprice") * 3).alias("v"))
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point))["v"].alias("v"))
    l = l.withColumn("b", codecs.packed_uints(F.col("v"))).withColumn("back", codecs.unpacked_uints("b"))
    return l.select("l_orderkey", F.hex("b").alias("packed"), F.col("back").eqNullSafe(F.col("v")).alias("same"))


@query(f"""
WITH t AS (SELECT user_id, n, x, y, y BETWEEN 8 AND 16 AND x > 100 AS inside FROM ({TRACK_SQL})),
m AS (SELECT user_id, count(*) AS n, min(n) FILTER (inside) AS f, max(n) FILTER (inside) AS l, count(*) FILTER (inside) AS hits FROM t GROUP BY 1),
k AS (SELECT user_id, n, hits, CASE WHEN f = l AND l = n THEN f - 1 ELSE f END AS f, CASE WHEN f = l AND l < n THEN l + 1 ELSE l END AS l FROM m),
p AS (SELECT user_id, hits, unnest([0, 1, 2]) AS part, unnest(CASE WHEN f IS NULL OR n < 2 THEN [1, NULL, NULL] ELSE [CASE WHEN f > 1 THEN 1 END, f, CASE WHEN l < n THEN l END] END) AS lo,
  unnest(CASE WHEN f IS NULL OR n < 2 THEN [n, NULL, NULL] ELSE [f, l, n] END) AS hi FROM k)
SELECT user_id, part::INT AS part, lo AS first, hi AS last, part = 1 AS inside, hits FROM p WHERE lo IS NOT NULL
""")
def split_tracks(spark, sf):
    """Tracks cut where a mask begins and ends to hold their points, the pieces sharing the points between them."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.hour("ts").between(8, 16) & (F.col("value") > 100)).alias("inside"))
    return ft.split_at_mask(e, "user_id", ["ts", "event_id"], F.col("inside"))


@query("""
WITH o AS (SELECT o_custkey AS g, o_orderkey AS id, o_totalprice AS size, o_orderpriority AS lang, o_orderstatus || o_orderkey AS v FROM orders)
SELECT g, lang, arg_min(v, row(-size, id)) AS v, (SELECT round(sum(size), 2) FROM o b WHERE b.g = o.g) AS total FROM o GROUP BY 1, 2
""")
def rolled_up(spark, sf):
    """Groups with the sum of their pieces and, for every key of the pieces' maps, the value of the largest piece that has it."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("size"),
        F.create_map("o_orderpriority", F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))).alias("names"),
    )
    return ft.roll_up(o, "g", "id", "size", "names").select("g", "lang", "v", F.round("total", 2).alias("total"))


@query("""
WITH n AS (SELECT p_partkey AS id, p_size AS a, p_size + p_partkey % 4 AS b, p_brand AS k FROM part),
x AS (SELECT *, lag(b) OVER (PARTITION BY k ORDER BY a, id) AS before FROM n)
SELECT id, CASE WHEN a >= b THEN 'empty' WHEN before > a THEN 'overlap' WHEN before < a THEN 'gap' END AS problem FROM x WHERE a >= b OR before <> a
""")
def timeline_report(spark, sf):
    """Intervals of a timeline that are empty, overlap the one before or leave a gap after it."""
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("a"), (F.col("p_size") + F.col("p_partkey") % 4).alias("b"), F.col("p_brand").alias("k"))
    return ft.timeline_report(n, "k", "id", "a", "b")


@query(f"""
WITH t AS (SELECT user_id, n, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS b, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM ({TRACK_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT user_id, sum(x * coalesce(b, fy) - coalesce(bx, fx) * y) AS a2, user_id % 3 = 0 AS hole FROM t GROUP BY 1)
SELECT user_id % 7 AS g, round(sum(CASE WHEN hole THEN -abs(a2) ELSE abs(a2) END) / 2, 3) AS area FROM a GROUP BY 1
""")
def net_areas(spark, sf):
    """Areas of features whose rings are turned by their role, holes taken off."""
    rings = _tracks(spark, sf).select((F.col("user_id") % 7).alias("g"), gm.orient(F.col("line"), F.col("user_id") % 3 == 0).alias("ring"))
    return rings.groupBy("g").agg(F.round(F.sum(gm.signed_area2(F.col("ring"))) / 2, 3).alias("area"))


@query("""
WITH a AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS x, n_nationkey % 4 AS y FROM nation), f AS (SELECT 'BRAZIL' AS name, 1 AS x, 2 AS y, 'Brasil' AS fixed UNION ALL SELECT 'INDIA', 9, 9, 'Bharat')
SELECT id, coalesce(f.fixed, a.name) AS name FROM a LEFT JOIN f USING (name, x, y)
""")
def ends_repaired(spark, sf):
    """Names put right where name and both ends of the feature are those of a fix."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("x"), (F.col("n_nationkey") % 4).alias("y"))
    fixes = spark.createDataFrame([("BRAZIL", 1, 2, "Brasil"), ("INDIA", 9, 9, "Bharat")], "name string, x int, y int, fixed string")
    return ft.repaired_by_keys(n, fixes, ["name", "x", "y"], "name", "fixed").select("id", "name")


@query("""
WITH a AS (SELECT 'way' AS kind, o_custkey % 500 AS id, o_orderkey AS v FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'relation', o_custkey % 300, o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT kind, id, max(v) AS v FROM a GROUP BY 1, 2
""")
def cached_elements(spark, sf):
    """Elements of several answers, once by kind and id, the newest answer holding."""
    o = table(spark, sf, "orders")
    part = lambda status, kind, n: o.where(F.col("o_orderstatus") == status).select(F.lit(kind).alias("kind"), (F.col("o_custkey") % n).alias("id"), F.col("o_orderkey").alias("v"))
    return ft.merged_elements([part("O", "way", 500), part("F", "relation", 300)], ["kind", "id"], "v")
