"""Readers with fixed schemas: pruned Parquet, NDJSON, GeoJSON, CSV by prefix, well-known binary geometry."""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.scalar import box_overlaps

#: A water row as newline-delimited JSON.
WATER_ROW = (
    "id string, subtype string, class string, name string, common map<string,string>, wikidata string, osm array<string>, tags map<string,string>, "
    "bbox array<double>, geometry struct<type:string,line:array<double>,rings:array<array<double>>,polygons:array<array<array<double>>>>"
)
GEOMETRY = "struct<type:string,parts:array<array<struct<x:double,y:double>>>>"
#: Geometry types of well-known binary; fixed by the format.
WKB_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}


def wanted_rows(spark: SparkSession, path: str, window: Mapping[str, float], subtypes: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of a GeoParquet table whose box struct `bbox` overlaps the window; box and subtype predicates reach the row groups."""
    box = {k: F.col(f"bbox.{k}") for k in ("xmin", "ymin", "xmax", "ymax")}
    return spark.read.parquet(path).where(F.col("subtype").isin(list(subtypes)) & box_overlaps(box, window)).select(*columns)


def ndjson(spark: SparkSession, path: str, schema: str = WATER_ROW) -> DataFrame:
    """Newline-delimited JSON; a line that does not fit the schema fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def ndjson_stream(spark: SparkSession, path: str, schema: str = WATER_ROW) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def geojson(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(properties, part): one row per line or outer and inner ring of the features of a GeoJSON file, multi-parts flattened."""
    pair, depth = "array<double>", {"LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
    out = None
    raw = spark.read.option("multiLine", True).schema("features array<struct<properties:map<string,string>,geometry:string>>").json(path)
    rows = raw.select(F.explode("features").alias("f")).select("f.properties", F.get_json_object("f.geometry", "$.type").alias("type"), F.get_json_object("f.geometry", "$.coordinates").alias("c"))
    for t, d in depth.items():
        if not t.endswith(kind):
            continue
        nested = pair
        for _ in range(d):
            nested = f"array<{nested}>"
        coords = F.from_json("c", nested)
        for _ in range(d - 1):
            coords = F.flatten(coords) if d == 3 and _ == 0 else coords
        parts = F.array(coords) if d == 1 else coords
        rowset = rows.where(F.col("type") == t).select("properties", F.explode(parts).alias("part"))
        out = rowset if out is None else out.unionByName(rowset)
    return out


def csv_by_prefix(spark: SparkSession, path: str, prefixes: Mapping[str, str]) -> DataFrame:
    """CSV columns found by how their header begins: {wanted name: prefix}; each must match exactly one column."""
    df = spark.read.option("header", True).csv(path)
    chosen = []
    for name, prefix in prefixes.items():
        found = [c for c in df.columns if c.strip().lower().startswith(prefix.lower())]
        if len(found) != 1:
            raise ValueError(f"{len(found)} columns begin with {prefix!r}")
        chosen.append(F.col(f"`{found[0]}`").cast("double").alias(name))
    return df.select(*chosen)


def decode_wkb(data: bytes) -> dict:
    """Type and parts of one two-dimensional geometry; Z and M are dropped; leftover or missing bytes raise ValueError."""
    geometry, end = _wkb(data, 0)
    if end != len(data):
        raise ValueError(f"{len(data) - end} bytes are left over")
    return geometry


def _wkb(data: bytes, at: int) -> tuple[dict, int]:
    try:
        order = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        z, m = bool(code & 0x80000000), bool(code & 0x40000000)
        at += 5 + (4 if code & 0x20000000 else 0)
        code &= 0x1FFFFFFF
        dims = 2 + max(z + m, (0, 1, 1, 2)[code // 1000])
        kind = WKB_TYPES[code % 1000]

        def points(n: int, at: int) -> tuple[list, int]:
            flat = struct.unpack_from(f"{order}{n * dims}d", data, at)
            return [{"x": flat[i], "y": flat[i + 1]} for i in range(0, n * dims, dims)], at + 8 * n * dims

        if kind == "Point":
            part, at = points(1, at)
            return {"type": kind, "parts": [part]}, at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if kind == "LineString":
            part, at = points(n, at)
            return {"type": kind, "parts": [part]}, at
        parts = []
        for _ in range(n):
            if kind == "Polygon":
                (k,) = struct.unpack_from(order + "I", data, at)
                part, at = points(k, at + 4)
                parts.append(part)
            else:
                inner, at = _wkb(data, at)
                parts += inner["parts"]
        return {"type": kind, "parts": parts}, at
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"not a geometry: {e}") from e


def geometry_of(wkb: Column) -> Column:
    """Geometry struct of a column of well-known binary; null gives null."""

    @pandas_udf(GEOMETRY)
    def decode(s: pd.Series) -> pd.DataFrame:
        out = [{"type": None, "parts": None} if b is None else decode_wkb(bytes(b)) for b in s]
        return pd.DataFrame(out, columns=["type", "parts"])

    return F.when(wkb.isNotNull(), decode(wkb))


def gpkg_body(blob: Column) -> Column:
    """Well-known binary inside a GeoPackage blob: behind an 8-byte head and an envelope whose size its flags tell."""
    flags = F.conv(F.hex(F.substring(blob, 4, 1)), 16, 10).cast("int")
    doubles = F.get(F.array(*map(F.lit, (0, 4, 6, 6, 8))), F.shiftright(flags, 1).bitwiseAND(F.lit(7)))
    fine = F.substring(blob, 1, 2) == F.lit(b"GP")
    return F.when(fine, F.substring(blob, F.lit(9) + 8 * doubles, F.octet_length(blob)))
