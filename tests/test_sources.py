import json
import struct

import pytest
from pyspark.sql import functions as F

from tessera.sources.readers import csv_by_prefix, decode_wkb, geojson, geometry_of, gpkg_body, ndjson, wanted_rows
from tessera.sources.sinks import packed_layers, tiled_parquet
from tessera.sources.sinks import ndjson as write_ndjson


def wkb(kind, body, order="<"):
    return struct.pack(order + "BI" if order == "<" else ">BI", 1 if order == "<" else 0, kind) + body


def line(points, order="<", kind=2):
    return wkb(kind, struct.pack(order + "I", len(points)) + b"".join(struct.pack(f"{order}{len(p)}d", *p) for p in points), order)


def test_wkb_in_both_orders_with_and_without_z():
    for order in "<>":
        assert decode_wkb(line([(1, 2), (3, 4)], order))["parts"] == [[{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}]]
    assert decode_wkb(line([(1, 2, 9)], kind=1002))["parts"] == [[{"x": 1.0, "y": 2.0}]]
    assert decode_wkb(line([(1, 2, 9)], kind=0x80000002))["parts"] == [[{"x": 1.0, "y": 2.0}]]
    ring = struct.pack("<II", 1, 3) + struct.pack("<6d", 0, 0, 1, 0, 0, 1)
    assert decode_wkb(wkb(6, struct.pack("<I", 2) + wkb(3, ring) * 2))["type"] == "MultiPolygon"
    for bad in (b"", line([(1, 2)]) + b"x", line([(1, 2)])[:-1], wkb(77, b"")):
        with pytest.raises(ValueError):
            decode_wkb(bad)


def test_geometry_columns(spark):
    g = line([(1, 2), (3, 4)])
    blob = b"GP\x00\x03" + b"\0" * 4 + struct.pack("<4d", 0, 0, 1, 1) + g
    df = spark.createDataFrame([(bytearray(g), bytearray(blob)), (None, None)], "g binary, b binary")
    rows = df.select(geometry_of(F.col("g")).alias("a"), geometry_of(gpkg_body(F.col("b"))).alias("b")).collect()
    assert rows[0].a == rows[0].b and rows[0].a.parts[0][1].x == 3.0 and rows[1].a is None


def test_pruned_scan_pushes_the_box_down(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.lit("river").alias("subtype"), F.struct(*[(F.col("id") / 10).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")]).alias("bbox"))
    df.coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/w")
    out = wanted_rows(spark, f"{tmp_path}/w", {"xmin": 10, "ymin": 10, "xmax": 12, "ymax": 12}, ["river"], ["id"])
    assert out.count() == 21
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "bbox.xmin" in plan[plan.index("PushedFilters") :]


def test_ndjson_geojson_and_csv(spark, tmp_path):
    rows = [{"id": "w1@2", "subtype": "lake", "class": "lake", "name": "", "common": {"en": "A"}, "osm": [], "tags": {}, "bbox": [0, 0, 1, 1], "geometry": {"type": "LineString", "line": [0, 0, 1, 1]}}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    (r,) = ndjson(spark, f"{tmp_path}/a.json").collect()
    assert (r.name, r.osm, r.wikidata, r.geometry.line) == ("", [], None, [0.0, 0.0, 1.0, 1.0])
    write_ndjson(ndjson(spark, f"{tmp_path}/a.json"), f"{tmp_path}/out", "id")
    assert ndjson(spark, f"{tmp_path}/out").count() == 1
    (tmp_path / "bad.json").write_text('{"id": 1, "bbox": "x"}')
    with pytest.raises(Exception):
        ndjson(spark, f"{tmp_path}/bad.json").collect()
    features = [
        {"properties": {"name": "x"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
        {"properties": {"name": "y"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}},
        {"properties": {"name": "z"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 1]]], [[[5, 5], [6, 5], [5, 6]]]]}},
    ]
    (tmp_path / "f.geojson").write_text(json.dumps({"features": features}))
    assert geojson(spark, f"{tmp_path}/f.geojson", "LineString").count() == 3
    assert geojson(spark, f"{tmp_path}/f.geojson", "Polygon").count() == 2
    (tmp_path / "p.csv").write_text("Lon (deg),Lat,Conifer share\n1,2,0.5\n")
    assert csv_by_prefix(spark, f"{tmp_path}/p.csv", {"lon": "lon", "conifer": "con"}).first() == (1.0, 0.5)
    with pytest.raises(ValueError):
        csv_by_prefix(spark, f"{tmp_path}/p.csv", {"x": "l"})


def test_tiles_and_packed_layers(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"))
    tiled_parquet(df, f"{tmp_path}/t", "x", "y", 5.0, 2)
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 100 and back.select("tile").distinct().count() == 4
    g = spark.createDataFrame([(0, 0, 1), (0, 2, 200), (1, 1, 7)], "r int, c int, a int")
    got = {(r.layer, r.r): bytes(r.bytes) for r in packed_layers(g, 2, 3, ["a"]).collect()}
    assert got == {("a", 0): b"\x01\xff\xc8", ("a", 1): b"\xff\x07\xff"}
