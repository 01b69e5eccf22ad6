import json

from pyspark.sql import functions as F

from streetweave.operators.snap import snap_entries
from streetweave.plans import catalogue
from streetweave.sources import readers
from streetweave.streaming.entries import snap_stream


def test_files(spark, tmp_path):
    d = spark.createDataFrame([(1, "LINESTRING (0 0, 3 4)"), (2, "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))"), (3, "POINT (1 1)")], "fid long, wkt string")
    for fmt in readers.FORMATS:
        readers.write_table(d, f"{tmp_path}/{fmt}", fmt)
        parts = {r.fid: len(r.parts) for r in readers.read_lines(spark, f"{tmp_path}/{fmt}", fmt, wkt="wkt").collect()}
        assert parts == {1: 1, 2: 2}
    p = readers.read_points(spark, f"{tmp_path}/parquet", wkt="wkt").where("x IS NOT NULL").first()
    assert (p.fid, p.x, p.y) == (3, 1.0, 1.0)


def test_geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4, 9]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [5, 6]}},
    ]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, features)))
    for got in (readers.read_geojson(spark, f"{tmp_path}/c.json"), readers.read_geojson_lines(spark, f"{tmp_path}/l.json")):
        r = {x.type: x for x in got.collect()}
        assert [tuple(p) for p in r["LineString"].parts[0]] == [(0, 0), (3, 4)] and r["LineString"].properties["name"] == "a"
        assert len(r["MultiLineString"].parts) == 2 and (r["Point"].x, r["Point"].y) == (5, 6)


def test_save_and_export(spark, tmp_path):
    net = catalogue.network(spark, "/root/testdata/sf0.001")
    readers.save_network(net.nodes, net.edges, net.entries, f"{tmp_path}/net")
    nodes, edges, entries = readers.load_network(spark, f"{tmp_path}/net")
    assert edges.count() == net.edges.count() and nodes.columns == net.nodes.columns and entries.count() == net.entries.count()
    readers.write_table(edges.limit(3), f"{tmp_path}/csv", "csv")
    assert readers.read_lines(spark, f"{tmp_path}/csv", "csv", wkt="geom").count() == 3
    one = json.loads(readers.geojson_rows(edges.select("edge_id", "geom")).first().value)
    assert one["geometry"]["type"] == "LineString" and len(one["geometry"]["coordinates"]) == 3


def test_stream_equals_batch(spark, tmp_path):
    net = catalogue.network(spark, "/root/testdata/sf0.001")
    raw = net.entries.select("entry_id", "x", "y")
    raw.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    snap_stream(stream, net.edges, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = snap_entries(raw, net.edges)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0


def test_catalogue_has_sql_for_every_query():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_some_queries_run_small(spark):
    for name in ("reach_wd_pos", "entry_unmapped", "smallest_missing_id"):
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
    assert catalogue.reach_n(spark, "/root/testdata/sf0.001").agg(F.sum("r")).first()[0] == 203
