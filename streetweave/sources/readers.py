"""Networks from files and results to files: Parquet, CSV, JSON, ORC, WKT columns and GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetweave.functions import geometry as G

FORMATS = ("parquet", "csv", "json", "orc")
_FEATURES = "features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt == "csv":
        options = {"header": True, "inferSchema": True} | options
    return spark.read.format(fmt).options(**options).load(path)


def read_lines(spark: SparkSession, path: str, fmt: str = "parquet", wkt: str | None = None, **options) -> DataFrame:
    """Lines with `geom`; with `wkt`, the column of that name becomes `parts`, an array of lines."""
    d = read_table(spark, path, fmt, **options)
    return d.withColumn("parts", G.from_wkt(F.col(wkt))).where("parts IS NOT NULL").drop(wkt) if wkt else d


def read_points(spark: SparkSession, path: str, fmt: str = "parquet", wkt: str | None = None, **options) -> DataFrame:
    d = read_table(spark, path, fmt, **options)
    if not wkt:
        return d
    p = G.point_from_wkt(F.col(wkt))
    return d.withColumn("x", p["x"]).withColumn("y", p["y"]).drop(wkt)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files: properties (map), type, parts (lines), x and y (points). A file is one value, so large
    collections should be lines of features (`read_geojson_lines`)."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", _FEATURES).alias("f"))
    return _features(text.select(F.explode("f.features").alias("f")))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features, one on a line."""
    one = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
    return _features(spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", one).alias("f")))


def _features(d: DataFrame) -> DataFrame:
    kind, c = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    to_line = lambda ps: F.transform(ps, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    single = F.array(to_line(F.from_json(c, "array<array<double>>")))
    multi = F.transform(F.from_json(c, "array<array<array<double>>>"), to_line)
    point = F.from_json(c, "array<double>")
    return d.select(
        F.col("f.properties").alias("properties"),
        kind.alias("type"),
        F.when(kind == "LineString", single).when(kind == "MultiLineString", multi).alias("parts"),
        F.when(kind == "Point", F.get(point, F.lit(0))).alias("x"),
        F.when(kind == "Point", F.get(point, F.lit(1))).alias("y"),
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", geom: str = "geom") -> None:
    """Write a result; for CSV, lines become WKT."""
    if fmt == "csv" and geom in df.columns:
        df = df.withColumn(geom, G.to_wkt(F.col(geom)))
    df.write.format(fmt).mode(mode).options(**({"header": True} if fmt == "csv" else {})).save(path)


def geojson_rows(df: DataFrame, geom: str = "geom") -> DataFrame:
    """A column `value` with a GeoJSON feature for each row, for `write.text`."""
    coordinates = F.transform(F.col(geom), lambda p: F.array(p["x"], p["y"]))
    properties = F.struct(*[F.col(c) for c in df.columns if c != geom])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"))).alias("value"))


def save_network(nodes: DataFrame, edges: DataFrame, entries: DataFrame, path: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("entries", entries)):
        df.write.parquet(f"{path}/{name}")


def load_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "entries"))
