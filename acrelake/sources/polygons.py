"""GeoJSON polygons as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.functions import geometry

_FILE = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ring array<struct<x, y>>, box, properties): the outer ring of each Polygon; other geometries and empty ones are left out."""
    files = spark.read.schema(_FILE).option("multiLine", True).json(path)
    one = files.select(F.explode("features").alias("f")).where("f.geometry.type = 'Polygon'")
    rings = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    one = one.select(F.transform(F.get(rings, 0), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))).alias("ring"), F.col("f.properties").alias("properties"))
    return one.where(F.size("ring") > 0).select("ring", geometry.box(F.col("ring")).alias("box"), "properties")
