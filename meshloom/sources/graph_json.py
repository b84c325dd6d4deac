"""The graph document (JSON) as tables, and tables as JSON.

A document has ``target_crs``, ``nodes`` (``id`` an array of two numbers), ``edges``
(``source``, ``target``) and ``corridor_paths``. Tables are written as a folder of JSON
lines each, so that no task has to hold a whole graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id array<double>, node_type string, metro_id string, name string, name_orig string, uac_code string, land_area_km2 double, radius_km double, x double, y double"
EDGE = "source array<double>, target array<double>, edge_type string, length_km double, euclidean_km double, detour_ratio double, capacity double, metro_a string, metro_b string, risk_groups array<string>"
PATH = "metro_a string, metro_b string, path_index int, length_km double, segment_ids array<string>, geometry array<array<double>>"


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{n}: {t}" for n, t in (x.split(" ") for x in fields.split(", "))) + ">"


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``crs``, ``nodes``, ``edges`` and ``paths`` of a document. Paths without both metros or an index are left out; metros are put in order."""
    schema = f"target_crs string, nodes array<{_struct(NODE)}>, edges array<{_struct(EDGE)}>, corridor_paths array<{_struct(PATH)}>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    table = lambda c: doc.select(F.explode(c).alias("r")).select("r.*")
    paths = table("corridor_paths").where("metro_a IS NOT NULL AND metro_b IS NOT NULL AND path_index IS NOT NULL")
    first, last = F.least("metro_a", "metro_b"), F.greatest("metro_a", "metro_b")
    return {
        "crs": doc.select("target_crs"), "nodes": table("nodes"), "edges": table("edges"),
        "paths": paths.withColumns({"metro_a": first, "metro_b": last, "length_km": F.coalesce("length_km", F.lit(0.0)), "segment_ids": F.coalesce("segment_ids", F.array().cast("array<string>"))}),
    }


def metro_rows(nodes: DataFrame) -> DataFrame:
    """Metros of a graph's nodes; an error, when a row is read, if one lacks a name, id or radius."""
    m = nodes.where(F.col("node_type").isin("metro", "metro+highway"))
    need = F.when(F.col("name").isNull() | F.col("metro_id").isNull() | F.col("radius_km").isNull(), F.raise_error(F.lit("metro node lacks a name, id or radius")).cast("string")).otherwise(F.col("name"))
    return m.select("metro_id", need.alias("name"), "name_orig", F.coalesce("x", F.get("id", 0)).alias("x"), F.coalesce("y", F.get("id", 1)).alias("y"), "radius_km")


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines under ``folder``."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def site_tables(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The site graph as ``nodes`` with a text ``id`` and ``edges`` with ``source``, ``target`` and ``key``; other columns as they are."""
    rest = [c for c in edges.columns if c not in ("u", "v", "edge_key")]
    return {
        "nodes": nodes.select(F.col("node").cast("string").alias("id"), *[c for c in nodes.columns if c not in ("node", "id")]),
        "edges": edges.select(F.col("u").cast("string").alias("source"), F.col("v").cast("string").alias("target"), F.col("edge_key").alias("key"), *rest),
    }


def feature(x: Column, y: Column, *properties: str) -> Column:
    """A GeoJSON point feature as text."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")
    ))
