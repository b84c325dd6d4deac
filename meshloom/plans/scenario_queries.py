"""Queries on areas and boundaries, the scenario's sections, libraries, and windows of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import expand, metros, scenario
from meshloom.plans import inputs, metro_queries
from meshloom.plans.inputs import METROS
from meshloom.plans.metro_queries import _extract
from meshloom.sources import graph_json, library
from meshloom.streaming import events


def _square(x, y, half):
    corner = lambda a, b: F.struct((x + a * half).alias("x"), (y + b * half).alias("y"))
    return F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)))


def _areas(spark, d):
    m = inputs.metro_table(spark, d)
    return m.select(F.col("metro_id").alias("uac_code"), "name", _square(F.col("x") / 100000, F.col("y") / 100000, F.col("radius_km") / 20).alias("parts"))


def _boundaries(spark, d):
    k = F.col("r_regionkey").cast("double")
    return inputs.table(spark, d, "region", "r_regionkey").select(F.col("r_regionkey").cast("string").alias("statefp"), _square(k * 2, k * 1.5, F.lit(1.0)).alias("parts"))


def _within(spark, d):
    return metros.within(_areas(spark, d), _boundaries(spark, d), 2.0).select("uac_code", "name")


def _points(spark, d):
    return metros.centred(_areas(spark, d)).select("uac_code", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _groups(spark, d):
    return scenario.groups(inputs.metro_table(spark, d), {"pop": "FullMesh4", "dc": "DCRegion"}, mw=150.0, gbps_per_mw=10.0)


def _risks(spark, d):
    m = inputs.metro_table(spark, d).select("metro_id", "name")
    return scenario.risk_section(_extract(spark, d), m)


def _geojson(spark, d):
    m = inputs.metro_table(spark, d)
    return m.select("metro_id", graph_json.feature(F.col("x"), F.col("y"), "metro_id", "name", "radius_km").alias("feature"))


def _components(spark, d):
    """Parts as users' components over the built-in ones; one has a built-in name."""
    k = F.col("p_partkey")
    own = inputs.table(spark, d, "part", "p_partkey", "p_type", "p_size", "p_retailprice").select(
        F.when(k == 1, "CoreRouter").otherwise(F.concat(F.lit("part-"), k)).alias("name"), F.col("p_type").alias("component_type"), F.col("p_retailprice").alias("capex"),
        *[F.lit(None).cast("double").alias(c) for c in ("power_watts", "power_watts_max")], (F.col("p_size") * 100).cast("double").alias("capacity"), F.col("p_size").cast("int").alias("ports"), F.lit(None).cast("string").alias("role"),
    )
    return expand.overlay(library.components(spark), own)


def _used(spark, d):
    used = inputs.table(spark, d, "nation", "n_nationkey").select(F.element_at(F.array(*map(F.lit, ("CoreRouter", "800G-DR4", "Other"))), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("name"))
    return library.referenced(library.components(spark), used).select("name", "capacity", "ports")


def _windows(spark, d):
    return events.windowed(inputs.table(spark, d, "events")).withColumn("total", F.round("total", 4))


def _counts(spark, d):
    return scenario.extremes(inputs.metro_table(spark, d))


QUERIES = {
    "areas_within": _within, "area_points": _points, "scenario_groups": _groups, "scenario_risks": _risks, "metro_geojson": _geojson,
    "library_components": _components, "library_used": _used, "event_windows": _windows, "metro_extremes": _counts,
}

SQL = {
    "areas_within": f"""WITH {METROS}, b AS (SELECT r_regionkey * 2.0::DOUBLE AS x, r_regionkey * 1.5::DOUBLE AS y FROM region)
SELECT metro_id AS uac_code, name FROM metros m WHERE EXISTS (
  SELECT 1 FROM b WHERE abs(m.x / 100000 - b.x) <= 1 + radius_km / 20 AND abs(m.y / 100000 - b.y) <= 1 + radius_km / 20)""",
    "area_points": f"WITH {METROS} SELECT metro_id AS uac_code, round(x / 100000, 6) AS x, round(y / 100000, 6) AS y FROM metros",
    "scenario_groups": f"""WITH {METROS} SELECT 'metro' || metro_idx || '/pop[1-' || pops || ']' AS path, 'FullMesh4' AS blueprint, 'pop' AS node_type, name AS metro_name, metro_id,
  x AS location_x, y AS location_y, radius_km, CAST(NULL AS DOUBLE) AS mw_per_dc_region, CAST(NULL AS DOUBLE) AS gbps_per_mw FROM metros
UNION ALL SELECT 'metro' || metro_idx || '/dc[1-' || dcs || ']', 'DCRegion', 'dc_region', name, metro_id, x, y, radius_km, 150, 10 FROM metros WHERE dcs > 0""",
    "metro_geojson": f"""WITH {METROS} SELECT metro_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR)
  || ']}},"properties":{{"metro_id":"' || metro_id || '","name":"' || name || '","radius_km":' || CAST(radius_km AS VARCHAR) || '}}}}' AS feature FROM metros""",
    "scenario_risks": metro_queries.SQL["risk_distance"],
    "library_components": "WITH c(" + ", ".join(c.split(" ")[0] for c in library.COLUMNS.split(", ")) + ") AS (VALUES " + ", ".join(
        "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::{'INT' if isinstance(v, int) else 'DOUBLE'}" for v in r) + ")" for r in library.COMPONENTS
    ) + """) SELECT * FROM c WHERE name <> 'CoreRouter' OR NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = 1)
UNION ALL SELECT CASE WHEN p_partkey = 1 THEN 'CoreRouter' ELSE 'part-' || p_partkey END, p_type, p_retailprice, NULL, NULL, CAST(p_size * 100 AS DOUBLE), CAST(p_size AS INT), NULL FROM part""",
    "library_used": "SELECT * FROM (VALUES ('CoreRouter', 409600.0::DOUBLE, 512), ('800G-DR4', 800.0::DOUBLE, 1)) c(name, capacity, ports)",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "metro_extremes": f"WITH {METROS} SELECT count(*) AS n_metros, max(pops) AS max_pops, max(dcs) AS max_dcs, min(radius_km) AS min_radius_km, round(avg(radius_km), 6) AS avg_radius_km, max(radius_km) AS max_radius_km FROM metros",
}
