"""Queries on unions of polygons.

Parcels are parts: squares of three sizes on a grid, in eight groups, that touch, overlap and
enclose each other. In SQL they are counted by half units, and rings are walked edge by edge.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import metros, overlay
from meshloom.plans import inputs, scenario_queries

#: Parcels in a row of the grid, and their groups.
ROW, GROUPS = 40, 8


def _parcels(spark, d):
    k = F.col("p_partkey")
    x, y, side = (k % ROW).cast("double"), F.floor(k / ROW).cast("double"), 1 + (k % 3) / 2
    corner = lambda a, b: F.struct((x + a * side).alias("x"), (y + b * side).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return inputs.table(spark, d, "part", "p_partkey", "p_size").select((F.col("p_size") % GROUPS).cast("string").alias("code"), F.array(ring).alias("parts"))


def _ring_table(spark, d):
    return overlay.ring_table(overlay.union(_parcels(spark, d), "code", 0.25), 0.25, straight=False)


def _rings(spark, d):
    first = F.array_min("vertices")
    return _ring_table(spark, d).select(F.col("group_key").alias("code"), "hole", "n_vertices", "area", first["x"].alias("x"), first["y"].alias("y"))


def _totals(spark, d):
    sign = F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))
    return _ring_table(spark, d).groupBy(F.col("group_key").alias("code")).agg(
        F.count_if(~F.col("hole")).alias("n_outer"), F.count_if("hole").alias("n_holes"), F.sum(sign).alias("area"), F.sum("n_vertices").alias("n_vertices")
    )


def _in_mask(spark, d):
    mask = overlay.dissolve(scenario_queries._boundaries(spark, d)).select(F.lit("all").alias("statefp"), "parts")
    return metros.within(scenario_queries._areas(spark, d), mask, 2.0).select("uac_code", "name")


QUERIES = {"dissolved_rings": _rings, "dissolved_totals": _totals, "areas_in_mask": _in_mask}

#: Directions are numbered counter-clockwise from east; a cell's edges run so that it lies on their left.
_WALK = f"""WITH RECURSIVE parcels AS (
  SELECT p_size % {GROUPS} AS code, 2 * (p_partkey % {ROW}) AS x, 2 * (p_partkey // {ROW}) AS y, 2 + p_partkey % 3 AS side FROM part),
cells AS (SELECT DISTINCT code, x + i AS x, y + j AS y FROM parcels, range(4) a(i), range(4) b(j) WHERE i < side AND j < side),
sides AS (
  SELECT code, x AS ax, y AS ay, x + 1 AS bx, y AS "by", 0 AS dir FROM cells UNION ALL SELECT code, x + 1, y, x + 1, y + 1, 1 FROM cells
  UNION ALL SELECT code, x + 1, y + 1, x, y + 1, 2 FROM cells UNION ALL SELECT code, x, y + 1, x, y, 3 FROM cells),
kept AS (SELECT *, row_number() OVER (ORDER BY code, ax, ay, bx, "by") AS id FROM sides s WHERE NOT EXISTS (
  SELECT 1 FROM sides t WHERE t.code = s.code AND t.ax = s.bx AND t.ay = s."by" AND t.bx = s.ax AND t."by" = s.ay)),
onward AS (SELECT e.id, arg_min(f.id, CASE (f.dir - e.dir + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS next
  FROM kept e JOIN kept f ON f.code = e.code AND f.ax = e.bx AND f.ay = e."by" GROUP BY e.id),
walk(start, cur) AS (SELECT id, id FROM kept UNION ALL SELECT w.start, o.next FROM walk w JOIN onward o ON o.id = w.cur WHERE o.next > w.start),
ends AS (SELECT w.start FROM walk w JOIN onward o ON o.id = w.cur WHERE o.next = w.start),
members AS (SELECT w.start, w.cur FROM walk w JOIN ends USING (start)),
rings AS (
  SELECT k.code, m.start, count(*) FILTER (k.dir <> p.dir) AS n_vertices, sum(k.ax * k."by" - k.bx * k.ay) / 8.0::DOUBLE AS signed, min((k.ax, k.ay)) AS low
  FROM members m JOIN kept k ON k.id = m.cur JOIN onward o ON o.next = m.cur JOIN kept p ON p.id = o.id GROUP BY ALL)"""

SQL = {
    "dissolved_rings": _WALK + """ SELECT CAST(code AS VARCHAR) AS code, signed < 0 AS hole, n_vertices, abs(signed) AS area, low[1] / 2.0::DOUBLE AS x, low[2] / 2.0::DOUBLE AS y FROM rings""",
    "dissolved_totals": _WALK + """ SELECT CAST(code AS VARCHAR) AS code, count(*) FILTER (signed > 0) AS n_outer, count(*) FILTER (signed < 0) AS n_holes,
  sum(signed) AS area, CAST(sum(n_vertices) AS BIGINT) AS n_vertices FROM rings GROUP BY 1""",
    "areas_in_mask": scenario_queries.SQL["areas_within"],
}
