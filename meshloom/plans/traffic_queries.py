"""Queries on traffic matrices between data centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import traffic
from meshloom.plans import inputs
from meshloom.plans.inputs import DCS, GBPS_PER_MW

MIN_KM, PARTNERS, STEP = 10.0, 3, 10.0


def _g(column: str):
    return F.round(column, 6).alias(column)


def _power(spark, d):
    names = inputs.metro_table(spark, d).where("metro_idx % 3 = 0").select(F.lower("name").alias("slug"), "name", (F.col("metro_idx") * 2.0).alias("mw"))
    over = names.select(F.concat("slug", F.lit("/dc2")).alias("key"), "mw").union(names.select("name", F.col("mw") + 1))
    return traffic.dc_power(inputs.dc_table(spark, d), 150.0, over).select("dc_pos", "metro", "dc_idx", "mw")


def _offered(spark, d):
    return traffic.offered(inputs.dc_table(spark, d), GBPS_PER_MW)


def _weights(spark, d):
    return traffic.spread(_bundle_weights(spark, d)).select("a_pos", "b_pos", "km", "weight")


def _bundle_weights(spark, d):
    """Rounded while they are pairs of bundles, which are far fewer."""
    return traffic.bundle_weights(inputs.dc_table(spark, d), 1.0, 1.5, MIN_KM, True).withColumn("km", _g("km")).withColumn("weight", _g("weight"))


def _top(spark, d):
    return traffic.heaviest_pairs(inputs.dc_table(spark, d), PARTNERS, 1.0, 1.5, MIN_KM).select("a_pos", "b_pos", _g("weight"))


def _allocated(spark, d, jitter=0.0):
    dcs = inputs.dc_table(spark, d)
    weighed = traffic.bundle_weights(dcs, 1.0, 1.0, MIN_KM)
    return traffic.allocate(weighed, inputs.kinds(spark), traffic.offered(dcs, GBPS_PER_MW), jitter)


def _rounded(policy):
    def run(spark, d):
        return traffic.conserve(_allocated(spark, d), STEP, policy).select("a_pos", "b_pos", "priority", "gbps")

    return run


def _demands(spark, d):
    return traffic.gravity(inputs.dc_table(spark, d), inputs.kinds(spark), GBPS_PER_MW, min_km=MIN_KM, exclude_same_metro=True, max_partners=PARTNERS, step=STEP)


def _plain(spark, d):
    return traffic.gravity(inputs.dc_table(spark, d), inputs.kinds(spark), GBPS_PER_MW, min_km=MIN_KM).select("source_path", "sink_path", "priority", F.round("demand", 2).alias("demand"), "euclidean_km")


def _uniform(spark, d):
    return traffic.uniform(_offered(spark, d), inputs.kinds(spark))


def _stats(spark, d):
    s = traffic.stats(_demands(spark, d))
    return s.select(F.coalesce("priority", F.lit(-1)).alias("priority"), "n", *[_g(c) for c in ("min_gbps", "median_gbps", "mean_gbps", "max_gbps")])


def _hose(spark, d):
    first = inputs.dc_table(spark, d)
    return traffic.hose(first, inputs.kinds(spark), GBPS_PER_MW, step=1.0, samples=2, seed=7, tilt=0.5, min_km=MIN_KM)


def _hose_margins(spark, d):
    cells = traffic.hose_matrices(inputs.dc_table(spark, d), GBPS_PER_MW, samples=2, seed=7, carve_top_k=4)
    sums = cells.groupBy("sample", F.col("i").alias("dc")).agg(F.sum("gbps").alias("egress"))
    return sums.select("sample", "dc", F.round("egress", 3).alias("egress"))


def _explained(spark, d):
    rows = traffic.explained(traffic.bundle_weights(inputs.dc_table(spark, d), 1.0, 1.5, MIN_KM), 1.0, 1.5)
    for c in ("km", "nearness", "weight", "share"):
        rows = rows.withColumn(c, F.round(c, 9))
    return traffic.spread(rows).select("a_pos", "b_pos", "a_mass", "b_mass", "km", "nearness", "weight", "share")


def _jitter(spark, d):
    return _allocated(spark, d, 0.3).groupBy("priority").agg(F.count("*").alias("n"), F.round(F.sum("gbps"), 4).alias("gbps"))


QUERIES = {
    "dc_power": _power, "offered_traffic": _offered, "gravity_weights": _weights, "gravity_topk": _top, "gravity_rounded": _rounded("nearest"),
    "gravity_rounded_floor": _rounded("floor"), "gravity_rounded_ceil": _rounded("ceil"), "gravity_demands": _demands, "gravity_plain": _plain,
    "uniform_demands": _uniform, "demand_stats": _stats, "hose_demands": _hose, "hose_margins": _hose_margins, "gravity_jitter": _jitter, "traffic_explained": _explained,
}

_ALL = DCS + """, pairs AS (
  SELECT a.dc_pos AS a_pos, b.dc_pos AS b_pos, a.metro AS a_metro, b.metro AS b_metro, a.metro_idx AS a_idx, b.metro_idx AS b_idx, a.dc_idx AS a_dc, b.dc_idx AS b_dc,
    a.mw AS a_mw, b.mw AS b_mw, CASE WHEN a.metro = b.metro THEN 10.0::DOUBLE
      ELSE greatest(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 1000, 10.0::DOUBLE) END AS km
  FROM dcs a JOIN dcs b ON a.dc_pos < b.dc_pos),
offered AS (SELECT sum(mw) AS total_mw, sum(mw) * 10 AS offered_gbps FROM dcs)"""


def _top_sql(source: str) -> str:
    return f"""kept AS (
  SELECT DISTINCT a_pos, b_pos FROM (
    SELECT *, row_number() OVER (PARTITION BY own ORDER BY weight DESC, other) AS r FROM (
      SELECT a_pos, b_pos, weight, a_pos AS own, b_pos AS other FROM {source} UNION ALL SELECT a_pos, b_pos, weight, b_pos, a_pos FROM {source})) WHERE r <= {PARTNERS}),
top AS (SELECT w.* FROM {source} w JOIN kept USING (a_pos, b_pos))"""


_GRAVITY = "w AS (SELECT *, a_mw * b_mw / km AS weight FROM pairs)"
_GRAVITY_APART = "w AS (SELECT *, a_mw * b_mw / km AS weight FROM pairs WHERE a_metro <> b_metro)"
_STEEP = "w AS (SELECT *, a_mw * b_mw / pow(km, 1.5::DOUBLE) AS weight FROM pairs)"


def _alloc(source: str) -> str:
    return f"""alloc AS (
  SELECT w.*, priority, offered_gbps * ratio AS class_gbps, offered_gbps * ratio * (weight / (SELECT sum(weight) FROM {source})) AS gbps
  FROM {source} w, offered, kinds)"""


def _conserve(rounding: str) -> str:
    return f"""q AS (SELECT *, {rounding} * {STEP}::DOUBLE AS q FROM alloc),
rem AS (
  SELECT *, greatest(round_even((class_gbps - sum(q) OVER (PARTITION BY priority)) / {STEP}::DOUBLE, 0), 0) AS steps,
    row_number() OVER (PARTITION BY priority ORDER BY round(gbps - q, 9) DESC, a_pos, b_pos) AS r FROM q),
rounded AS (SELECT *, q + CASE WHEN r <= steps THEN {STEP}::DOUBLE ELSE 0 END AS total FROM rem)"""


_NEAREST = f"round_even(gbps / {STEP}::DOUBLE, 0)"
_DIRECTED = f"""d AS (SELECT *, round_even(total / 2 / {STEP / 2}::DOUBLE, 0) * {STEP / 2}::DOUBLE AS demand FROM rounded),
demands AS (
  SELECT '^metro' || a_idx || '/dc' || a_dc || '/.*' AS source_path, '^metro' || b_idx || '/dc' || b_dc || '/.*' AS sink_path, priority, demand, CAST(ceil(km) AS BIGINT) AS euclidean_km FROM d WHERE demand > 0
  UNION ALL
  SELECT '^metro' || b_idx || '/dc' || b_dc || '/.*', '^metro' || a_idx || '/dc' || a_dc || '/.*', priority, demand, CAST(ceil(km) AS BIGINT) FROM d WHERE demand > 0)"""
DEMANDS = f"{_ALL}, {_GRAVITY_APART}, {_top_sql('w')}, {_alloc('top')}, {_conserve(_NEAREST)}, {_DIRECTED}"

SQL = {
    "dc_power": f"""WITH {DCS}, over_ AS (
  SELECT lower(name) || '/dc2' AS key, metro_idx * 2.0::DOUBLE AS mw FROM metros WHERE metro_idx % 3 = 0
  UNION ALL SELECT name, metro_idx * 2.0::DOUBLE + 1 FROM metros WHERE metro_idx % 3 = 0)
SELECT dc_pos, metro, CAST(dc_idx AS INT) AS dc_idx, coalesce(p.mw, m.mw, 150.0::DOUBLE) AS mw
FROM dcs LEFT JOIN over_ p ON p.key = replace(lower(metro), ' ', '-') || '/dc' || dc_idx LEFT JOIN over_ m ON m.key = metro""",
    "offered_traffic": f"WITH {_ALL} SELECT total_mw, offered_gbps FROM offered",
    "gravity_weights": f"WITH {_ALL}, {_STEEP} SELECT a_pos, b_pos, round(km, 6) AS km, round(weight, 6) AS weight FROM w WHERE a_metro <> b_metro",
    "gravity_topk": f"WITH {_ALL}, {_STEEP}, {_top_sql('w')} SELECT a_pos, b_pos, round(weight, 6) AS weight FROM top",
    "gravity_rounded": f"WITH {_ALL}, {_GRAVITY}, {_alloc('w')}, {_conserve(_NEAREST)} SELECT a_pos, b_pos, priority, total AS gbps FROM rounded",
    "gravity_rounded_floor": f"WITH {_ALL}, {_GRAVITY}, {_alloc('w')}, {_conserve(f'floor(gbps / {STEP}::DOUBLE)')} SELECT a_pos, b_pos, priority, total AS gbps FROM rounded",
    "gravity_rounded_ceil": f"WITH {_ALL}, {_GRAVITY}, {_alloc('w')}, {_conserve(f'ceil(gbps / {STEP}::DOUBLE)')} SELECT a_pos, b_pos, priority, total AS gbps FROM rounded",
    "gravity_demands": f"WITH {DEMANDS} SELECT * FROM demands",
    "gravity_plain": f"""WITH {_ALL}, {_GRAVITY}, {_alloc('w')}, d AS (SELECT *, round(gbps / 2, 2) AS demand FROM alloc)
SELECT '^metro' || a_idx || '/dc' || a_dc || '/.*' AS source_path, '^metro' || b_idx || '/dc' || b_dc || '/.*' AS sink_path, priority, demand, CAST(ceil(km) AS BIGINT) AS euclidean_km FROM d WHERE demand > 0
UNION ALL SELECT '^metro' || b_idx || '/dc' || b_dc || '/.*', '^metro' || a_idx || '/dc' || a_dc || '/.*', priority, demand, CAST(ceil(km) AS BIGINT) FROM d WHERE demand > 0""",
    "uniform_demands": f"WITH {_ALL} SELECT '{traffic.ANY_DC}' AS source_path, '{traffic.ANY_DC}' AS sink_path, priority, offered_gbps * ratio AS demand FROM offered, kinds WHERE offered_gbps * ratio > 0",
    "demand_stats": f"""WITH {DEMANDS} SELECT coalesce(priority, -1) AS priority, count(*) AS n, round(min(demand), 6) AS min_gbps, round(quantile_cont(demand, 0.5), 6) AS median_gbps,
  round(avg(demand), 6) AS mean_gbps, round(max(demand), 6) AS max_gbps FROM demands GROUP BY GROUPING SETS ((), (priority))""",
    "gravity_jitter": f"WITH {_ALL}, {_GRAVITY}, {_alloc('w')} SELECT priority, count(*) AS n, round(sum(gbps), 4) AS gbps FROM alloc GROUP BY priority",
    "hose_margins": f"WITH {_ALL} SELECT CAST(s AS INT) AS sample, row_number() OVER (PARTITION BY s ORDER BY dc_pos) AS dc, round(mw * 10, 3) AS egress FROM dcs, range(1, 3) r(s)",
    "traffic_explained": f"""WITH {_ALL}, {_STEEP} SELECT a_pos, b_pos, a_mw AS a_mass, b_mw AS b_mass, round(km, 9) AS km, round(1 / pow(km, 1.5::DOUBLE), 9) AS nearness,
  round(weight, 9) AS weight, round(weight / (SELECT sum(weight) FROM w), 9) AS share FROM w""",
}
