"""Planning inputs read from the star-schema tables, by one fixed mapping, and the same mapping in SQL.

Nations are metros, suppliers data centres, users' events road polylines, parts components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshloom.operators import metros, roads, traffic

RATIOS = {0: 0.5, 1: 0.25, 2: 0.25}
GBPS_PER_MW = 10.0
ROAD_CLASSES = ("view", "click")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of the data folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def road_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices ``(line_id, mtfcc, ts, event_id, x, y)``: a line for each user, in order of time."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("line_id"), F.col("event_type").alias("mtfcc"), "ts", "event_id", (F.col("value") * 100).alias("x"), (k * 100).alias("y"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urban areas ``(uac_code, name_orig, aland)``: nations, with land for each customer."""
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    land = table(spark, sf_dir, "customer", "c_nationkey").groupBy("c_nationkey").agg((F.count("*") * 1_000_000).alias("aland"))
    rows = n.join(land, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("uac_code"), F.col("n_name").alias("name_orig"), F.col("aland").cast("string").alias("aland"))


def metro_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metros ``(metro_idx, metro_id, name, x, y, radius_km, pops, dcs)``."""
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    dcs = table(spark, sf_dir, "supplier", "s_nationkey").groupBy("s_nationkey").agg(F.count("*").cast("int").alias("dcs"))
    k = F.col("n_nationkey")
    return n.join(dcs, k == F.col("s_nationkey"), "left").select(
        (k + 1).alias("metro_idx"), F.lpad(k.cast("string"), 2, "0").alias("metro_id"), F.col("n_name").alias("name"),
        (200000 * (k % 5) + 1000 * ((7 * k) % 13)).cast("double").alias("x"),
        (150000 * F.floor(k / 5) + 1000 * ((11 * k) % 17)).cast("double").alias("y"),
        (10 + k % 7).cast("double").alias("radius_km"), (1 + k % 4).cast("int").alias("pops"), F.coalesce("dcs", F.lit(0)).alias("dcs"),
    )


def dc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data centres ``(dc_pos, metro_idx, metro, dc_idx, x, y, mw)``."""
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    m = metro_table(spark, sf_dir).select("metro_idx", F.col("name").alias("metro"), "x", "y")
    rows = s.join(m, F.col("s_nationkey") + 1 == F.col("metro_idx"))
    own = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    return rows.select(
        F.col("s_suppkey").alias("dc_pos"), "metro_idx", "metro", F.row_number().over(own).alias("dc_idx"), "x", "y", (100 + F.col("s_suppkey") % 50).cast("double").alias("mw")
    )


def kinds(spark: SparkSession) -> DataFrame:
    """Priority classes."""
    return traffic.classes(spark, RATIOS)


def corridor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct corridors ``(metro_a, metro_b, length_km)`` between near metros."""
    near = metros.neighbours(metro_table(spark, sf_dir), 3, 600.0)
    return near.select(F.col("a").alias("metro_a"), F.col("b").alias("metro_b"), (F.col("euclidean_km") * 1.25).alias("length_km"))


def corridor_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paths and their edges: index 0 runs over the pair's own edge, index 1 over each metro that both are joined to."""
    direct = corridor_pairs(spark, sf_dir)
    edge = lambda a, b: F.concat_ws("-", F.least(a, b), F.greatest(a, b))
    sides = F.explode(F.array(F.struct(F.col("metro_a").alias("u"), F.col("metro_b").alias("v")), F.struct(F.col("metro_b").alias("u"), F.col("metro_a").alias("v"))))
    both = direct.select(sides.alias("e"), "length_km").select("e.*", "length_km")
    via = both.toDF("metro_a", "m", "first_km").join(both.toDF("m", "metro_b", "second_km"), "m").where("metro_a < metro_b")
    via = via.select("metro_a", "metro_b", "m", (F.col("first_km") + F.col("second_km")).alias("length_km"))
    via = via.withColumn("path_index", F.row_number().over(W.partitionBy("metro_a", "metro_b").orderBy("length_km", "m")))
    paths = direct.select("metro_a", "metro_b", F.lit(0).alias("path_index"), "length_km").union(via.select("metro_a", "metro_b", "path_index", "length_km"))
    own = direct.select("metro_a", "metro_b", F.lit(0).alias("path_index"), F.lit(0).alias("pos"), edge("metro_a", "metro_b").alias("edge_id"))
    hops = F.posexplode(F.array(edge("metro_a", "m"), edge("m", "metro_b")))
    return paths, own.union(via.select("metro_a", "metro_b", "path_index", hops.alias("pos", "edge_id")))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hardware ``(name, ports, capacity)``."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    return p.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_size").alias("ports"), (F.col("p_size") * 100).cast("double").alias("capacity"))


METROS = """metros AS (
  SELECT n_nationkey + 1 AS metro_idx, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS metro_id, n_name AS name,
    CAST(200000 * (n_nationkey % 5) + 1000 * ((7 * n_nationkey) % 13) AS DOUBLE) AS x,
    CAST(150000 * (n_nationkey // 5) + 1000 * ((11 * n_nationkey) % 17) AS DOUBLE) AS y,
    CAST(10 + n_nationkey % 7 AS DOUBLE) AS radius_km, 1 + n_nationkey % 4 AS pops,
    CAST(coalesce((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey), 0) AS INT) AS dcs
  FROM nation)"""

DCS = METROS + """, dcs AS (
  SELECT s_suppkey AS dc_pos, metro_idx, name AS metro, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS dc_idx,
    x, y, CAST(100 + s_suppkey % 50 AS DOUBLE) AS mw
  FROM supplier JOIN metros ON s_nationkey + 1 = metro_idx),
kinds(priority, ratio) AS (VALUES (0, CAST(0.5 AS DOUBLE)), (1, CAST(0.25 AS DOUBLE)), (2, CAST(0.25 AS DOUBLE)))"""

PAIRS = METROS + """, near AS (
  SELECT a.metro_id AS a, b.metro_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 1000 AS km
  FROM metros a JOIN metros b ON a.metro_id <> b.metro_id),
listed AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY km, b) AS r FROM near WHERE km <= 600),
direct AS (SELECT a AS metro_a, b AS metro_b, km * 1.25::DOUBLE AS length_km, km AS euclidean_km FROM listed WHERE r <= 3 AND a < b)"""

PATHS = PAIRS + """, sides AS (
  SELECT metro_a AS u, metro_b AS v, length_km FROM direct UNION ALL SELECT metro_b, metro_a, length_km FROM direct),
via AS (
  SELECT f.u AS metro_a, g.v AS metro_b, f.v AS m, f.length_km + g.length_km AS length_km,
    row_number() OVER (PARTITION BY f.u, g.v ORDER BY f.length_km + g.length_km, f.v) AS path_index
  FROM sides f JOIN sides g ON f.v = g.u WHERE f.u < g.v),
paths AS (
  SELECT metro_a, metro_b, 0 AS path_index, length_km FROM direct
  UNION ALL SELECT metro_a, metro_b, CAST(path_index AS INT), length_km FROM via),
path_edges AS (
  SELECT metro_a, metro_b, 0 AS path_index, metro_a || '-' || metro_b AS edge_id FROM direct
  UNION ALL SELECT metro_a, metro_b, path_index, least(metro_a, m) || '-' || greatest(metro_a, m) FROM via
  UNION ALL SELECT metro_a, metro_b, path_index, least(m, metro_b) || '-' || greatest(m, metro_b) FROM via),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metro_a, metro_b ORDER BY length_km, path_index) AS r FROM paths) WHERE r = 1)"""


def roads_sql(snap: float) -> str:
    """CTE ``edges(ax, ay, bx, by, length_km)`` of the snapped road graph."""
    return f"""pts AS (
  SELECT user_id, ts, event_id, CAST(round_even(CAST(value * 100 AS DOUBLE) / {snap}::DOUBLE, 0) AS BIGINT) AS gx,
    CAST(round_even(CAST(json_extract(props, '$.k') AS DOUBLE) * 100 / {snap}::DOUBLE, 0) AS BIGINT) AS gy
  FROM events WHERE event_type IN ('view', 'click')),
steps AS (
  SELECT gx, gy, lead(gx) OVER w AS hx, lead(gy) OVER w AS hy FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ways AS (
  SELECT CASE WHEN (gx, gy) < (hx, hy) THEN gx ELSE hx END AS ax, CASE WHEN (gx, gy) < (hx, hy) THEN gy ELSE hy END AS ay,
    CASE WHEN (gx, gy) < (hx, hy) THEN hx ELSE gx END AS bx, CASE WHEN (gx, gy) < (hx, hy) THEN hy ELSE gy END AS "by",
    sqrt(CAST((gx - hx) * (gx - hx) + (gy - hy) * (gy - hy) AS DOUBLE)) * {snap}::DOUBLE / 1000 AS km
  FROM steps WHERE hx IS NOT NULL AND (gx <> hx OR gy <> hy)),
edges AS (SELECT ax, ay, bx, "by", min(km) AS length_km FROM ways GROUP BY ALL)"""


def road_edges(spark: SparkSession, sf_dir: str, snap: float) -> DataFrame:
    """The snapped road graph of the kept classes."""
    points = roads.keep_classes(road_points(spark, sf_dir), ROAD_CLASSES)
    return roads.snapped_edges(points, snap, order=("ts", "event_id"))


def road_graph(spark: SparkSession, sf_dir: str, snap: float) -> DataFrame:
    """The road graph with one column for each end: ``(a, b, length_km)``, ends as ``x_y``."""
    e = road_edges(spark, sf_dir, snap)
    return e.select(F.concat_ws("_", "ax", "ay").alias("a"), F.concat_ws("_", "bx", "by").alias("b"), "length_km")


