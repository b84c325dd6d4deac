"""Queries on metros: selection, names, neighbours, corridors and their shared risks."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.functions import text
from meshloom.functions.numeric import albers, bearing_offset
from meshloom.operators import corridors, graph, integrated, metros, roads
from meshloom.plans import inputs
from meshloom.plans.inputs import METROS, PAIRS, PATHS

PATTERNS = ("nation_1", "NATION_2$")


def _areas(spark, d):
    return metros.with_radius(inputs.areas(spark, d))


def _topk(spark, d):
    return metros.largest(_areas(spark, d), 10).select("sel_pos", "uac_code", "name_orig", F.col("aland").cast("long").alias("aland"))


def _override(spark, d):
    return metros.select(_areas(spark, d), 8, PATTERNS).select("sel_pos", "uac_code", "name_orig", F.col("aland").cast("long").alias("aland"))


def _radius(spark, d):
    return _areas(spark, d).select("uac_code", "land_area_km2", "radius_km")


def _slug(spark, d):
    names = inputs.table(spark, d, "nation", "n_name").union(inputs.table(spark, d, "part", "p_name")).distinct().toDF("raw")
    shown = names.withColumn("raw", F.concat(F.lit(" - Big  "), "raw", F.lit("_--Area's (No. 7), XY"))).withColumn("path", text.path_slug(F.col("raw")))
    return shown.select("raw", text.sanitize(F.col("raw")).alias("name"), text.metro_slug(F.col("raw")).alias("slug"), "path")


def _knn(spark, d):
    return metros.neighbours(inputs.metro_table(spark, d), 3, 600.0).select("a", "b", F.round("euclidean_km", 6).alias("euclidean_km"))


def _knn_symmetric(spark, d):
    return metros.neighbours(inputs.metro_table(spark, d), 2, 600.0, symmetric=True).select("a", "b", F.round("euclidean_km", 6).alias("euclidean_km"))


def _overlap(spark, d):
    m = inputs.metro_table(spark, d).withColumn("radius_km", F.col("radius_km") * 8)
    return metros.overlaps(m).select("a", "b", F.round("euclidean_km", 6).alias("euclidean_km"), "sum_radius_km")


def _duplicate_ids(spark, d):
    p = inputs.table(spark, d, "part", "p_name").select(text.sanitize(F.col("p_name")).alias("metro_id"))
    return metros.duplicate_ids(p)


def _project(spark, d):
    m = inputs.metro_table(spark, d).select("metro_id", (F.lit(-120.0) + F.col("x") / 20000).alias("lon"), (F.lit(28.0) + F.col("y") / 50000).alias("lat"))
    x, y = albers(F.col("lon"), F.col("lat"))
    return m.select("metro_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _bearings(spark, d):
    n = inputs.table(spark, d, "nation", "n_nationkey")
    east, north = bearing_offset(F.col("n_nationkey") * 45.0, F.lit(10.0))
    return n.select("n_nationkey", F.round(east, 6).alias("east"), F.round(north, 6).alias("north"))


def _best_path(spark, d):
    paths, _ = inputs.corridor_paths(spark, d)
    return corridors.best_paths(paths).select("metro_a", "metro_b", "path_index", F.round("length_km", 6).alias("length_km"))


def _path_lengths(spark, d):
    _, edges = inputs.corridor_paths(spark, d)
    direct = inputs.corridor_pairs(spark, d).select(F.concat_ws("-", "metro_a", "metro_b").alias("edge_id"), "length_km")
    return corridors.path_lengths(edges, direct, 600.0).select("metro_a", "metro_b", "path_index", F.round("length_km", 6).alias("length_km"))


def _edge_ends(spark, d):
    m = inputs.metro_table(spark, d).select("metro_id", "x", "y")
    e = inputs.corridor_pairs(spark, d)
    e = e.join(m.toDF("metro_a", "ax", "ay"), "metro_a").join(m.toDF("metro_b", "bx", "by"), "metro_b")
    return e.select(F.concat_ws("-", "metro_a", "metro_b").alias("edge_id"), F.col("ax") + 15000, F.col("ay"), F.col("bx"), F.col("by") + 15000).toDF("edge_id", "ax", "ay", "bx", "by")


def _risk_exclusion(spark, d):
    return corridors.outside_metros(_edge_ends(spark, d), inputs.metro_table(spark, d)).select("edge_id")


def _risks(spark, d):
    _, edges = inputs.corridor_paths(spark, d)
    opened = corridors.outside_metros(_edge_ends(spark, d), inputs.metro_table(spark, d))
    return corridors.risk_groups(edges, inputs.metro_table(spark, d).select("metro_id", "name"), opened)


def _extract(spark, d):
    paths, edges = inputs.corridor_paths(spark, d)
    return corridors.extract(paths, edges, _risks(spark, d), inputs.metro_table(spark, d))


def _corridors(spark, d):
    return _extract(spark, d).select(
        "metro_a", "metro_b", "path_index", F.round("length_km", 6).alias("length_km"), F.round("euclidean_km", 6).alias("euclidean_km"),
        F.round("detour_ratio", 6).alias("detour_ratio"), F.array_join("risk_groups", ",").alias("risk_groups"),
    )


def _risk_distance(spark, d):
    return corridors.risk_distances(_extract(spark, d), inputs.metro_table(spark, d).select("metro_id", "name"))


def _summary(spark, d):
    return corridors.summary(_extract(spark, d)).select("n_corridors", F.round("total_km", 6).alias("total_km"), F.round("avg_km", 6).alias("avg_km"))


def _pairs(spark, d):
    return corridors.distinct_pairs(inputs.corridor_paths(spark, d)[0])


def _corridor_graph(spark, d):
    return inputs.corridor_pairs(spark, d).select(F.col("metro_a").alias("a"), F.col("metro_b").alias("b"), "length_km")


def _every_pair(spark, d):
    ids = inputs.metro_table(spark, d).select("metro_id")
    return ids.toDF("a").join(ids.toDF("b"), F.col("a") < F.col("b"))


def _shortest_all(spark, d):
    return graph.k_shortest_paths(_corridor_graph(spark, d), _every_pair(spark, d)).select("a", "b", F.round("length_km", 6).alias("length_km"), F.array_join("nodes", ">").alias("nodes"))


def _k_paths_all(spark, d):
    return graph.k_shortest_paths(_corridor_graph(spark, d), _every_pair(spark, d), 3, 4000.0).select("a", "b", "path_index", F.round("length_km", 6).alias("length_km"), F.array_join("nodes", ">").alias("nodes"))


def _sparse_graph(spark, d):
    """Corridors to the two nearest metros."""
    near = metros.neighbours(inputs.metro_table(spark, d), 2, 600.0)
    return near.select("a", "b", F.col("euclidean_km").alias("length_km"))


def _articulation(spark, d):
    return graph.articulation_points(_sparse_graph(spark, d))


def _cut_sets(spark, d):
    return graph.cut_sets(_sparse_graph(spark, d), 2, 12).select(F.array_join("nodes", ",").alias("nodes"), "degree")


def _connectivity(spark, d):
    return graph.node_connectivity(_corridor_graph(spark, d)).select("k", F.array_join("nodes", ",").alias("nodes"))


def _geometry_all(spark, d):
    found = graph.k_shortest_paths(_corridor_graph(spark, d), _every_pair(spark, d)).withColumnsRenamed({"a": "metro_a", "b": "metro_b"})
    e = inputs.corridor_pairs(spark, d).toDF("a", "b", "km")
    e = e.select("a", "b", F.concat_ws("~", "a", "b").alias("segment_id"), F.array("a", F.concat_ws("~", "a", "b"), "b").alias("geometry"))
    p = corridors.path_geometry(found, e)
    return p.select("metro_a", "metro_b", F.array_join("segment_ids", ",").alias("segment_ids"), F.array_join("geometry", ">").alias("geometry"))


def _road_nodes(spark, d):
    both = roads.both_ways(inputs.road_edges(spark, d, 1000.0))
    return both.select((F.col("x") * 1000.0).alias("x"), (F.col("y") * 1000.0).alias("y")).distinct()


def _small_metros(spark, d):
    """Metros on the scale of the road graph, some of them on its nodes."""
    return inputs.metro_table(spark, d).withColumn("x", F.rint(F.col("x") / 40000) * 1000).withColumn("y", F.rint(F.col("y") / 40000) * 1000 + 500 * (F.col("metro_idx") % 2))


def _integrated_nodes(spark, d):
    return integrated.nodes(_road_nodes(spark, d), _small_metros(spark, d))


def _integrated_edges_of(spark, d):
    e = inputs.road_edges(spark, d, 1000.0)
    e = e.select(*[(F.col(c) * 1000.0).alias(c) for c in ("ax", "ay", "bx", "by")], "length_km")
    m = _small_metros(spark, d)
    return integrated.edges(e, m, metros.anchors(m, _road_nodes(spark, d), 2.0))


def _integrated_edges(spark, d):
    return _integrated_edges_of(spark, d).withColumn("length_km", F.round("length_km", 6))


def _integrated_checks(spark, d):
    return integrated.checks(_integrated_edges_of(spark, d), _small_metros(spark, d), 100)


def _corridor_checks(spark, d):
    return integrated.corridor_checks(inputs.corridor_pairs(spark, d), inputs.metro_table(spark, d))


QUERIES = {
    "path_geometry": _geometry_all, "integrated_nodes": _integrated_nodes, "integrated_edges": _integrated_edges, "integrated_checks": _integrated_checks,
    "corridor_checks": _corridor_checks, "node_connectivity": _connectivity, "metro_topk": _topk, "metro_override_select": _override, "metro_radius": _radius, "metro_slug": _slug, "metro_knn": _knn, "metro_knn_symmetric": _knn_symmetric,
    "metro_overlap": _overlap, "metro_duplicate_ids": _duplicate_ids, "metro_project": _project, "bearing_points": _bearings,
    "corridor_best_path": _best_path, "corridor_path_lengths": _path_lengths, "risk_exclusion": _risk_exclusion, "risk_groups": _risks,
    "corridors": _corridors, "risk_distance": _risk_distance, "corridor_summary": _summary, "corridor_pairs": _pairs, "corridor_shortest": _shortest_all,
    "corridor_shortest_all": _shortest_all, "corridor_k_paths_all": _k_paths_all, "path_geometry_all": _geometry_all,
    "corridor_k_paths": _k_paths_all, "articulation_points": _articulation, "cut_sets": _cut_sets,
}

_AREAS = """WITH areas AS (
  SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS uac_code, n_name AS name_orig,
    CASE WHEN n > 0 THEN CAST(n * 1000000 AS DOUBLE) END AS aland
  FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON n_nationkey = c_nationkey)"""

_SANITIZE = r"substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(split_part({0}, ',', 1)), '[\s-]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30)"

_ENDS = PATHS + """, ends AS (
  SELECT metro_a || '-' || metro_b AS edge_id, a.x + 15000 AS ax, a.y AS ay, b.x AS bx, b.y + 15000 AS "by"
  FROM direct JOIN metros a ON a.metro_id = metro_a JOIN metros b ON b.metro_id = metro_b),
outside AS (
  SELECT edge_id FROM ends WHERE NOT EXISTS (
    SELECT 1 FROM metros m WHERE sqrt((ax - m.x) * (ax - m.x) + (ay - m.y) * (ay - m.y)) <= 1000 * m.radius_km
      OR sqrt((bx - m.x) * (bx - m.x) + ("by" - m.y) * ("by" - m.y)) <= 1000 * m.radius_km)),
risks AS (
  SELECT DISTINCT edge_id, 'corridor_risk_' || least(a.name, b.name) || '_' || greatest(a.name, b.name)
    || CASE WHEN path_index > 0 THEN '_path' || path_index ELSE '' END AS risk_group
  FROM path_edges JOIN outside USING (edge_id) JOIN metros a ON a.metro_id = metro_a JOIN metros b ON b.metro_id = metro_b),
corridors AS (
  SELECT p.metro_a, p.metro_b, p.path_index, p.length_km,
    sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 1000 AS euclidean_km,
    (SELECT coalesce(list_sort(list(DISTINCT risk_group)), []) FROM path_edges e JOIN risks r ON e.edge_id = r.edge_id
      WHERE e.metro_a = p.metro_a AND e.metro_b = p.metro_b AND e.path_index = p.path_index) AS risk_groups
  FROM best p JOIN metros a ON a.metro_id = p.metro_a JOIN metros b ON b.metro_id = p.metro_b)"""

_DISTANCES = f"""WITH RECURSIVE {PAIRS}, sides AS (
  SELECT metro_a AS u, metro_b AS v, length_km AS w FROM direct UNION ALL SELECT metro_b, metro_a, length_km FROM direct),
dist(a, node, km, nodes) USING KEY (a, node) AS (
  SELECT metro_id, metro_id, CAST(0 AS DOUBLE), metro_id FROM metros
  UNION
  SELECT d.a, v, min(d.km + w), arg_min(d.nodes || '>' || v, (d.km + w, d.nodes || '>' || v))
  FROM dist d JOIN sides ON d.node = u LEFT JOIN recurring.dist r ON r.a = d.a AND r.node = v
  WHERE r.km IS NULL OR (d.km + w, d.nodes || '>' || v) < (r.km, r.nodes) GROUP BY d.a, v)
SELECT a, node AS b, round(km, 6) AS length_km, nodes FROM dist
"""
_SHORTEST_ALL = _DISTANCES + "WHERE a < node"

_SMALL = f"""WITH {inputs.roads_sql(1000)}, {METROS}, small AS (
  SELECT metro_id, round_even(x / 40000, 0) * 1000 AS x, round_even(y / 40000, 0) * 1000 + 500 * (metro_idx % 2) AS y FROM metros),
nodes AS (SELECT ax * 1000.0::DOUBLE AS x, ay * 1000.0::DOUBLE AS y FROM edges UNION SELECT bx * 1000.0::DOUBLE, "by" * 1000.0::DOUBLE FROM edges),
near AS (
  SELECT metro_id, m.x AS mx, m.y AS my, n.x, n.y, sqrt((n.x - m.x) * (n.x - m.x) + (n.y - m.y) * (n.y - m.y)) / 1000 AS km FROM small m, nodes n),
tied AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metro_id ORDER BY km, x, y) AS r FROM near WHERE km <= 2) WHERE r = 1),
every AS (
  SELECT ax * 1000.0::DOUBLE AS ax, ay * 1000.0::DOUBLE AS ay, bx * 1000.0::DOUBLE AS bx, "by" * 1000.0::DOUBLE AS "by", length_km, NULL AS edge_type, NULL AS metro_id FROM edges
  UNION ALL SELECT mx, my, x, y, km, 'metro_anchor', metro_id FROM tied)"""

SQL = {
    "path_geometry_all": f"""WITH p AS (SELECT a, b, string_split(nodes, '>') AS l FROM ({_SHORTEST_ALL}))
SELECT a AS metro_a, b AS metro_b, array_to_string(list_transform(range(1, len(l)), lambda i: least(l[i], l[i + 1]) || '~' || greatest(l[i], l[i + 1])), ',') AS segment_ids,
  l[1] || array_to_string(list_transform(range(1, len(l)), lambda i: '>' || least(l[i], l[i + 1]) || '~' || greatest(l[i], l[i + 1]) || '>' || l[i + 1]), '') AS geometry FROM p""",
    "integrated_nodes": _SMALL + """ SELECT coalesce(n.x, m.x) AS x, coalesce(n.y, m.y) AS y,
  CASE WHEN n.x IS NOT NULL AND m.x IS NOT NULL THEN 'metro+highway' WHEN m.x IS NOT NULL THEN 'metro' END AS node_type, metro_id
FROM nodes n FULL JOIN small m ON n.x = m.x AND n.y = m.y""",
    "integrated_edges": _SMALL + """ SELECT ax, ay, bx, "by", round(length_km, 6) AS length_km, edge_type, metro_id FROM every""",
    "integrated_checks": _SMALL + """ SELECT 'anchor' AS "check", metro_id AS key FROM small WHERE metro_id NOT IN (SELECT metro_id FROM tied)
UNION ALL SELECT 'degree', printf('%.1f_%.1f', x, y) FROM (SELECT ax AS x, ay AS y FROM every UNION ALL SELECT bx, "by" FROM every) GROUP BY x, y HAVING count(*) > 100""",
    "corridor_checks": f"""WITH RECURSIVE {PAIRS}, sides AS (SELECT metro_a AS u, metro_b AS v FROM direct UNION ALL SELECT metro_b, metro_a FROM direct),
reach(a, b) AS (SELECT u, u FROM sides UNION SELECT a, v FROM reach JOIN sides ON b = u),
parts AS (SELECT root, count(*) AS n FROM (SELECT a, min(b) AS root FROM reach GROUP BY a) GROUP BY root)
SELECT (SELECT count(*) FROM metros) AS n_metros, (SELECT count(*) FROM direct) AS n_corridors, (SELECT count(*) FROM metros WHERE metro_id NOT IN (SELECT u FROM sides)) AS n_alone,
  count(*) AS n_components, max(n) AS largest FROM parts""",
    "metro_topk": _AREAS + " SELECT CAST(row_number() OVER (ORDER BY aland DESC NULLS LAST, uac_code) AS INT) AS sel_pos, uac_code, name_orig, CAST(aland AS BIGINT) AS aland FROM areas ORDER BY 1 LIMIT 10",
    "metro_override_select": _AREAS + """, named AS (
  SELECT sel_pos, arg_min(areas, (-coalesce(aland, -1), uac_code)) AS r FROM areas, (VALUES (1, 'nation_1'), (2, 'NATION_2$')) p(sel_pos, pattern)
  WHERE regexp_matches(name_orig, pattern, 'i') GROUP BY sel_pos),
rest AS (SELECT *, row_number() OVER (ORDER BY aland DESC NULLS LAST, uac_code) AS r FROM areas WHERE uac_code NOT IN (SELECT r.uac_code FROM named))
SELECT sel_pos, r.uac_code AS uac_code, r.name_orig AS name_orig, CAST(r.aland AS BIGINT) AS aland FROM named
UNION ALL SELECT CAST(r + 2 AS INT), uac_code, name_orig, CAST(aland AS BIGINT) FROM rest WHERE r <= 6""",
    "metro_radius": _AREAS + " SELECT uac_code, round(aland / 1e6, 3) AS land_area_km2, round(least(sqrt(aland / 1e6 / pi()), 100.0::DOUBLE), 3) AS radius_km FROM areas",
    "metro_slug": f"""WITH names AS (SELECT n_name AS n FROM nation UNION SELECT p_name FROM part),
shown AS (SELECT ' - Big  ' || n || '_--Area''s (No. 7), XY' AS raw FROM names)
SELECT raw, {_SANITIZE.format("raw")} AS name, {_SANITIZE.format("trim(raw)")} AS slug, replace(lower(raw), ' ', '-') AS path FROM shown""",
    "metro_knn": f"WITH {PAIRS} SELECT metro_a AS a, metro_b AS b, round(euclidean_km, 6) AS euclidean_km FROM direct",
    "metro_knn_symmetric": f"WITH {PAIRS} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, round(km, 6) AS euclidean_km FROM listed WHERE r <= 2",
    "metro_overlap": f"""WITH {PAIRS} SELECT a, b, round(km, 6) AS euclidean_km, 8 * (m.radius_km + n.radius_km) AS sum_radius_km
FROM near JOIN metros m ON m.metro_id = a JOIN metros n ON n.metro_id = b WHERE a < b AND km < 8 * (m.radius_km + n.radius_km)""",
    "metro_duplicate_ids": f"SELECT {_SANITIZE.format('p_name')} AS metro_id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "bearing_points": "SELECT n_nationkey, round(10 * sin(radians(n_nationkey * 45.0::DOUBLE)), 6) AS east, round(10 * cos(radians(n_nationkey * 45.0::DOUBLE)), 6) AS north FROM nation",
    "metro_project": f"""WITH {METROS}, k AS (
  SELECT 6378137.0::DOUBLE AS a, 0.006694380022903416::DOUBLE AS e2, sqrt(0.006694380022903416::DOUBLE) AS e),
p AS (
  SELECT radians(23.0::DOUBLE) AS lat, 0 AS w UNION ALL SELECT radians(29.5::DOUBLE), 1 UNION ALL SELECT radians(45.5::DOUBLE), 2),
pq AS (
  SELECT w, (1 - e2) * (sin(lat) / (1 - e2 * sin(lat) * sin(lat)) - ln((1 - e * sin(lat)) / (1 + e * sin(lat))) / (2 * e)) AS q,
    cos(lat) / sqrt(1 - e2 * sin(lat) * sin(lat)) AS m FROM p, k),
c AS (
  SELECT (p1.m * p1.m - p2.m * p2.m) / (p2.q - p1.q) AS n, p1.m * p1.m AS mm, p1.q AS q1, p0.q AS q0
  FROM pq p0, pq p1, pq p2 WHERE p0.w = 0 AND p1.w = 1 AND p2.w = 2),
l AS (SELECT metro_id, -120.0::DOUBLE + x / 20000 AS lon, sin(radians(28.0::DOUBLE + y / 50000)) AS s FROM metros),
q AS (SELECT *, (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) AS q FROM l, k)
SELECT metro_id, round(a * sqrt(mm + n * q1 - n * q) / n * sin(n * (radians(lon) - radians(-96.0::DOUBLE))), 3) AS x,
  round(a * sqrt(mm + n * q1 - n * q0) / n - a * sqrt(mm + n * q1 - n * q) / n * cos(n * (radians(lon) - radians(-96.0::DOUBLE))), 3) AS y
FROM q, c""",
    "corridor_best_path": f"WITH {PATHS} SELECT metro_a, metro_b, CAST(path_index AS INT) AS path_index, round(length_km, 6) AS length_km FROM best",
    "corridor_path_lengths": f"WITH {PATHS} SELECT metro_a, metro_b, CAST(path_index AS INT) AS path_index, round(length_km, 6) AS length_km FROM paths WHERE length_km <= 600",
    "risk_exclusion": f"WITH {_ENDS} SELECT edge_id FROM outside",
    "risk_groups": f"WITH {_ENDS} SELECT edge_id, risk_group FROM risks",
    "corridors": f"""WITH {_ENDS} SELECT metro_a, metro_b, CAST(path_index AS INT) AS path_index, round(length_km, 6) AS length_km,
  round(euclidean_km, 6) AS euclidean_km, round(length_km / euclidean_km, 6) AS detour_ratio, array_to_string(risk_groups, ',') AS risk_groups FROM corridors""",
    "risk_distance": f"""WITH {_ENDS}, own AS (
  SELECT 'corridor_risk_' || least(a.name, b.name) || '_' || greatest(a.name, b.name) AS pair, max(CAST(ceil(length_km) AS BIGINT)) AS own_km
  FROM corridors JOIN metros a ON a.metro_id = metro_a JOIN metros b ON b.metro_id = metro_b GROUP BY 1),
long AS (SELECT unnest(risk_groups) AS risk_group, CAST(ceil(length_km) AS BIGINT) AS km FROM corridors)
SELECT risk_group, max(coalesce(own_km, km)) AS distance_km
FROM long LEFT JOIN own ON pair = regexp_replace(risk_group, '_path[0-9]+$', '') GROUP BY risk_group""",
    "corridor_summary": f"WITH {_ENDS} SELECT count(*) AS n_corridors, round(sum(length_km), 6) AS total_km, round(avg(length_km), 6) AS avg_km FROM corridors",
    "corridor_pairs": f"WITH {PATHS} SELECT DISTINCT least(metro_a, metro_b) AS metro_a, greatest(metro_a, metro_b) AS metro_b FROM paths",
    "corridor_shortest": _SHORTEST_ALL,
    "corridor_shortest_all": _SHORTEST_ALL,
    "articulation_points": f"""WITH RECURSIVE {PAIRS}, sides AS (
  SELECT a AS u, b AS v FROM listed WHERE r <= 2 AND a < b UNION ALL SELECT b, a FROM listed WHERE r <= 2 AND a < b),
nodes AS (SELECT DISTINCT u AS n FROM sides),
reach(gone, node) AS (
  SELECT g.n, (SELECT min(n) FROM nodes WHERE n <> g.n) FROM nodes g
  UNION
  SELECT gone, v FROM reach JOIN sides ON node = u WHERE v <> gone)
SELECT gone AS node FROM reach GROUP BY gone HAVING count(*) < (SELECT count(*) - 1 FROM nodes)""",
    "cut_sets": f"""WITH RECURSIVE {PAIRS}, sides AS (
  SELECT a AS u, b AS v FROM listed WHERE r <= 2 AND a < b UNION ALL SELECT b, a FROM listed WHERE r <= 2 AND a < b),
deg AS (SELECT u AS n, count(*) AS degree FROM sides GROUP BY u),
top AS (SELECT * FROM deg ORDER BY degree DESC, n LIMIT 12),
sets AS (SELECT a.n AS a, b.n AS b, a.degree + b.degree AS degree FROM top a JOIN top b ON a.n < b.n),
reach(a, b, node) AS (
  SELECT a, b, (SELECT min(n) FROM deg WHERE n <> a AND n <> b) FROM sets
  UNION
  SELECT a, b, v FROM reach JOIN sides ON node = u WHERE v <> a AND v <> b)
SELECT a || ',' || b AS nodes, CAST(degree AS BIGINT) AS degree FROM sets JOIN (SELECT a, b, count(*) AS n FROM reach GROUP BY a, b) USING (a, b)
WHERE n < (SELECT count(*) - 2 FROM deg)""",
}

#: Of every pair as well, under the names of the first round.
SQL["path_geometry"] = SQL["path_geometry_all"]
