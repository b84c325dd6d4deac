"""Queries on the road graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import discover, graph, metros, roads
from meshloom.plans import inputs
from meshloom.plans.inputs import METROS, PAIRS, road_edges, road_graph, roads_sql
from meshloom.session import cut

KM = "round(length_km, 6) AS length_km"


def _road_edges(spark, d):
    return road_edges(spark, d, 1000.0).selectExpr("ax", "ay", "bx", "by", KM)


def _class_counts(spark, d):
    return roads.class_counts(inputs.road_points(spark, d)).select(F.col("mtfcc").alias("road_class"), "n")


def _node_degree(spark, d):
    return roads.degrees(road_edges(spark, d, 1000.0))


def _degree_histogram(spark, d):
    return roads.degree_histogram(road_edges(spark, d, 200.0))


def _components(spark, d):
    return graph.connected_components(road_graph(spark, d, 10.0))


def _component_sizes(spark, d):
    return graph.component_sizes(road_graph(spark, d, 10.0))


def _largest(spark, d):
    return graph.keep_largest(road_graph(spark, d, 10.0)).selectExpr("a", "b", KM)


def _slivers(spark, d):
    return graph.drop_slivers(road_graph(spark, d, 10.0), 1.0).selectExpr("a", "b", KM)


def _fragmentation(spark, d):
    g = road_graph(spark, d, 10.0)
    return graph.fragmentation(g, graph.drop_slivers(g, 1.0)).withColumn("largest_share", F.round("largest_share", 6))


def _contracted(spark, d):
    return graph.contract_chains(road_graph(spark, d, 200.0)).selectExpr("a", "b", KM, "n_edges")


def _contracted_nodes(spark, d):
    return graph.contract_chains(road_graph(spark, d, 200.0)).select("a", "b", "nodes")


def _chain_nodes(spark, d):
    return _contracted_nodes(spark, d).withColumn("nodes", F.array_join("nodes", ">"))


def _anchors(spark, d):
    nodes = roads.both_ways(road_edges(spark, d, 1000.0)).select((F.col("x") * 1000.0).alias("x"), (F.col("y") * 1000.0).alias("y")).distinct()
    m = inputs.metro_table(spark, d).withColumn("x", F.col("x") / 20).withColumn("y", F.col("y") / 20)
    return metros.anchors(m, nodes, 30.0).select("metro_id", "ax", "ay", F.round("distance_km", 6).alias("distance_km"))


def _road_corridors(spark, d):
    anchors = _anchors(spark, d).select("metro_id", F.concat_ws("_", (F.col("ax") / 1000).cast("long"), (F.col("ay") / 1000).cast("long")).alias("node"))
    found = discover.road_corridors(road_graph(spark, d, 1000.0), anchors, inputs.corridor_pairs(spark, d), max_km=100.0)
    return found.select("metro_a", "metro_b", "path_index", F.round("length_km", 6).alias("length_km"))


def _registry(spark, d):
    """Corridors with the roads under them, whose lengths are summed once more along all nodes."""
    anchors = _anchors(spark, d).select("metro_id", F.concat_ws("_", (F.col("ax") / 1000).cast("long"), (F.col("ay") / 1000).cast("long")).alias("node"))
    g = cut(road_graph(spark, d, 1000.0))
    found = cut(discover.registry(g, anchors, inputs.corridor_pairs(spark, d), max_km=100.0))
    key = ["metro_a", "metro_b", "path_index"]
    known = g.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("length_km").alias("km"))
    hops = discover.path_edges(found.select(*key, F.col("road_nodes").alias("nodes"))).join(known, ["a", "b"], "left")
    total = hops.groupBy(*key).agg(F.round(F.sum("km"), 6).alias("road_km"), (F.count("*") - F.count("km")).alias("n_lost"))
    ends = [F.get("road_nodes", F.lit(0)).alias("first_node"), F.element_at("road_nodes", -1).alias("last_node")]
    return found.join(total, key).select(*key, F.round("length_km", 6).alias("length_km"), "road_km", "n_lost", (F.size("road_nodes") - 1 - F.col("n_edges")).alias("n_odd"), *ends)


def _anchor_stats(spark, d):
    return metros.anchor_stats(_anchors(spark, d)).select("n", F.round("avg_km", 6).alias("avg_km"), "max_km")


def _degree_rank(spark, d):
    return graph.degree_rank(road_graph(spark, d, 1000.0), 20)


def _core_numbers(spark, d):
    return graph.core_numbers(road_graph(spark, d, 1000.0))


def _sssp(spark, d):
    g = road_graph(spark, d, 1000.0)
    both = graph.both_ways(g, "a", "b", "length_km").select(F.col("u").alias("a"), F.col("v").alias("b"), F.round(F.col("length_km") * 1e6).cast("long").alias("cost"))
    first = both.select("a").orderBy("a").limit(1).select(F.col("a").alias("source"))
    return graph.shortest_distances(both, first)


QUERIES = {
    "road_edges": _road_edges, "road_class_counts": _class_counts, "node_degree": _node_degree, "degree_histogram": _degree_histogram,
    "components": _components, "component_sizes": _component_sizes, "largest_component": _largest, "sliver_filter": _slivers,
    "fragmentation": _fragmentation, "contracted_edges": _contracted, "contracted_nodes": _contracted_nodes, "chain_nodes": _chain_nodes, "metro_anchor": _anchors,
    "anchor_stats": _anchor_stats, "road_corridors": _road_corridors, "corridor_registry": _registry, "degree_rank": _degree_rank, "core_numbers": _core_numbers, "road_distances": _sssp,
}

_NAMED = """, g AS (SELECT ax || '_' || ay AS a, bx || '_' || "by" AS b, length_km FROM edges),
sym AS (SELECT a AS u, b AS v, length_km FROM g UNION ALL SELECT b, a, length_km FROM g)"""


def _cc(edges: str, name: str = "cc") -> str:
    """Component labels by label propagation over ``edges(u, v)``."""
    return f""", {name}(node, root) AS (
  SELECT u, u FROM {edges} GROUP BY u
  UNION
  SELECT e.v, min(c.root) FROM {name} c JOIN {edges} e ON c.node = e.u JOIN recurring.{name} r ON r.node = e.v
  WHERE c.root < r.root GROUP BY e.v)"""


def _with_cc(snap: float, extra: str, name: str = "cc") -> str:
    return f"WITH RECURSIVE {roads_sql(snap)}{_NAMED}{extra}".replace(f"{name}(node, root) AS", f"{name}(node, root) USING KEY (node) AS")


_ANCHORS = f"""WITH {roads_sql(1000)}, {METROS}, nodes AS (
  SELECT ax * 1000.0::DOUBLE AS x, ay * 1000.0::DOUBLE AS y FROM edges UNION SELECT bx * 1000.0::DOUBLE, "by" * 1000.0::DOUBLE FROM edges),
d AS (
  SELECT metro_id, n.x AS ax, n.y AS ay, sqrt((n.x - m.x / 20) * (n.x - m.x / 20) + (n.y - m.y / 20) * (n.y - m.y / 20)) / 1000 AS km
  FROM metros m, nodes n),
anchors AS (
  SELECT metro_id, ax, ay, round(km, 6) AS distance_km FROM (
    SELECT *, row_number() OVER (PARTITION BY metro_id ORDER BY km, ax, ay) AS r FROM d WHERE km <= 30) WHERE r = 1)"""

SQL = {
    "road_edges": f"""WITH {roads_sql(1000)} SELECT ax, ay, bx, "by", round(length_km, 6) AS length_km FROM edges""",
    "road_class_counts": "SELECT event_type AS road_class, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "node_degree": f"""WITH {roads_sql(1000)} SELECT x, y, count(*) AS degree
FROM (SELECT ax AS x, ay AS y FROM edges UNION ALL SELECT bx, "by" FROM edges) GROUP BY x, y""",
    "degree_histogram": f"""WITH {roads_sql(200)}, deg AS (SELECT x, y, count(*) AS degree
FROM (SELECT ax AS x, ay AS y FROM edges UNION ALL SELECT bx, "by" FROM edges) GROUP BY x, y)
SELECT degree, count(*) AS n_nodes FROM deg GROUP BY degree""",
    "components": _with_cc(10, _cc("sym") + " SELECT node, root FROM cc"),
    "component_sizes": _with_cc(10, _cc("sym") + " SELECT root, count(*) AS n_nodes FROM cc GROUP BY root"),
    "largest_component": _with_cc(10, _cc("sym") + """, top AS (SELECT root FROM cc GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)
SELECT a, b, round(length_km, 6) AS length_km FROM g JOIN cc ON g.a = cc.node WHERE root = (SELECT root FROM top)"""),
    "sliver_filter": f"WITH {roads_sql(10)}{_NAMED} SELECT a, b, round(length_km, 6) AS length_km FROM g WHERE length_km >= 1",
    "fragmentation": _with_cc(10, ", kept AS (SELECT u, v FROM sym WHERE length_km >= 1)" + _cc("kept") + """, s AS (SELECT root, count(*) AS n FROM cc GROUP BY root)
SELECT (SELECT count(DISTINCT u) FROM sym) AS n_before, CAST(sum(n) AS BIGINT) AS n_after, count(*) AS n_components, max(n) AS largest,
  round(max(n) / (SELECT count(DISTINCT u) FROM sym), 6) AS largest_share FROM s"""),
    "contracted_edges": _with_cc(200, """, inner_ AS (SELECT u FROM sym GROUP BY u HAVING count(*) = 2),
il AS (SELECT u, v, length_km FROM sym WHERE u IN (FROM inner_) AND v IN (FROM inner_)
  UNION ALL SELECT u, u, 0 FROM inner_)""" + _cc("il") + """,
tied AS (SELECT g.root, a, b, length_km, ca.node IS NULL AS sa, cb.node IS NULL AS sb FROM (
    SELECT g.*, coalesce(ca.root, cb.root) AS root FROM g LEFT JOIN cc ca ON ca.node = g.a LEFT JOIN cc cb ON cb.node = g.b) g
  LEFT JOIN cc ca ON ca.node = g.a LEFT JOIN cc cb ON cb.node = g.b WHERE g.root IS NOT NULL),
ends AS (SELECT root, a AS e FROM tied WHERE sa UNION ALL SELECT root, b FROM tied WHERE sb),
chains AS (SELECT t.root, min(e) AS a, max(e) AS b, t.km AS length_km, t.n AS n_edges
  FROM (SELECT root, sum(length_km) AS km, count(*) AS n FROM tied GROUP BY root) t JOIN ends USING (root) GROUP BY ALL),
every AS (
  SELECT least(a, b) AS a, greatest(a, b) AS b, length_km, 1 AS n_edges FROM g WHERE a NOT IN (SELECT node FROM cc) AND b NOT IN (SELECT node FROM cc)
  UNION ALL SELECT a, b, length_km, n_edges FROM chains)
SELECT a, b, round(min(length_km), 6) AS length_km, CAST(arg_min(n_edges, (length_km, n_edges)) AS BIGINT) AS n_edges FROM every GROUP BY a, b"""),
    "metro_anchor": _ANCHORS + " SELECT * FROM anchors",
    "anchor_stats": _ANCHORS + " SELECT count(*) AS n, round(avg(distance_km), 6) AS avg_km, max(distance_km) AS max_km FROM anchors",
    "degree_rank": f"WITH {roads_sql(1000)}{_NAMED} SELECT u AS node, count(*) AS degree FROM sym GROUP BY u ORDER BY degree DESC, node LIMIT 20",
    "road_distances": f"""WITH RECURSIVE {roads_sql(1000)}{_NAMED}, s AS (SELECT min(u) AS source FROM sym),
e AS (SELECT u, v, CAST(round(length_km * 1e6) AS BIGINT) AS cost FROM sym),
dist(node, dist) USING KEY (node) AS (
  SELECT source, 0::BIGINT FROM s
  UNION
  SELECT e.v, min(d.dist + e.cost) FROM dist d JOIN e ON d.node = e.u LEFT JOIN recurring.dist r ON r.node = e.v
  WHERE r.dist IS NULL OR d.dist + e.cost < r.dist GROUP BY e.v)
SELECT source, node, dist FROM dist, s""",
    # a node's core is what repeated h-indices of its neighbours' values, from their degrees on, come down to
    "core_numbers": f"""WITH RECURSIVE {roads_sql(1000)}{_NAMED},
c(node, core) USING KEY (node) AS (
  SELECT u, count(*) FROM sym GROUP BY u
  UNION
  SELECT o.node, x.h FROM (
    SELECT u, max(least(core, r)) AS h FROM (
      SELECT s.u, n.core, row_number() OVER (PARTITION BY s.u ORDER BY n.core DESC) AS r FROM sym s JOIN recurring.c n ON n.node = s.v) GROUP BY u) x
  JOIN recurring.c o ON o.node = x.u WHERE x.h < o.core AND EXISTS (SELECT 1 FROM c))
SELECT node, CAST(core AS INT) AS core FROM c""",
    # from each node that stays, along degree-2 nodes to the next that does
    "chain_nodes": f"""WITH RECURSIVE {roads_sql(200)}{_NAMED}, inner_ AS (SELECT u FROM sym GROUP BY u HAVING count(*) = 2),
walk AS (
  SELECT u AS a, u AS prev, v AS cur, [u, v] AS l, length_km AS km, 1 AS n FROM sym WHERE u NOT IN (FROM inner_)
  UNION ALL
  SELECT a, cur, s.v, list_append(l, s.v), km + s.length_km, n + 1 FROM walk w JOIN sym s ON s.u = w.cur AND s.v <> w.prev WHERE w.cur IN (FROM inner_)),
every AS (
  SELECT a, b, length_km AS km, 1 AS n, [a, b] AS l FROM g WHERE a NOT IN (FROM inner_) AND b NOT IN (FROM inner_)
  UNION ALL SELECT a, cur, km, n, l FROM walk WHERE n > 1 AND cur NOT IN (FROM inner_) AND (a < cur OR (a = cur AND l[2] <= l[-2])))
SELECT least(a, b) AS a, greatest(a, b) AS b, array_to_string(arg_min(l, (round(km, 6), n, l)), '>') AS nodes FROM every GROUP BY least(a, b), greatest(a, b)""",
    "road_corridors": f"""WITH RECURSIVE {roads_sql(1000)}{_NAMED}, {PAIRS},
places AS (SELECT DISTINCT u, CAST(split_part(u, '_', 1) AS BIGINT) * 1000.0::DOUBLE AS px, CAST(split_part(u, '_', 2) AS BIGINT) * 1000.0::DOUBLE AS py FROM sym),
reach AS (
  SELECT metro_id, u, px, py, sqrt((px - m.x / 20) * (px - m.x / 20) + (py - m.y / 20) * (py - m.y / 20)) / 1000 AS km FROM metros m, places),
anchors AS (SELECT metro_id, u FROM (SELECT *, row_number() OVER (PARTITION BY metro_id ORDER BY km, px, py) AS r FROM reach WHERE km <= 30) WHERE r = 1),
want AS (SELECT metro_a, metro_b, p.u AS na, q.u AS nb FROM direct JOIN anchors p ON p.metro_id = metro_a JOIN anchors q ON q.metro_id = metro_b WHERE p.u <> q.u),
dist(source, node, km) USING KEY (source, node) AS (
  SELECT DISTINCT na, na, 0::DOUBLE FROM want
  UNION
  SELECT d.source, e.v, min(d.km + e.length_km) FROM dist d JOIN sym e ON d.node = e.u LEFT JOIN recurring.dist r ON r.source = d.source AND r.node = e.v
  WHERE r.km IS NULL OR d.km + e.length_km < r.km GROUP BY d.source, e.v)
SELECT metro_a, metro_b, 0 AS path_index, round(km, 6) AS length_km FROM want JOIN dist ON source = na AND node = nb WHERE km <= 100""",
}
SQL["corridor_registry"] = SQL["road_corridors"].replace(
    "length_km FROM want", "length_km, round(km, 6) AS road_km, 0::BIGINT AS n_lost, 0::BIGINT AS n_odd, na AS first_node, nb AS last_node FROM want"
)
