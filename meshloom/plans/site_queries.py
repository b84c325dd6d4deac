"""Queries on the site graph, its expansion, flows over it, and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import audits, expand, flows, sites
from meshloom.plans import inputs
from meshloom.plans.inputs import METROS, PAIRS
from meshloom.plans.traffic_queries import DEMANDS, _demands
from meshloom.session import cut

STRIPES = 4
#: Optics by role pair, of the query: both ways, one way, and one of an unknown component.
OPTICS = (("core|core", "29"), ("dc-core", "7"), ("core-dc", "none"))


def _named(rows):
    return rows.select("u", "v", "edge_key", "link_type", "base_capacity", "cost", "adjacency_id", "source_metro", "target_metro")


def _nodes(spark, d):
    return sites.nodes(inputs.metro_table(spark, d))


def _positions(spark, d):
    return sites.positions(inputs.metro_table(spark, d)).select("node", F.round("pos_x", 3).alias("pos_x"), F.round("pos_y", 3).alias("pos_y"))


def _intra(spark, d):
    return sites.intra_metro_edges(inputs.metro_table(spark, d))


def _dc_pop(spark, d):
    return sites.dc_pop_edges(inputs.metro_table(spark, d))


def _inter(mode, stripes=0):
    def run(spark, d):
        return sites.inter_metro_edges(inputs.corridor_pairs(spark, d), inputs.metro_table(spark, d), mode, stripes=stripes)

    return run


def _edges(spark, d):
    return _intra(spark, d).union(_dc_pop(spark, d)).union(_inter("mesh")(spark, d))


def _devices(spark, d):
    p = inputs.table(spark, d, "part", "p_partkey", "p_brand")
    return p.select(F.col("p_brand").alias("blueprint"), F.concat(F.lit("leaf"), "p_partkey").alias("device"))


def _stripes(spark, d):
    return sites.stripes_by_width(_devices(spark, d), 5, check=False).select("blueprint", "device", F.col("place").cast("long").alias("place"), "stripe")


def _stripe_rules(spark, d):
    first = _nodes(spark, d).where("kind = 'pop' AND ordinal = 1").select("node", F.concat(F.lit("Brand#"), "metro_idx").alias("blueprint"))
    return sites.stripe_rules(_stripes(spark, d), first, "stripe_w5")


def _site_table(spark, d):
    kind = F.when(F.col("kind") == "dc", "DCRegion").when(F.col("metro_idx") % 3 == 0, "Clos_L16_S4").when(F.col("metro_idx") % 3 == 1, "FullMesh4").otherwise("SingleRouter")
    return _nodes(spark, d).select("node", kind.alias("blueprint"))


def _blueprint_nodes(spark, d):
    groups, _ = expand.blueprint_tables(spark)
    return expand.nodes(_site_table(spark, d), groups)


#: Blueprints that suppliers' sites have in turn.
TURNS = ("SingleRouter", "FullMesh4", "Clos_L16_S4", "DragonFly_CustomG4", "Dragonfly_A3H2G7")


def _supplier_sites(spark, d):
    k = F.col("s_suppkey")
    return inputs.table(spark, d, "supplier", "s_suppkey").select(F.concat(F.lit("site"), k).alias("node"), F.element_at(F.array(*map(F.lit, TURNS)), (k % len(TURNS) + 1).cast("int")).alias("blueprint"))


def _group_view(spark, d):
    """Pairs of linked groups of the blueprints that sites have, and how many sites."""
    used = _supplier_sites(spark, d).groupBy("blueprint").agg(F.count("*").alias("n_sites"))
    return expand.group_view(*expand.blueprint_tables(spark)).join(used, "blueprint")


def _inner_counts(spark, d):
    """Links within all sites of a blueprint, expanded and counted."""
    groups, links = expand.blueprint_tables(spark)
    own = _supplier_sites(spark, d)
    found = expand.inner_links(own, groups, links).join(own.withColumnRenamed("node", "site"), "site")
    return found.groupBy("blueprint").agg(F.count_distinct("site").alias("n_sites"), F.count("*").alias("n_links"))


def _site_view(spark, d):
    groups, _ = expand.blueprint_tables(spark)
    return expand.site_view("metro4/pop1", expand.nodes(_site_table(spark, d), groups), _blueprint_links(spark, d))[1]


def _blueprint_links(spark, d):
    groups, links = expand.blueprint_tables(spark)
    return expand.inner_links(_site_table(spark, d), groups, links)


CORE = ["core", "spine", "dc"]


def _site_links(spark, d):
    return expand.site_links(_edges(spark, d), _blueprint_nodes(spark, d), CORE)


def _link_counts(spark, d):
    groups, _ = expand.blueprint_tables(spark)
    return expand.link_counts(_edges(spark, d), _site_table(spark, d), groups, CORE)


def _per_link(spark, d):
    return expand.per_link_capacity(_edges(spark, d), _link_counts(spark, d)).select("edge_key", "base_capacity", "n_links", "capacity")


def _roles(spark, d):
    return _nodes(spark, d).select("node", F.when(F.col("kind") == "dc", "dc").otherwise("core").alias("role"))


def _links(spark, d):
    return _edges(spark, d).select("edge_key", "u", "v", F.col("base_capacity").alias("capacity"))


def _rules(spark):
    return spark.createDataFrame(OPTICS, "pair string, optic string")


def _optics(spark, d):
    return expand.assign_optics(_links(spark, d), _roles(spark, d), _rules(spark), inputs.components(spark, d))


def _optic_pairs(spark, d):
    return expand.pair_counts(_optics(spark, d))


def _adjacency_roles(spark, d):
    return expand.adjacency_roles(_edges(spark, d).select("adjacency_id", "u", "v"), _roles(spark, d))


def _heaviest(spark, d):
    return expand.heaviest_sites(_site_table(spark, d), _links(spark, d))


def _policies(spark, d):
    p = inputs.table(spark, d, "part", "p_type").distinct().select(F.col("p_type").alias("name"))
    steps = inputs.table(spark, d, "region", "r_regionkey").select(F.element_at(F.array(F.lit("ECONOMY"), F.lit(None), F.lit("PROMO")), (F.col("r_regionkey") % 3 + 1).cast("int")).alias("failure_policy"))
    return expand.used_policies(p, steps, "STANDARD")


def _overlay(spark, d):
    p = inputs.components(spark, d)
    return expand.overlay(p, p.where("CAST(name AS BIGINT) % 10 = 0").withColumn("ports", F.col("ports") + 1000))


def _ranges(spark, d):
    n = inputs.metro_table(spark, d).select(F.concat(F.lit("metro"), "metro_idx", F.lit("/pop[1-"), "pops", F.lit("]/x")).alias("name"))
    return expand.expand_ranges(n.union(inputs.table(spark, d, "nation", "n_name")))


def _assigned(mode):
    def run(spark, d):
        k = F.col("n_nationkey")
        values = lambda p, n: F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(p), i.cast("string")))
        rules = inputs.table(spark, d, "nation", "n_nationkey").select(k.alias("rule"), F.create_map(F.lit("a"), values("p", k % 4), F.lit("b"), values("q", k % 3 + 1)).alias("vars"))
        return expand.assignments(rules, mode).select("rule", expand.fill(F.lit("x{a}/y{b}/{c}"), F.col("values")).alias("name"))

    return run


def _flow_demands(spark, d):
    return flows.metro_demands(_demands(spark, d))


def _loads_of(spark, d):
    return cut(flows.ecmp_loads(flows.flow_edges(_edges(spark, d)), _flow_demands(spark, d)))


def _loads(spark, d):
    return _loads_of(spark, d).select("edge_key", "way", F.round("load", 6).alias("load"))


def _sized_of(spark, d):
    return flows.size_corridors(_edges(spark, d), _loads_of(spark, d))


def _sized(spark, d):
    return _sized_of(spark, d).select("edge_key", "base_capacity")


def _sized_local(spark, d):
    return flows.size_local(_edges(spark, d), _sized_of(spark, d)).select("edge_key", "link_type", "base_capacity")


def _egress(spark, d):
    return flows.pop_egress(_sized_of(spark, d))


def _change(spark, d):
    before = _inter("mesh")(spark, d)
    return flows.capacity_change(before, _sized_of(spark, d)).select("source_metro", "target_metro", "before", "after", "delta", F.round("factor", 6).alias("factor"))


def _hardware(spark, d):
    return _nodes(spark, d).select("node", (F.col("metro_idx") * 7 + F.col("ordinal")).cast("string").alias("component"), F.lit(2).alias("n"))


def _audit_isolated(spark, d):
    return audits.isolated(_nodes(spark, d), _links(spark, d).where("u LIKE '%1' AND v LIKE '%1'"))


def _audit_refs(spark, d):
    uses = inputs.table(spark, d, "orders", "o_custkey").select(F.nullif((F.col("o_custkey") + 20) % 1600, F.lit(0)).alias("name"))
    return audits.references(uses, inputs.table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("name")), "name")


def _audit_pairing(spark, d):
    m = inputs.metro_table(spark, d)
    pops = m.where("metro_idx % 5 <> 0").select("metro_idx", "name")
    dcs = m.where("dcs > 0").select("metro_idx", F.when(F.col("metro_idx") % 7 == 0, F.lit("other")).otherwise(F.col("name")).alias("name"))
    return audits.pairing(pops, dcs)


def _audit_coordinates(spark, d):
    m = inputs.metro_table(spark, d)
    return audits.coordinates(m.select("name", (F.col("x") + F.when(F.col("metro_idx") % 4 == 0, 1.0).otherwise(0.0)).alias("x"), "y"), m)


def _audit_required(spark, d):
    k = F.col("s_suppkey")
    dcs = inputs.table(spark, d, "supplier", "s_suppkey").select(k, F.when(k % 3 > 0, k).alias("mw"), F.when(k % 4 > 0, k).alias("capacity"))
    return audits.required(dcs, "s_suppkey", "mw", "capacity")


def _audit_demands(spark, d):
    k = F.col("s_suppkey")
    bad = F.when(k % 5 == 0, F.lit(0.0)).when(k % 5 == 1, F.lit(float("nan"))).when(k % 5 == 2, F.lit(-1.0)).when(k % 5 == 3, k.cast("double"))
    return audits.positive_demands(inputs.table(spark, d, "supplier", "s_suppkey").select(F.concat(F.lit("s"), k).alias("source_path"), F.lit("t").alias("sink_path"), bad.alias("demand")))


def _dc_limits(spark, d):
    dcs = inputs.dc_table(spark, d)
    return dcs.select(F.concat(F.lit("metro"), "metro_idx", F.lit("/dc"), "dc_idx").alias("dc"), (F.col("mw") * 10 - F.when(F.col("dc_pos") % 2 == 0, 1000).otherwise(0)).alias("capacity"))


def _dc_balance(spark, d):
    return audits.dc_balance(_dc_limits(spark, d), _demands(spark, d)).select("dc", "capacity", F.round("egress", 6).alias("egress"), F.round("ingress", 6).alias("ingress"))


def _audit_dc(spark, d):
    return audits.dc_capacity(_dc_limits(spark, d), _demands(spark, d))


def _audit_capacity(spark, d):
    return audits.hardware_capacity(_hardware(spark, d), _links(spark, d), inputs.components(spark, d))


def _audit_presence(spark, d):
    nodes = _hardware(spark, d).withColumn("component", F.when(F.col("node").endswith("2"), None).when(F.col("node").endswith("3"), F.lit("x")).otherwise(F.col("component")))
    return audits.hardware_presence(nodes, inputs.components(spark, d))


def _audit_ports(spark, d):
    return audits.ports(_hardware(spark, d), _links(spark, d), _roles(spark, d), _rules(spark), inputs.components(spark, d))


def _audit_optics(spark, d):
    rules = spark.createDataFrame([("core|core", "29"), ("dc-core", "none")], "pair string, optic string")
    modules = F.when(F.col("edge_key").endswith("1"), 0).otherwise(9).alias("n_modules")
    return audits.optics(_links(spark, d).select("*", modules), _roles(spark, d), rules, inputs.components(spark, d))


def _audit_empty(spark, d):
    rules = inputs.metro_table(spark, d).select(F.col("metro_idx").alias("rule"))
    return audits.empty_expansions(rules, _nodes(spark, d).where("kind = 'pop' AND ordinal = 3").select(F.col("metro_idx").alias("rule")))


def _audit_roles(spark, d):
    return audits.missing_roles(_roles(spark, d).withColumn("role", F.when(F.col("role") == "core", F.col("role"))))


def _audit_all(spark, d):
    return audits.combine(_audit_isolated(spark, d), _audit_dc(spark, d), _audit_capacity(spark, d), _audit_ports(spark, d)).groupBy("audit").agg(F.count("*").alias("n_issues"))


QUERIES = {
    "site_nodes": _nodes, "site_positions": _positions, "intra_metro_edges": _intra, "dc_pop_edges": _dc_pop, "inter_metro_mesh": _inter("mesh"),
    "inter_metro_one_to_one": _inter("one_to_one"), "inter_metro_striped": _inter("mesh", STRIPES), "stripe_groups": _stripes, "stripe_rules": _stripe_rules,
    "blueprint_nodes": _blueprint_nodes, "blueprint_links": _blueprint_links, "blueprint_groups": _group_view, "blueprint_link_counts": _inner_counts, "site_view": _site_view, "site_links": _site_links, "link_counts": _link_counts, "per_link_capacity": _per_link,
    "optic_assignment": _optics, "optic_pairs": _optic_pairs, "adjacency_roles": _adjacency_roles, "heaviest_sites": _heaviest, "used_policies": _policies, "library_overlay": _overlay, "range_names": _ranges, "assign_zip": _assigned("zip"),
    "assign_product": _assigned("cartesian"), "metro_demands": _flow_demands, "ecmp_loads": _loads, "sized_corridors": _sized, "sized_local_links": _sized_local,
    "pop_egress": _egress, "capacity_change": _change, "audit_isolated": _audit_isolated, "audit_refs": _audit_refs, "audit_pairing": _audit_pairing,
    "audit_coordinates": _audit_coordinates, "audit_required": _audit_required, "audit_demands": _audit_demands, "dc_balance": _dc_balance, "audit_dc_capacity": _audit_dc,
    "audit_hw_capacity": _audit_capacity, "audit_hw_presence": _audit_presence, "audit_ports": _audit_ports, "audit_optics": _audit_optics, "audit_empty": _audit_empty,
    "audit_roles": _audit_roles, "audit_counts": _audit_all,
}

_SITES = PAIRS + """, nodes AS (
  SELECT 'metro' || metro_idx || '/pop' || o AS node, metro_idx, 'pop' AS kind, CAST(o AS INT) AS ordinal FROM metros, LATERAL (SELECT unnest(range(1, pops + 1)) AS o)
  UNION ALL SELECT 'metro' || metro_idx || '/dc' || o, metro_idx, 'dc', CAST(o AS INT) FROM metros, LATERAL (SELECT unnest(range(1, dcs + 1)) AS o))"""


def _arc(i: str, j: str) -> str:
    delta = f"((abs({i} - ({j})) % pops + pops) % pops)"
    return f"CASE WHEN pops <= 1 OR radius_km <= 0 THEN 1 ELSE CAST(ceil(least({delta}, pops - {delta}) * (2 * pi() * radius_km / pops)) AS BIGINT) END"


_INTRA = f"""intra AS (
  SELECT 'metro' || metro_idx || '/pop' || i AS u, 'metro' || metro_idx || '/pop' || j AS v, 'intra_metro:' || name || ':' || i || '-' || j AS edge_key,
    'intra_metro' AS link_type, 400.0::DOUBLE AS base_capacity, CAST({_arc("i", "j")} AS BIGINT) AS cost, 'intra_metro:' || name AS adjacency_id, name AS source_metro, name AS target_metro
  FROM metros, LATERAL (SELECT unnest(range(1, pops + 1)) AS i), LATERAL (SELECT unnest(range(1, pops + 1)) AS j) WHERE i < j)"""

_DC_POP = f"""dc_pop AS (
  SELECT 'metro' || metro_idx || '/dc' || dc AS u, 'metro' || metro_idx || '/pop' || pop AS v, 'dc_to_pop:' || name || ':' || dc || '-' || pop AS edge_key, 'dc_to_pop' AS link_type,
    800.0::DOUBLE AS base_capacity,
    CAST(greatest(1, least({_arc("pop", "CAST(floor(place) AS BIGINT) % pops + 1")}, {_arc("pop", "CAST(ceil(place) AS BIGINT) % pops + 1")})) AS BIGINT) AS cost,
    'dc_to_pop:' || name AS adjacency_id, name AS source_metro, name AS target_metro
  FROM metros, LATERAL (SELECT unnest(range(1, dcs + 1)) AS dc), LATERAL (SELECT unnest(range(1, pops + 1)) AS pop), LATERAL (SELECT (dc - 1) * (CAST(pops AS DOUBLE) / dcs) AS place))"""


def _inter_sql(pairing: str, label: str = "''") -> str:
    return f"""inter AS (
  SELECT 'metro' || s.metro_idx || '/pop' || p AS u, 'metro' || t.metro_idx || '/pop' || q AS v, adj || ':' || p || '-' || q AS edge_key, 'inter_metro_corridor' AS link_type,
    1600.0::DOUBLE AS base_capacity, CAST(ceil(length_km) AS BIGINT) AS cost, adj || {label} AS adjacency_id, s.name AS source_metro, t.name AS target_metro
  FROM direct JOIN metros s ON s.metro_id = metro_a JOIN metros t ON t.metro_id = metro_b,
    LATERAL (SELECT 'inter_metro:' || least(s.metro_idx, t.metro_idx) || '-' || greatest(s.metro_idx, t.metro_idx) AS adj),
    LATERAL (SELECT unnest(range(1, s.pops + 1)) AS p), LATERAL (SELECT unnest(range(1, t.pops + 1)) AS q) WHERE {pairing})"""


_EDGES = f"""{_SITES}, {_INTRA}, {_DC_POP}, {_inter_sql("true")},
site_edges AS (SELECT * FROM intra UNION ALL SELECT * FROM dc_pop UNION ALL SELECT * FROM inter),
links AS (SELECT edge_key, u, v, base_capacity AS capacity FROM site_edges),
roles AS (SELECT node, CASE WHEN kind = 'dc' THEN 'dc' ELSE 'core' END AS role FROM nodes),
components AS (SELECT CAST(p_partkey AS VARCHAR) AS name, p_size AS ports, CAST(p_size * 100 AS DOUBLE) AS capacity FROM part),
hardware AS (SELECT node, CAST(metro_idx * 7 + ordinal AS VARCHAR) AS component, 2 AS n FROM nodes),
optics(role_a, role_b, optic) AS (VALUES ('core', 'core', '29'), ('dc', 'core', '7'), ('core', 'dc', 'none')),
attached AS (SELECT node, sum(capacity) AS attached FROM (SELECT u AS node, capacity FROM links UNION ALL SELECT v, capacity FROM links) GROUP BY node)"""

_STRIPES = """striped AS (
  SELECT blueprint, device, place, 'g' || ((place - 1) // 5 + 1) AS stripe FROM (
    SELECT p_brand AS blueprint, 'leaf' || p_partkey AS device, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part))"""

_SUPPLIER_SITES = f"used AS (SELECT list_extract({list(TURNS)}, CAST(s_suppkey % {len(TURNS)} AS INT) + 1) AS blueprint, count(*) AS n_sites FROM supplier GROUP BY 1)"

_EXPANDED = _EDGES + """, blueprints AS (
  SELECT node, CASE WHEN kind = 'dc' THEN 'DCRegion' WHEN metro_idx % 3 = 0 THEN 'Clos_L16_S4' WHEN metro_idx % 3 = 1 THEN 'FullMesh4' ELSE 'SingleRouter' END AS blueprint FROM nodes),
groups(blueprint, grp, n) AS (VALUES ('DCRegion', 'dc', 1), ('SingleRouter', 'core', 1), ('FullMesh4', 'core', 4), ('Clos_L16_S4', 'leaf', 16), ('Clos_L16_S4', 'spine', 4)),
devices AS (
  SELECT node || '/' || grp || '/' || grp || idx AS name, node AS site, grp, grp AS role, CAST(idx AS INT) AS idx
  FROM blueprints JOIN groups USING (blueprint), LATERAL (SELECT unnest(range(1, n + 1)) AS idx)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY grp, idx) - 1 AS k, count(*) OVER (PARTITION BY site) AS n FROM devices WHERE role IN ('core', 'spine', 'dc')),
counts AS (
  SELECT edge_key, CAST(coalesce(greatest(a.n, b.n), 0) AS BIGINT) AS n_links FROM site_edges
  LEFT JOIN (SELECT site, count(*) AS n FROM numbered GROUP BY site) a ON a.site = u LEFT JOIN (SELECT site, count(*) AS n FROM numbered GROUP BY site) b ON b.site = v)"""

_FLOWS = f"""{DEMANDS}, {_EDGES.replace(METROS + ',', '')}, md AS (
  SELECT CAST(regexp_extract(source_path, '^\\^*metro([0-9]+)', 1) AS INT) AS s, CAST(regexp_extract(sink_path, '^\\^*metro([0-9]+)', 1) AS INT) AS t, sum(demand) AS demand
  FROM demands GROUP BY 1, 2 HAVING s <> t),
fe AS (
  SELECT edge_key, 'fwd' AS way, CAST(regexp_extract(u, 'metro([0-9]+)', 1) AS INT) AS a, CAST(regexp_extract(v, 'metro([0-9]+)', 1) AS INT) AS b, cost FROM inter
  UNION ALL SELECT edge_key, 'rev', CAST(regexp_extract(v, 'metro([0-9]+)', 1) AS INT), CAST(regexp_extract(u, 'metro([0-9]+)', 1) AS INT), cost FROM inter),
dist(t, node, d) USING KEY (t, node) AS (
  SELECT DISTINCT t, t, 0::BIGINT FROM md
  UNION
  SELECT x.t, fe.a, min(x.d + cost) FROM dist x JOIN fe ON fe.b = x.node LEFT JOIN recurring.dist r ON r.t = x.t AND r.node = fe.a
  WHERE r.d IS NULL OR x.d + cost < r.d GROUP BY x.t, fe.a),
tight AS (
  SELECT n.t, fe.*, count(*) OVER (PARTITION BY n.t, fe.a) AS fan FROM fe JOIN dist n ON n.node = b JOIN dist f ON f.node = a AND f.t = n.t WHERE cost + n.d = f.d),
hops AS (SELECT t, a, b, count(*) / min(fan) AS share FROM tight GROUP BY t, a, b),
moving(step, t, a, amount) AS (
  SELECT 0, t, s, demand FROM md
  UNION ALL
  SELECT step + 1, t, a, sum(amount) FROM (SELECT m.step, m.t, h.b AS a, m.amount * h.share AS amount FROM moving m JOIN hops h ON h.t = m.t AND h.a = m.a WHERE h.b <> m.t) GROUP BY step, t, a),
loads AS (SELECT edge_key, way, sum(amount / fan) AS load FROM moving m JOIN tight USING (t, a) GROUP BY edge_key, way),
sized AS (
  SELECT inter.* REPLACE (CASE WHEN most > 0 THEN greatest(base_capacity, 3200 * ceil(most * 1.3::DOUBLE / 3200)) ELSE base_capacity END AS base_capacity)
  FROM inter LEFT JOIN (SELECT edge_key, max(load) AS most FROM loads GROUP BY edge_key) USING (edge_key)),
egress AS (SELECT node, sum(base_capacity) AS egress FROM (SELECT u AS node, base_capacity FROM sized UNION ALL SELECT v, base_capacity FROM sized) GROUP BY node)"""

_COLUMNS = "u, v, edge_key, link_type, base_capacity, cost, adjacency_id, source_metro, target_metro"
_LIMITS = DEMANDS + """, limits AS (
  SELECT 'metro' || metro_idx || '/dc' || dc_idx AS dc, mw * 10 - CASE WHEN dc_pos % 2 = 0 THEN 1000 ELSE 0 END AS capacity FROM dcs),
balance AS (
  SELECT coalesce(l.dc, o.dc, i.dc) AS dc, coalesce(capacity, 0) AS capacity, coalesce(egress, 0) AS egress, coalesce(ingress, 0) AS ingress FROM limits l
  FULL JOIN (SELECT regexp_extract(source_path, 'metro[0-9]+/dc[0-9]+') AS dc, sum(demand) AS egress FROM demands GROUP BY 1) o ON o.dc = l.dc
  FULL JOIN (SELECT regexp_extract(sink_path, 'metro[0-9]+/dc[0-9]+') AS dc, sum(demand) AS ingress FROM demands GROUP BY 1) i ON i.dc = coalesce(l.dc, o.dc))"""

_ISOLATED = "SELECT 'isolated' AS audit, node AS key, 'no link' AS message FROM nodes WHERE node NOT IN (SELECT unnest([u, v]) FROM links WHERE u LIKE '%1' AND v LIKE '%1')"
_OVER_DC = """SELECT 'dc_capacity' AS audit, dc AS key, 'egress over capacity' AS message FROM balance WHERE egress > capacity + 1e-9
UNION ALL SELECT 'dc_capacity', dc, 'ingress over capacity' FROM balance WHERE ingress > capacity + 1e-9"""
_OVER_HW = """SELECT 'hw_capacity' AS audit, node AS key, 'more capacity attached than hardware has' AS message
FROM hardware JOIN components ON name = component JOIN attached USING (node) WHERE attached > capacity * n + 1e-9"""
_OVER_PORTS = """SELECT 'ports' AS audit, node AS key, 'needs ' || CAST(need AS BIGINT) || ' ports of ' || have AS message FROM (
  SELECT node, sum(need) AS need FROM (
    SELECT unnest([u, v]) AS node, ceil(l.capacity / c.capacity) * greatest(ports, 1) AS need
    FROM links l JOIN roles a ON a.node = u JOIN roles b ON b.node = v JOIN optics o ON o.role_a = a.role AND o.role_b = b.role JOIN components c ON c.name = optic WHERE c.capacity > 0) GROUP BY node)
  JOIN (SELECT node, ports * n AS have FROM hardware JOIN components ON name = component) USING (node) WHERE need > have"""

SQL = {
    "site_nodes": f"WITH {_SITES} SELECT node, metro_idx, kind, ordinal FROM nodes",
    "site_positions": f"""WITH {_SITES}, r AS (
  SELECT node, x, y, CASE WHEN kind = 'pop' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END * radius_km * 1000 AS r,
    CASE WHEN kind = 'pop' THEN 0 ELSE pi() / 4 END + 2 * pi() * (ordinal - 1) / CASE WHEN kind = 'pop' THEN pops ELSE dcs END AS angle FROM nodes JOIN metros USING (metro_idx))
SELECT node, round(x + r * cos(angle), 3) AS pos_x, round(y + r * sin(angle), 3) AS pos_y FROM r""",
    "intra_metro_edges": f"WITH {METROS}, {_INTRA} SELECT {_COLUMNS} FROM intra",
    "dc_pop_edges": f"WITH {METROS}, {_DC_POP} SELECT {_COLUMNS} FROM dc_pop",
    "inter_metro_mesh": f"WITH {PAIRS}, {_inter_sql('true')} SELECT {_COLUMNS} FROM inter",
    "inter_metro_one_to_one": f"WITH {PAIRS}, {_inter_sql('p = q')} SELECT {_COLUMNS} FROM inter",
    "inter_metro_striped": f"""WITH {PAIRS}, {_inter_sql('true', "':g' || (((p - 1) * t.pops + q - 1) % 4 + 1)")} SELECT {_COLUMNS} FROM inter""",
    "stripe_groups": f"WITH {_STRIPES} SELECT blueprint, device, place, stripe FROM striped",
    "stripe_rules": f"""WITH {_SITES}, {_STRIPES} SELECT '^' || node || '/[^/]+/' || device || '$' AS path, 'stripe_w5' AS attribute, stripe AS label
FROM nodes JOIN striped ON blueprint = 'Brand#' || metro_idx WHERE kind = 'pop' AND ordinal = 1""",
    "blueprint_nodes": f"WITH {_EXPANDED} SELECT name, site, grp, role, idx FROM devices",
    "blueprint_links": f"""WITH {_EXPANDED} SELECT a.site, a.name AS a, b.name AS b FROM devices a JOIN devices b ON a.site = b.site
WHERE (a.grp = 'leaf' AND b.grp = 'spine') OR (a.grp = 'core' AND b.grp = 'core' AND a.idx < b.idx)""",
    "blueprint_groups": f"""WITH v AS (
  SELECT 'FullMesh4' AS blueprint, 'core' AS a, 'core' AS b, 'mesh' AS patterns UNION ALL SELECT 'Clos_L16_S4', 'leaf', 'spine', 'mesh'
  UNION ALL SELECT 'DragonFly_CustomG4', 'leaf' || a, 'leaf' || b, CASE WHEN a = b THEN 'mesh' ELSE 'one_to_one' END FROM unnest(['A', 'B', 'C', 'D']) x(a), unnest(['A', 'B', 'C', 'D']) y(b)
  WHERE a = b OR a || b IN ('AB', 'AD', 'BC', 'CD')
  UNION ALL SELECT 'Dragonfly_A3H2G7', 'G' || a, 'G' || b, CASE WHEN a = b THEN 'mesh' ELSE ((b - a - 1) % 3 + 1) || ':' || (3 - (b - a - 1) % 3) END FROM range(1, 8) x(a), range(1, 8) y(b) WHERE a <= b),
{_SUPPLIER_SITES} SELECT blueprint, a, b, patterns, n_sites FROM v JOIN used USING (blueprint)""",
    "blueprint_link_counts": f"""WITH c(blueprint, n) AS (VALUES ('FullMesh4', 6), ('Clos_L16_S4', 64), ('DragonFly_CustomG4', 40), ('Dragonfly_A3H2G7', 42)),
{_SUPPLIER_SITES} SELECT blueprint, n_sites, CAST(n * n_sites AS BIGINT) AS n_links FROM c JOIN used USING (blueprint)""",
    "site_view": f"""WITH {_EXPANDED} SELECT a.site, a.name AS a, b.name AS b FROM devices a JOIN devices b ON a.site = b.site
WHERE a.site = 'metro4/pop1' AND a.grp = 'core' AND b.grp = 'core' AND a.idx < b.idx""",
    "site_links": f"""WITH {_EXPANDED} SELECT edge_key, a.name AS a, b.name AS b, cost FROM site_edges JOIN numbered a ON a.site = u JOIN numbered b ON b.site = v
WHERE CASE WHEN a.n >= b.n THEN a.k % b.n = b.k ELSE b.k % a.n = a.k END""",
    "link_counts": f"WITH {_EXPANDED} SELECT edge_key, n_links FROM counts",
    "per_link_capacity": f"WITH {_EXPANDED} SELECT edge_key, base_capacity, n_links, CASE WHEN n_links > 0 THEN base_capacity / n_links END AS capacity FROM site_edges JOIN counts USING (edge_key)",
    "optic_assignment": f"""WITH {_EDGES} SELECT edge_key, u, v, role_a, role_b, optic, CAST(ceil(l.capacity / c.capacity) AS BIGINT) AS n_modules
FROM links l JOIN roles a ON a.node = u JOIN roles b ON b.node = v JOIN optics o ON o.role_a = a.role AND o.role_b = b.role JOIN components c ON c.name = optic""",
    "optic_pairs": f"""WITH {_EDGES} SELECT role_a, role_b, count(*) AS n
FROM links l JOIN roles a ON a.node = u JOIN roles b ON b.node = v JOIN optics o ON o.role_a = a.role AND o.role_b = b.role JOIN components c ON c.name = optic GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 3""",
    "adjacency_roles": f"""WITH {_EDGES} SELECT adjacency_id, CAST(CASE WHEN min(a.role) = min(b.role) THEN 1 ELSE 2 END AS BIGINT) AS n_roles, count(DISTINCT a.role || b.role) AS n_pairs,
  min(a.role) AS role_a, min(b.role) AS role_b FROM site_edges JOIN roles a ON a.node = u JOIN roles b ON b.node = v GROUP BY adjacency_id""",
    "heaviest_sites": f"""WITH {_EXPANDED} SELECT blueprint, node, attached FROM (
  SELECT blueprint, node, coalesce(attached, 0) AS attached, row_number() OVER (PARTITION BY blueprint ORDER BY coalesce(attached, 0) DESC, node) AS r FROM blueprints LEFT JOIN attached USING (node)) WHERE r = 1""",
    "used_policies": "SELECT DISTINCT p_type AS name FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'STANDARD')",
    "library_overlay": "SELECT CAST(p_partkey AS VARCHAR) AS name, p_size + CASE WHEN p_partkey % 10 = 0 THEN 1000 ELSE 0 END AS ports, CAST(p_size * 100 AS DOUBLE) AS capacity FROM part",
    "range_names": f"""WITH {METROS} SELECT 'metro' || metro_idx || '/pop' || o || '/x' AS name FROM metros, LATERAL (SELECT unnest(range(1, pops + 1)) AS o)
UNION ALL SELECT n_name FROM nation""",
    "assign_zip": """SELECT n_nationkey AS rule, 'xp' || i || '/yq' || i || '/{c}' AS name FROM nation, LATERAL (SELECT unnest(range(1, least(n_nationkey % 4, n_nationkey % 3 + 1) + 1)) AS i)
UNION ALL SELECT n_nationkey, 'x{a}/y{b}/{c}' FROM nation WHERE n_nationkey % 4 = 0""",
    "assign_product": """SELECT n_nationkey AS rule, 'xp' || i || '/yq' || j || '/{c}' AS name
FROM nation, LATERAL (SELECT unnest(range(1, n_nationkey % 4 + 1)) AS i), LATERAL (SELECT unnest(range(1, n_nationkey % 3 + 2)) AS j)
UNION ALL SELECT n_nationkey, 'x{a}/y{b}/{c}' FROM nation WHERE n_nationkey % 4 = 0""",
    "metro_demands": f"WITH RECURSIVE {_FLOWS} SELECT s, t, demand FROM md",
    "ecmp_loads": f"WITH RECURSIVE {_FLOWS} SELECT edge_key, way, round(load, 6) AS load FROM loads",
    "sized_corridors": f"WITH RECURSIVE {_FLOWS} SELECT edge_key, base_capacity FROM sized",
    "sized_local_links": f"""WITH RECURSIVE {_FLOWS} SELECT edge_key, link_type, greatest(base_capacity, 3200 * ceil(CASE WHEN link_type = 'dc_to_pop' THEN 1.2::DOUBLE * coalesce(b.egress, 0)
  ELSE 0.8::DOUBLE * least(coalesce(a.egress, 0), coalesce(b.egress, 0)) END / 3200)) AS base_capacity
FROM site_edges LEFT JOIN egress a ON a.node = u LEFT JOIN egress b ON b.node = v WHERE link_type <> 'inter_metro_corridor'""",
    "pop_egress": f"WITH RECURSIVE {_FLOWS} SELECT node, egress FROM egress",
    "capacity_change": f"""WITH RECURSIVE {_FLOWS}, b AS (SELECT source_metro, target_metro, sum(base_capacity) AS before FROM inter GROUP BY 1, 2),
a AS (SELECT source_metro, target_metro, sum(base_capacity) AS after FROM sized GROUP BY 1, 2)
SELECT source_metro, target_metro, before, after, after - before AS delta, round(after / before, 6) AS factor FROM b JOIN a USING (source_metro, target_metro)""",
    "audit_isolated": f"WITH {_EDGES} {_ISOLATED}",
    "audit_refs": "SELECT DISTINCT 'reference' AS audit, CAST((o_custkey + 20) % 1600 AS VARCHAR) AS key, 'unknown' AS message FROM orders WHERE (o_custkey + 20) % 1600 <> 0 AND (o_custkey + 20) % 1600 NOT IN (SELECT c_custkey FROM customer)",
    "audit_pairing": f"""WITH {METROS} SELECT 'pairing' AS audit, CAST(metro_idx AS VARCHAR) AS key, CASE WHEN metro_idx % 5 = 0 THEN 'no points of presence' ELSE 'names differ' END AS message
FROM metros WHERE dcs > 0 AND (metro_idx % 5 = 0 OR metro_idx % 7 = 0)""",
    "audit_coordinates": f"WITH {METROS} SELECT 'coordinates' AS audit, name AS key, 'not where the graph has it' AS message FROM metros WHERE metro_idx % 4 = 0",
    "audit_required": """SELECT 'required' AS audit, CAST(s_suppkey AS VARCHAR) AS key, 'no mw' AS message FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'required', CAST(s_suppkey AS VARCHAR), 'no capacity' FROM supplier WHERE s_suppkey % 4 = 0""",
    "audit_demands": "SELECT 'demand' AS audit, 's' || s_suppkey || ' t' AS key, 'not positive' AS message FROM supplier WHERE s_suppkey % 5 <> 3",
    "dc_balance": f"WITH {_LIMITS} SELECT dc, capacity, round(egress, 6) AS egress, round(ingress, 6) AS ingress FROM balance",
    "audit_dc_capacity": f"WITH {_LIMITS} {_OVER_DC}",
    "audit_hw_capacity": f"WITH {_EDGES} {_OVER_HW}",
    "audit_hw_presence": f"""WITH {_EDGES}, h AS (SELECT node, CASE WHEN node LIKE '%2' THEN NULL WHEN node LIKE '%3' THEN 'x' ELSE component END AS component FROM hardware)
SELECT 'hw_presence' AS audit, node AS key, CASE WHEN component IS NULL THEN 'no hardware' ELSE 'unknown hardware' END AS message FROM h WHERE component IS NULL OR component NOT IN (SELECT name FROM components)""",
    "audit_ports": f"WITH {_EDGES} {_OVER_PORTS}",
    "audit_optics": f"""WITH {_EDGES}, bad AS (
  SELECT edge_key, a.role AS role_a, b.role AS role_b, CASE WHEN optic IS NULL THEN 'no optic for roles' WHEN c.capacity IS NULL THEN 'unknown optic'
    WHEN CASE WHEN edge_key LIKE '%1' THEN 0 ELSE 9 END * c.capacity + 1e-9 < l.capacity THEN 'optics too small' END AS kind
  FROM links l JOIN roles a ON a.node = u JOIN roles b ON b.node = v
  LEFT JOIN (VALUES ('core', 'core', '29'), ('dc', 'core', 'none')) o(role_a, role_b, optic) ON o.role_a = a.role AND o.role_b = b.role LEFT JOIN components c ON c.name = optic)
SELECT 'optics' AS audit, role_a || '|' || role_b AS key, kind || ': ' || count(*) || ' (' || array_to_string(list_sort(list(edge_key))[1:3], ', ') || ')' AS message
FROM bad WHERE kind IS NOT NULL GROUP BY kind, role_a, role_b""",
    "audit_empty": f"WITH {METROS} SELECT 'empty' AS audit, CAST(metro_idx AS VARCHAR) AS key, 'expands to nothing' AS message FROM metros WHERE pops < 3",
    "audit_roles": f"""WITH {_SITES}, bare AS (SELECT node FROM nodes WHERE kind = 'dc')
SELECT 'roles' AS audit, 'role' AS key, count(*) || ' nodes without: ' || array_to_string(list_sort(list(node))[1:5], ', ') AS message FROM bare HAVING count(*) > 0""",
    "audit_counts": f"""WITH {_EDGES}, {_LIMITS.replace(METROS + ',', '')}, every AS (
  SELECT audit FROM ({_ISOLATED}) UNION ALL SELECT audit FROM ({_OVER_DC}) UNION ALL SELECT audit FROM ({_OVER_HW}) UNION ALL SELECT audit FROM ({_OVER_PORTS}))
SELECT audit, count(*) AS n_issues FROM every GROUP BY audit""",
}
