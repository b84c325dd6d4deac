"""Queries of audits over order lines as links between suppliers and parts, with hardware at their ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import audits, expand
from meshloom.plans import inputs

#: Optic rules by hundreds of parts: both ways, one way, both directions written out, and rules that say nothing.
RULES = "element_at(array('leaf|spine', 'spine|leaf', 'core-leaf', ' leaf - core ', 'core|core', '-leaf', 'edge'), CAST(p_partkey % 7 AS INT) + 1)"


def _links(spark, d):
    """Order lines as links: hardware at both ends, one, or none, by the line's number and part."""
    rows = inputs.table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    return rows.selectExpr(
        "CASE WHEN l_orderkey % 9 = 0 THEN ' ' ELSE concat(l_returnflag, l_orderkey % 50) END AS adjacency_id", "concat('s', l_suppkey) AS u", "concat('p', l_partkey) AS v", "l_quantity * 100 AS capacity",
        "CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_partkey + 100 AS STRING) END AS u_component", "CASE WHEN l_partkey % 2 = 0 THEN 2.0D END AS u_count",
        "CASE WHEN l_partkey % 4 = 0 THEN CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE CAST(l_suppkey AS STRING) END END AS v_component", "1.0D AS v_count",
    )


def _roles(spark, d):
    """Suppliers are leaves, spines or without a role, by nation; parts are cores or leaves, by brand."""
    s = inputs.table(spark, d, "supplier", "s_suppkey", "s_nationkey").selectExpr("concat('s', s_suppkey) AS node", "element_at(array('leaf', 'spine', '', NULL), s_nationkey % 4 + 1) AS role")
    return s.unionByName(inputs.table(spark, d, "part", "p_partkey", "p_size").selectExpr("concat('p', p_partkey) AS node", "CASE WHEN p_size % 5 = 0 THEN 'core' ELSE 'leaf' END AS role"))


def _rules(spark, d):
    return inputs.table(spark, d, "part", "p_partkey", "p_type").selectExpr(f"{RULES} AS pair", "CASE WHEN p_type <> 'PROMO' THEN p_type END AS optic").distinct()


def _few_rules(spark, d):
    return _rules(spark, d).where("pair = 'core-leaf' OR (pair = 'leaf|spine' AND optic = 'ECONOMY')")


def _link_hardware(spark, d):
    return audits.link_hardware(_links(spark, d), _roles(spark, d), _few_rules(spark, d), inputs.components(spark, d))


def _conflicts(spark, d):
    return audits.optic_conflicts(_rules(spark, d))


def _role_hardware(spark, d):
    """Customers as nodes, their segments as roles; segments are mapped to hardware, exempt or not mapped."""
    nodes = inputs.table(spark, d, "customer", "c_custkey", "c_mktsegment").selectExpr(
        "concat('c', c_custkey) AS node", "CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_mktsegment END AS role", "CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey * 2 AS STRING) END AS component"
    )
    mapping = nodes.selectExpr("trim(role) AS role", "CASE WHEN role LIKE 'B%' THEN 'x' WHEN role LIKE 'H%' THEN '' END AS component").where("role <> '' AND role NOT LIKE 'M%'").distinct()
    return audits.role_hardware(nodes, mapping, inputs.components(spark, d))


def _expansions(spark, d):
    """Suppliers as sites and order lines as their links; brands are blueprints, with the sizes of their parts as groups."""
    p = inputs.table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    groups = p.where("p_partkey % 3 = 0 AND p_size < 20").selectExpr("p_brand AS blueprint", "concat('g', p_size % 10) AS grp", "p_size % 4 AS n", "'core' AS role")
    sites = inputs.table(spark, d, "supplier", "s_suppkey").selectExpr("concat('s', s_suppkey) AS node", "concat('Brand#', s_suppkey % 40) AS blueprint")
    lines = inputs.table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    edges = lines.selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS edge_key", "concat('s', l_suppkey) AS u", "concat('s', l_partkey % 200) AS v")
    inner = p.where("p_partkey % 2 = 0").selectExpr(
        "p_brand AS blueprint", "concat('g', p_size % 10) AS src_grp", "concat('g', p_size % 7) AS dst_grp", "element_at(array('mesh', 'one_to_one', '2:1', '0:1'), CAST(p_partkey DIV 2 % 4 AS INT) + 1) AS pattern"
    ).distinct()
    return audits.combine(audits.empty_groups(sites, groups), audits.empty_links(edges, expand.link_counts(edges, sites, groups)), audits.empty_blueprint_links(groups, inner))


QUERIES = {"audit_link_hardware": _link_hardware, "audit_optic_conflicts": _conflicts, "audit_role_hardware": _role_hardware, "audit_expansions": _expansions}

_RULES = """rules AS (
  SELECT DISTINCT (['leaf|spine', 'spine|leaf', 'core-leaf', ' leaf - core ', 'core|core', '-leaf', 'edge'])[p_partkey % 7 + 1] AS pair, p_type AS optic FROM part WHERE p_type <> 'PROMO'),
said AS (
  SELECT 'leaf' AS a, 'spine' AS b, optic FROM rules WHERE pair = 'leaf|spine' UNION SELECT 'spine', 'leaf', optic FROM rules WHERE pair = 'spine|leaf'
  UNION SELECT 'core', 'leaf', optic FROM rules WHERE pair = 'core-leaf' UNION SELECT 'leaf', 'core', optic FROM rules WHERE pair = ' leaf - core '
  UNION SELECT 'core', 'core', optic FROM rules WHERE pair = 'core|core'),
lonely AS (SELECT max(pair) AS pair, max(optic) AS optic FROM rules WHERE pair IN ('leaf|spine', 'spine|leaf') HAVING count(*) = 1),
declared AS (
  SELECT * FROM said UNION SELECT 'spine', 'leaf', optic FROM lonely WHERE pair = 'leaf|spine' UNION SELECT 'leaf', 'spine', optic FROM lonely WHERE pair = 'spine|leaf')"""

_COMPONENTS = "components AS (SELECT CAST(p_partkey AS VARCHAR) AS name, p_size * 100 AS each FROM part)"

SQL = {
    "audit_link_hardware": f"""WITH {_COMPONENTS}, asked(a, b) AS (VALUES ('core', 'leaf'), ('leaf', 'spine'), ('spine', 'leaf')),
ends AS (
  SELECT CASE WHEN l_orderkey % 9 <> 0 THEN l_returnflag || l_orderkey % 50 END AS adj, CASE s_nationkey % 4 WHEN 0 THEN 'leaf' ELSE 'spine' END AS ra, CASE WHEN p_size % 5 = 0 THEN 'core' ELSE 'leaf' END AS rb,
    l_quantity * 100 AS need, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_partkey + 100 AS VARCHAR) END AS uc, CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 1 END AS un,
    CASE WHEN l_partkey % 4 = 0 THEN CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END END AS vc
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE s_nationkey % 4 < 2),
l AS (SELECT e.*, u.each AS ue, v.each AS ve, (ra, rb) IN (SELECT (a, b) FROM asked) AS ua, (rb, ra) IN (SELECT (a, b) FROM asked) AS va FROM ends e LEFT JOIN components u ON u.name = uc LEFT JOIN components v ON v.name = vc),
bad AS (
  SELECT 'hardware only at the target' AS kind, ra || '|' || rb AS key, adj FROM l WHERE uc IS NULL AND vc IS NOT NULL
  UNION ALL SELECT 'hardware only at the source', rb || '|' || ra, adj FROM l WHERE uc IS NOT NULL AND vc IS NULL
  UNION ALL SELECT 'unknown component at the source', ra || '|' || rb, adj FROM l WHERE uc <> '' AND vc IS NOT NULL AND ue IS NULL
  UNION ALL SELECT 'unknown component at the target', rb || '|' || ra, adj FROM l WHERE uc IS NOT NULL AND vc <> '' AND ve IS NULL
  UNION ALL SELECT 'hardware too small', ra || '|' || rb, adj FROM l WHERE uc IS NOT NULL AND vc IS NOT NULL AND (coalesce(ue * un, 0) + 1e-9 < need OR coalesce(ve, 0) + 1e-9 < need)
  UNION ALL SELECT CASE WHEN ua THEN 'no hardware at the source, which a rule asks for' ELSE 'no rule for the source' END, ra || '|' || rb, adj FROM l WHERE uc IS NULL AND vc IS NULL
  UNION ALL SELECT CASE WHEN va THEN 'no hardware at the target, which a rule asks for' ELSE 'no rule for the target' END, rb || '|' || ra, adj FROM l WHERE uc IS NULL AND vc IS NULL)
SELECT 'link_hardware' AS audit, key, kind || ': ' || count(*) || coalesce(' (' || nullif(array_to_string(list_sort(list(DISTINCT adj) FILTER (adj IS NOT NULL))[1:3], ', '), '') || ')', '') AS message FROM bad GROUP BY kind, key""",
    "audit_optic_conflicts": f"""WITH {_RULES} SELECT 'optic_conflicts' AS audit, a || '|' || b AS key, 'conflicting optics ' || array_to_string(list_sort(list(DISTINCT optic)), ', ') AS message
FROM declared GROUP BY a, b HAVING count(DISTINCT optic) > 1""",
    "audit_role_hardware": f"""WITH {_COMPONENTS}, nodes AS (
  SELECT 'c' || c_custkey AS node, c_mktsegment AS role, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey * 2 AS VARCHAR) END AS component FROM customer WHERE c_custkey % 11 <> 0)
SELECT DISTINCT 'role_hardware' AS audit, role AS key, 'no mapping for role' AS message FROM nodes WHERE role LIKE 'M%'
UNION ALL SELECT 'role_hardware', node, CASE WHEN component IS NULL THEN 'no hardware for role ' || role ELSE 'unknown component ' || component END FROM nodes
WHERE role LIKE 'B%' AND (component IS NULL OR component NOT IN (SELECT name FROM components))""",
    "audit_expansions": """WITH size AS (SELECT p_brand AS blueprint, 'g' || p_size % 10 AS grp, sum(p_size % 4) AS n FROM part WHERE p_partkey % 3 = 0 AND p_size < 20 GROUP BY 1, 2),
full_ AS (SELECT DISTINCT blueprint FROM size WHERE n > 0),
sites AS (SELECT 's' || s_suppkey AS node, 'Brand#' || s_suppkey % 40 AS blueprint FROM supplier),
good AS (SELECT node FROM sites JOIN full_ USING (blueprint)),
inner_ AS (SELECT DISTINCT p_brand AS blueprint, 'g' || p_size % 10 AS a, 'g' || p_size % 7 AS b, (['mesh', 'one_to_one', '2:1', '0:1'])[p_partkey // 2 % 4 + 1] AS pattern FROM part WHERE p_partkey % 2 = 0)
SELECT 'expansion' AS audit, node AS key, 'group expands to 0 nodes' AS message FROM sites WHERE node NOT IN (SELECT node FROM good)
UNION ALL SELECT 'expansion', l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'link expands to 0 links (s' || l_suppkey || ' to s' || l_partkey % 200 || ')'
FROM lineitem WHERE 's' || l_suppkey NOT IN (SELECT node FROM good) OR 's' || l_partkey % 200 NOT IN (SELECT node FROM good)
UNION ALL SELECT 'expansion', i.blueprint, 'link expands to 0 links (' || a || ' to ' || b || ', ' || pattern || ')'
FROM inner_ i LEFT JOIN size x ON x.blueprint = i.blueprint AND x.grp = a LEFT JOIN size y ON y.blueprint = i.blueprint AND y.grp = b
WHERE NOT CASE pattern WHEN 'mesh' THEN coalesce(x.n, 0) * (coalesce(y.n, 0) - CASE WHEN a = b THEN 1 ELSE 0 END) > 0 WHEN 'one_to_one' THEN coalesce(x.n, 0) > 0 AND coalesce(y.n, 0) > 0 WHEN '2:1' THEN coalesce(x.n, 0) > 1 AND coalesce(y.n, 0) > 0 ELSE false END""",
}
