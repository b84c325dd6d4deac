"""Queries on settings by metro, striping by attribute, blueprint sections, value formats, and further audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom import config
from meshloom.functions import numeric
from meshloom.operators import audits, expand, scenario, settings, sites, traffic
from meshloom.plans import inputs, scenario_queries, site_queries, traffic_queries
from meshloom.plans.inputs import METROS


def _tables(spark, d):
    """Build tables: the configuration's defaults, and overrides of every third metro by name and of every fourth by its original name."""
    base = config.build_tables(spark, config.resolve({"build": {"build_defaults": {"dc_to_pop_link": {"role_pairs": [["dc", "core"], "dc|leaf"]}}}}))
    n = inputs.table(spark, d, "nation", "n_nationkey", "n_name").withColumn("slug", F.replace(F.replace(F.lower("n_name"), F.lit("_")), F.lit(" "), F.lit("-")))
    own, orig = n.where("n_nationkey % 3 = 0"), n.where("n_nationkey % 4 = 1").withColumn("slug", F.concat("slug", F.lit("-area")))
    null = lambda t: F.lit(None).cast(t)
    over = own.select("slug", (5 + F.col("n_nationkey") % 2).cast("int").alias("pops"), null("string").alias("site_blueprint"), (F.col("n_nationkey") % 4).cast("int").alias("dcs"), F.lit("DCLarge").alias("dc_blueprint"))
    over = over.union(orig.select("slug", F.lit(7), F.lit("FullMesh4"), null("int"), null("string")))
    link = lambda rows, family, cap, attrs, width: rows.select(
        "slug", F.lit(family).alias("family"), cap.cast("long").alias("capacity"), null("long").alias("cost"), null("string").alias("mode"), attrs.alias("attrs"),
        null("array<string>").alias("role_pairs"), F.lit(width).cast("int").alias("stripe_width"), null("string").alias("stripe_attribute"),
    )
    links = link(own, "dc_to_pop_link", F.col("n_nationkey") * 100 - 300, F.create_map(F.lit("tier"), F.lit("x"), F.lit("link_type"), F.lit("dc")), 4)
    links = links.union(link(orig, "inter_metro_link", F.lit(900), null("map<string,string>"), None))
    return {**base, "site_overrides": over, "link_overrides": links}


def _metros(spark, d):
    return inputs.metro_table(spark, d).select("metro_idx", "name", F.concat("name", F.lit(" AREA")).alias("name_orig"))


def _settings(spark, d):
    return settings.metro_settings(_metros(spark, d), _tables(spark, d))


def _link_settings(spark, d):
    attrs = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    rows = settings.link_settings(_metros(spark, d), _tables(spark, d))
    return rows.select("metro_idx", "family", "capacity", "cost", "mode", attrs.alias("attrs"), F.array_join("role_pairs", ",").alias("role_pairs"), F.coalesce("stripe_width", F.lit(0)).alias("stripe_width"))


def _problems(spark, d):
    t = _tables(spark, d)
    return settings.problems(settings.metro_settings(_metros(spark, d), t), settings.link_settings(_metros(spark, d), t))


def _unknown(spark, d):
    half = _metros(spark, d).where("metro_idx > 12")
    return settings.unknown_overrides(half, _tables(spark, d)["site_overrides"])


def _striped_dcs(spark, d):
    t = settings.link_settings(_metros(spark, d), _tables(spark, d))
    return sites.striped_dc_edges(sites.dc_pop_edges(inputs.metro_table(spark, d)), t).select("edge_key", "u", "v", "cost", "stripe_attribute")


def _grouped_devices(spark, d):
    p = inputs.table(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_type")
    return p.select(F.col("p_brand").alias("blueprint"), F.concat(F.lit("size"), "p_size").alias("grp"), F.concat(F.lit("leaf"), "p_partkey").alias("device"))


def _labels(spark, d):
    """Every group of an even size has a label; one brand lacks the label of the largest sizes."""
    g = _grouped_devices(spark, d).select("blueprint", "grp").distinct().withColumn("size", F.substring("grp", 5, 9).cast("int"))
    label = F.when((F.col("size") % 2 == 0) & ~((F.col("size") > 40) & (F.col("blueprint") == "Brand#3")), F.concat(F.lit("plane"), F.floor(F.col("size") / 10)))
    return g.select("blueprint", "grp", label.alias("label"))


def _by_attribute(spark, d):
    found = sites.stripes_by_attribute(_grouped_devices(spark, d), _labels(spark, d))
    return found.select("blueprint", "device", F.col("place").cast("long").alias("place"), "stripe")


def _unmatched(spark, d):
    b = inputs.table(spark, d, "part", "p_brand").distinct()
    pairs = b.where("p_brand <> 'Brand#1'").select(F.concat(F.lit("Brand#1-"), "p_brand").alias("pair"), F.lit("Brand#1").alias("left"), F.col("p_brand").alias("right"))
    return sites.unmatched_stripes(sites.stripes_by_attribute(_grouped_devices(spark, d), _labels(spark, d)), pairs)


def _section(spark, d):
    groups, _ = expand.blueprint_tables(spark)
    used = inputs.metro_table(spark, d).select(F.when(F.col("metro_idx") % 2 == 0, "FullMesh4").otherwise("Clos_L16_S4").alias("blueprint"))
    platforms = spark.createDataFrame([("core", "CoreRouter"), ("leaf", "LeafRouter")], "role string, component string")
    return scenario.blueprint_section(groups, used, platforms).fillna({"component": "none", "count": 0})


def _bounds(spark, d):
    return scenario.bounds(inputs.metro_table(spark, d))


def _role_links(spark, d):
    groups, _ = expand.blueprint_tables(spark)
    pops = sites.nodes(inputs.metro_table(spark, d)).where("kind = 'pop'").withColumn("blueprint", F.lit("Clos_L16_S4"))
    edges = sites.intra_metro_edges(inputs.metro_table(spark, d))
    return expand.site_links(edges, expand.nodes(pops.select("node", "blueprint"), groups), ["spine"]).select("edge_key", "a", "b")


def _scenario_links(spark, d):
    found = scenario.links(site_queries._edges(spark, d), site_queries._per_link(spark, d))
    named = [F.element_at("attrs", F.lit(c)).alias(c) for c in ("link_type", "adjacency_id", "source_metro", "target_metro")]
    return found.select("source", "target", F.round("capacity", 6).alias("capacity"), "cost", *named)


def _ruled(spark, d):
    """Devices of all sites, of which the leaves of first sites are striped by rules, four a stripe."""
    groups, _ = expand.blueprint_tables(spark)
    pops = sites.nodes(inputs.metro_table(spark, d)).where("kind = 'pop'").withColumn("blueprint", F.lit("Clos_L16_S4"))
    first = pops.where("ordinal = 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(16))))
    rules = first.select(
        F.lit(1).alias("pos"), F.concat(F.lit("^"), "node", F.lit("/[^/]+/leaf"), "i", F.lit("$")).alias("path"), F.lit("stripe_w4").alias("attribute"),
        F.concat(F.lit("g"), F.floor((F.col("i") - 1) / 4) + 1).alias("label"),
    )
    every = spark.createDataFrame([(0, "/spine/", "plane", "top")], rules.schema)
    return expand.apply_rules(expand.nodes(pops.select("node", "blueprint"), groups), rules.union(every))


def _rule_devices(spark, d):
    return _ruled(spark, d).select("name", *[F.coalesce(F.element_at("attrs", F.lit(c)), F.lit("-")).alias(c) for c in ("role", "stripe_w4", "plane")])


def _matched_links(spark, d):
    edges = sites.intra_metro_edges(inputs.metro_table(spark, d))
    chosen = expand.match([("role", "==", "spine"), ("stripe_w4", "==", "g2")])
    return expand.site_links(edges, _ruled(spark, d), where=chosen).select("edge_key", "a", "b")


def _dc_links(spark, d):
    """Links of data centres, striped in each third metro by four leaves a stripe."""
    m, (groups, _) = inputs.metro_table(spark, d), expand.blueprint_tables(spark)
    placed = sites.nodes(m).withColumn("blueprint", F.lit("Clos_L16_S4"))
    edges = _striped_dcs(spark, d)
    striped = sites.stripes_by_width(sites.devices(groups.where("blueprint = 'Clos_L16_S4'"), ["leaf"]), 4)
    rules = sites.stripe_rules(striped, placed.where((F.col("metro_idx") - 1) % 3 == 0), "stripe")
    own = F.concat(F.lit("stripe_dc_"), F.regexp_extract("path", r"^\^metro([0-9]+)/", 1))
    ruled = expand.apply_rules(expand.nodes(placed.select("node", "blueprint"), groups), rules.select(F.lit(1).alias("pos"), "path", own.alias("attribute"), "label"))
    return expand.striped_links(edges, ruled, ["leaf"]).select("edge_key", "a", "b", "cost")


def _top_weights(spark, d):
    return traffic.heaviest(traffic_queries._bundle_weights(spark, d), 10).select("a_pos", "b_pos", "km", "weight")


def _formats(spark, d):
    p = inputs.table(spark, d, "part", "p_partkey", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.col("p_size"), F.lit("_"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 5 == 1, F.concat("p_size", F.lit(".75"))).when(k % 5 == 2, F.lit("none")).when(k % 5 == 3, F.col("p_size").cast("string"))
    return p.select("p_partkey", numeric.thousands(F.col("p_size") * 1234567.25).alias("shown"), F.coalesce(numeric.whole_number(text), F.lit(-1)).alias("whole"), numeric.float_or_nan(text).alias("number"))


def _hardware(spark, d):
    p = inputs.table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    k = F.col("p_partkey")
    attrs = F.when(k % 4 == 0, F.lit("{}")).when(k % 4 == 1, F.format_string('{"hardware": {"component": "%s", "count": %d}}', "p_brand", "p_size")).when(
        k % 4 == 2, F.format_string('{"hardware": {"component": "%s", "count": "many"}}', "p_brand")
    ).otherwise(F.lit('{"hardware": {"component": " "}}'))
    name, count = numeric.hardware(attrs)
    return p.select("p_partkey", name.alias("component"), count.alias("count"))


def _audit_groups(spark, d):
    groups = scenario_queries._groups(spark, d)
    return audits.combine(audits.no_groups(groups), audits.no_groups(groups.where("radius_km > 1000")))


def _audit_matrices(spark, d):
    matrices = inputs.table(spark, d, "region", "r_regionkey").select(F.concat(F.lit("m"), "r_regionkey").alias("name"))
    region = inputs.table(spark, d, "nation", "n_nationkey", "n_regionkey").where("n_regionkey <> 3")
    found = inputs.table(spark, d, "supplier", "s_nationkey").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("m"), "n_regionkey").alias("matrix"))
    return audits.empty_matrices(matrices, found)


def _audit_hint(spark, d):
    links = sites.intra_metro_edges(inputs.metro_table(spark, d))
    groups = scenario_queries._groups(spark, d)
    return audits.combine(audits.isolation_hint(groups, links), audits.isolation_hint(groups, links.where("cost < 0")))


CONTRACT = "path string, blueprint string, node_type string, metro_name string, metro_id int, location_x double, location_y double, radius_km double, mw_per_dc_region double, color string"


def _audit_contract(spark, d):
    return audits.contract("groups", scenario_queries._groups(spark, d), CONTRACT)


def _audit_stages(spark, d):
    """Three stages: one with issues, one without, and one that fails as a column is missing."""
    m = inputs.metro_table(spark, d)
    found = audits.run_all(spark, {
        "matrices": lambda: _audit_matrices(spark, d),
        "groups": lambda: audits.no_groups(scenario_queries._groups(spark, d)),
        "broken": lambda: audits.required(m, "metro_id", "no_such_column"),
    })
    return found.groupBy("audit").agg(F.count("*").alias("n"))


QUERIES = {
    "metro_settings": _settings, "metro_link_settings": _link_settings, "settings_problems": _problems, "unknown_overrides": _unknown, "dc_stripes": _striped_dcs,
    "stripe_by_attribute": _by_attribute, "stripe_mismatch": _unmatched, "blueprint_section": _section, "metro_bounds": _bounds, "site_links_by_role": _role_links,
    "scenario_links": _scenario_links, "node_rules": _rule_devices, "matched_links": _matched_links, "dc_striped_links": _dc_links, "top_weights": _top_weights, "value_formats": _formats, "node_hardware": _hardware, "audit_groups": _audit_groups, "audit_matrices": _audit_matrices,
    "audit_isolation_hint": _audit_hint, "audit_contract": _audit_contract, "audit_stages": _audit_stages,
}

_SLUG = "replace(replace(lower(name), '_', ''), ' ', '-')"
_SETTINGS = f"""{METROS}, picked AS (
  SELECT *, metro_idx - 1 AS k, CASE WHEN (metro_idx - 1) % 3 = 0 THEN 'own' WHEN (metro_idx - 1) % 4 = 1 THEN 'orig' END AS o FROM metros),
links AS (
  SELECT metro_idx, name, 'intra_metro_link' AS family, 400 AS capacity, 'link_type=intra_metro' AS attrs, '' AS role_pairs, NULL AS stripe_width FROM picked
  UNION ALL SELECT metro_idx, name, 'inter_metro_link', CASE WHEN o = 'orig' THEN 900 ELSE 100 END, 'link_type=inter_metro_corridor', '', NULL FROM picked
  UNION ALL SELECT metro_idx, name, 'dc_to_pop_link', CASE WHEN o = 'own' THEN k * 100 - 300 ELSE 400 END, CASE WHEN o = 'own' THEN 'link_type=dc,tier=x' ELSE 'link_type=dc_to_pop' END,
    'dc|core,dc|leaf', CASE WHEN o = 'own' THEN 4 END FROM picked)"""
_LABELLED = """labelled AS (
  SELECT p_brand AS blueprint, 'leaf' || p_partkey AS device, p_partkey, 'plane' || (p_size // 10) AS stripe FROM part WHERE p_size % 2 = 0 AND NOT (p_size > 40 AND p_brand = 'Brand#3'))"""

_RULED = f"""{site_queries._EDGES}, ruled AS (
  SELECT node AS site, node || '/' || grp || '/' || grp || i AS name, grp AS role, grp AS grp, i, CASE WHEN grp = 'spine' THEN 'top' ELSE '-' END AS plane,
    CASE WHEN grp = 'leaf' AND ends_with(node, '/pop1') THEN 'g' || ((i - 1) // 4 + 1) ELSE '-' END AS stripe_w4
  FROM (SELECT 'metro' || metro_idx || '/pop' || o AS node FROM metros, LATERAL (SELECT unnest(range(1, pops + 1)) AS o)),
    (SELECT 'leaf' AS grp, unnest(range(1, 17)) AS i UNION ALL SELECT 'spine', unnest(range(1, 5)))),
chosen AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY grp, i) - 1 AS k, count(*) OVER (PARTITION BY site) AS n FROM ruled WHERE role = 'spine' OR stripe_w4 = 'g2')"""

SQL = {
    "scenario_links": f"""WITH {site_queries._EXPANDED} SELECT u AS source, v AS target, round(base_capacity / n_links, 6) AS capacity, cost, link_type, adjacency_id, source_metro, target_metro
FROM site_edges JOIN counts USING (edge_key) WHERE n_links > 0""",
    "node_rules": f"WITH {_RULED} SELECT name, role, stripe_w4, plane FROM ruled",
    "matched_links": f"""WITH {_RULED} SELECT edge_key, a.name AS a, b.name AS b FROM site_edges JOIN chosen a ON a.site = u JOIN chosen b ON b.site = v
WHERE link_type = 'intra_metro' AND CASE WHEN a.n >= b.n THEN a.k % b.n = b.k ELSE b.k % a.n = a.k END""",
    "metro_settings": f"""WITH {_SETTINGS} SELECT metro_idx, name, CAST(CASE o WHEN 'own' THEN 5 + k % 2 WHEN 'orig' THEN 7 ELSE 2 END AS INT) AS pops,
  CASE WHEN o = 'orig' THEN 'FullMesh4' ELSE 'SingleRouter' END AS site_blueprint, CAST(CASE WHEN o = 'own' THEN k % 4 ELSE 2 END AS INT) AS dcs,
  CASE WHEN o = 'own' THEN 'DCLarge' ELSE 'DCRegion' END AS dc_blueprint FROM picked""",
    "metro_link_settings": f"WITH {_SETTINGS} SELECT metro_idx, family, CAST(capacity AS BIGINT) AS capacity, 1::BIGINT AS cost, 'mesh' AS mode, attrs, role_pairs, CAST(coalesce(stripe_width, 0) AS INT) AS stripe_width FROM links",
    "settings_problems": f"WITH {_SETTINGS} SELECT 'settings' AS audit, name AS key, family || ' capacity' AS message FROM links WHERE capacity <= 0",
    "unknown_overrides": f"""WITH {METROS}, slugs AS (
  SELECT {_SLUG} AS slug FROM metros WHERE (metro_idx - 1) % 3 = 0 UNION SELECT {_SLUG} || '-area' FROM metros WHERE (metro_idx - 1) % 4 = 1)
SELECT slug FROM slugs WHERE slug NOT IN (SELECT {_SLUG} FROM metros WHERE metro_idx > 12) AND slug NOT IN (SELECT {_SLUG} || '-area' FROM metros WHERE metro_idx > 12)""",
    "dc_striped_links": f"""WITH {site_queries._EDGES} SELECT edge_key, u || '/leaf/leaf' || i AS a, v || '/leaf/leaf' || i AS b, cost FROM site_edges, range(1, 17) r(i)
WHERE link_type = 'dc_to_pop' AND (i <= 4 OR (CAST(regexp_extract(u, '^metro([0-9]+)/', 1) AS INT) - 1) % 3 <> 0)""",
    "dc_stripes": f"""WITH {site_queries._EDGES} SELECT edge_key, u, v, cost,
  CASE WHEN (CAST(regexp_extract(u, '^metro([0-9]+)/', 1) AS INT) - 1) % 3 = 0 THEN 'stripe_dc_' || regexp_extract(u, '^metro([0-9]+)/', 1) END AS stripe_attribute
FROM site_edges WHERE link_type = 'dc_to_pop'""",
    "stripe_by_attribute": f"WITH {_LABELLED} SELECT blueprint, device, row_number() OVER (PARTITION BY blueprint, stripe ORDER BY p_partkey) AS place, stripe FROM labelled",
    "stripe_mismatch": f"""WITH {_LABELLED}, brands AS (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#1'),
l AS (SELECT DISTINCT 'Brand#1-' || p_brand AS pair, stripe FROM brands, labelled WHERE blueprint = 'Brand#1'),
r AS (SELECT DISTINCT 'Brand#1-' || p_brand AS pair, stripe FROM brands JOIN labelled ON blueprint = p_brand)
SELECT pair, stripe, 'left' AS "on" FROM (FROM l EXCEPT FROM r) UNION ALL SELECT pair, stripe, 'right' FROM (FROM r EXCEPT FROM l)""",
    "blueprint_section": """SELECT * FROM (VALUES ('FullMesh4', 'core', 4, 'core{n}', 'core', 'CoreRouter', 1), ('Clos_L16_S4', 'leaf', 16, 'leaf{n}', 'leaf', 'LeafRouter', 1),
  ('Clos_L16_S4', 'spine', 4, 'spine{n}', 'spine', 'none', 0)) c(blueprint, grp, n, template, role, component, count)""",
    "metro_bounds": f"WITH {METROS} SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n_metros, CAST(sum(pops) AS BIGINT) AS n_pops, CAST(sum(dcs) AS BIGINT) AS n_dcs FROM metros",
    "site_links_by_role": f"""WITH {site_queries._EDGES} SELECT edge_key, u || '/spine/spine' || i AS a, v || '/spine/spine' || i AS b FROM site_edges, range(1, 5) r(i) WHERE link_type = 'intra_metro'""",
    "top_weights": f"SELECT * FROM ({traffic_queries.SQL['gravity_weights']}) ORDER BY weight DESC, a_pos, b_pos LIMIT 10",
    "value_formats": """SELECT p_partkey, format('{:,.2f}', p_size * 1234567.25::DOUBLE) AS shown,
  CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS BIGINT) * 1000 + p_partkey % 1000 WHEN 1 THEN p_size WHEN 3 THEN p_size ELSE -1 END AS whole,
  CASE p_partkey % 5 WHEN 1 THEN p_size + 0.75::DOUBLE WHEN 3 THEN p_size ELSE 'NaN'::DOUBLE END AS number FROM part""",
    "node_hardware": """SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 2) THEN p_brand END AS component,
  CASE p_partkey % 4 WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN 1 ELSE 0 END AS count FROM part""",
    "audit_groups": "SELECT 'groups' AS audit, 'network.nodes' AS key, 'no groups' AS message",
    "audit_matrices": """SELECT 'matrix' AS audit, 'm' || r_regionkey AS key, 'empty although traffic is enabled' AS message FROM region
WHERE r_regionkey = 3 OR r_regionkey NOT IN (SELECT n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "audit_isolation_hint": f"SELECT 'isolated' AS audit, path AS key, 'no link in the scenario' AS message FROM ({scenario_queries.SQL['scenario_groups']})",
    "audit_contract": """SELECT 'contract' AS audit, key, message FROM (VALUES ('groups.metro_id', 'string instead of int'), ('groups.color', 'missing'), ('groups.gbps_per_mw', 'not in the contract')) c(key, message)""",
    "audit_stages": """SELECT 'matrix' AS audit, count(*) AS n FROM region WHERE r_regionkey = 3 OR r_regionkey NOT IN (SELECT n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
HAVING count(*) > 0 UNION ALL SELECT 'broken', 1""",
}
