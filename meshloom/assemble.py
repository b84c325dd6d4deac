"""From metros and corridors to a scenario: sites, links, risks and demands by one configuration, and the document of them.

Each table is a stage after those of :mod:`meshloom.run`. Striping and sizing by traffic are
there as operators; a configuration that asks for sizing is an error here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshloom import config as configuration
from meshloom import run, stages
from meshloom.operators import audits, corridors, expand, scenario, schema_check, settings, sites, traffic
from meshloom.session import cut
from meshloom.sources import documents, single
from meshloom.stages import Stage

FAMILY = {"intra_metro": "intra_metro_link", "dc_to_pop": "dc_to_pop_link", "inter_metro_corridor": "inter_metro_link"}

#: What a scenario's document has to look like.
SCHEMA = {
    "type": "object",
    "required": ["seed", "network", "risk_groups", "traffic_matrix_set"],
    "additionalProperties": False,
    "properties": {
        "seed": {"type": "integer"},
        "network": {
            "type": "object",
            "required": ["nodes", "links"],
            "properties": {
                "nodes": {"type": "object", "minProperties": 1, "propertyNames": {"pattern": r"^metro[0-9]+/(pop|dc)\[1-[0-9]+\]$"}, "additionalProperties": {"$ref": "#/$defs/group"}},
                "links": {"type": "array", "items": {"$ref": "#/$defs/link"}},
            },
        },
        "risk_groups": {"type": "array", "items": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 1}}}},
        "traffic_matrix_set": {"type": "object", "additionalProperties": {"type": "array", "items": {"$ref": "#/$defs/demand"}}},
    },
    "$defs": {
        "group": {"type": "object", "required": ["blueprint", "attrs"], "properties": {"blueprint": {"type": "string"}, "attrs": {"type": "object", "required": ["node_type", "metro_id"]}}},
        "link": {
            "type": "object",
            "required": ["source", "target", "capacity", "cost"],
            "properties": {"source": {"type": "string"}, "target": {"type": "string"}, "capacity": {"type": "number", "exclusiveMinimum": 0}, "cost": {"type": "number", "minimum": 0}},
        },
        "demand": {
            "type": "object",
            "required": ["source_path", "sink_path", "priority", "demand"],
            "properties": {"priority": {"type": "integer", "minimum": 0}, "demand": {"type": "number", "exclusiveMinimum": 0}},
        },
    },
}


def _metros(spark: SparkSession, config: dict, made: dict[str, DataFrame]) -> DataFrame:
    """Metros with their numbers of sites and blueprints."""
    own = settings.metro_settings(made["metros"], configuration.build_tables(spark, config))
    return made["metros"].join(own.drop("name"), "metro_idx")


def _corridors(spark: SparkSession, config: dict, made: dict[str, DataFrame]) -> DataFrame:
    """The corridor of each pair of metros, with the risk groups of its edges."""
    given, snap = config["corridors"]["risk_groups"], config["highway_processing"]["snap_precision_m"]
    edges = made["corridor_edges"].withColumn("edge_id", F.concat_ws("-", "a", "b"))
    names = made["metros"].select("metro_id", "name")
    place = lambda node, k: F.split(node, "_")[k].cast("double") * snap
    risks = spark.createDataFrame([], "edge_id string, risk_group string")
    if given["enabled"]:
        ends = edges.select("edge_id", *[place(c, k).alias(f"{c}{xy}") for c in "ab" for k, xy in enumerate("xy")]).distinct()
        open_edges = corridors.outside_metros(ends, made["metros"]) if given["exclude_metro_radius_shared"] else None
        risks = corridors.risk_groups(edges, names, open_edges, given["group_prefix"])
    paths = made["corridors"].select("metro_a", "metro_b", "path_index", "length_km")
    return corridors.extract(paths, edges.select("metro_a", "metro_b", "path_index", "edge_id"), risks, made["metros"])


def _groups(spark: SparkSession, config: dict, made: dict[str, DataFrame]) -> DataFrame:
    t = config["traffic"]
    rows = scenario.groups(made["placed"], {"pop": "", "dc": ""}, float(t["mw_per_dc_region"]), float(t["gbps_per_mw"]))
    own = made["placed"].select("metro_id", "site_blueprint", "dc_blueprint")
    blueprint = F.when(F.col("node_type") == "pop", F.col("site_blueprint")).otherwise(F.col("dc_blueprint"))
    return rows.join(own, "metro_id").withColumn("blueprint", blueprint).select(*rows.columns)


def _site_edges(spark: SparkSession, config: dict, made: dict[str, DataFrame]) -> DataFrame:
    """Site links of all families, with the capacity that the family has in the metro of their first end."""
    m, defaults = made["placed"], config["build"]["build_defaults"]
    parts = [
        sites.intra_metro_edges(m, base_cost=defaults["intra_metro_link"]["cost"]), sites.dc_pop_edges(m, base_cost=defaults["dc_to_pop_link"]["cost"]),
        sites.inter_metro_edges(made["corridor_table"], m, defaults["inter_metro_link"]["mode"], base_cost=defaults["inter_metro_link"]["cost"]),
    ]
    family = F.element_at(F.create_map(*(F.lit(x) for kv in FAMILY.items() for x in kv)), F.col("link_type"))
    edges = reduce(DataFrame.unionByName, parts).withColumn("family", family).withColumn("metro_idx", F.regexp_extract("u", "^metro([0-9]+)/", 1).cast("int"))
    own = settings.link_settings(made["metros"], configuration.build_tables(spark, config)).select("metro_idx", "family", F.col("capacity").cast("double").alias("_capacity"))
    return edges.join(own, ["metro_idx", "family"], "left").withColumn("base_capacity", F.coalesce("_capacity", "base_capacity")).select(*parts[0].columns)


def _blueprints(made: dict[str, DataFrame]) -> DataFrame:
    """The blueprint of every site: ``(node, blueprint)``."""
    placed = sites.nodes(made["placed"]).join(made["placed"].select("metro_idx", "site_blueprint", "dc_blueprint"), "metro_idx")
    return placed.select("node", F.when(F.col("kind") == "pop", F.col("site_blueprint")).otherwise(F.col("dc_blueprint")).alias("blueprint"))


def _links(spark: SparkSession, config: dict, made: dict[str, DataFrame]) -> DataFrame:
    """The scenario's links: each site link with the capacity of one of its device links."""
    if config["build"]["tm_sizing"]["enabled"]:
        raise ValueError("build.tm_sizing is not done by this command")
    counts = expand.link_counts(made["site_edges"], _blueprints(made), expand.blueprint_tables(spark)[0])
    return scenario.links(made["site_edges"], expand.per_link_capacity(made["site_edges"], counts, check=True))


def _demands(spark: SparkSession, config: dict, made: dict[str, DataFrame]) -> DataFrame:
    t, m = config["traffic"], made["placed"]
    if not t["enabled"]:
        return spark.createDataFrame([], "source_path string, sink_path string, priority int, demand double")
    overrides = [(str(k), float(v)) for k, v in t["gravity"]["mw_per_dc_region_overrides"].items()]
    each = m.where("dcs > 0").select("metro_idx", F.col("name").alias("metro"), "x", "y", F.explode(F.sequence(F.lit(1), F.col("dcs").cast("int"))).alias("dc_idx"))
    dcs = each.withColumn("dc_pos", F.row_number().over(W.orderBy("metro_idx", "dc_idx")))  # as many rows as metros are asked for, times their data centres
    dcs = cut(traffic.dc_power(dcs, t["mw_per_dc_region"], spark.createDataFrame(overrides, "key string, mw double") if overrides else None))
    kinds, g, h = traffic.classes(spark, t["priority_ratios"]), t["gravity"], t["hose"]
    if t["model"] == "uniform":
        return traffic.uniform(traffic.offered(dcs, t["gbps_per_mw"]), kinds)
    if t["model"] == "gravity":
        return traffic.gravity(
            dcs, kinds, t["gbps_per_mw"], g["alpha"], g["beta"], g["min_distance_km"], g["exclude_same_metro"], g["max_partners_per_dc"], g["rounding_gbps"], g["rounding_policy"],
            g["jitter_stddev"], config["output"]["scenario_seed"], check=True,
        )
    if t["samples"] > 1:
        raise ValueError("one document has one hose sample")
    return traffic.hose(
        dcs, kinds, t["gbps_per_mw"], seed=config["output"]["scenario_seed"], tilt=h["tilt_exponent"], beta=h["beta"], min_km=h["min_distance_km"],
        exclude_same_metro=h["exclude_same_metro"], carve_top_k=h["carve_top_k"],
    )


def _risks(spark: SparkSession, config: dict, made: dict[str, DataFrame]) -> DataFrame:
    return corridors.risk_distances(made["corridor_table"], made["metros"].select("metro_id", "name"), config["corridors"]["risk_groups"]["group_prefix"])


STAGES = (
    *run.STAGES,
    Stage("placed", _metros, ("build.build_defaults", "build.build_overrides"), (), ("metros",), (settings, configuration)),
    Stage("corridor_table", _corridors, ("corridors.risk_groups", "highway_processing.snap_precision_m"), (), ("metros", "corridors", "corridor_edges"), (corridors,)),
    Stage("groups", _groups, ("traffic.mw_per_dc_region", "traffic.gbps_per_mw"), (), ("placed",), (scenario,)),
    Stage("site_edges", _site_edges, ("build.build_defaults", "build.build_overrides"), (), ("placed", "corridor_table"), (sites, settings)),
    Stage("links", _links, ("build.tm_sizing",), (), ("site_edges", "placed"), (expand, scenario)),
    Stage("risks", _risks, ("corridors.risk_groups",), (), ("corridor_table",), (corridors,)),
    Stage("demands", _demands, ("traffic", "output.scenario_seed"), (), ("placed",), (traffic,)),
)


def issues(spark: SparkSession, config: dict, made: dict[str, DataFrame], path: str) -> DataFrame:
    """What audits find in the scenario's tables, and what of its document breaks the schema: ``(audit, key, message)``."""
    nodes = sites.nodes(made["placed"]).select("node")
    broken = schema_check.check(documents.read(spark, path), SCHEMA, "path", "text")
    matrix = spark.createDataFrame([(config["traffic"]["matrix_name"],)], "name string")
    groups, inner = expand.blueprint_tables(spark)
    own = _blueprints(made)
    used = inner.join(own.select("blueprint"), "blueprint", "left_semi")
    return audits.combine(
        audits.no_groups(made["groups"]), audits.isolated(nodes, made["site_edges"]), audits.positive_demands(made["demands"]),
        audits.empty_matrices(matrix, made["demands"].withColumn("matrix", F.lit(config["traffic"]["matrix_name"])), config["traffic"]["enabled"]),
        audits.empty_groups(own, groups), audits.empty_links(made["site_edges"], expand.link_counts(made["site_edges"], own, groups)), audits.empty_blueprint_links(groups, used),
        audits.issues(broken, "schema", "path", F.concat_ws(": ", "rule", "message")),
    )


def build(spark: SparkSession, config: dict, folder: str, force: bool = False) -> tuple[dict[str, DataFrame], list[str], str]:
    """All stages' tables under ``folder`` and the document ``scenario.yml``: the tables, the names of those that were made, and the document's path."""
    made, fresh = stages.run(spark, STAGES, config, folder, force)
    path = f"{folder.rstrip('/')}/scenario.yml"
    demands = made["demands"].select(*[c for c in ("source_path", "sink_path", "priority", "demand") if c in made["demands"].columns])
    single.scenario_yaml({"groups": made["groups"], "links": made["links"], "risks": made["risks"], "demands": demands}, path, config["output"]["scenario_seed"])
    return made, fresh, path
