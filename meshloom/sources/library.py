"""Built-in hardware, blueprints, failure policies and workflows, and users' entries over them."""

from __future__ import annotations

import json

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import trees
from meshloom.operators.expand import BLUEPRINTS, overlay
from meshloom.sources import documents

COLUMNS = "name string, component_type string, capex double, power_watts double, power_watts_max double, capacity double, ports int, role string"
#: Built-in components (fixed values), in the order of COLUMNS.
COMPONENTS = (
    ("CoreRouter", "chassis", 650000.0, 22000.0, 29000.0, 409600.0, 512, "core"),
    ("LeafRouter", "chassis", 85000.0, 2000.0, 3000.0, 51200.0, 64, "leaf"),
    ("SpineRouter", "chassis", 55000.0, 2000.0, 3000.0, 102400.0, 64, "spine"),
    ("800G-ZR+", "optic", 15000.0, 29.0, 30.0, 800.0, 1, None),
    ("1600G-2xDR4", "optic", 5500.0, 25.0, 28.0, 1600.0, 1, None),
    ("800G-DR4", "optic", 3000.0, 16.0, 18.0, 800.0, 1, None),
)

#: Built-in failure policies (fixed values).
FAILURE_POLICIES = {
    "empty": {},
    "single_random_link_failure": {
        "attrs": {"description": "Fails exactly one random link to test network resilience"},
        "modes": [{"weight": 1.0, "rules": [{"entity_scope": "link", "rule_type": "choice", "count": 1}]}],
    },
    "mc_baseline": {
        "attrs": {"description": "Balanced MC: SRLG + DC->PoP + node(maint) + intra-site fabric"},
        "modes": [
            {"weight": 0.30, "rules": [{"entity_scope": "risk_group", "rule_type": "choice", "count": 1, "weight_by": "distance_km"}]},
            {
                "weight": 0.35,
                "rules": [{
                    "entity_scope": "link", "rule_type": "choice", "count": 3, "conditions": [{"attr": "link_type", "op": "==", "value": "dc_to_pop"}], "logic": "and",
                    "weight_by": "target_capacity",
                }],
            },
            {
                "weight": 0.25,
                "rules": [{
                    "entity_scope": "node", "rule_type": "choice", "count": 1, "conditions": [{"attr": "node_type", "op": "!=", "value": "dc_region"}], "logic": "and",
                    "weight_by": "attached_capacity_gbps",
                }],
            },
            {
                "weight": 0.10,
                "rules": [{
                    "entity_scope": "link", "rule_type": "choice", "count": 4,
                    "conditions": [{"attr": "link_type", "op": "==", "value": v} for v in ("leaf_spine", "intra_group", "inter_group", "internal_mesh")], "logic": "or",
                }],
            },
        ],
    },
}
#: Built-in workflows (fixed values).
WORKFLOWS = {
    "design_analysis_brief": [
        {"step_type": "NetworkStats", "name": "network_statistics"},
        {
            "step_type": "MaximumSupportedDemand", "name": "msd_baseline", "matrix_name": "baseline_traffic_matrix", "acceptance_rule": "hard", "alpha_start": 1.0, "growth_factor": 2.0,
            "alpha_min": 1e-3, "alpha_max": 1e6, "resolution": 0.05, "max_bracket_iters": 16, "max_bisect_iters": 32, "seeds_per_alpha": 1, "placement_rounds": 2,
        },
        {
            "step_type": "TrafficMatrixPlacement", "name": "tm_placement", "seed": 42, "matrix_name": "baseline_traffic_matrix", "failure_policy": "mc_baseline", "iterations": 1000,
            "parallelism": 7, "placement_rounds": "auto", "baseline": True, "store_failure_patterns": False, "include_flow_details": True, "include_used_edges": False,
            "alpha_from_step": "msd_baseline", "alpha_from_field": "data.alpha_star",
        },
        {"step_type": "CostPower", "name": "cost_power", "include_disabled": True, "aggregation_level": 2},
    ]
}


def _builtin(kind: str) -> dict:
    """Built-in definitions of a kind by name; blueprints in the form that users write them in."""
    if kind != "blueprints":
        return {"failure_policies": FAILURE_POLICIES, "workflows": WORKFLOWS}[kind]
    side = lambda g: f"/{g}"
    return {
        name: {
            "nodes": {g: {"count": n, "template": template, "attrs": {"role": role}} for g, n, template, role in d["groups"]},
            "links": [{"source": side(a), "target": side(b), "pattern": pattern} for a, b, pattern in d["links"]],
        }
        for name, d in BLUEPRINTS.items()
    }


def definitions(spark: SparkSession, kind: str, path: str | None = None, deep: bool = False) -> DataFrame:
    """``(name, text)``: built-in ``blueprints``, ``failure_policies`` or ``workflows`` as JSON, under those of the YAML file at ``path``.

    A user's definition takes the place of the built-in one of its name; with ``deep``, its
    keys go over those of the built-in one, and null takes a key away. An empty file has none;
    one that isn't YAML, or no mapping, is an error.
    """
    as_rows = lambda found: spark.createDataFrame([(str(k), json.dumps(v)) for k, v in found.items()], "name string, text string")
    base = as_rows(_builtin(kind))
    if path is None:
        return base
    row = documents.read(spark, path).first()  # one configuration file; Spark gives no row of an empty one
    text = "null" if row is None else row.text
    found = None if text is None else json.loads(text)
    if text is None or not isinstance(found, dict | None):
        raise ValueError(f"{path} is no YAML mapping")
    return trees.merged(base, as_rows(found or {}), deep)


def blueprint_tables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and links of blueprints, as :func:`meshloom.operators.expand.blueprint_tables` has them, from definitions ``(name, text)``.

    A group without a count has one device, one without a template is named by its group and
    number, and a link without a pattern is a mesh; names of groups stand with or without a slash.
    """
    form = "nodes map<string,struct<count:int,template:string,attrs:struct<role:string>>>, links array<struct<source:string,target:string,pattern:string>>"
    rows = found.select(F.col("name").alias("blueprint"), F.from_json("text", form).alias("d"))
    groups = rows.select("blueprint", F.explode("d.nodes").alias("grp", "g")).select(
        "blueprint", "grp", F.coalesce("g.count", F.lit(1)).alias("n"), F.coalesce("g.template", F.concat("grp", F.lit("{n}"))).alias("template"), F.col("g.attrs.role").alias("role")
    )
    bare = lambda c: F.regexp_replace(c, "^/", "")
    links = rows.select("blueprint", F.explode("d.links").alias("l")).select(
        "blueprint", bare("l.source").alias("src_grp"), bare("l.target").alias("dst_grp"), F.coalesce("l.pattern", F.lit("mesh")).alias("pattern")
    )
    return groups, links


def components(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Built-in components, under those of the YAML file at ``path``; an error if the file isn't a mapping of mappings."""
    builtin = spark.createDataFrame(COMPONENTS, COLUMNS)
    if path is None:
        return builtin
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one configuration file
    try:
        found = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"{path} is not YAML") from e
    if not isinstance(found, dict) or not all(isinstance(v, dict) for v in found.values()):
        raise ValueError(f"{path} is not a mapping of components")
    number = lambda v: None if v is None else float(v)
    rows = [
        (name, v.get("component_type"), *(number(v.get(c)) for c in ("capex", "power_watts", "power_watts_max", "capacity")), v.get("ports"), (v.get("attrs") or {}).get("role"))
        for name, v in found.items()
    ]
    return overlay(builtin, spark.createDataFrame(rows, COLUMNS))


def of_type(parts: DataFrame, kind: str) -> DataFrame:
    """Components of a type."""
    return parts.where(F.col("component_type") == kind)


def of_role(parts: DataFrame, role: str) -> DataFrame:
    """Components for a role."""
    return parts.where(F.col("role") == role)


def referenced(parts: DataFrame, used: DataFrame, check: bool = False) -> DataFrame:
    """Components that ``used`` names; with ``check``, an error if one isn't known."""
    if check and not used.join(parts, "name", "left_anti").isEmpty():
        raise ValueError("an unknown component is referenced")
    return parts.join(used.select("name").distinct(), "name", "left_semi")
