"""The run's configuration: one YAML file, checked against the defaults' own shape.

A key that the defaults don't have is an error, except under OPEN sections, and so is a
value of another kind. What is per metro becomes tables, for :mod:`meshloom.operators.settings`.
"""

from __future__ import annotations

import copy
from decimal import Decimal
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.text import metro_slug

_LINK = {"capacity": 400, "cost": 1, "attrs": {}, "match": {}, "role_pairs": [], "striping": {}, "mode": "mesh"}
#: Link families, in the order of their tables.
FAMILIES = ("intra_metro_link", "inter_metro_link", "dc_to_pop_link")

# Sections, keys and defaults of the configuration.
DEFAULTS: dict[str, Any] = {
    "data_sources": {
        "uac_polygons": "data/tl_2020_us_uac20.zip", "tiger_roads": "data/tl_2024_us_primaryroads.zip", "conus_boundary": "data/cb_2024_us_state_500k.zip",
    },
    "projection": {"target_crs": "EPSG:5070"},
    "clustering": {
        "metro_clusters": 30, "max_uac_radius_km": 100.0, "export_clusters": False, "export_integrated_graph": False, "override_metro_clusters": [],
        "coordinate_precision": 1, "area_precision": 2,
    },
    "highway_processing": {
        "min_edge_length_km": 0.05, "snap_precision_m": 10.0, "highway_classes": ["S1100", "S1200"], "min_cycle_nodes": 3, "filter_largest_component": True, "validation_sample_size": 5,
    },
    "corridors": {
        "k_paths": 1, "k_nearest": 3, "max_edge_km": 600.0, "max_corridor_distance_km": 1000.0,
        "risk_groups": {"enabled": True, "group_prefix": "corridor_risk", "exclude_metro_radius_shared": True},
    },
    "validation": {"max_metro_highway_distance_km": 10.0, "require_connected": True, "max_degree_threshold": 1000, "high_degree_warning": 20, "min_largest_component_fraction": 0.5},
    "output": {
        "scenario_metadata": {
            "title": "Continental US Backbone Topology", "description": "Generated backbone topology based on population density and highway infrastructure", "version": "1.0",
        },
        "formatting": {"json_indent": 2, "yaml_anchors": True},
        "scenario_seed": 42,
    },
    "build": {
        "build_defaults": {
            "pop_per_metro": 2, "site_blueprint": "SingleRouter", "dc_regions_per_metro": 2, "dc_region_blueprint": "DCRegion",
            "intra_metro_link": {**_LINK, "attrs": {"link_type": "intra_metro"}},
            "inter_metro_link": {**_LINK, "capacity": 100, "attrs": {"link_type": "inter_metro_corridor"}},
            "dc_to_pop_link": {**_LINK, "attrs": {"link_type": "dc_to_pop"}},
        },
        "build_overrides": [],
        "tm_sizing": {
            "enabled": False, "matrix_name": None, "quantum_gbps": 3200.0, "headroom": 1.3, "alpha_dc_to_pop": 1.2, "beta_intra_pop": 0.8,
            "flow_placement": "EQUAL_BALANCED", "edge_select": "ALL_MIN_COST", "respect_min_base_capacity": True,
        },
    },
    "components": {"assignments": {}, "hw_component": {}, "optics": {}},
    "failure_policies": {"assignments": {"default": "single_random_link_failure", "scenario_overrides": {}}},
    "workflows": {"assignments": {"default": "capacity_analysis", "scenario_overrides": {}}},
    "traffic": {
        "enabled": True, "gbps_per_mw": 1000.0, "mw_per_dc_region": 150.0, "priority_ratios": {0: 0.3, 1: 0.3, 2: 0.4}, "flow_policy_config": {}, "matrix_name": "default",
        "model": "uniform", "samples": 1,
        "gravity": {
            "alpha": 1.0, "beta": 1.0, "min_distance_km": 1.0, "exclude_same_metro": False, "max_partners_per_dc": None, "jitter_stddev": 0.0, "rounding_gbps": 0.0,
            "rounding_policy": "nearest", "mw_per_dc_region_overrides": {},
        },
        "hose": {"tilt_exponent": 0.0, "beta": 1.0, "min_distance_km": 1.0, "exclude_same_metro": False, "carve_top_k": None},
    },
    "visualization": {"corridors": {"use_real_geometry": False}, "site_graph": {"export": False}, "blueprints": {"export": False}, "dpi": 300},
}
#: Mappings whose keys are the user's own.
OPEN = ("attrs", "match", "striping", "assignments", "hw_component", "optics", "scenario_overrides", "priority_ratios", "flow_policy_config", "mw_per_dc_region_overrides")
#: Values that have to be above 0, and those that may be 0.
POSITIVE = (
    "clustering.metro_clusters", "corridors.k_paths", "corridors.k_nearest", "traffic.samples", "traffic.gravity.alpha", "traffic.gravity.beta", "traffic.gravity.min_distance_km",
    "traffic.gravity.max_partners_per_dc", "traffic.hose.beta", "traffic.hose.min_distance_km", "traffic.hose.carve_top_k", "visualization.dpi",
)
NOT_NEGATIVE = ("traffic.gbps_per_mw", "traffic.mw_per_dc_region", "traffic.gravity.jitter_stddev", "traffic.gravity.rounding_gbps", "traffic.hose.tilt_exponent")
CHOICES = {
    "traffic.model": ("uniform", "gravity", "hose"), "traffic.gravity.rounding_policy": ("nearest", "ceil", "floor"),
    "build.tm_sizing.flow_placement": ("EQUAL_BALANCED", "PROPORTIONAL"), "build.tm_sizing.edge_select": ("ALL_MIN_COST", "ALL_MIN_COST_WITH_CAP_REMAINING"),
}


def whole(value: Any, where: str) -> int:
    """A whole number, also from text such as ``12_800`` or ``3200.0``; decimals are cut off."""
    try:
        return int(Decimal(value.replace("_", ""))) if isinstance(value, str) else int(value)
    except (TypeError, ValueError, ArithmeticError) as e:
        raise ValueError(f"{where} is no whole number: {value!r}") from e


def _merge(default: Any, given: Any, where: str) -> Any:
    """The given value in the default's shape."""
    if isinstance(default, dict):
        if given is None:
            return copy.deepcopy(default)
        if not isinstance(given, dict):
            raise ValueError(f"{where} has to be a mapping")
        if where.rsplit(".", 1)[-1] in OPEN:
            return {**given}
        if extra := sorted(map(str, set(given) - set(default))):
            raise ValueError(f"{where or 'configuration'} has unknown keys: {', '.join(extra)}")
        return {k: _merge(v, given[k], f"{where}.{k}".lstrip(".")) if k in given else copy.deepcopy(v) for k, v in default.items()}
    if default is None or given is None:
        return given if given is not None else default
    if isinstance(default, bool):
        if not isinstance(given, bool):
            raise ValueError(f"{where} has to be true or false")
        return given
    if isinstance(default, int):
        return whole(given, where)
    if isinstance(default, float):
        try:
            return float(given)
        except (TypeError, ValueError) as e:
            raise ValueError(f"{where} has to be a number: {given!r}") from e
    if not isinstance(given, type(default)):
        raise ValueError(f"{where} has to be a {type(default).__name__}")
    return given


def at(config: dict, where: str) -> Any:
    """The value under a dotted name."""
    for k in where.split("."):
        config = config[k]
    return config


def resolve(given: dict | None) -> dict:
    """The whole configuration: what is given, over the defaults; an error for what doesn't fit or agree."""
    config = _merge(DEFAULTS, given or {}, "")
    for names, fits, text in ((POSITIVE, lambda v: v > 0, "positive"), (NOT_NEGATIVE, lambda v: v >= 0, "0 or more")):
        for where in names:
            if (value := at(config, where)) is not None and not fits(value):
                raise ValueError(f"{where} has to be {text}")
    for where, known in CHOICES.items():
        if at(config, where) not in known:
            raise ValueError(f"{where} has to be one of {', '.join(known)}")
    traffic = config["traffic"]
    for name, kind in (("priority_ratios", float), ("flow_policy_config", str)):
        traffic[name] = {whole(k, f"traffic.{name}"): kind(v) for k, v in traffic[name].items()}
    classes = sorted(traffic["priority_ratios"])
    if traffic["enabled"]:
        if not classes or classes != list(range(len(classes))):
            raise ValueError("traffic.priority_ratios has to have the classes 0, 1, 2 and so on")
        if abs(sum(traffic["priority_ratios"].values()) - 1) > 1e-9:
            raise ValueError("traffic.priority_ratios have to add up to 1")
        if not set(traffic["flow_policy_config"]) <= set(classes) or not all(v.strip() for v in traffic["flow_policy_config"].values()):
            raise ValueError("traffic.flow_policy_config has to name a policy for known classes")
    allowed = {"metros", *DEFAULTS["build"]["build_defaults"]}
    for entry in config["build"]["build_overrides"]:
        if not isinstance(entry, dict) or "metros" not in entry:
            raise ValueError("a build override has to be a mapping with metros")
        names = [entry["metros"]] if isinstance(entry["metros"], str) else entry["metros"]
        if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
            raise ValueError("metros of a build override have to be names")
        if extra := sorted(set(entry) - allowed):
            raise ValueError(f"a build override has unknown keys: {', '.join(extra)}")
    return config


def load(spark: SparkSession, path: str) -> dict:
    """:func:`resolve` of the YAML file at ``path``, on any file system that Spark reads."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one configuration file
    try:
        given = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"{path} is not YAML") from e
    if not isinstance(given, dict):
        raise ValueError(f"{path} is empty or no mapping")
    return resolve(given)


SITES = "pops int, site_blueprint string, dcs int, dc_blueprint string"
LINKS = "family string, capacity long, cost long, mode string, attrs map<string,string>, role_pairs array<string>, stripe_width int, stripe_attribute string"


def _link_row(family: str, given: dict, where: str) -> tuple:
    number = lambda k: whole(given[k], f"{where}.{family}.{k}") if k in given else None
    striping = given.get("striping") or {}
    pairs = ["|".join(p) if isinstance(p, list) else str(p) for p in given["role_pairs"]] if "role_pairs" in given else None
    attrs = {str(k): str(v) for k, v in given["attrs"].items()} if "attrs" in given else None
    width = whole(striping["width"], f"{where}.{family}.striping.width") if "width" in striping else None
    return family, number("capacity"), number("cost"), given.get("mode"), attrs, pairs, width, striping.get("attribute")


def _site_row(given: dict) -> tuple:
    return tuple(given.get(k) for k in ("pop_per_metro", "site_blueprint", "dc_regions_per_metro", "dc_region_blueprint"))


def build_tables(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """``sites`` and ``links`` of the build defaults, and ``site_overrides`` and ``link_overrides`` by ``slug``; what an override leaves out is null.

    Later entries for a metro replace earlier ones whole. A file's worth of rows.
    """
    build, by_name = config["build"], {}
    for entry in build["build_overrides"]:
        for name in [entry["metros"]] if isinstance(entry["metros"], str) else entry["metros"]:
            by_name[name] = entry
    base = build["build_defaults"]
    named = lambda rows, schema: spark.createDataFrame(rows, f"name string, {schema}").withColumn("slug", metro_slug(F.col("name"))).drop("name")
    return {
        "sites": spark.createDataFrame([_site_row(base)], SITES),
        "links": spark.createDataFrame([_link_row(f, base[f], "defaults") for f in FAMILIES], LINKS),
        "site_overrides": named([(n, *_site_row(e)) for n, e in by_name.items()], SITES),
        "link_overrides": named([(n, *_link_row(f, e[f], n)) for n, e in by_name.items() for f in FAMILIES if f in e], LINKS),
    }
