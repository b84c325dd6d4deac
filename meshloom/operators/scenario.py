"""Sections of a scenario as tables; nesting is left to the sink."""

from __future__ import annotations

from collections.abc import Mapping

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.corridors import risk_distances


def groups(metros: DataFrame, blueprints: Mapping[str, str], mw: float, gbps_per_mw: float) -> DataFrame:
    """One row for the points of presence of each metro and one for its data centres, if any; paths hold the range of numbers."""
    kinds = F.explode(F.array(
        F.struct(F.lit("pop").alias("kind"), F.lit("pop").alias("node_type"), F.lit(blueprints["pop"]).alias("blueprint"), F.col("pops").alias("n")),
        F.struct(F.lit("dc").alias("kind"), F.lit("dc_region").alias("node_type"), F.lit(blueprints["dc"]).alias("blueprint"), F.col("dcs").alias("n")),
    ))
    rows = metros.withColumn("k", kinds).where("k.n > 0")
    dc = F.col("k.kind") == "dc"
    return rows.select(
        F.concat(F.lit("metro"), "metro_idx", F.lit("/"), "k.kind", F.lit("[1-"), "k.n", F.lit("]")).alias("path"), "k.blueprint", "k.node_type", F.col("name").alias("metro_name"), "metro_id",
        F.col("x").alias("location_x"), F.col("y").alias("location_y"), "radius_km", F.when(dc, F.lit(mw)).alias("mw_per_dc_region"), F.when(dc, F.lit(gbps_per_mw)).alias("gbps_per_mw"),
    )


def links(site_edges: DataFrame, capacities: DataFrame) -> DataFrame:
    """Link rows with the capacity of each device link, and ``attrs`` as a map."""
    rows = site_edges.join(capacities.select("edge_key", "capacity"), "edge_key")
    attrs = F.create_map(*(x for c in ("link_type", "adjacency_id", "source_metro", "target_metro") for x in (F.lit(c), F.col(c))))
    return rows.select(F.col("u").alias("source"), F.col("v").alias("target"), "capacity", "cost", attrs.alias("attrs"))


def risk_section(corridors: DataFrame, names: DataFrame) -> DataFrame:
    """Risk groups with their distance, in order of name."""
    return risk_distances(corridors, names).orderBy("risk_group")


def extremes(metros: DataFrame) -> DataFrame:
    """One row: number of metros, most sites of each kind (1 and 0 without metros), and radii."""
    return metros.agg(
        F.count("*").alias("n_metros"), F.coalesce(F.max("pops"), F.lit(1)).alias("max_pops"), F.coalesce(F.max("dcs"), F.lit(0)).alias("max_dcs"),
        F.min("radius_km").alias("min_radius_km"), F.round(F.avg("radius_km"), 6).alias("avg_radius_km"), F.max("radius_km").alias("max_radius_km"),
    )


def bounds(metros: DataFrame) -> DataFrame:
    """One row: the corners around all metros, and the numbers of metros and sites."""
    return metros.agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.count("*").alias("n_metros"), F.sum("pops").alias("n_pops"), F.sum("dcs").alias("n_dcs"),
    )


def document(tables: Mapping[str, DataFrame], seed: int = 42, most: int = 100_000) -> dict:
    """The scenario's nested form from its tables ``groups``, ``links``, ``risks``, ``demands``: a configuration file, so tables over ``most`` rows are refused; ``sources.single`` writes those."""
    def rows(name: str) -> list[dict]:
        found = tables[name].limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{name} has more than {most} rows; keep it as a table")
        return [r.asDict(recursive=True) for r in found]

    plain = lambda r, *skip: {k: v for k, v in r.items() if v is not None and k not in skip}
    return {
        "seed": seed,
        "network": {
            "nodes": {r["path"]: {"blueprint": r["blueprint"], "attrs": plain(r, "path", "blueprint")} for r in rows("groups")},
            "links": [plain(r) for r in rows("links")],
        },
        "risk_groups": [{"name": r["risk_group"], "attrs": {"distance_km": r["distance_km"]}} for r in rows("risks")],
        "traffic_matrix_set": {"baseline_traffic_matrix": [plain(r) for r in rows("demands")]},
    }


def blueprint_section(groups: DataFrame, used: DataFrame, hardware: DataFrame) -> DataFrame:
    """Groups of the used blueprints with the platform of their role: ``(blueprint, grp, n, template, role, component, count)``.

    ``hardware`` is ``(role, component)``; roles that it lacks get none. Reading a row is an
    error if a used blueprint isn't known or a group of it has no role.
    """
    known = groups.join(hardware, "role", "left")
    rows = used.select("blueprint").distinct().join(known, "blueprint", "left")
    fault = F.when(F.col("grp").isNull(), F.raise_error(F.concat(F.lit("unknown blueprint "), "blueprint"))).when(
        F.coalesce("role", F.lit("")) == "", F.raise_error(F.concat(F.lit("no role: "), "blueprint", F.lit(" "), "grp"))
    )
    role = F.coalesce(fault.cast("string"), F.col("role"))
    return rows.select("blueprint", "grp", "n", "template", role.alias("role"), "component", F.when(F.col("component").isNotNull(), F.lit(1)).alias("count"))


def workflow_section(workflows: Mapping[str, list], name: str) -> list:
    """Steps of the assigned workflow; an error names those that are known."""
    if name not in workflows:
        raise ValueError(f"unknown workflow {name}; known are {', '.join(sorted(workflows))}")
    return list(workflows[name])


#: What is put before the first link of a type in the scenario's text.
COMMENTS = {"intra_metro": "Links within metros", "dc_to_pop": "Links of data centres", "inter_metro_corridor": "Links between metros, along corridors"}


def to_yaml(doc: dict, anchors: bool = True) -> str:
    """The nested form as YAML, keys in their order, with a comment before the first link of each type."""
    class Plain(yaml.SafeDumper):
        def ignore_aliases(self, data):
            return super().ignore_aliases(data) if anchors else True

    rest = {k: v for k, v in doc["network"].items() if k != "links"}
    dump = lambda x: yaml.dump(x, Dumper=Plain, sort_keys=False, default_flow_style=False, allow_unicode=True, width=float("inf"))
    indented = lambda text: "".join(f"  {line}\n" for line in text.splitlines())
    out, told = dump({"seed": doc["seed"]}) + "network:\n" + (indented(dump(rest)) if rest else ""), set()
    links = doc["network"].get("links") or []
    out += "  links:\n" if links else "  links: []\n"
    for link in links:
        kind = (link.get("attrs") or {}).get("link_type")
        if kind in COMMENTS and kind not in told:
            out += f"  # {COMMENTS[kind]}\n"
            told.add(kind)
        out += indented(dump([link]))
    return out + "".join(dump({k: v}) for k, v in doc.items() if k not in ("seed", "network"))


def from_yaml(spark, path: str) -> dict[str, DataFrame]:
    """``groups``, ``links``, ``risks`` and ``demands`` of a scenario's file, as tables for the audits; an error if it isn't YAML or no mapping."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one file, as document() bounds it
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"{path} is not YAML") from e
    if not isinstance(doc, dict):
        raise ValueError(f"{path} is no mapping")
    network = doc.get("network") or {}
    flat = lambda m: {str(k): str(v) for k, v in (m or {}).items()}
    number = lambda v: None if v is None else float(v)
    groups = [(p, g.get("blueprint"), flat(g.get("attrs"))) for p, g in (network.get("nodes") or {}).items()]
    found = [(x.get("source"), x.get("target"), number(x.get("capacity")), number(x.get("cost")), flat(x.get("attrs"))) for x in network.get("links") or []]
    risks = [(r.get("name"), number((r.get("attrs") or {}).get("distance_km"))) for r in doc.get("risk_groups") or []]
    demands = [(m, x.get("source_path"), x.get("sink_path"), x.get("priority"), number(x.get("demand"))) for m, rows in (doc.get("traffic_matrix_set") or {}).items() for x in rows or []]
    return {
        "groups": spark.createDataFrame(groups, "path string, blueprint string, attrs map<string,string>"),
        "links": spark.createDataFrame(found, "source string, target string, capacity double, cost double, attrs map<string,string>"),
        "risks": spark.createDataFrame(risks, "risk_group string, distance_km double"),
        "demands": spark.createDataFrame(demands, "matrix string, source_path string, sink_path string, priority int, demand double"),
    }
