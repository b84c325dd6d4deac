"""Audits of a scenario. Each gives issues ``(audit, key, message)``; none means it passes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshloom.functions.text import dc_key
from meshloom.operators.expand import optic_map
from meshloom.session import cut

#: Tolerance on capacities.
EPSILON = 1e-9


def issues(rows: DataFrame, audit: str, key: str | Column, message: str | Column) -> DataFrame:
    """Rows as issues."""
    k = F.col(key) if isinstance(key, str) else key
    m = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(audit).alias("audit"), k.cast("string").alias("key"), m.alias("message"))


def combine(*found: DataFrame) -> DataFrame:
    """All issues of several audits."""
    return reduce(DataFrame.unionByName, found)


def isolated(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes at no link."""
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return issues(nodes.join(ends, "node", "left_anti"), "isolated", "node", "no link")


def references(uses: DataFrame, known: DataFrame, column: str, audit: str = "reference") -> DataFrame:
    """Names used that aren't known; nulls are not names."""
    missing = uses.where(F.col(column).isNotNull()).select(column).distinct().join(known.select(column), column, "left_anti")
    return issues(missing, audit, column, "unknown")


def pairing(pops: DataFrame, dcs: DataFrame) -> DataFrame:
    """Data centres of a metro without points of presence, and groups of one metro whose names differ. Columns ``metro_idx, name``."""
    both = pops.select("metro_idx", F.col("name").alias("pop_name")).join(dcs.select("metro_idx", F.col("name").alias("dc_name")), "metro_idx", "full_outer")
    text = F.when(F.col("pop_name").isNull(), "no points of presence").when(F.col("dc_name").isNotNull() & (F.col("pop_name") != F.col("dc_name")), "names differ")
    return issues(both.withColumn("m", text).where("m IS NOT NULL"), "pairing", "metro_idx", F.col("m"))


def coordinates(groups: DataFrame, graph: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Groups ``(name, x, y)`` that stand elsewhere than their metro in the graph."""
    both = groups.join(graph.select("name", F.col("x").alias("gx"), F.col("y").alias("gy")), "name")
    off = (F.abs(F.col("x") - F.col("gx")) > tolerance) | (F.abs(F.col("y") - F.col("gy")) > tolerance)
    return issues(both.where(off), "coordinates", "name", "not where the graph has it")


def required(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows that lack a value, one issue for each column."""
    lacking = F.explode(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return issues(rows.select(F.col(key), lacking.alias("c")).where("c IS NOT NULL"), "required", key, F.concat(F.lit("no "), "c"))


def positive_demands(demands: DataFrame) -> DataFrame:
    """Demands that aren't positive numbers."""
    bad = demands.where("demand IS NULL OR isnan(demand) OR demand <= 0")
    return issues(bad, "demand", F.concat_ws(" ", "source_path", "sink_path"), "not positive")


def dc_balance(dcs: DataFrame, demands: DataFrame) -> DataFrame:
    """``(dc, capacity, egress, ingress)`` of every data centre with a capacity or a demand, missing ones 0."""
    total = lambda c, name: demands.select(dc_key(F.col(c)).alias("dc"), "demand").where("dc IS NOT NULL").groupBy("dc").agg(F.sum("demand").alias(name))
    rows = dcs.select("dc", F.col("capacity").cast("double").alias("capacity")).groupBy("dc").agg(F.sum("capacity").alias("capacity"))
    rows = rows.join(total("source_path", "egress"), "dc", "full_outer").join(total("sink_path", "ingress"), "dc", "full_outer")
    return rows.na.fill(0.0, ["capacity", "egress", "ingress"])


def dc_capacity(dcs: DataFrame, demands: DataFrame) -> DataFrame:
    """Data centres whose demands, out or in, are over their capacity."""
    over = F.explode(F.array(*[F.when(F.col(w) > F.col("capacity") + EPSILON, F.lit(w)) for w in ("egress", "ingress")]))
    return issues(dc_balance(dcs, demands).select("dc", over.alias("w")).where("w IS NOT NULL"), "dc_capacity", "dc", F.concat("w", F.lit(" over capacity")))


def attached(links: DataFrame) -> DataFrame:
    """``(node, attached)``: capacity of all links at a node."""
    return links.select(F.explode(F.array("u", "v")).alias("node"), "capacity").groupBy("node").agg(F.sum("capacity").alias("attached"))


def hardware_capacity(nodes: DataFrame, links: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes ``(node, component, n)`` with more capacity attached than their hardware has; unknown hardware isn't judged here."""
    rows = nodes.join(components.select(F.col("name").alias("component"), F.col("capacity").alias("each")), "component").join(attached(links), "node")
    return issues(rows.where(F.col("attached") > F.col("each") * F.col("n") + EPSILON), "hw_capacity", "node", "more capacity attached than hardware has")


def hardware_presence(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes without hardware, or with an unknown component."""
    rows = nodes.join(components.select(F.col("name").alias("component"), F.lit(True).alias("known")), "component", "left")
    text = F.when(F.col("component").isNull(), "no hardware").when(F.col("known").isNull(), "unknown hardware")
    return issues(rows.withColumn("m", text).where("m IS NOT NULL"), "hw_presence", "node", F.col("m"))


def ports(nodes: DataFrame, links: DataFrame, roles: DataFrame, rules: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes that need more ports than their hardware has.

    A link needs, at each end, the ports of the optics that its capacity takes.
    """
    r, c = roles.select("node", "role"), components.select(F.col("name").alias("optic"), F.col("capacity").alias("each"), F.col("ports").alias("per"))
    rows = links.join(r.toDF("u", "role_a"), "u").join(r.toDF("v", "role_b"), "v").join(optic_map(rules), ["role_a", "role_b"]).join(c, "optic").where("each > 0")
    need = rows.select(F.explode(F.array("u", "v")).alias("node"), (F.ceil(F.col("capacity") / F.col("each")) * F.greatest("per", F.lit(1))).alias("need"))
    need = need.groupBy("node").agg(F.sum("need").alias("need"))
    have = nodes.join(components.select(F.col("name").alias("component"), "ports"), "component").select("node", (F.col("ports") * F.col("n")).alias("have"))
    over = need.join(have, "node").where("need > have")
    return issues(over, "ports", "node", F.concat(F.lit("needs "), F.col("need").cast("long"), F.lit(" ports of "), F.col("have").cast("long")))


def optics(links: DataFrame, roles: DataFrame, rules: DataFrame, components: DataFrame, samples: int = 3) -> DataFrame:
    """Links whose role pair has no optic, whose optic is unknown, or whose fitted modules (``n_modules``) are too small.

    One issue for each kind and role pair, with the number of links and the first few.
    """
    r, c = roles.select("node", "role"), components.select(F.col("name").alias("optic"), F.col("capacity").alias("each"))
    rows = links.join(r.toDF("u", "role_a"), "u").join(r.toDF("v", "role_b"), "v").join(optic_map(rules), ["role_a", "role_b"], "left").join(c, "optic", "left")
    kind = (
        F.when(F.col("optic").isNull(), "no optic for roles").when(F.col("each").isNull(), "unknown optic")
        .when(F.col("n_modules") * F.col("each") + EPSILON < F.col("capacity"), "optics too small")
    )
    bad = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    first = bad.withColumn("k", F.row_number().over(W.partitionBy("kind", "role_a", "role_b").orderBy("edge_key"))).where(F.col("k") <= samples)
    some = first.groupBy("kind", "role_a", "role_b").agg(F.array_join(F.array_sort(F.collect_list("edge_key")), ", ").alias("some"))
    n = bad.groupBy("kind", "role_a", "role_b").agg(F.count("*").alias("n")).join(some, ["kind", "role_a", "role_b"])
    return issues(n, "optics", F.concat_ws("|", "role_a", "role_b"), F.concat("kind", F.lit(": "), F.col("n"), F.lit(" ("), "some", F.lit(")")))


def empty_expansions(rules: DataFrame, expanded: DataFrame, key: str = "rule") -> DataFrame:
    """Rules from which nothing came."""
    return issues(rules.join(expanded.select(key).distinct(), key, "left_anti"), "empty", key, "expands to nothing")


def role_hardware(nodes: DataFrame, mapping: DataFrame, components: DataFrame) -> DataFrame:
    """Hardware of nodes ``(node, role, component)`` as the roles of ``mapping`` ``(role, component)`` ask for it.

    Roles that nodes have and the mapping lacks, once each; nodes of a mapped role without
    hardware, or with an unknown component. A role mapped to null or blank is exempt, nodes
    without a role are another audit's, and an empty mapping asks for nothing.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    given = mapping.groupBy(F.trim("role").alias("role")).agg(F.max("component").alias("wanted"))
    any_ = F.broadcast(given.agg(F.count("*").alias("n_given")).where("n_given > 0"))  # one row or none
    rows = nodes.select("node", F.trim("role").alias("role"), F.trim("component").alias("component")).where(~blank(F.col("role")))
    unmapped = rows.select("role").distinct().join(given, "role", "left_anti").join(any_, F.lit(True), "left_semi")
    known = components.select(F.trim("name").alias("component"), F.lit(True).alias("known")).distinct()
    judged = rows.join(given.where(~blank(F.col("wanted"))), "role").join(known, "component", "left")
    text = F.when(blank(F.col("component")), F.concat(F.lit("no hardware for role "), "role")).when(F.col("known").isNull(), F.concat(F.lit("unknown component "), "component"))
    return combine(issues(unmapped, "role_hardware", "role", "no mapping for role"), issues(judged.withColumn("m", text).where("m IS NOT NULL"), "role_hardware", "node", F.col("m")))


def declared_optics(rules: DataFrame) -> DataFrame:
    """``(role_a, role_b, optic)``: all that rules ``(pair, optic)`` say of each direction.

    ``a-b`` holds one way. ``a|b`` holds both ways if it is the only rule of the two roles
    with a bar, else as written. Rules without two roles or an optic say nothing.
    """
    bar = F.contains("pair", F.lit("|"))
    part = lambda k: F.trim(F.when(bar, F.split("pair", r"\|", 2)[k]).otherwise(F.get(F.split("pair", "-", 2), k)))
    rows = rules.select(bar.alias("bar"), part(0).alias("a"), part(1).alias("b"), "optic").where("a <> '' AND b <> '' AND optic IS NOT NULL")
    two = rows.where("bar").groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.count("*").alias("n"), F.min(F.struct("a", "b", "optic")).alias("m"))
    back = two.where("n = 1").select(F.col("m.b").alias("a"), F.col("m.a").alias("b"), F.col("m.optic").alias("optic"))
    return rows.select("a", "b", "optic").unionByName(back).distinct().toDF("role_a", "role_b", "optic")


def optic_conflicts(rules: DataFrame) -> DataFrame:
    """Directions for which rules name different optics."""
    found = declared_optics(rules).groupBy("role_a", "role_b").agg(F.sort_array(F.collect_set("optic")).alias("all")).where(F.size("all") > 1)
    return issues(found, "optic_conflicts", F.concat_ws("|", "role_a", "role_b"), F.concat(F.lit("conflicting optics "), F.array_join("all", ", ")))


def link_hardware(links: DataFrame, roles: DataFrame, rules: DataFrame, components: DataFrame, samples: int = 3) -> DataFrame:
    """What the hardware at the ends of links ``(adjacency_id, u, v, capacity, u_component, u_count, v_component, v_count)`` lacks.

    With hardware at one end, the other's absence; with both, unknown components, and ends with
    less capacity than the link has (unknown and blank ones have none; a null count is 1). With
    none, the hardware that a rule asks for, or the rule's own absence, for each end. Without any
    rule nothing is asked for, and links of a node without a role aren't judged. One issue for
    each kind and pair of roles, seen from the end at fault: number of links, and the first adjacencies by name.
    """
    declared = declared_optics(rules).select("role_a", "role_b").distinct().withColumn("asked", F.lit(True))
    r = roles.select("node", F.trim("role").alias("role")).where("role <> ''")
    c = components.groupBy(F.trim("name").alias("name")).agg(F.max("capacity").alias("each"))
    end = lambda x: (
        c.select(F.col("name").alias(f"{x}_name"), F.coalesce("each", F.lit(0.0)).alias(f"{x}_each"), F.lit(True).alias(f"{x}_known")), F.trim(f"{x}_component") == F.col(f"{x}_name"), "left"
    )
    rows = links.join(r.toDF("u", "ra"), "u").join(r.toDF("v", "rb"), "v").join(F.broadcast(declared.limit(1).select("asked").toDF("any")), F.lit(True))  # one row or none
    rows = rows.join(*end("u")).join(*end("v"))
    rows = rows.join(declared.toDF("ra", "rb", "u_asked"), ["ra", "rb"], "left").join(declared.toDF("rb", "ra", "v_asked"), ["ra", "rb"], "left")
    has_u, has_v = F.col("u_component").isNotNull(), F.col("v_component").isNotNull()
    fitted = has_u & has_v
    unknown = lambda x: fitted & (F.trim(f"{x}_component") != "") & F.col(f"{x}_known").isNull()
    room = lambda x: F.coalesce(F.col(f"{x}_each") * F.coalesce(f"{x}_count", F.lit(1.0)), F.lit(0.0)) + EPSILON < F.coalesce("capacity", F.lit(0.0))
    bare = ~has_u & ~has_v
    kinds = [
        (has_v & ~has_u, "hardware only at the target", False), (has_u & ~has_v, "hardware only at the source", True),
        (unknown("u"), "unknown component at the source", False), (unknown("v"), "unknown component at the target", True),
        (fitted & (room("u") | room("v")), "hardware too small", False),
        (bare & F.col("u_asked").isNotNull(), "no hardware at the source, which a rule asks for", False), (bare & F.col("u_asked").isNull(), "no rule for the source", False),
        (bare & F.col("v_asked").isNotNull(), "no hardware at the target, which a rule asks for", True), (bare & F.col("v_asked").isNull(), "no rule for the target", True),
    ]
    pair = lambda back: (F.col("rb"), F.col("ra")) if back else (F.col("ra"), F.col("rb"))
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(kind).alias("kind"), F.concat_ws("|", *pair(back)).alias("pair"))) for when, kind, back in kinds]))
    bad = rows.select(F.explode(found).alias("f"), F.nullif(F.trim("adjacency_id"), F.lit("")).alias("adjacency")).select("f.*", "adjacency")
    counted = cut(bad.groupBy("kind", "pair", "adjacency").agg(F.count("*").alias("n")))  # one pass over links; shuffles adjacencies
    first = counted.where("adjacency IS NOT NULL").withColumn("k", F.row_number().over(W.partitionBy("kind", "pair").orderBy("adjacency"))).where(F.col("k") <= samples)
    some = first.groupBy("kind", "pair").agg(F.array_join(F.array_sort(F.collect_list("adjacency")), ", ").alias("some"))
    total = counted.groupBy("kind", "pair").agg(F.sum("n").alias("n")).join(some, ["kind", "pair"], "left")
    return issues(total, "link_hardware", "pair", F.concat("kind", F.lit(": "), F.col("n"), F.coalesce(F.concat(F.lit(" ("), "some", F.lit(")")), F.lit(""))))


def empty_groups(sites: DataFrame, groups: DataFrame) -> DataFrame:
    """Sites ``(node, blueprint)`` from whose blueprint no device comes, unknown blueprints among them."""
    size = groups.where("n > 0").select("blueprint").distinct()
    return issues(sites.join(size, "blueprint", "left_anti"), "expansion", "node", "group expands to 0 nodes")


def empty_links(site_edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Site links from which no device link comes, by ``counts`` ``(edge_key, n_links)``; an edge without a count has none."""
    rows = site_edges.join(counts.where("n_links > 0"), "edge_key", "left_anti")
    return issues(rows, "expansion", "edge_key", F.concat(F.lit("link expands to 0 links ("), "u", F.lit(" to "), "v", F.lit(")")))


def empty_blueprint_links(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Links of blueprints from which nothing would come in any site, by the groups' numbers of devices and without expanding.

    A mesh within a group takes two devices, a numbered pair ``i:j`` as many as its numbers,
    anything else one at each end; a group that doesn't exist has none.
    """
    size = groups.groupBy("blueprint", "grp").agg(F.sum(F.greatest("n", F.lit(0))).alias("n"))
    rows = links.join(size.toDF("blueprint", "src_grp", "na"), ["blueprint", "src_grp"], "left").join(size.toDF("blueprint", "dst_grp", "nb"), ["blueprint", "dst_grp"], "left")
    numbers = F.split("pattern", ":")
    paired = F.col("pattern").rlike("^[0-9]+:[0-9]+$")
    least = lambda k: F.when(paired, numbers[k].cast("long")).when((F.col("pattern") == "mesh") & (F.col("src_grp") == F.col("dst_grp")), 2).otherwise(1)
    numbered = F.coalesce(F.when(paired, (numbers[0].cast("long") > 0) & (numbers[1].cast("long") > 0)), F.lit(True))
    made = (F.coalesce("na", F.lit(0)) >= least(0)) & (F.coalesce("nb", F.lit(0)) >= least(1)) & numbered
    return issues(rows.where(~made), "expansion", "blueprint", F.concat(F.lit("link expands to 0 links ("), "src_grp", F.lit(" to "), "dst_grp", F.lit(", "), "pattern", F.lit(")")))


def missing_roles(nodes: DataFrame, samples: int = 5) -> DataFrame:
    """One issue with the number of nodes without a role and the first few; none if all have one."""
    bare = nodes.where("role IS NULL OR role = ''")
    first = bare.orderBy("node").limit(samples).agg(F.array_join(F.array_sort(F.collect_list("node")), ", ").alias("some"))
    n = bare.agg(F.count("*").alias("n")).join(first, F.lit(True)).where("n > 0")
    return issues(n, "roles", F.lit("role"), F.concat(F.col("n"), F.lit(" nodes without: "), "some"))


def no_groups(groups: DataFrame) -> DataFrame:
    """An issue if the scenario has no group of nodes."""
    return issues(groups.agg(F.count("*").alias("n")).where("n = 0"), "groups", F.lit("network.nodes"), "no groups")


def empty_matrices(matrices: DataFrame, demands: DataFrame, enabled: bool = True) -> DataFrame:
    """Traffic matrices ``name`` without a demand, where traffic is enabled."""
    found = matrices.select("name").distinct().join(demands.select(F.col("matrix").alias("name")), "name", "left_anti")
    return issues(found.where(F.lit(enabled)), "matrix", "name", "empty although traffic is enabled")


def isolation_hint(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups of sites (column ``path``), in a scenario that has no link at all."""
    n = links.agg(F.count("*").alias("n_links"))
    found = groups.where(F.col("path").rlike(r"^/?metro[0-9]+/(pop|dc)\b")).join(F.broadcast(n), F.lit(True))  # one row
    return issues(found.where("n_links = 0"), "isolated", "path", "no link in the scenario")


def contract(name: str, table: DataFrame, schema: str) -> DataFrame:
    """Columns of a table that its contract, a schema in SQL, asks for and that lack or are of another type, and those it doesn't know."""
    spark = table.sparkSession
    want = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
    have = {f.name: f.dataType.simpleString() for f in table.schema}
    found = [(f"{name}.{c}", "missing" if c not in have else f"{have[c]} instead of {t}") for c, t in want.items() if have.get(c) != t]
    found += [(f"{name}.{c}", "not in the contract") for c in have if c not in want]
    return issues(spark.createDataFrame(found, "key string, message string"), "contract", "key", F.col("message"))


def run_all(spark, stages: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """Issues of all stages. A stage that fails is an issue of its own, and doesn't keep the others from running."""
    found = []
    for name, stage in stages.items():
        try:
            found.append(cut(stage()))
        except Exception as e:  # whatever a stage stumbles over is what the audit has to tell
            found.append(issues(spark.createDataFrame([(name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")], "key string, message string"), name, "key", F.col("message")))
    return combine(*found)
