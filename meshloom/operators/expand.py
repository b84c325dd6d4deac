"""Blueprints and link rules to devices and device links, and hardware on links.

Blueprint groups are ``(blueprint, grp, n, template, role)``, their links ``(blueprint,
src_grp, dst_grp, pattern)``. Sites are ``(node, blueprint)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Built-in blueprints (fixed values): groups as (name, number, template, role), links as (group, group, pattern).
BLUEPRINTS: dict[str, dict[str, list[tuple]]] = {
    "DCRegion": {"groups": [("dc", 1, "dc{n}", "dc")], "links": []},
    "SingleRouter": {"groups": [("core", 1, "core{n}", "core")], "links": []},
    "FullMesh4": {"groups": [("core", 4, "core{n}", "core")], "links": [("core", "core", "mesh")]},
    "Clos_L16_S4": {"groups": [("leaf", 16, "leaf{n}", "leaf"), ("spine", 4, "spine{n}", "spine")], "links": [("leaf", "spine", "mesh")]},
    # four cliques of four in a ring, joined by number
    "DragonFly_CustomG4": {
        "groups": [(f"leaf{g}", 4, f"leaf{g}{{n}}", "leaf") for g in "ABCD"],
        "links": [*((f"leaf{g}", f"leaf{g}", "mesh") for g in "ABCD"), *((f"leaf{a}", f"leaf{b}", "one_to_one") for a, b in ("AB", "AD", "BC", "CD"))],
    },
    # seven cliques of three, each pair joined once; the k-th group on is reached from router k (in turn) by the one opposite
    "Dragonfly_A3H2G7": {
        "groups": [(f"G{g}", 3, f"G{g}_r{{n}}", "leaf") for g in range(1, 8)],
        "links": [
            *((f"G{g}", f"G{g}", "mesh") for g in range(1, 8)),
            *((f"G{a}", f"G{b}", f"{(b - a - 1) % 3 + 1}:{3 - (b - a - 1) % 3}") for a in range(1, 8) for b in range(a + 1, 8)),
        ],
    },
}


def blueprint_tables(spark: SparkSession, blueprints: dict[str, dict[str, list[tuple]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups and links of blueprints as tables."""
    b = BLUEPRINTS if blueprints is None else blueprints
    groups = [(name, *g) for name, d in b.items() for g in d["groups"]]
    links = [(name, *x) for name, d in b.items() for x in d["links"]]
    return (
        spark.createDataFrame(groups, "blueprint string, grp string, n int, template string, role string"),
        spark.createDataFrame(links, "blueprint string, src_grp string, dst_grp string, pattern string"),
    )


def expand_ranges(names: DataFrame, column: str = "name") -> DataFrame:
    """``pop[1-3]`` as pop1, pop2, pop3: one range a name; names without one stay."""
    found = lambda k: F.regexp_extract(column, r"^(.*)\[([0-9]+)-([0-9]+)\](.*)$", k)
    has = F.col(column).rlike(r"\[[0-9]+-[0-9]+\]")
    low, high = F.when(has, found(2)).cast("int"), F.when(has, found(3)).cast("int")
    many = F.transform(F.sequence(low, high), lambda i: F.concat(found(1), i.cast("string"), found(4)))
    return names.withColumn(column, F.explode(F.when(has, many).otherwise(F.array(column))))


def assignments(rules: DataFrame, mode: str = "cartesian") -> DataFrame:
    """One row for each assignment of rules ``(rule, vars MAP<STRING, ARRAY<STRING>>)``: ``(rule, values MAP)``.

    ``zip`` pairs values by position up to the shortest list; otherwise all combinations.
    A rule without variables, or with an empty list, has one empty assignment.
    """
    empty = F.create_map().cast("map<string,string>")
    shortest = F.array_min(F.transform(F.map_values("vars"), F.size))
    none = F.coalesce(shortest, F.lit(0)) < 1
    if mode == "zip":
        each = F.transform(F.sequence(F.lit(1), shortest), lambda i: F.transform_values("vars", lambda k, v: F.element_at(v, i)))
        return rules.select("rule", F.explode(F.when(none, F.array(empty)).otherwise(each)).alias("values"))

    def add(acc: Column, entry: Column) -> Column:
        return F.flatten(F.transform(acc, lambda m: F.transform(entry["value"], lambda v: F.map_concat(m, F.map_from_arrays(F.array(entry["key"]), F.array(v))))))

    all_ = F.aggregate(F.map_entries("vars"), F.array(empty), add)
    return rules.select("rule", F.explode(F.when(none, F.array(empty)).otherwise(all_)).alias("values"))


def fill(template: Column, values: Column) -> Column:
    """``{name}`` replaced by its value; unknown names stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def nodes(sites: DataFrame, groups: DataFrame) -> DataFrame:
    """Devices ``(name, site, grp, role, idx)`` of all sites; a device's full name is site/group/device."""
    rows = sites.join(groups, "blueprint").where("n > 0").withColumn("idx", F.explode(F.sequence(F.lit(1), "n")))
    device = F.replace(F.col("template"), F.lit("{n}"), F.col("idx").cast("string"))
    return rows.select(F.concat_ws("/", "node", "grp", device).alias("name"), F.col("node").alias("site"), "grp", "role", "idx")


def inner_links(sites: DataFrame, groups: DataFrame, links: DataFrame) -> DataFrame:
    """Links within sites ``(site, a, b)``.

    ``mesh`` joins all devices of two groups, and each pair once within a group;
    ``one_to_one`` joins by number, the shorter side starting anew; ``2:3`` joins the second
    device of one group with the third of the other.
    """
    own = nodes(sites, groups)
    rules = sites.join(links, "blueprint").select(F.col("node").alias("site"), "src_grp", "dst_grp", "pattern")
    a = own.select("site", F.col("grp").alias("src_grp"), F.col("name").alias("a"), F.col("idx").alias("i"))
    b = own.select("site", F.col("grp").alias("dst_grp"), F.col("name").alias("b"), F.col("idx").alias("j"))
    both = rules.where("pattern = 'mesh'").join(a, ["site", "src_grp"]).join(b, ["site", "dst_grp"])
    mesh = both.where((F.col("src_grp") != F.col("dst_grp")) | (F.col("i") < F.col("j")))
    pair = F.split("pattern", ":")
    single = rules.where("pattern RLIKE '^[0-9]+:[0-9]+$'").withColumn("i", pair[0].cast("int")).withColumn("j", pair[1].cast("int"))
    sizes = own.groupBy("site", "grp").agg(F.count("*").alias("n"))
    counted = rules.where("pattern = 'one_to_one'").join(sizes.toDF("site", "src_grp", "na"), ["site", "src_grp"]).join(sizes.toDF("site", "dst_grp", "nb"), ["site", "dst_grp"])
    numbered = single.unionByName(_numbered(counted).drop("na", "nb")).join(a, ["site", "src_grp", "i"]).join(b, ["site", "dst_grp", "j"])
    return mesh.select("site", "a", "b").unionByName(numbered.select("site", "a", "b"))


def _numbered(rows: DataFrame) -> DataFrame:
    """A row for each link of ``na`` to ``nb`` devices one to one, with the devices' numbers ``i`` and ``j``, the shorter side wrapping.

    So each link is made once and meets its two devices by number. An error if neither count divides the other.
    """
    long, short = F.greatest("na", "nb"), F.least("na", "nb")
    n = F.when(long % short != 0, F.raise_error(F.lit("one_to_one: neither side divides the other")).cast("long")).otherwise(long)
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    number = lambda c: (F.pmod(F.col("_k") - 1, F.col(c)) + 1).cast("int")
    return rows.withColumn("i", number("na")).withColumn("j", number("nb")).drop("_k")


def group_view(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Blueprints seen as groups: ``(blueprint, a, b, patterns)``, each unordered pair of groups once; a group linked within itself has ``a = b``."""
    known = groups.select("blueprint", F.col("grp").alias("g"))
    ends = links.join(known.toDF("blueprint", "src_grp"), ["blueprint", "src_grp"], "left_semi").join(known.toDF("blueprint", "dst_grp"), ["blueprint", "dst_grp"], "left_semi")
    pair = ends.groupBy("blueprint", F.least("src_grp", "dst_grp").alias("a"), F.greatest("src_grp", "dst_grp").alias("b"))
    return pair.agg(F.array_join(F.sort_array(F.collect_set("pattern")), ",").alias("patterns"))


def site_view(site: str, devices: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Devices of one site, and device links ``(a, b)`` of which both ends are under it."""
    head = lambda c: F.substring_index(c, "/", 2) == site
    return devices.where(head("name")), links.where(head("a") & head("b"))


def apply_rules(devices: DataFrame, rules: DataFrame) -> DataFrame:
    """``devices`` with ``attrs``, a map: their role, and what rules ``(pos, path, attribute, label)`` put on names that match ``path`` (a pattern), later ones over earlier.

    A rule whose path begins with a site's plain name meets that site's devices alone; only
    rules without one, which are few, meet all.
    """
    plain = F.regexp_extract("path", r"^\^([A-Za-z0-9_-]+/[A-Za-z0-9_-]+)/", 1)
    placed = rules.withColumn("site", F.nullif(plain, F.lit("")))
    near = devices.select("name", "site").join(placed.where("site IS NOT NULL"), "site")
    loose = devices.select("name").join(F.broadcast(placed.where("site IS NULL").drop("site")), F.lit(True))
    hit = near.select("name", "pos", "path", "attribute", "label").unionByName(loose).where("name RLIKE path")
    last = hit.groupBy("name", "attribute").agg(F.max_by("label", "pos").alias("label"))
    own = last.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "label"))).alias("_own"))
    role = F.create_map(F.lit("role"), F.col("role"))
    kept = F.map_filter(role, lambda k, v: ~F.coalesce(F.map_contains_key("_own", k), F.lit(False)))
    return devices.join(own, "name", "left").withColumn("attrs", F.when(F.col("_own").isNull(), role).otherwise(F.map_concat(kept, "_own"))).drop("_own")


def match(conditions: Sequence[tuple[str, str, str]], logic: str = "or", attrs: str = "attrs") -> Column:
    """Whether a device's attributes meet conditions ``(attribute, "==" or "!=", value)``, any or all of them; without a condition all do."""
    found = []
    for name, op, value in conditions:
        if op not in ("==", "!="):
            raise ValueError(f"unknown operator {op}")
        same = F.coalesce(F.element_at(attrs, F.lit(name)) == value, F.lit(False))
        found.append(same if op == "==" else ~same)
    return reduce(lambda a, b: a | b if logic == "or" else a & b, found) if found else F.lit(True)


def site_links(site_edges: DataFrame, devices: DataFrame, roles: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Device links ``(edge_key, a, b, cost)`` of site edges, one to one between the matching devices of both ends.

    Each link is made once, from the numbers of matching devices, and meets both by number.
    Devices match if their role is one of ``roles`` and they meet ``where``, as of :func:`match`
    (any, without). They are numbered within their site over all groups.
    """
    d = devices if roles is None else devices.where(F.col("role").isin(*roles))
    d = d if where is None else d.where(where)
    d = d.select("site", "name", F.row_number().over(W.partitionBy("site").orderBy("grp", "idx")).alias("k"))
    sizes = d.groupBy("site").agg(F.max("k").cast("long").alias("n"))
    counted = site_edges.select("edge_key", "u", "v", "cost").join(sizes.toDF("u", "na"), "u").join(sizes.toDF("v", "nb"), "v")
    rows = _numbered(counted).join(d.toDF("u", "a", "i"), ["u", "i"]).join(d.toDF("v", "b", "j"), ["v", "j"])
    return rows.select("edge_key", "a", "b", "cost")


def striped_links(site_edges: DataFrame, devices: DataFrame, roles: list[str] | None = None, label: str = "g1") -> DataFrame:
    """Device links as of :func:`site_links`, where an edge with a ``stripe_attribute`` joins, at both ends, the devices whose attribute of that name is ``label``.

    Edges without one join the devices of ``roles``. ``devices`` have ``attrs``; of all edges
    at a site either all or none are striped, by one attribute.
    """
    ends = site_edges.where("stripe_attribute IS NOT NULL").select(F.explode(F.array("u", "v")).alias("site"), "stripe_attribute")
    rows = devices.join(ends.groupBy("site").agg(F.min("stripe_attribute").alias("stripe_attribute")), "site", "left")
    of_role = F.col("role").isin(*roles) if roles is not None else F.lit(True)
    striped = F.coalesce(F.element_at("attrs", F.col("stripe_attribute")) == label, F.lit(False))
    return site_links(site_edges, rows.where(F.when(F.col("stripe_attribute").isNull(), of_role).otherwise(striped)))


def link_counts(site_edges: DataFrame, sites: DataFrame, groups: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """``(edge_key, n_links)`` without expanding: counts of matching devices are looked up by blueprint."""
    g = groups if roles is None else groups.where(F.col("role").isin(*roles))
    size = sites.join(g.groupBy("blueprint").agg(F.sum("n").alias("n")), "blueprint").select("node", "n")
    rows = site_edges.join(size.toDF("u", "nu"), "u", "left").join(size.toDF("v", "nv"), "v", "left")
    return rows.select("edge_key", F.coalesce(F.when((F.col("nu") > 0) & (F.col("nv") > 0), F.greatest("nu", "nv")), F.lit(0)).alias("n_links"))


def per_link_capacity(site_edges: DataFrame, counts: DataFrame, check: bool = False) -> DataFrame:
    """``capacity``: an edge's base capacity over its number of device links.

    With ``check``, an error if a base isn't positive or an edge has no link; without, such an edge's capacity is null.
    """
    rows = site_edges.join(counts, "edge_key", "left")
    ok = (F.col("base_capacity") > 0) & (F.col("n_links") > 0)
    if check and not rows.where(~F.coalesce(ok, F.lit(False))).isEmpty():
        raise ValueError("an edge has no positive base capacity or no device links")
    return rows.withColumn("capacity", F.when(ok, F.col("base_capacity") / F.col("n_links")))


def optic_map(rules: DataFrame) -> DataFrame:
    """``(role_a, role_b, optic)`` from ``(pair, optic)``: ``a|b`` holds both ways, ``a-b`` one way.

    A pair that several rules give has the optic of the first name.
    """
    both, one = F.split("pair", r"\|"), F.split("pair", "-")
    directed = F.when(
        F.contains("pair", F.lit("|")), F.array(F.struct(both[0].alias("a"), both[1].alias("b")), F.struct(both[1].alias("a"), both[0].alias("b")))
    ).otherwise(F.array(F.struct(one[0].alias("a"), one[1].alias("b"))))
    long = rules.select("optic", F.explode(directed).alias("d")).select(F.trim("d.a").alias("role_a"), F.trim("d.b").alias("role_b"), "optic")
    return long.groupBy("role_a", "role_b").agg(F.min("optic").alias("optic"))


def assign_optics(links: DataFrame, roles: DataFrame, rules: DataFrame, components: DataFrame, check: bool = False) -> DataFrame:
    """Optic and number of modules of links ``(edge_key, u, v, capacity)``.

    ``roles`` is ``(node, role)``, ``components`` ``(name, capacity)``. Links without both
    roles or a rule are left out. So are those whose rule names an unknown optic or one
    without capacity; with ``check``, such a link is an error.
    """
    r = roles.select("node", "role")
    rows = links.join(r.toDF("u", "role_a"), "u").join(r.toDF("v", "role_b"), "v").join(optic_map(rules), ["role_a", "role_b"])
    if check:
        good = components.where("capacity > 0").select(F.col("name").alias("optic"))
        if not rows.join(good, "optic", "left_anti").isEmpty():
            raise ValueError("a link's optic is unknown or has no capacity")
    c = components.select(F.col("name").alias("optic"), F.col("capacity").alias("optic_capacity")).where("optic_capacity > 0")
    rows = rows.join(c, "optic")
    return rows.select("edge_key", "u", "v", "role_a", "role_b", "optic", F.ceil(F.col("capacity") / F.col("optic_capacity")).cast("long").alias("n_modules"))


def pair_counts(assigned: DataFrame, top: int = 3) -> DataFrame:
    """The role pairs with most optics."""
    return assigned.groupBy("role_a", "role_b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role_a", "role_b").limit(top)


def overlay(builtin: DataFrame, user: DataFrame, key: str = "name") -> DataFrame:
    """A library with the user's entries over the built-in ones of the same name."""
    return user.unionByName(builtin.join(user.select(key), key, "left_anti"))


def adjacency_roles(links: DataFrame, roles: DataFrame) -> DataFrame:
    """``(adjacency_id, n_roles, n_pairs, role_a, role_b)`` of links ``(adjacency_id, u, v)``.

    Roles and ordered role pairs of each adjacency, counted; the pair itself only where it is
    the one. More than two roles, or several pairs, can't be given one optic.
    """
    r = roles.select("node", "role")
    rows = links.join(r.toDF("u", "a"), "u").join(r.toDF("v", "b"), "v").select("adjacency_id", "a", "b").distinct()
    names = rows.select("adjacency_id", F.explode(F.array("a", "b")).alias("r")).groupBy("adjacency_id").agg(F.countDistinct("r").alias("n_roles"))
    pairs = rows.groupBy("adjacency_id").agg(F.count("*").alias("n_pairs"), F.min("a").alias("a"), F.min("b").alias("b"))
    one = lambda c: F.when(F.col("n_pairs") == 1, F.col(c))
    return pairs.join(names, "adjacency_id").select("adjacency_id", "n_roles", "n_pairs", one("a").alias("role_a"), one("b").alias("role_b"))


def heaviest_sites(sites: DataFrame, links: DataFrame) -> DataFrame:
    """The site of each blueprint with most capacity attached, the first name of equals: ``(blueprint, node, attached)``."""
    total = links.select(F.explode(F.array("u", "v")).alias("node"), "capacity").groupBy("node").agg(F.sum("capacity").alias("attached"))
    rows = sites.join(total, "node", "left").select("blueprint", "node", F.coalesce("attached", F.lit(0.0)).alias("attached"))
    top = rows.groupBy("blueprint").agg(F.min(F.struct((-F.col("attached")).alias("k"), "node")).alias("m"))
    return top.select("blueprint", "m.node", (-F.col("m.k")).alias("attached"))


def used_policies(policies: DataFrame, workflow: DataFrame, default: str, check: bool = False) -> DataFrame:
    """The default policy and those that a workflow's steps name (``failure_policy``); with ``check``, an error if one isn't known."""
    spark = policies.sparkSession
    want = workflow.where("failure_policy IS NOT NULL").select(F.col("failure_policy").alias("name")).union(spark.createDataFrame([(default,)], "name string")).distinct()
    if check and not want.join(policies, "name", "left_anti").isEmpty():
        raise ValueError("an unknown failure policy is referenced")
    return policies.join(want, "name", "left_semi")
