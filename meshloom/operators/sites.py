"""Site graph: points of presence and data centres of each metro, and the links between them.

Metros are ``(metro_idx, name, x, y, radius_km, pops, dcs)``. Edges are ``(u, v, edge_key,
link_type, base_capacity, cost, adjacency_id, source_metro, target_metro)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshloom.functions.numeric import ring_arc
from meshloom.functions.text import natural_number, natural_prefix, site_id

#: Share of a metro's radius at which its sites stand, and the angle of the first one.
RINGS = {"pop": (0.70, 0.0), "dc": (0.40, math.pi / 4)}


def _upto(n: Column) -> Column:
    return F.explode(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))


def nodes(metros: DataFrame) -> DataFrame:
    """``(node, metro_idx, kind, ordinal)`` of every site."""
    kinds = F.explode(F.array(F.struct(F.lit("pop").alias("kind"), F.col("pops").alias("n")), F.struct(F.lit("dc").alias("kind"), F.col("dcs").alias("n"))))
    rows = metros.select("metro_idx", kinds.alias("k")).select("metro_idx", "k.kind", _upto(F.col("k.n").cast("int")).alias("ordinal"))
    return rows.select(site_id(F.col("metro_idx"), F.col("kind"), F.col("ordinal")).alias("node"), "metro_idx", "kind", "ordinal")


def positions(metros: DataFrame) -> DataFrame:
    """Sites with ``pos_x`` and ``pos_y``: evenly on a ring of their kind around the metro's centre."""
    rows = nodes(metros).join(metros.select("metro_idx", "x", "y", "radius_km", "pops", "dcs"), "metro_idx")
    share = F.when(F.col("kind") == "pop", RINGS["pop"][0]).otherwise(RINGS["dc"][0])
    phase = F.when(F.col("kind") == "pop", RINGS["pop"][1]).otherwise(RINGS["dc"][1])
    n = F.when(F.col("kind") == "pop", F.col("pops")).otherwise(F.col("dcs"))
    angle = phase + F.lit(2 * math.pi) * (F.col("ordinal") - 1) / n
    r = share * F.greatest(F.lit(0.0), F.col("radius_km") * 1000.0)
    return rows.select("node", "metro_idx", "kind", "ordinal", (F.col("x") + r * F.cos(angle)).alias("pos_x"), (F.col("y") + r * F.sin(angle)).alias("pos_y"))


def _edge(u: Column, v: Column, key: Column, kind: str, capacity: float, cost: Column, adjacency: Column, source: str, target: str) -> list[Column]:
    return [
        u.alias("u"), v.alias("v"), key.alias("edge_key"), F.lit(kind).alias("link_type"), F.lit(float(capacity)).alias("base_capacity"),
        cost.cast("long").alias("cost"), adjacency.alias("adjacency_id"), F.col(source).alias("source_metro"), F.col(target).alias("target_metro"),
    ]


def intra_metro_edges(metros: DataFrame, capacity: float = 400.0, base_cost: int = 1) -> DataFrame:
    """A mesh of the points of presence of each metro; cost is the way along the ring."""
    n = F.col("pops").cast("int")
    rows = metros.where("pops > 1").withColumn("i", _upto(n)).withColumn("j", _upto(n)).where("i < j")
    cost = ring_arc(n, F.col("i"), F.col("j"), F.col("radius_km"), F.lit(base_cost))
    adjacency = F.concat(F.lit("intra_metro:"), "name")
    pop = lambda k: site_id(F.col("metro_idx"), F.lit("pop"), F.col(k))
    key = F.concat(adjacency, F.lit(":"), "i", F.lit("-"), "j")
    return rows.select(*_edge(pop("i"), pop("j"), key, "intra_metro", capacity, cost, adjacency, "name", "name"))


def dc_pop_edges(metros: DataFrame, capacity: float = 800.0, base_cost: int = 1) -> DataFrame:
    """Every data centre to every point of presence of its metro.

    Data centres are spread over the ring of points of presence; cost is the shorter way
    from the two places next to one's own, 1 at least.
    """
    n, d = F.col("pops").cast("int"), F.col("dcs").cast("int")
    rows = metros.where("pops > 0 AND dcs > 0").withColumn("dc", _upto(d)).withColumn("pop", _upto(n))
    place = (F.col("dc") - 1) * (n / d)
    ways = [ring_arc(n, F.col("pop"), F.pmod(f(place), n) + 1, F.col("radius_km"), F.lit(base_cost)) for f in (F.floor, F.ceil)]
    adjacency = F.concat(F.lit("dc_to_pop:"), "name")
    key = F.concat(adjacency, F.lit(":"), "dc", F.lit("-"), "pop")
    u, v = site_id(F.col("metro_idx"), F.lit("dc"), F.col("dc")), site_id(F.col("metro_idx"), F.lit("pop"), F.col("pop"))
    return rows.select(*_edge(u, v, key, "dc_to_pop", capacity, F.greatest(F.lit(1), F.least(*ways)), adjacency, "name", "name"))


def inter_metro_edges(corridors: DataFrame, metros: DataFrame, mode: str = "mesh", capacity: float = 1600.0, stripes: int = 0, base_cost: int = 1) -> DataFrame:
    """Links over corridors ``(metro_a, metro_b, length_km)``, by id of metros that are known.

    ``mesh`` joins all points of presence of both metros, ``one_to_one`` those of equal
    number. With ``stripes``, the mesh's links take the labels g1, g2, ... in turn, in order
    of their ends, and each label is an adjacency of its own.
    """
    m = metros.select("metro_id", "metro_idx", "name", F.col("pops").cast("int").alias("pops"))
    rows = corridors.join(m.toDF("metro_a", "s_idx", "s_name", "s_pops"), "metro_a").join(m.toDF("metro_b", "t_idx", "t_name", "t_pops"), "metro_b")
    adjacency = F.concat(F.lit("inter_metro:"), F.least("s_idx", "t_idx"), F.lit("-"), F.greatest("s_idx", "t_idx"))
    if mode == "one_to_one" and not stripes:
        rows = rows.withColumn("p", _upto(F.least("s_pops", "t_pops"))).withColumn("q", F.col("p"))
    elif mode == "mesh" or stripes:
        rows = rows.withColumn("p", _upto(F.col("s_pops"))).withColumn("q", _upto(F.col("t_pops")))
    else:
        raise ValueError(f"unknown mode: {mode}")
    key = F.concat(adjacency, F.lit(":"), "p", F.lit("-"), "q")
    label = adjacency
    if stripes:
        turn = F.pmod((F.col("p") - 1) * F.col("t_pops") + F.col("q") - 1, F.lit(stripes)) + 1
        label = F.concat(adjacency, F.lit(":g"), turn)
    cost = F.ceil(F.coalesce("length_km", F.lit(float(base_cost))))
    u, v = site_id(F.col("s_idx"), F.lit("pop"), F.col("p")), site_id(F.col("t_idx"), F.lit("pop"), F.col("q"))
    return rows.select(*_edge(u, v, key, "inter_metro_corridor", capacity, cost, label, "s_name", "t_name"))


def unknown_metros(corridors: DataFrame, metros: DataFrame) -> DataFrame:
    """Corridor ends that no metro has."""
    ends = corridors.select(F.explode(F.array("metro_a", "metro_b")).alias("metro_id")).distinct()
    return ends.join(metros, "metro_id", "left_anti")


def devices(groups: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """``(blueprint, grp, role, device)`` from blueprint groups with ``n`` devices of a ``template``; all roles if none is given."""
    rows = groups if not roles else groups.where(F.col("role").isin(*roles))
    rows = rows.withColumn("i", _upto(F.col("n").cast("int")))
    return rows.select("blueprint", "grp", "role", F.replace(F.col("template"), F.lit("{n}"), F.col("i").cast("string")).alias("device"))


def stripes_by_width(named: DataFrame, width: int, owner: str = "blueprint", check: bool = True) -> DataFrame:
    """Devices in natural order, cut into stripes g1, g2, ... of equal width, by owner.

    Natural order is by the name without digits, then by its digits as a number. An error if
    the width isn't positive or, with ``check``, doesn't divide an owner's number of devices.
    """
    if width <= 0:
        raise ValueError("striping width must be positive")
    if check and not named.groupBy(owner).agg(F.count("*").alias("n")).where(F.col("n") % width != 0).isEmpty():
        raise ValueError(f"number of devices is not divisible by width {width}")
    order = W.partitionBy(owner).orderBy(natural_prefix(F.col("device")), natural_number(F.col("device")), "device")
    place = F.row_number().over(order)
    return named.select(owner, "device", place.alias("place"), F.concat(F.lit("g"), F.floor((place - 1) / width) + 1).alias("stripe"))


def stripe_rules(striped: DataFrame, sites: DataFrame, attribute: str, owner: str = "blueprint") -> DataFrame:
    """Rules ``(path, attribute, label)`` that put a stripe on the devices of sites ``(node, owner)``; a path has one group level."""
    path = F.concat(F.lit("^"), "node", F.lit("/[^/]+/"), "device", F.lit("$"))
    return sites.join(striped, owner).select(path.alias("path"), F.lit(attribute).alias("attribute"), F.col("stripe").alias("label")).distinct()


def stripes_by_attribute(named: DataFrame, labels: DataFrame, owner: str = "blueprint") -> DataFrame:
    """Devices with the label of their group, ``(owner, device, place, stripe)``, in natural order within a label; groups without one are left out."""
    rows = named.join(labels.where("label IS NOT NULL"), [owner, "grp"])
    order = W.partitionBy(owner, "label").orderBy(natural_prefix(F.col("device")), natural_number(F.col("device")), "device")
    return rows.select(owner, "device", F.row_number().over(order).alias("place"), F.col("label").alias("stripe"))


def unmatched_stripes(striped: DataFrame, pairs: DataFrame, owner: str = "blueprint") -> DataFrame:
    """Stripes that one side of a pair ``(pair, left, right)`` of owners has and the other lacks: ``(pair, stripe, on)``."""
    own = striped.select(owner, "stripe").distinct()
    side = lambda c: pairs.select("pair", F.col(c).alias(owner)).join(own, owner).select("pair", "stripe", F.lit(True).alias(c))
    both = side("left").join(side("right"), ["pair", "stripe"], "full_outer")
    return both.where("left IS NULL OR right IS NULL").select("pair", "stripe", F.when(F.col("right").isNull(), F.lit("left")).otherwise(F.lit("right")).alias("on"))


def striped_dc_edges(dc_edges: DataFrame, settings: DataFrame) -> DataFrame:
    """Edges of data centres with ``stripe_attribute``, ``stripe_dc_<metro>`` where the metro's family is striped (a width or an attribute), else null."""
    striped = settings.where("family = 'dc_to_pop_link' AND (stripe_width IS NOT NULL OR stripe_attribute IS NOT NULL)").select("metro_idx", F.lit(True).alias("_striped"))
    number = F.regexp_extract("u", "^metro([0-9]+)/", 1).cast(settings.schema["metro_idx"].dataType)
    rows = dc_edges.withColumn("metro_idx", number).join(striped, "metro_idx", "left")
    return rows.withColumn("stripe_attribute", F.when(F.col("_striped"), F.concat(F.lit("stripe_dc_"), "metro_idx"))).drop("_striped", "metro_idx")
