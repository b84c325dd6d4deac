"""Demands over shortest paths with equal split, and link capacities from the loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions.numeric import quantize_up
from meshloom.functions.text import metro_index
from meshloom.operators.graph import shortest_distances
from meshloom.session import cut


def metro_demands(demands: DataFrame) -> DataFrame:
    """``(s, t, demand)`` between metros; demands without a metro at an end, within one, or not positive go."""
    rows = demands.select(metro_index(F.col("source_path")).alias("s"), metro_index(F.col("sink_path")).alias("t"), "demand")
    return rows.where("s IS NOT NULL AND t IS NOT NULL AND s <> t AND demand > 0").groupBy("s", "t").agg(F.sum("demand").alias("demand"))


def flow_edges(site_edges: DataFrame) -> DataFrame:
    """Directed edges ``(edge_key, way, a, b, cost)`` between metros, two for each corridor link."""
    number = lambda c: F.regexp_extract(c, "^metro([0-9]+)/", 1).cast("int")
    links = site_edges.where("link_type = 'inter_metro_corridor'").select("edge_key", number("u").alias("s"), number("v").alias("t"), "cost")
    ways = F.array(F.struct(F.lit("fwd").alias("way"), F.col("s").alias("a"), F.col("t").alias("b")), F.struct(F.lit("rev").alias("way"), F.col("t").alias("a"), F.col("s").alias("b")))
    return links.select("edge_key", "cost", F.explode(ways).alias("w")).select("edge_key", "w.*", "cost")


def ecmp_loads(edges: DataFrame, demands: DataFrame) -> DataFrame:
    """``(edge_key, way, load)`` after all demands ``(s, t, demand)`` are placed on shortest paths.

    What leaves a node for a destination is split equally over all edges that lie on a
    shortest path there, parallel ones included. Loads add up, so flows to one destination
    move together: each round takes them one edge further, until all have arrived. Demands
    to where no path leads are left out.
    """
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost")
    to = demands.select(F.col("t").alias("source")).distinct()
    dist = cut(shortest_distances(back, to).select(F.col("source").alias("t"), F.col("node"), F.col("dist")))
    near = dist.select("t", F.col("node").alias("b"), F.col("dist").alias("rest"))
    far = dist.select("t", F.col("node").alias("a"), F.col("dist").alias("whole"))
    tight = edges.join(near, "b").join(far, ["t", "a"]).where(F.col("cost") + F.col("rest") == F.col("whole"))
    fan = tight.groupBy("t", "a").agg(F.count("*").alias("fan"))
    tight = cut(tight.join(fan, ["t", "a"]).select("t", "a", "b", "edge_key", "way", "fan"))
    moving = cut(demands.select("t", F.col("s").alias("a"), F.col("demand").alias("amount")))
    placed = []
    while True:
        step = cut(moving.join(tight, ["t", "a"]).withColumn("amount", F.col("amount") / F.col("fan")))
        if step.isEmpty():
            break
        placed.append(step.select("edge_key", "way", "amount"))
        moving = step.where("b <> t").groupBy("t", F.col("b").alias("a")).agg(F.sum("amount").alias("amount"))
    if not placed:
        return edges.select("edge_key", "way", F.lit(0.0).alias("load")).where("false")
    every = placed[0]
    for p in placed[1:]:
        every = every.union(p)
    return every.groupBy("edge_key", "way").agg(F.sum("amount").alias("load"))


def size_corridors(site_edges: DataFrame, loads: DataFrame, quantum: float = 3200.0, headroom: float = 1.3, keep_base: bool = True) -> DataFrame:
    """Corridor links with ``base_capacity`` for the heavier of both ways; at least what it was, if ``keep_base``. Links without a load stay."""
    most = loads.groupBy("edge_key").agg(F.max("load").alias("load"))
    rows = site_edges.where("link_type = 'inter_metro_corridor'").join(most, "edge_key", "left")
    sized = quantize_up(F.col("load") * headroom, quantum).cast("double")
    new = F.greatest("base_capacity", sized) if keep_base else F.coalesce(sized, "base_capacity")
    return rows.withColumn("base_capacity", F.when(F.col("load") > 0, new).otherwise(F.col("base_capacity"))).drop("load").select(*site_edges.columns)


def pop_egress(corridors: DataFrame) -> DataFrame:
    """``(node, egress)``: capacity of all corridor links at a site."""
    return corridors.select(F.explode(F.array("u", "v")).alias("node"), "base_capacity").groupBy("node").agg(F.sum("base_capacity").alias("egress"))


def size_local(site_edges: DataFrame, corridors: DataFrame, quantum: float = 3200.0, alpha: float = 1.2, beta: float = 0.8, keep_base: bool = True) -> DataFrame:
    """Links within metros, sized from the egress of their points of presence.

    A data centre's link takes ``alpha`` times the egress of its point of presence, a link
    of two of these ``beta`` times the smaller egress.
    """
    egress = pop_egress(corridors)
    rows = site_edges.where("link_type IN ('dc_to_pop', 'intra_metro')")
    rows = rows.join(egress.toDF("u", "eu"), "u", "left").join(egress.toDF("v", "ev"), "v", "left").na.fill(0.0, ["eu", "ev"])
    want = F.when(F.col("link_type") == "dc_to_pop", alpha * F.col("ev")).otherwise(beta * F.least("eu", "ev"))
    sized = quantize_up(want, quantum).cast("double")
    return rows.withColumn("base_capacity", F.greatest("base_capacity", sized) if keep_base else sized).select(*site_edges.columns)


def capacity_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Corridor capacity by directed metro pair, before and after, with difference and factor."""
    total = lambda df, name: df.groupBy("source_metro", "target_metro").agg(F.sum("base_capacity").alias(name))
    rows = total(before, "before").join(total(after, "after"), ["source_metro", "target_metro"], "full_outer").na.fill(0.0, ["before", "after"])
    return rows.withColumn("delta", F.col("after") - F.col("before")).withColumn("factor", F.when(F.col("before") > 0, F.col("after") / F.col("before")))
