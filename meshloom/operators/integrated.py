"""Metros and roads in one graph, and checks of it.

Road nodes are ``(x, y)``, road edges ``(ax, ay, bx, by, length_km)``; anchors come from
:func:`meshloom.operators.metros.anchors`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.graph import component_sizes


def nodes(road_nodes: DataFrame, metros: DataFrame) -> DataFrame:
    """``(x, y, node_type, metro_id)``: a metro that stands on a road node is merged with it; plain road nodes have no type."""
    m = metros.select("x", "y", "metro_id", F.lit(True).alias("is_metro"))
    both = road_nodes.select("x", "y", F.lit(True).alias("is_road")).join(m, ["x", "y"], "full_outer")
    kind = F.when(F.col("is_metro") & F.col("is_road"), "metro+highway").when(F.col("is_metro"), "metro")
    return both.select("x", "y", kind.alias("node_type"), "metro_id")


def edges(road_edges: DataFrame, metros: DataFrame, anchors: DataFrame) -> DataFrame:
    """Road edges, and one from each metro to its anchor, of length zero if it stands on it."""
    roads = road_edges.select("ax", "ay", "bx", "by", "length_km", F.lit(None).cast("string").alias("edge_type"), F.lit(None).cast("string").alias("metro_id"))
    own = metros.select("metro_id", "x", "y").join(anchors, "metro_id")
    tied = own.select("x", "y", F.col("ax").alias("to_x"), F.col("ay").alias("to_y"), "distance_km", F.lit("metro_anchor").alias("edge_type"), "metro_id")
    return roads.union(tied)


def checks(all_edges: DataFrame, metros: DataFrame, max_degree: int = 1000) -> DataFrame:
    """Issues ``(check, key)``: metros without exactly one anchor, edges of negative or unknown length, nodes of too high a degree."""
    tied = all_edges.where("edge_type = 'metro_anchor'").groupBy("metro_id").agg(F.count("*").alias("n"))
    loose = metros.select("metro_id").join(tied, "metro_id", "left").where("coalesce(n, 0) <> 1").select(F.lit("anchor").alias("check"), F.col("metro_id").alias("key"))
    name = lambda x, y: F.concat_ws("_", F.col(x), F.col(y))
    bad = all_edges.where("length_km IS NULL OR isnan(length_km) OR length_km < 0").select(F.lit("length"), F.concat_ws("-", name("ax", "ay"), name("bx", "by")))
    ends = all_edges.select(F.explode(F.array(name("ax", "ay"), name("bx", "by"))).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    return loose.union(bad).union(ends.where(F.col("d") > max_degree).select(F.lit("degree"), "node"))


def corridor_checks(corridors: DataFrame, metros: DataFrame) -> DataFrame:
    """One row on the corridor graph: metros, corridors, metros without one, and components of the rest."""
    pairs = corridors.select(F.col("metro_a").alias("a"), F.col("metro_b").alias("b"))
    on = pairs.select(F.explode(F.array("a", "b")).alias("metro_id")).distinct()
    alone = metros.join(on, "metro_id", "left_anti").agg(F.count("*").alias("n_alone"))
    parts = component_sizes(pairs).agg(F.count("*").alias("n_components"), F.coalesce(F.max("n_nodes"), F.lit(0)).alias("largest"))
    counts = metros.agg(F.count("*").alias("n_metros")).join(pairs.agg(F.count("*").alias("n_corridors")), F.lit(True))
    return counts.join(alone, F.lit(True)).join(parts, F.lit(True))
