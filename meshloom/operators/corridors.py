"""Corridors between metros: best paths, shared-risk groups, extraction.

``paths`` are ``(metro_a, metro_b, path_index, length_km)``, ``path_edges`` ``(metro_a,
metro_b, path_index, pos, edge_id)``, one row for each edge of a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshloom.functions.numeric import detour, distance
from meshloom.functions.text import risk_group

PAIR = ("metro_a", "metro_b")
PATH = (*PAIR, "path_index")


def path_lengths(path_edges: DataFrame, edges: DataFrame, max_km: float | None = None) -> DataFrame:
    """Length of every path from its edges; with a limit, longer ones go and indexes keep their gaps."""
    total = path_edges.join(edges.select("edge_id", "length_km"), "edge_id").groupBy(*PATH).agg(F.sum("length_km").alias("length_km"))
    return total if max_km is None else total.where(F.col("length_km") <= max_km)


def best_paths(paths: DataFrame) -> DataFrame:
    """The shortest path of each pair; of equal ones, that of the lower index."""
    rank = W.partitionBy(*PAIR).orderBy("length_km", "path_index")
    return paths.withColumn("r", F.row_number().over(rank)).where("r = 1").drop("r")


def path_edges_of(paths: DataFrame) -> DataFrame:
    """``path_edges`` from paths with ordered ``nodes``; an edge's id is its two ends, the smaller first."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.array_sort(F.array(F.element_at("nodes", i), F.element_at("nodes", i + 1))))
    long = paths.where(F.size("nodes") > 1).select(*PATH, F.posexplode(pairs).alias("pos", "e"))
    return long.select(*PATH, "pos", F.concat_ws("__", F.col("e")[0].cast("string"), F.col("e")[1].cast("string")).alias("edge_id"))


def _inside(x: Column, y: Column) -> Column:
    return distance(x, y, F.col("mx"), F.col("my")) <= F.col("mr")


def outside_metros(edges: DataFrame, metros: DataFrame) -> DataFrame:
    """Edges ``(edge_id, ax, ay, bx, by)`` of which no end is in a metro's circle, rim included.

    Ends and circles meet by grid cells as wide as the largest circle, so an end is compared
    with circles around it alone.
    """
    wide = 1000 * (metros.agg(F.max("radius_km")).first()[0] or 1.0)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    circles = metros.select(F.col("x").alias("mx"), F.col("y").alias("my"), (F.col("radius_km") * 1000).alias("mr")).withColumn("dx", around).withColumn("dy", around)
    circles = circles.select("mx", "my", "mr", (F.floor(F.col("mx") / wide) + F.col("dx")).alias("gx"), (F.floor(F.col("my") / wide) + F.col("dy")).alias("gy"))
    ends = edges.select("edge_id", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    ends = ends.select("edge_id", "p.x", "p.y", F.floor(F.col("p.x") / wide).alias("gx"), F.floor(F.col("p.y") / wide).alias("gy"))
    hit = ends.join(circles, ["gx", "gy"]).where(_inside(F.col("x"), F.col("y"))).select("edge_id").distinct()
    return edges.join(hit, "edge_id", "left_anti")


def risk_groups(path_edges: DataFrame, names: DataFrame, open_edges: DataFrame | None = None, prefix: str = "corridor_risk") -> DataFrame:
    """``(edge_id, risk_group)``: each path over an edge puts its group on it.

    ``names`` is ``(metro_id, name)``. Edges that aren't in ``open_edges`` (those outside the
    metros) get none.
    """
    if open_edges is not None:
        path_edges = path_edges.join(open_edges.select("edge_id"), "edge_id", "left_semi")
    n = names.select("metro_id", "name")
    rows = path_edges.join(n.toDF("metro_a", "name_a"), "metro_a").join(n.toDF("metro_b", "name_b"), "metro_b")
    return rows.select("edge_id", risk_group(F.col("name_a"), F.col("name_b"), F.col("path_index"), prefix).alias("risk_group")).distinct()


def extract(paths: DataFrame, path_edges: DataFrame, edge_risks: DataFrame, metros: DataFrame) -> DataFrame:
    """The corridor of each pair: length of its best path, straight line, detour, and all risk groups on its edges, sorted.

    A corridor takes on the groups of other pairs whose paths share its edges. Corridors
    without any have an empty array.
    """
    best = best_paths(paths)
    m = metros.select("metro_id", "x", "y")
    rows = best.join(m.toDF("metro_a", "ax", "ay"), "metro_a").join(m.toDF("metro_b", "bx", "by"), "metro_b")
    straight = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) / 1000
    on = path_edges.join(best.select(*PATH), list(PATH), "left_semi").join(edge_risks, "edge_id")
    groups = on.select(*PAIR, "risk_group").distinct().groupBy(*PAIR).agg(F.sort_array(F.collect_list("risk_group")).alias("risk_groups"))
    return rows.join(groups, list(PAIR), "left").select(
        *PATH, "length_km", straight.alias("euclidean_km"), detour(F.col("length_km"), straight).alias("detour_ratio"),
        F.coalesce("risk_groups", F.array().cast("array<string>")).alias("risk_groups"),
    )


def risk_distances(corridors: DataFrame, names: DataFrame, prefix: str = "corridor_risk") -> DataFrame:
    """``(risk_group, distance_km)``: the longest corridor, in whole kilometres, of each group.

    A numbered group takes the distance of its pair's own corridor, if there is one.
    """
    n = names.select("metro_id", "name")
    rows = corridors.join(n.toDF("metro_a", "name_a"), "metro_a").join(n.toDF("metro_b", "name_b"), "metro_b")
    km = F.ceil("length_km").cast("long")
    own = rows.groupBy(risk_group(F.col("name_a"), F.col("name_b"), F.lit(0), prefix).alias("pair")).agg(F.max(km).alias("own_km"))
    long = rows.select(F.explode("risk_groups").alias("risk_group"), km.alias("km"))
    long = long.withColumn("pair", F.regexp_replace("risk_group", "_path[0-9]+$", ""))
    return long.join(own, "pair", "left").groupBy("risk_group").agg(F.max(F.coalesce("own_km", "km")).alias("distance_km"))


def summary(corridors: DataFrame) -> DataFrame:
    """Number, total and mean length."""
    return corridors.agg(F.count("*").alias("n_corridors"), F.sum("length_km").alias("total_km"), F.avg("length_km").alias("avg_km"))


def distinct_pairs(tags: DataFrame) -> DataFrame:
    """Unordered metro pairs that tags name."""
    return tags.select(F.least(*PAIR).alias("metro_a"), F.greatest(*PAIR).alias("metro_b")).distinct()


def path_geometry(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``segment_ids`` and ``geometry`` of paths with ordered ``nodes``, from edges ``(a, b, segment_id, geometry)``.

    An edge's geometry runs from ``a`` to ``b`` and is turned where the path goes the other way;
    the vertex that two edges share is there once. Edges without a segment id (anchors) give none.
    """
    steps = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(F.element_at("nodes", i).alias("u"), F.element_at("nodes", i + 1).alias("v")))
    long = paths.where(F.size("nodes") > 1).select(*PATH, F.posexplode(steps).alias("pos", "s")).select(*PATH, "pos", "s.*")
    turned = edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "segment_id", F.reverse("geometry").alias("geometry"))
    either = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "segment_id", "geometry").union(turned).dropDuplicates(["u", "v"])
    parts = F.sort_array(F.collect_list(F.struct("pos", "segment_id", "geometry")))
    whole = long.join(either, ["u", "v"]).groupBy(*PATH).agg(parts.alias("p"))
    rest = lambda x: F.when(x["pos"] == 0, x["geometry"]).otherwise(F.slice(x["geometry"], F.lit(2), F.size(x["geometry"])))
    return whole.select(
        *PATH, F.filter(F.transform("p", lambda x: x["segment_id"]), lambda s: s.isNotNull()).alias("segment_ids"), F.flatten(F.transform("p", rest)).alias("geometry")
    )
