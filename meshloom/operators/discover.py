"""Corridors between metros found on the road graph: contraction, anchors, adjacent pairs, paths, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.graph import contract_chains, k_shortest_paths
from meshloom.session import cut


def _found(edges: DataFrame, anchors: DataFrame, pairs: DataFrame, k: int, max_km: float | None, check: bool) -> tuple[DataFrame, DataFrame]:
    """Paths of :func:`road_corridors`, and the contracted roads they were found on."""
    at = anchors.select("metro_id", "node")
    ends = pairs.select("metro_a", "metro_b").join(at.toDF("metro_a", "a"), "metro_a").join(at.toDF("metro_b", "b"), "metro_b").where("a <> b")
    ends = cut(ends.select("metro_a", "metro_b", "a", "b"))
    short = cut(contract_chains(edges, at.select("node").distinct()))
    found = k_shortest_paths(short.select("a", "b", "length_km"), ends.select("a", "b").distinct(), k, max_km)
    paths = ends.join(found, ["a", "b"]).select("metro_a", "metro_b", "path_index", "length_km", "nodes")
    if check and paths.isEmpty():
        raise ValueError("no pair of metros has a corridor")
    return paths, short


def road_corridors(edges: DataFrame, anchors: DataFrame, pairs: DataFrame, k: int = 1, max_km: float | None = None, check: bool = False) -> DataFrame:
    """Paths ``(metro_a, metro_b, path_index, length_km, nodes)`` of adjacent metros over the road graph ``(a, b, length_km)``.

    ``anchors`` is ``(metro_id, node)``, ``pairs`` ``(metro_a, metro_b)``. Roads are contracted
    first, all anchors staying. Pairs of metros that share an anchor, or without one, have no
    path; nor have those whose paths are longer than ``max_km``. With ``check``, an error if
    no pair has one.
    """
    return _found(edges, anchors, pairs, k, max_km, check)[0]


def registry(edges: DataFrame, anchors: DataFrame, pairs: DataFrame, k: int = 1, max_km: float | None = None, check: bool = False) -> DataFrame:
    """:func:`road_corridors` with the roads under them: also ``segments``, ``n_edges`` and ``road_nodes``.

    ``segments`` names the contracted edges in order, ``road_nodes`` are all nodes of the
    uncontracted roads from the first anchor to the second, and ``n_edges`` the roads between.
    """
    paths, short = _found(edges, anchors, pairs, k, max_km, check)
    key = ["metro_a", "metro_b", "path_index"]
    hop = F.posexplode(F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.get("nodes", i).alias("u"), F.get("nodes", i + 1).alias("v"))))
    hops = paths.select(*key, hop.alias("pos", "h")).select(*key, "pos", "h.u", F.least("h.u", "h.v").alias("a"), F.greatest("h.u", "h.v").alias("b"))
    roads = short.select("a", "b", "n_edges", F.col("nodes").alias("way"))
    onward = F.when(F.get("way", F.lit(0)) == F.col("u"), F.col("way")).otherwise(F.reverse("way"))
    part = F.struct("pos", F.concat_ws("~", "a", "b").alias("segment"), F.slice(onward, 2, F.size("way") - 1).alias("way"), "n_edges")
    under = hops.join(roads, ["a", "b"]).select(*key, part.alias("part")).groupBy(*key).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = F.concat(F.slice("nodes", 1, 1), F.flatten(F.transform("parts", lambda p: p["way"])))
    return paths.join(under, key).select(
        *key, "length_km", "nodes", F.transform("parts", lambda p: p["segment"]).alias("segments"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n_edges"]).alias("n_edges"), whole.alias("road_nodes"),
    )


def path_edges(paths: DataFrame) -> DataFrame:
    """``(metro_a, metro_b, path_index, pos, a, b)``: the edges of each path in order, each from its smaller end."""
    hop = F.posexplode(F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.get("nodes", i).alias("u"), F.get("nodes", i + 1).alias("v"))))
    hops = paths.select("metro_a", "metro_b", "path_index", hop.alias("pos", "h"))
    return hops.select("metro_a", "metro_b", "path_index", "pos", F.least("h.u", "h.v").alias("a"), F.greatest("h.u", "h.v").alias("b"))


def tags(paths: DataFrame) -> DataFrame:
    """``(a, b, n_paths, tags)``: the corridors that run over each edge, in order of metros and index."""
    tag = F.struct("metro_a", "metro_b", "path_index")
    return path_edges(paths).groupBy("a", "b").agg(F.count("*").alias("n_paths"), F.sort_array(F.collect_set(tag)).alias("tags"))
