"""The stage from source files to metros and the corridors between them, from one configuration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshloom import config, stages
from meshloom.functions import polygon
from meshloom.functions.text import sanitize
from meshloom.operators import discover, graph, metros, overlay, roads
from meshloom.session import cut, not_empty
from meshloom.sources import shapes
from meshloom.stages import Stage


def road_graph(spark: SparkSession, config: dict) -> DataFrame:
    """Edges ``(a, b, length_km)`` of the kept road classes, snapped, without slivers; the largest component, if that is asked for."""
    h = config["highway_processing"]
    lines = roads.keep_classes(shapes.roads(spark, config["data_sources"]["tiger_roads"], h["highway_classes"]), h["highway_classes"], check=True)
    edges = roads.snapped_edges(roads.vertices(roads.parts(lines)), h["snap_precision_m"])
    edges = edges.select(F.concat_ws("_", "ax", "ay").alias("a"), F.concat_ws("_", "bx", "by").alias("b"), "length_km")
    edges = not_empty(cut(graph.drop_slivers(edges, h["min_edge_length_km"])), "no road is left")
    return cut(graph.keep_largest(edges)) if h["filter_largest_component"] else edges


def metro_table(spark: SparkSession, config: dict) -> DataFrame:
    """Metros ``(metro_idx, metro_id, name, name_orig, x, y, radius_km)``: urban areas within the boundary, those named and the largest."""
    c, source = config["clustering"], config["data_sources"]
    mask = overlay.dissolve(not_empty(shapes.states(spark, source["conus_boundary"]), "the boundary file holds no state")).withColumn("statefp", F.lit("all"))
    areas = metros.within(shapes.urban_areas(spark, source["uac_polygons"]), mask)
    chosen = metros.select(metros.with_radius(areas, c["max_uac_radius_km"]), c["metro_clusters"], c["override_metro_clusters"], check=True)
    placed = metros.centred(shapes.project(chosen))
    order = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("sel_pos"))  # as many rows as metros are asked for
    return placed.select(order.alias("metro_idx"), F.col("uac_code").alias("metro_id"), sanitize(F.col("name_orig")).alias("name"), "name_orig", "x", "y", "radius_km")


def _anchors(spark: SparkSession, config: dict, made: dict[str, DataFrame]) -> DataFrame:
    snap = config["highway_processing"]["snap_precision_m"]
    grid = lambda k: F.split("node", "_")[k].cast("double") * snap
    nodes = graph.both_ways(made["roads"]).select(F.col("u").alias("node")).distinct().select(grid(0).alias("x"), grid(1).alias("y"))
    near = metros.anchors(made["metros"], nodes, config["validation"]["max_metro_highway_distance_km"])
    return near.withColumn("node", F.concat_ws("_", *[F.rint(F.col(k) / snap).cast("long") for k in ("ax", "ay")]))


def _corridors(spark: SparkSession, config: dict, made: dict[str, DataFrame]) -> DataFrame:
    c = config["corridors"]
    pairs = metros.neighbours(made["metros"], c["k_nearest"], c["max_edge_km"]).select(F.col("a").alias("metro_a"), F.col("b").alias("metro_b"))
    return discover.road_corridors(made["roads"], made["anchors"], pairs, c["k_paths"], c["max_corridor_distance_km"], check=True)


STAGES = (
    Stage("roads", lambda spark, config, made: road_graph(spark, config), ("highway_processing",), ("data_sources.tiger_roads",), (), (shapes, roads, graph)),
    Stage("metros", lambda spark, config, made: metro_table(spark, config), ("clustering",), ("data_sources.uac_polygons", "data_sources.conus_boundary"), (), (shapes, metros, polygon, overlay)),
    Stage("anchors", _anchors, ("highway_processing.snap_precision_m", "validation.max_metro_highway_distance_km"), (), ("roads", "metros"), (metros,)),
    Stage("corridors", _corridors, ("corridors",), (), ("roads", "metros", "anchors"), (discover, graph, metros)),
    Stage("corridor_edges", lambda spark, config, made: discover.path_edges(made["corridors"]), (), (), ("corridors",), (discover,)),
)


def build(spark: SparkSession, config: dict, folder: str, force: bool = False) -> tuple[dict[str, DataFrame], list[str]]:
    """Write the tables of STAGES as Parquet under ``folder``, those that have changed or all with ``force``.

    Returns them as read back, and the names of those that were made; an error if no metros are joined.
    """
    return stages.run(spark, STAGES, config, folder, force)


class Outcome(NamedTuple):
    """What became of a configuration: ``ok``, ``config`` or ``failed``, the error if any, and the stages that were made."""

    name: str
    state: str
    error: str
    fresh: list[str]


def batch(spark: SparkSession, configs: str, folder: str, include: Sequence[str] = (), exclude: Sequence[str] = (), force: bool = False) -> Iterator[Outcome]:
    """Build each YAML configuration right under ``configs`` into a folder of its own name.

    ``include`` and ``exclude`` are globs on file names: one of the first has to match, if there
    are any, and none of the second. One that fails doesn't keep the others from running.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yml,yaml}").load(configs).select("path").orderBy("path").collect()
    for path in [r.path for r in files]:
        name = path.rsplit("/", 1)[1]
        if (include and not any(fnmatchcase(name, g) for g in include)) or any(fnmatchcase(name, g) for g in exclude):
            continue
        try:
            given = config.load(spark, path)
        except ValueError as e:
            yield Outcome(name, "config", str(e), [])
            continue
        try:
            yield Outcome(name, "ok", "", build(spark, given, f"{folder.rstrip('/')}/{name.rsplit('.', 1)[0]}", force)[1])
        except (ValueError, PySparkException) as e:
            yield Outcome(name, "failed", str(e).splitlines()[0], [])
