"""Road polylines to a snapped, undirected graph.

Lines are ``(line_id, mtfcc, coords)`` with ``coords`` an array of ``(x, y)`` in metres, or
vertices in rows. Edges are ``(ax, ay, bx, by, length_km)`` between grid cells, the smaller
end first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshloom.functions.numeric import cell, distance
from meshloom.session import not_empty


def keep_classes(lines: DataFrame, classes: Sequence[str], column: str = "mtfcc", check: bool = False) -> DataFrame:
    """Lines of the road classes; with ``check``, an error if none is left."""
    kept = lines.where(F.col(column).isin(*classes))
    return not_empty(kept, f"no roads of classes {', '.join(classes)}") if check else kept


def class_counts(lines: DataFrame, column: str = "mtfcc", top: int = 10) -> DataFrame:
    """The most frequent road classes."""
    return lines.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(top)


def parts(lines: DataFrame) -> DataFrame:
    """One row for each part of multi-part lines (``parts``), those of fewer than two points dropped."""
    rows = lines.select("*", F.posexplode("parts").alias("part_pos", "coords")).where(F.size("coords") >= 2)
    return rows.withColumn("line_id", F.concat_ws("#", "line_id", "part_pos")).drop("parts", "part_pos")


def vertices(lines: DataFrame) -> DataFrame:
    """``(line_id, pos, x, y)`` from ``coords``."""
    return lines.select("line_id", F.posexplode("coords").alias("pos", "p")).select("line_id", "pos", "p.x", "p.y")


def snapped_edges(points: DataFrame, snap_m: float, line: str = "line_id", order: Sequence[str] = ("pos",)) -> DataFrame:
    """Undirected edges between consecutive vertices after snapping to a grid, shortest of equals.

    Equal cells give no edge. One shuffle by line pairs vertices, one more merges edges,
    after a partial minimum in each task.
    """
    if snap_m <= 0:
        raise ValueError("snap precision must be positive")
    w = W.partitionBy(line).orderBy(*order)
    cells = points.select(line, *order, cell(F.col("x"), snap_m).alias("ax"), cell(F.col("y"), snap_m).alias("ay"))
    pairs = cells.select("ax", "ay", F.lead("ax").over(w).alias("bx"), F.lead("ay").over(w).alias("by"))
    return merge_edges(pairs.where("bx IS NOT NULL AND (ax <> bx OR ay <> by)").withColumn(
        "length_km", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) * F.lit(snap_m) / 1000
    ))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One undirected edge for each pair of cells: the shortest; those without a length are dropped."""
    one, other = F.struct("ax", "ay"), F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay"))
    ends = edges.where("length_km > 0").select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"), "length_km")
    return ends.select(
        F.col("a.ax").alias("ax"), F.col("a.ay").alias("ay"), F.col("b.ax").alias("bx"), F.col("b.ay").alias("by"), "length_km"
    ).groupBy("ax", "ay", "bx", "by").agg(F.min("length_km").alias("length_km"))


def both_ways(edges: DataFrame) -> DataFrame:
    """``(x, y, nx, ny, length_km)``: every edge from both of its ends."""
    ends = F.array(
        F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("nx"), F.col("by").alias("ny")),
        F.struct(F.col("bx").alias("x"), F.col("by").alias("y"), F.col("ax").alias("nx"), F.col("ay").alias("ny")),
    )
    return edges.select(F.explode(ends).alias("e"), "length_km").select("e.*", "length_km")


def degrees(edges: DataFrame) -> DataFrame:
    """``(x, y, degree)``: number of neighbours. Edges are distinct, so their ends are counted; a self-loop counts twice."""
    return both_ways(edges).groupBy("x", "y").agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    """Number of nodes of each degree."""
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def validate(edges: DataFrame, max_degree: int = 1000) -> DataFrame:
    """``edges``; an error if there are none, a length isn't positive and finite, or a degree is over the limit."""
    not_empty(edges, "road graph has no edges")
    bad = edges.where("NOT (length_km > 0) OR isnan(length_km) OR length_km = double('Infinity')")
    if not bad.isEmpty():
        raise ValueError("road graph has an edge without a positive finite length")
    if not degrees(edges).where(F.col("degree") > max_degree).isEmpty():
        raise ValueError(f"road graph has a node of a degree over {max_degree}")
    return edges
