"""Metropolitan areas: selection, names, neighbours and anchors.

A metro table is ``(metro_idx, metro_id, name, name_orig, x, y, radius_km, ...)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshloom.functions.numeric import cell, distance
from meshloom.functions.polygon import polygons_intersect, representative_point
from meshloom.functions.text import sanitize
from meshloom.session import cut


def with_radius(areas: DataFrame, max_radius_km: float = 100.0) -> DataFrame:
    """Land area as a number (null if it isn't one), in km2, and the radius of a circle of that area, capped."""
    aland = F.col("aland").try_cast("double")
    return areas.withColumn("aland", aland).withColumns({"land_area_km2": F.round(F.col("aland") / 1e6, 3), "radius_km": F.round(F.least(F.sqrt(F.col("aland") / 1e6 / math.pi), F.lit(max_radius_km)), 3)})


def largest(areas: DataFrame, k: int) -> DataFrame:
    """The ``k`` areas of most land, then by code, numbered from 1 in ``sel_pos``."""
    top = areas.orderBy(F.desc_nulls_last("aland"), "uac_code").limit(k)
    return top.withColumn("sel_pos", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("aland"), "uac_code")))


def matching(areas: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """For each pattern, in order, the largest area whose name it is found in, in any case; names that are null match none."""
    spark = areas.sparkSession
    rules = spark.createDataFrame([(i + 1, p) for i, p in enumerate(patterns)], "sel_pos int, pattern string")
    hits = areas.join(F.broadcast(rules), F.expr("coalesce(name_orig RLIKE concat('(?i)', pattern), false)"))  # as many rows as patterns are given
    rank = W.partitionBy("sel_pos").orderBy(F.desc_nulls_last("aland"), "uac_code")
    return hits.withColumn("r", F.row_number().over(rank)).where("r = 1").drop("r", "pattern")


def select(areas: DataFrame, k: int, patterns: Sequence[str] = (), check: bool = False) -> DataFrame:
    """Areas that patterns name, then the largest others, ``k`` in all, in order of ``sel_pos``.

    With ``check``: an error if there are fewer, a pattern matches nothing, or two match the same area.
    """
    if not patterns:
        chosen = largest(areas, k)
    else:
        named = matching(areas, patterns)
        rest = areas.join(named.select("uac_code"), "uac_code", "left_anti")
        filled = largest(rest, max(k - len(patterns), 0)).withColumn("sel_pos", F.col("sel_pos") + len(patterns))
        chosen = named.unionByName(filled.select(*named.columns))
    if check:
        n, different = chosen.agg(F.count("*"), F.countDistinct("uac_code")).first()
        if n != k or different != n:
            raise ValueError(f"{k} different metros are asked for, {n} rows with {different} codes found")
    return chosen


def duplicate_ids(metros: DataFrame, column: str = "metro_id") -> DataFrame:
    """Ids that several metros have."""
    return metros.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def named(metros: DataFrame) -> DataFrame:
    """``name`` from ``name_orig``."""
    return metros.withColumn("name", sanitize(F.col("name_orig")))


#: Cells are this much wider than the distance searched, so that points just as far apart are never two cells off.
WIDER = 1 + 1e-9


def _around(points: DataFrame, targets: DataFrame, wide: float) -> DataFrame:
    """``(a, b, d)``: points with all targets in the nine cells around, which hold all within ``wide``; both are ``(id, x, y)``."""
    wide *= WIDER
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    spread = points.withColumn("dx", step).withColumn("dy", step).select(
        F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (cell(F.col("x"), wide) + F.col("dx")).alias("gx"), (cell(F.col("y"), wide) + F.col("dy")).alias("gy")
    )
    placed = targets.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell(F.col("x"), wide).alias("gx"), cell(F.col("y"), wide).alias("gy"))
    return spread.join(placed, ["gx", "gy"]).where("a <> b").select("a", "b", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("d"))


#: Width in metres under which cells aren't halved any more, and targets in a cell that aren't worth halving it.
FINEST, FEW = 1.0, 48


def nearest(points: DataFrame, k: int, limit: float) -> DataFrame:
    """``(a, b, d, r)``: the ``k`` nearest others of every point ``(id, x, y)`` within ``limit`` metres, ranked by distance and id.

    Cells start so small that none holds many targets. A point that finds ``k`` others
    no farther than a cell is wide has its nearest, as the nine cells around hold all of these;
    the others go on with cells twice as wide, up to the limit. So what is compared follows the
    density around a point, not the limit. Of targets at one place the ``k + 1`` first by id are
    all that can be among the ``k`` nearest of any point. Points without a place have none.
    """
    points = points.where("x IS NOT NULL AND y IS NOT NULL")
    targets = points.withColumn("r", F.row_number().over(W.partitionBy("x", "y").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    halvings = 0
    while limit / 2**halvings > FINEST:
        wide = limit / 2**halvings
        most = targets.groupBy(cell(F.col("x"), wide), cell(F.col("y"), wide)).count().agg(F.max("count")).first()[0]
        if most is None or most <= max(FEW, 2 * (k + 1)):
            break
        if not halvings:
            points, targets = cut(points), cut(targets)
        halvings += 1
    found, left = [], points
    for halved in range(halvings, -1, -1):
        wide = limit / 2**halved
        near = _around(left, targets, wide).where(F.col("d") <= wide)
        listed = near.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= k)
        if not halved:
            found.append(listed)
            break
        listed = cut(listed)
        done = listed.where(F.col("r") == k).select("a")
        found.append(listed.join(done, "a", "left_semi"))
        left = cut(left.join(done, F.col("id") == F.col("a"), "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def neighbours(metros: DataFrame, k: int, max_km: float, symmetric: bool = False) -> DataFrame:
    """Pairs ``(a, b, euclidean_km)`` of metros of which one is among the other's ``k`` :func:`nearest`, within ``max_km``.

    By default the metro of the smaller id has to list the other, as a pair seen from the
    larger id alone is left out; ``symmetric`` keeps both.
    """
    listed = nearest(metros.select(F.col("metro_id").alias("id"), "x", "y"), k, max_km * 1000)
    if symmetric:
        listed = listed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct()
    return listed.where("a < b").select("a", "b", (F.col("d") / 1000).alias("euclidean_km"))


def overlaps(metros: DataFrame) -> DataFrame:
    """Pairs of metros whose circles overlap: nearer than the sum of their radii. Compared within adjoining cells as wide as the largest circle."""
    wide = metros.agg(F.max("radius_km")).first()[0] or 1.0
    near = neighbours(metros, 1 << 30, max(2 * wide, 1e-6))
    r = metros.select("metro_id", "radius_km")
    both = near.join(r.toDF("a", "ra"), "a").join(r.toDF("b", "rb"), "b")
    return both.where("euclidean_km < ra + rb").select("a", "b", "euclidean_km", (F.col("ra") + F.col("rb")).alias("sum_radius_km"))


def anchors(metros: DataFrame, nodes: DataFrame, max_km: float) -> DataFrame:
    """Nearest road node ``(x, y)`` of each metro within ``max_km``: ``(metro_id, ax, ay, distance_km)``; smallest node of equals.

    Nodes are dealt by a grid whose cells are as wide as the limit, metros to the nine cells
    around, and the minimum is taken before the shuffle by metro. Metros without a node in
    reach give no row.
    """
    wide = max_km * 1000 * WIDER
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    spread = metros.select("metro_id", F.col("x").alias("mx"), F.col("y").alias("my")).withColumn("dx", around).withColumn("dy", around).select(
        "metro_id", "mx", "my", (cell(F.col("mx"), wide) + F.col("dx")).alias("gx"), (cell(F.col("my"), wide) + F.col("dy")).alias("gy")
    )
    placed = nodes.select("x", "y", cell(F.col("x"), wide).alias("gx"), cell(F.col("y"), wide).alias("gy"))
    near = placed.join(spread, ["gx", "gy"]).withColumn("d", distance(F.col("x"), F.col("y"), F.col("mx"), F.col("my")) / 1000)
    best = near.where(F.col("d") <= max_km).groupBy("metro_id").agg(F.min(F.struct("d", "x", "y")).alias("m"))
    return best.select("metro_id", F.col("m.x").alias("ax"), F.col("m.y").alias("ay"), F.col("m.d").alias("distance_km"))


def anchor_stats(found: DataFrame) -> DataFrame:
    """Number, mean and largest distance of anchors."""
    return found.agg(F.count("*").alias("n"), F.avg("distance_km").alias("avg_km"), F.max("distance_km").alias("max_km"))


def within(areas: DataFrame, boundaries: DataFrame, cell_deg: float = 4.0) -> DataFrame:
    """Areas whose polygon (``parts``) meets a boundary polygon: a semi-join.

    Areas and boundaries are dealt by the grid cells that their boxes touch, so that an area
    is compared with boundaries around it alone. Areas without a polygon go.
    """
    def boxed(df: DataFrame, key: str) -> DataFrame:
        points = F.flatten("parts")
        x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        cells = lambda v: F.explode(F.sequence(F.floor(F.array_min(v) / cell_deg), F.floor(F.array_max(v) / cell_deg)))
        rows = df.where(F.size(points) > 0)
        return rows.select(key, F.col("parts").alias(f"{key}_parts"), cells(x).alias("gx"), y.alias("y")).select(key, f"{key}_parts", "gx", cells(F.col("y")).alias("gy"))

    near = boxed(areas, "uac_code").join(boxed(boundaries, "statefp"), ["gx", "gy"])
    met = near.where(polygons_intersect("uac_code_parts", "statefp_parts")).select("uac_code").distinct()
    return areas.join(met, "uac_code", "left_semi")


def centred(areas: DataFrame) -> DataFrame:
    """Areas with ``x`` and ``y``, a point inside of their polygon."""
    return areas.withColumn("_p", representative_point("parts")).select("*", "_p.x", "_p.y").drop("_p")
