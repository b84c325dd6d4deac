"""Union of polygons by group: what a map's dissolve does, as joins.

Vertices are whole numbers of ``snap`` units, so equal places are equal keys. Edges meet by
grid cells and are split where they touch (:func:`noded`); what two polygons share from both
sides cancels by count (:func:`netted`); how many polygons lie beside each remaining edge is
a sum along its row of cells and within its own cell (:func:`borders`), and those with none on
one side are the union's. Rings are closed by doubling (:func:`rings`), so rounds grow with
the logarithm of the longest ring. Spark guesses the size of edges from that of the few bytes
they come from, far too small, so joins of edges say that neither side is to go through the driver.

Rows without parts, parts of under three different vertices and null vertices add nothing; a
null group is a group of its own. Repeated polygons cover once. Within one polygon, rings are
filled by the even-odd rule, whatever way they run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshloom.functions.polygon import contains
from meshloom.session import cut

EDGE = ["ax", "ay", "bx", "by"]
GROUP = "group_key"


def directed(shapes: DataFrame, group: str | None = None, snap: float = 1e-6) -> DataFrame:
    """``(group_key, ax, ay, bx, by)``: edges of every polygon with its inside on their left, in whole units.

    A ring within an odd number of the polygon's other rings is a hole, and runs clockwise.
    """

    def ways(parts) -> Iterator[np.ndarray]:
        found = []
        for part in () if parts is None else parts:
            points = np.array([(p["x"], p["y"]) for p in part if p is not None and p["x"] is not None and p["y"] is not None], float).reshape(-1, 2)
            xy = np.rint(points / snap).astype(np.int64)
            xy = xy[(xy != np.roll(xy, 1, axis=0)).any(axis=1)]
            if len(xy) > 2:
                found.append(xy)
        for i, xy in enumerate(found):
            near = np.roll(xy, -1, axis=0)
            off, ahead = xy - xy[0], near - xy[0]  # small, so that the area has no rounding
            twice = int((off[:, 0].astype(object) * ahead[:, 1] - ahead[:, 0].astype(object) * off[:, 1]).sum())
            if not twice:
                continue
            hole = len(found) > 1 and sum(contains([np.asarray(o, float)], *_beside(xy)) for k, o in enumerate(found) if k != i) % 2 == 1
            yield np.hstack([near[::-1], xy[::-1]] if (twice > 0) == hole else [xy, near])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(key, way) for key, parts in zip(frame[GROUP], frame["parts"]) for way in ways(parts)]
            if made:
                ends = np.concatenate([way for _, way in made])
                keys = [key for key, way in made for _ in range(len(way))]
                yield pd.DataFrame({GROUP: keys, **{c: ends[:, k] for k, c in enumerate(EDGE)}})

    rows = shapes.select((F.col(group).cast("string") if group else F.lit(None).cast("string")).alias(GROUP), "parts")
    rows = rows.repartition(shapes.sparkSession.sparkContext.defaultParallelism * 4)  # a small file of many polygons would be one task
    return rows.mapInPandas(run, f"{GROUP} string, ax long, ay long, bx long, by long")


def _beside(ring: np.ndarray) -> tuple[float, float]:
    """A place just inside of a ring's first edge that isn't level, off all whole numbers."""
    a, b = next((p, q) for p, q in zip(ring, np.roll(ring, -1, axis=0)) if p[1] != q[1])
    x, y = (a + b) / 2
    if y == int(y):
        y += min(abs(b[1] - a[1]), 1) / 4
        x = a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
    off = 1 / 1024
    return (x + off, y) if contains([np.asarray(ring, float)], x + off, y) else (x - off, y)


def _cells(low: Column, high: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def dealt(edges: DataFrame, size: int) -> DataFrame:
    """``edges`` with the cells ``gx, gy`` that their boxes touch; long ones are met by few, as cells are chosen to hold a usual edge."""
    rows = edges.withColumn("gx", _cells(F.least("ax", "bx"), F.greatest("ax", "bx"), size))
    return rows.withColumn("gy", _cells(F.least("ay", "by"), F.greatest("ay", "by"), size))


def cell_size(edges: DataFrame) -> int:
    """A width of cells that nine of ten edges fit in, found without moving rows."""
    wide = edges.select(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))).alias("w"))
    found = wide.agg(F.percentile_approx("w", 0.9).alias("p"), F.max("w").alias("m")).first()
    return max(int(found.p or 1), int(found.m or 1) // 256, 1) * 2


def noded(edges: DataFrame, size: int | None = None) -> DataFrame:
    """Edges of a group split at every place where they cross or touch, so that they meet only in vertices.

    A crossing is put on the next whole place, which may bend an edge by less than a unit; so
    it is done again until there is nothing to split.
    """
    edges = cut(edges)
    while True:
        width = size or cell_size(edges)
        e = edges.select(GROUP, *EDGE).distinct()
        place = F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
        points = e.select(GROUP, place.alias("p")).select(GROUP, "p.x", "p.y").distinct()
        named = lambda df: df.withColumn("g", F.coalesce(GROUP, F.lit(""))).withColumn("n", F.col(GROUP).isNull())
        keys = ["g", "n", "gx", "gy"]
        keyed = cut(named(dealt(e, width)))
        placed = named(points.withColumn("gx", F.floor(F.col("x") / width)).withColumn("gy", F.floor(F.col("y") / width)))
        on = keyed.join(placed.drop(GROUP).hint("merge"), keys)
        cross = lambda px, py: (F.col("bx") - F.col("ax")) * (py - F.col("ay")) - (F.col("by") - F.col("ay")) * (px - F.col("ax"))
        between = F.col("x").between(F.least("ax", "bx"), F.greatest("ax", "bx")) & F.col("y").between(F.least("ay", "by"), F.greatest("ay", "by"))
        inner = ~((F.col("x") == F.col("ax")) & (F.col("y") == F.col("ay"))) & ~((F.col("x") == F.col("bx")) & (F.col("y") == F.col("by")))
        touched = on.where(between & inner & (cross(F.col("x"), F.col("y")) == 0)).select(GROUP, *EDGE, "x", "y")
        other = keyed.select(*keys, *[F.col(c).alias(f"o{c}") for c in EDGE])
        side = lambda px, py: F.signum(cross(F.col(px), F.col(py)).cast("double"))
        oside = lambda px, py: F.signum(((F.col("obx") - F.col("oax")) * (F.col(py) - F.col("oay")) - (F.col("oby") - F.col("oay")) * (F.col(px) - F.col("oax"))).cast("double"))
        boxes = (F.least("ax", "bx") <= F.greatest("oax", "obx")) & (F.least("oax", "obx") <= F.greatest("ax", "bx")) & (F.least("ay", "by") <= F.greatest("oay", "oby")) & (
            F.least("oay", "oby") <= F.greatest("ay", "by")
        )
        apart = (side("oax", "oay") * side("obx", "oby") < 0) & (oside("ax", "ay") * oside("bx", "by") < 0)
        met = keyed.join(other.hint("merge"), keys).where(boxes & apart)
        # both of a pair compute the place from the smaller edge, so they get the same
        first = F.struct(*EDGE) < F.struct(*[f"o{c}" for c in EDGE])
        p = {c: F.when(first, F.col(c)).otherwise(F.col(f"o{c}")).cast("double") for c in EDGE}
        q = {c: F.when(first, F.col(f"o{c}")).otherwise(F.col(c)).cast("double") for c in EDGE}
        d = (p["bx"] - p["ax"]) * (q["by"] - q["ay"]) - (p["by"] - p["ay"]) * (q["bx"] - q["ax"])
        t = F.try_divide((q["ax"] - p["ax"]) * (q["by"] - q["ay"]) - (q["ay"] - p["ay"]) * (q["bx"] - q["ax"]), d)
        crossed = met.select(
            GROUP, *EDGE, F.rint(p["ax"] + t * (p["bx"] - p["ax"])).cast("long").alias("x"), F.rint(p["ay"] + t * (p["by"] - p["ay"])).cast("long").alias("y")
        ).where(inner)
        splits = cut(touched.union(crossed).groupBy(F.col(GROUP).alias("sg"), *[F.col(c).alias(f"s{c}") for c in EDGE]).agg(F.collect_set(F.struct("x", "y")).alias("at")))
        if splits.isEmpty():
            return edges
        same = [F.col(GROUP).eqNullSafe(F.col("sg")), *[F.col(c) == F.col(f"s{c}") for c in EDGE]]
        joined = edges.join(splits.hint("merge"), same, "left").select(GROUP, *EDGE, "at")
        along = F.array_sort(F.transform("at", lambda s: F.struct(((s["x"] - F.col("ax")) * (F.col("bx") - F.col("ax")) + (s["y"] - F.col("ay")) * (F.col("by") - F.col("ay"))).alias("d"), s["x"].alias("x"), s["y"].alias("y"))))
        end = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
        run = F.concat(end("ax", "ay"), F.coalesce(F.transform(along, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))), F.array().cast("array<struct<x:bigint,y:bigint>>")), end("bx", "by"))
        steps = F.zip_with(F.slice("run", F.lit(1), F.size("run") - 1), F.slice("run", F.lit(2), F.size("run") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        edges = cut(
            joined.withColumn("run", run).select(GROUP, F.explode(steps).alias("s"))
            .select(GROUP, F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
            .where("ax <> bx OR ay <> by")
        )


def netted(edges: DataFrame) -> DataFrame:
    """``(group_key, ax, ay, bx, by, net)``: edges from their smaller end, and how many more polygons lie left of them than right; edges whose sides are alike go."""
    ahead = F.struct("ax", "ay") < F.struct("bx", "by")
    ends = [F.when(ahead, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in zip(EDGE, ("bx", "by", "ax", "ay"))]
    rows = edges.select(GROUP, *ends, F.when(ahead, 1).otherwise(-1).alias("way"))
    return rows.groupBy(GROUP, *EDGE).agg(F.sum("way").alias("net")).where("net <> 0")


def borders(net: DataFrame, size: int | None = None) -> DataFrame:
    """``(group_key, ax, ay, bx, by)``: edges of the union, with its inside on their left.

    The cover at a cell's corner, a quarter of a unit inside where no vertex or middle is, is the sum of what crosses its row to the
    left. From there to the middle of an edge, only edges of the same cell are crossed: up or
    down first, and then along, to the side of the edge that comes first. An edge that isn't
    split between others, as :func:`noded` leaves it, has no other through its middle.
    """
    net = cut(net)
    size = size or cell_size(net)
    off = F.lit(0.25)
    edge = net.withColumn("px", (F.col("ax") + F.col("bx")) / 2).withColumn("py", (F.col("ay") + F.col("by")) / 2)
    edge = edge.withColumn("gx", F.floor(F.col("px") / size)).withColumn("gy", F.floor(F.col("py") / size))
    level = lambda y: F.col("ax") + F.try_divide((y - F.col("ay")) * (F.col("bx") - F.col("ax")), F.col("by") - F.col("ay"))
    east = F.when(F.col("by") > F.col("ay"), -F.col("net")).otherwise(F.col("net"))  # what is gained by crossing the edge eastward
    # what crosses the rows' lines, at the first cell whose corner is right of it
    low, high = F.floor((F.least("ay", "by") - off) / size) + 1, F.floor((F.greatest("ay", "by") - off) / size)
    lines = net.where((F.col("ay") != F.col("by")) & (low <= high)).withColumn("gy", F.explode(F.sequence(low, high)))
    lines = lines.select(GROUP, "gy", (F.floor((level(F.col("gy") * size + off) - off) / size) + 1).alias("gx"), east.alias("gain"))
    steps = lines.union(edge.select(GROUP, "gy", "gx", F.lit(0).cast("long")).distinct()).groupBy(GROUP, "gy", "gx").agg(F.sum("gain").alias("gain"))
    corner = steps.withColumn("cover", F.sum("gain").over(W.partitionBy(GROUP, "gy").orderBy("gx"))).drop("gain")
    # what is crossed within the cell
    other = dealt(net, size).select(F.col(GROUP).alias("og"), F.col("gx").alias("ogx"), F.col("gy").alias("ogy"), *[F.col(c).alias(f"o{c}") for c in (*EDGE, "net")])
    rx, ry = F.col("gx") * size + off, F.col("gy") * size + off
    same = F.col(GROUP).eqNullSafe(F.col("og")) & (F.col("gx") == F.col("ogx")) & (F.col("gy") == F.col("ogy"))
    y_at = F.col("oay") + F.try_divide((rx - F.col("oax")) * (F.col("oby") - F.col("oay")), F.col("obx") - F.col("oax"))
    x_at = F.col("oax") + F.try_divide((F.col("py") - F.col("oay")) * (F.col("obx") - F.col("oax")), F.col("oby") - F.col("oay"))
    # an edge at the height of the way along counts as below it
    up = F.when((F.col("oax") < rx) & (F.col("obx") > rx) & (y_at > ry) & (y_at <= F.col("py")), F.col("onet")).when(
        (F.col("oax") < rx) & (F.col("obx") > rx) & (y_at < ry) & (y_at > F.col("py")), -F.col("onet")
    ).otherwise(0)
    oeast = F.when(F.col("oby") > F.col("oay"), -F.col("onet")).otherwise(F.col("onet"))
    hit = (F.col("oay") > F.col("py")) != (F.col("oby") > F.col("py"))
    along = F.when(hit & (x_at > rx) & (x_at < F.col("px")), oeast).when(hit & (x_at < rx) & (x_at > F.col("px")), -oeast).otherwise(0)
    own = F.struct(*EDGE) == F.struct(*[f"o{c}" for c in EDGE])  # up or down the way may cross the edge itself, along it ends there
    crossed = edge.join(other.hint("merge"), same).groupBy(GROUP, *EDGE).agg(F.sum(up + F.when(own, 0).otherwise(along)).alias("crossed"))
    keys = [F.col(GROUP).eqNullSafe(F.col("cg")), *[F.col(c) == F.col(f"c{c}") for c in EDGE]]
    crossed = crossed.select(F.col(GROUP).alias("cg"), *[F.col(c).alias(f"c{c}") for c in EDGE], "crossed")
    corner = corner.select(F.col(GROUP).alias("kg"), F.col("gx").alias("kx"), F.col("gy").alias("ky"), "cover")
    rows = edge.join(corner.hint("merge"), F.col(GROUP).eqNullSafe(F.col("kg")) & (F.col("gx") == F.col("kx")) & (F.col("gy") == F.col("ky"))).join(crossed.hint("merge"), keys, "left")
    first = F.col("cover") + F.coalesce("crossed", F.lit(0))  # on the side that is come to
    # level edges are come to from above, others from the corner's side
    flat, from_west = F.col("ay") == F.col("by"), F.col("px") >= rx
    left_first = F.when(flat, F.lit(True)).otherwise((F.col("by") > F.col("ay")) == from_west)
    rows = rows.withColumn("left", F.when(left_first, first).otherwise(first + F.col("net"))).withColumn("right", F.when(left_first, first - F.col("net")).otherwise(first))
    kept = rows.where("(left > 0) <> (right > 0)")
    ends = [F.when(F.col("left") > 0, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in zip(EDGE, ("bx", "by", "ax", "ay"))]
    return kept.select(GROUP, *ends)


def followed(rows: DataFrame, then: str) -> DataFrame:
    """``rows`` with ``to`` (as ``far``) and ``then`` of the row whose ``e`` their own ``to`` is; nulls where there is none.

    A join of the rows with themselves would do the same, but Spark guesses its size as the
    product of both sides and a checkpoint keeps the guess: over rounds its digits double,
    to hundreds of MB in the driver. The guess for a union is a sum.
    """
    asked, known = rows.select(F.col("to").alias("at"), F.struct(*rows.columns).alias("own")), rows.select(F.col("e").alias("at"), F.struct(F.col("to").alias("far"), F.col(then).alias("then")).alias("next"))
    asking = asked.where("at IS NOT NULL").unionByName(known, allowMissingColumns=True)
    met = asking.withColumn("next", F.max("next").over(W.partitionBy("at"))).where("own IS NOT NULL")
    return met.unionByName(asked.where("at IS NULL"), allowMissingColumns=True).select("own.*", "next.far", "next.then")


def rings(border: DataFrame) -> DataFrame:
    """``(group_key, ring, pos, x, y)``: closed rings in order, each from its smallest edge on; ``ring`` is that edge.

    Where more than one ring passes a vertex, an edge goes on by the first one that leaves
    clockwise from it, so polygons that meet in a corner stay apart.
    """
    e = border.select(F.struct(GROUP, *EDGE).alias("e"), GROUP, *EDGE)
    angle = lambda dy, dx: F.atan2(dy.cast("double"), dx.cast("double"))
    ways = F.array(
        F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"), angle(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("turn"), F.lit(1).alias("out")),
        F.struct(F.col("bx").alias("x"), F.col("by").alias("y"), angle(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")).alias("turn"), F.lit(0).alias("out")),
    )
    around = e.select("e", GROUP, F.explode(ways).alias("w")).select("e", GROUP, "w.*")
    at = W.partitionBy(GROUP, "x", "y")
    leaving = F.when(F.col("out") == 1, F.col("e"))
    before = F.last(leaving, ignorenulls=True).over(at.orderBy("turn", F.desc("out")).rowsBetween(W.unboundedPreceding, -1))
    final = F.last(leaving, ignorenulls=True).over(at.orderBy("turn", F.desc("out")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    onward = cut(around.withColumn("to", F.coalesce(before, final)).where("out = 0").select("e", "to"))
    # the smallest edge of each ring
    low = onward.withColumn("low", F.least("e", "to"))
    while True:
        found = cut(followed(low, "low").select("e", F.col("far").alias("to"), F.least("low", "then").alias("low"), (F.col("then") < F.col("low")).alias("new")))
        low = found.drop("new")
        if found.where("new").isEmpty():
            break
    # edges up to the ring's end, which is before its smallest edge
    names = low.select("e", F.col("low").alias("ring"))
    rank = cut(onward.join(names.hint("merge"), "e").withColumn("open", F.col("to") != F.col("ring")).select("e", "ring", F.when(F.col("open"), F.col("to")).alias("to"), F.col("open").cast("long").alias("left")))
    while not rank.where("to IS NOT NULL").isEmpty():
        rank = cut(followed(rank, "left").select("e", "ring", F.col("far").alias("to"), (F.col("left") + F.coalesce("then", F.lit(0))).alias("left")))
    pos = F.max("left").over(W.partitionBy("ring")) - F.col("left")
    return rank.select(F.col(f"e.{GROUP}").alias(GROUP), "ring", pos.cast("int").alias("pos"), F.col("e.ax").alias("x"), F.col("e.ay").alias("y"))


def union(shapes: DataFrame, group: str | None = None, snap: float = 1e-6) -> DataFrame:
    """``(group_key, ring, pos, x, y)`` of the union of the polygons (``parts``) of each group, in whole units of ``snap``."""
    return rings(borders(netted(noded(directed(shapes, group, snap)))))


def ring_table(points: DataFrame, snap: float = 1e-6, straight: bool = True) -> DataFrame:
    """``(group_key, ring, n_vertices, area, hole, vertices)``: a row for each ring, outer ones counter-clockwise and holes clockwise.

    ``straight`` False leaves out vertices where the ring goes straight on.
    """
    own = W.partitionBy("ring").orderBy("pos")
    whole = W.partitionBy("ring").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = lambda c, f, g: F.coalesce(f(c).over(own), g(c).over(whole))
    rows = points.select("*", *[near(c, F.lead, F.first).alias(f"n{c}") for c in "xy"], *[near(c, F.lag, F.last).alias(f"l{c}") for c in "xy"])
    rows = rows.withColumn("turn", (F.col("x") - F.col("lx")) * (F.col("ny") - F.col("y")) - (F.col("y") - F.col("ly")) * (F.col("nx") - F.col("x")))
    twice = F.sum(F.col("x").cast("decimal(38,0)") * F.col("ny") - F.col("nx").cast("decimal(38,0)") * F.col("y"))
    point = F.struct("pos", (F.col("x") * snap).alias("x"), (F.col("y") * snap).alias("y"))
    kept = F.collect_list(point if straight else F.when(F.col("turn") != 0, point))
    out = rows.groupBy(GROUP, "ring").agg(twice.alias("twice"), F.transform(F.array_sort(kept), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("vertices"))
    area = F.col("twice").cast("double") * (snap * snap / 2)
    return out.select(GROUP, "ring", F.size("vertices").alias("n_vertices"), F.abs(area).alias("area"), (area < 0).alias("hole"), "vertices")


def dissolve(shapes: DataFrame, group: str | None = None, snap: float = 1e-6) -> DataFrame:
    """``(group_key, parts)``: one polygon for each group, its rings in ``parts``."""
    found = ring_table(union(shapes, group, snap), snap)
    return found.groupBy(GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "vertices"))), lambda r: r["vertices"]).alias("parts"))
