"""Graph reductions over edge tables, as joins and aggregates in loops with checkpoints.

Nodes are single columns here (strings, numbers or structs). Loops end when nothing
changes; each round cuts its lineage in the shared folder.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshloom.session import cut


def both_ways(edges: DataFrame, a: str = "a", b: str = "b", *more: str) -> DataFrame:
    """``(u, v, ...)``: every edge from both of its ends."""
    ends = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    return edges.select(F.explode(ends).alias("e"), *more).select("e.u", "e.v", *more)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)``: the smallest reachable node of every node with an edge.

    Large-star and small-star rounds: each is a pre-aggregated minimum and an equi-join,
    and their number grows with the logarithm of the graph, not with its diameter.
    """
    nodes = both_ways(edges, a, b).select("u").distinct()
    pairs = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        sym = both_ways(pairs, "u", "v")
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        pairs = cut(small.distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    return nodes.join(pairs, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))


def component_sizes(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(root, n_nodes)`` of every component."""
    return connected_components(edges, a, b).groupBy("root").agg(F.count("*").alias("n_nodes"))


def keep_largest(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges of the component with most nodes; of equal ones, that of the smallest node."""
    nodes = cut(connected_components(edges, a, b))
    sizes = nodes.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)
    kept = nodes.join(F.broadcast(sizes.select("root")), "root").select(F.col("node").alias("_n"))  # one row
    return edges.join(kept, F.col(a) == F.col("_n"), "left_semi")


def drop_slivers(edges: DataFrame, least_km: float, length: str = "length_km") -> DataFrame:
    """Edges of at least the length; nodes left without an edge go with theirs."""
    return edges.where(F.col(length) >= least_km)


def fragmentation(before: DataFrame, after: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: nodes before, nodes and components after, and the largest component's share of the nodes before."""
    total = both_ways(before, a, b).select("u").distinct().agg(F.count("*").alias("n_before"))
    sizes = component_sizes(after, a, b).agg(
        F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("n_after"), F.count("*").alias("n_components"), F.coalesce(F.max("n_nodes"), F.lit(0)).alias("largest")
    )
    return total.join(sizes, F.lit(True)).withColumn("largest_share", F.when(F.col("n_before") > 0, F.col("largest") / F.col("n_before")))


def contract_chains(edges: DataFrame, protected: DataFrame | None = None, a: str = "a", b: str = "b", length: str = "length_km") -> DataFrame:
    """Chains of degree-2 nodes as single edges ``(a, b, length_km, n_edges, nodes)``.

    Junctions, dead ends and ``protected`` nodes (column ``node``) stay. A chain is put in
    order by doubling (see :func:`_runs`), so its length costs rounds only by its logarithm.
    A ring without a node that stays becomes an edge from its smallest node to the one
    half-way round, with the whole length. Parallel edges of the result are merged to the
    shortest.
    """
    sym = both_ways(edges, a, b, length)
    inner = sym.groupBy("u").agg(F.count("*").alias("d"), F.count_if(F.col("u") == F.col("v")).alias("loops")).where("d = 2 AND loops = 0").select(F.col("u").alias("node"))
    if protected is not None:
        inner = inner.join(protected.select("node"), "node", "left_anti")
    inner = cut(inner)
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(length).alias("length_km"))
    mark = lambda rows, nodes: _marked(_marked(rows, nodes, "a", "ia"), nodes, "b", "ib")
    marked = cut(mark(e, inner))
    # nodes that link to none that stays are rings, which open at their smallest node
    linked = connected_components(marked.where("ia AND ib"))
    chains = cut(inner.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("chain")))
    tied = marked.where("ia <> ib").select(F.when(F.col("ia"), F.col("a")).otherwise(F.col("b")).alias("node")).join(chains, "node").select("chain").distinct()
    rings = chains.join(tied, "chain", "left_anti").select(F.col("chain").alias("node")).distinct()
    marked = cut(mark(e, inner.join(rings, "node", "left_anti")))
    runs = _runs(marked.where("ia OR ib"))
    ring = F.col("a") == F.col("b")
    opened = runs.join(rings.select(F.col("node").alias("_r")), F.col("a") == F.col("_r"), "left")
    half = F.element_at("nodes", F.floor((F.size("nodes") - 1) / 2).cast("int") + 1)
    ordered = opened.select("a", F.when(ring & F.col("_r").isNotNull(), half).otherwise(F.col("b")).alias("b"), "length_km", "n_edges", "nodes")
    passed = marked.where("NOT ia AND NOT ib").select("a", "b", "length_km", F.lit(1).cast("long").alias("n_edges"), F.array("a", "b").alias("nodes"))
    every = passed.unionByName(ordered).withColumn("k", F.struct("length_km", "n_edges", "nodes"))
    every = every.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("k").alias("k"))
    return every.select("a", "b", "k.length_km", "k.n_edges", "k.nodes")


def _marked(rows: DataFrame, nodes: DataFrame, end: str, name: str) -> DataFrame:
    """``rows`` with whether one end is among ``nodes``."""
    own = nodes.select(F.col("node").alias("_n"), F.lit(True).alias("_in"))
    return rows.join(own, F.col(end) == F.col("_n"), "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_n", "_in")


def _runs(edges: DataFrame) -> DataFrame:
    """Chains of edges ``(a, b, length_km, ia, ib)`` between nodes that aren't inner: ``(a, b, length_km, n_edges, nodes)``, each from its smaller end.

    Every edge is taken both ways and points to the one that goes on from it; by rounds, each
    points as far as what it points to does, until all point to their chain's last edge and
    know how many are between.
    """
    ends = F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v"), F.col("ib").alias("inner")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), F.col("ia").alias("inner"))
    )
    ways = cut(edges.select(F.explode(ends).alias("e"), "length_km").select("e.*", "length_km"))
    onward = ways.select(F.col("u").alias("v"), F.col("v").alias("w"))
    at = ways.join(onward, "v", "left").where("NOT inner OR w <> u").select(
        "u", "v", "length_km", F.col("inner").alias("open"),
        F.when(F.col("inner"), F.struct(F.col("v").alias("u"), F.col("w").alias("v"))).otherwise(F.struct("u", "v")).alias("to"), F.col("inner").cast("long").alias("hops"),
    )
    at = cut(at.distinct())
    while not at.where("open").isEmpty():
        far = at.select(F.struct("u", "v").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("open").alias("open2"))
        at = cut(at.join(far, "to").select("u", "v", "length_km", F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("open") & F.col("open2")).alias("open")))
    run = at.groupBy("to").agg(F.sort_array(F.collect_list(F.struct((-F.col("hops")).alias("k"), "u"))).alias("own"), F.sum("length_km").alias("length_km"), F.count("*").alias("n_edges"))
    run = run.select(F.concat(F.transform("own", lambda x: x["u"]), F.array("to.v")).alias("nodes"), "length_km", "n_edges")
    # a chain is found from both of its ends: the way from the smaller end stays, of rings that to the smaller neighbour
    run = run.withColumn("a", F.get("nodes", 0)).withColumn("b", F.element_at("nodes", -1))
    back = F.when(F.col("a") == F.col("b"), F.get("nodes", 1) <= F.element_at("nodes", -2)).otherwise(F.col("a") < F.col("b"))
    return run.where(back).select("a", "b", "length_km", "n_edges", "nodes")


def degree_rank(edges: DataFrame, top: int | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes by degree, largest first, then by name; the first ``top`` if given."""
    ranked = both_ways(edges, a, b).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node")
    return ranked if top is None else ranked.limit(top)


def core_numbers(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, core)``: the largest k for which a node is in the k-core.

    Every node starts with its number of neighbours, and goes down to the largest h for which
    h neighbours have h or more, until none goes down: rounds don't follow the number of cores.
    """
    steps = cut(both_ways(edges.where(F.col(a) != F.col(b)), a, b).select("u", "v").distinct())
    core = cut(steps.groupBy("u").agg(F.count("*").alias("core")))
    while True:
        near = steps.join(core.select(F.col("u").alias("v"), F.col("core").alias("c")), "v")
        # by how many neighbours have each number, which are far fewer rows than neighbours
        sizes = near.groupBy("u", "c").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy("u").orderBy(F.desc("c")))
        low = sizes.withColumn("h", F.least(F.col("c"), upto)).groupBy("u").agg(F.max("h").alias("h"))
        core, before = cut(low.join(core, "u").select("u", F.least("h", "core").alias("core"), (F.col("h") < F.col("core")).alias("down"))), core
        if core.where("down").isEmpty():
            break
    every = both_ways(edges, a, b).select(F.col("u").alias("node"), F.lit(0).cast("long").alias("core")).distinct()
    every = every.union(before.select("u", "core"))
    return every.groupBy("node").agg(F.max("core").cast("int").alias("core"))


def shortest_distances(edges: DataFrame, sources: DataFrame, weight: str = "cost", a: str = "a", b: str = "b") -> DataFrame:
    """``(source, node, dist)`` from every source along directed edges, by rounds of relaxation.

    Each round extends only the distances that the last one lowered.
    """
    steps = edges.select(F.col(a).alias("u"), F.col(b).alias("v"), F.col(weight).alias("w"))
    best = cut(sources.select(F.col("source"), F.col("source").alias("node"), F.lit(0).cast(edges.schema[weight].dataType).alias("dist")).distinct())
    fresh = best
    while not fresh.isEmpty():
        reached = fresh.join(steps, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        better = reached.join(best, ["source", "node"], "left").where("dist IS NULL OR new < dist").select("source", "node", F.col("new").alias("dist"))
        fresh = cut(better)
        best = cut(best.unionByName(fresh).groupBy("source", "node").agg(F.min("dist").alias("dist")))
    return best


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The shortest path of each pair ``(a, b)``: ``(a, b, path_index, length_km, nodes)``; unreachable pairs give no row.

    Paths grow from the pairs' starts edge by edge, as joins; of the partial paths of a pair
    to the same node the shortest is kept, of equal ones that whose nodes come first. A path
    longer than one that has arrived goes no further.
    """
    step = both_ways(edges, "a", "b", "length_km").groupBy("u", "v").agg(F.min("length_km").alias("w"))
    live = cut(pairs.select("a", "b", F.col("a").alias("end"), F.struct(F.lit(0.0).alias("length_km"), F.array("a").alias("nodes")).alias("p")).distinct())
    best = live
    while not live.isEmpty():
        grown = live.join(step, F.col("end") == F.col("u")).where(~F.array_contains("p.nodes", F.col("v"))).select(
            "a", "b", F.col("v").alias("end"),
            F.struct((F.col("p.length_km") + F.col("w")).alias("length_km"), F.concat("p.nodes", F.array("v")).alias("nodes")).alias("p"),
        )
        grown = grown.groupBy("a", "b", "end").agg(F.min("p").alias("p"))
        had = best.select("a", "b", "end", F.col("p").alias("had"))
        better = cut(grown.join(had, ["a", "b", "end"], "left").where("had IS NULL OR p < had").select("a", "b", "end", "p"))
        best = cut(best.unionByName(better).groupBy("a", "b", "end").agg(F.min("p").alias("p")))
        there = best.where("end = b").select("a", "b", F.col("p.length_km").alias("most"))
        live = cut(better.where("end <> b").join(there, ["a", "b"], "left").where("most IS NULL OR p.length_km <= most").select("a", "b", "end", "p"))
    return best.where("end = b AND a <> b").select("a", "b", F.lit(0).alias("path_index"), "p.length_km", "p.nodes")


def k_shortest_paths(edges: DataFrame, pairs: DataFrame, k: int = 1, max_km: float | None = None) -> DataFrame:
    """Up to ``k`` shortest loopless paths of each pair, as :func:`shortest_paths` returns them.

    One path a pair is searched by joins, whatever the graph's size. For more, pairs are dealt
    over tasks and each is searched by deviation from its shorter paths; the (contracted)
    graph goes to every task, so its size is checked. Ties go to the path whose nodes come
    first. The length filter follows, and leaves gaps in ``path_index``.
    """
    if k == 1:
        found = shortest_paths(edges, pairs)
    else:
        near: dict = {}
        for a, b, w in bounded(edges.select("a", "b", "length_km")).itertuples(index=False):
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})[y] = min(w, near.get(x, {}).get(y, w))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = [(a, b, i, *p) for a, b in zip(f["a"], f["b"]) for i, p in enumerate(_deviations(near, a, b, k))]
                yield pd.DataFrame(rows, columns=["a", "b", "path_index", "length_km", "nodes"])

        kind = edges.schema["a"].dataType.simpleString()
        n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        schema = f"a {kind}, b {kind}, path_index int, length_km double, nodes array<{kind}>"
        found = pairs.select("a", "b").distinct().repartition(n, "a", "b").mapInPandas(run, schema)
    return found if max_km is None else found.where(F.col("length_km") <= max_km)


def _best(near: dict, start, end, shut_nodes: set, shut_edges: set) -> tuple | None:
    """Length and nodes of the best path that avoids some nodes and first steps."""
    heap, done = [(0.0, (start,))], set()
    while heap:
        length, nodes = heapq.heappop(heap)
        x = nodes[-1]
        if x == end:
            return length, nodes
        if x in done:
            continue
        done.add(x)
        for y, w in near.get(x, {}).items():
            if y not in done and y not in shut_nodes and not (len(nodes) == 1 and (x, y) in shut_edges):
                heapq.heappush(heap, (length + w, (*nodes, y)))
    return None


def _deviations(near: dict, start, end, k: int) -> list[tuple[float, list]]:
    first = _best(near, start, end, set(), set())
    found, waiting = ([first] if first and start != end else []), []
    while found and len(found) < k:
        last = found[-1][1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            shut = {(p[i], p[i + 1]) for _, p in found if p[: i + 1] == root}
            if rest := _best(near, root[-1], end, set(root[:-1]), shut):
                whole = (*root[:-1], *rest[1])
                new = (sum(near[x][y] for x, y in zip(whole, whole[1:])), whole)
                if new not in waiting and new not in found:
                    heapq.heappush(waiting, new)
        if not waiting:
            break
        found.append(heapq.heappop(waiting))
    return [(length, list(nodes)) for length, nodes in found]


def is_connected(pdf: pd.DataFrame, without: Iterator = ()) -> bool:
    """Whether the graph of a small edge frame ``(a, b)`` is connected once nodes are taken out; nothing that is left isn't."""
    gone, near = set(without), {}
    for a, b in zip(pdf["a"], pdf["b"]):
        for x, y in ((a, b), (b, a)):
            if x not in gone:
                near.setdefault(x, set()).update({y} - gone)
    if not near:
        return False
    seen, todo = set(), [next(iter(near))]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near[x] - seen
    return len(seen) == len(near)


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``(a, b)`` that connect what the given ones (``a < b``, distinct) do, without rings, and ``(node, root)`` with each tree's smallest node.

    Every part picks its first edge to another part; picks never close a ring, as edges have
    one order. Parts at least halve in number each round.
    """
    nodes = both_ways(edges).select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    left, picked = edges.select("a", "b", F.col("a").alias("pa"), F.col("b").alias("pb")), []
    while not left.isEmpty():
        first = both_ways(left, "pa", "pb", "a", "b", "pa", "pb").groupBy("u").agg(F.min(F.struct("a", "b", "pa", "pb")).alias("m"))
        picks = cut(first.select("m.*").distinct())
        picked.append(picks.select("a", "b"))
        parts = cut(connected_components(picks, "pa", "pb"))
        left = left.join(parts.toDF("pa", "ra"), "pa").join(parts.toDF("pb", "rb"), "pb")
        left = cut(left.where("ra <> rb").select("a", "b", F.col("ra").alias("pa"), F.col("rb").alias("pb")))
        nodes = cut(nodes.join(parts.toDF("root", "r"), "root", "left").select("node", F.coalesce("r", "root").alias("root")))
    forest = picked[0] if picked else edges.select("a", "b")
    for more in picked[1:]:
        forest = forest.unionByName(more)
    return forest, nodes


def euler_tour(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, node, up, start, end)`` of every node but the roots: where a walk around its tree enters and leaves what hangs on it.

    At a node the walk goes on to the next neighbour after the one it came from. Its steps are
    numbered by doubling: each knows a step further on and how far that is. Numbers count up
    to 0 at a tree's last step, and those of ``start`` and ``end`` lie around all below a node.
    """
    order = W.partitionBy("u").orderBy("v")
    turns = both_ways(forest).select("u", "v", F.lead("v").over(order).alias("onward"), F.first("v").over(order).alias("first"))
    turns = turns.join(roots.select(F.col("node").alias("u"), "root"), "u")
    last = F.col("onward").isNull() & (F.col("u") == F.col("root"))
    after = F.when(~last, F.struct(F.col("u").alias("x"), F.coalesce("onward", "first").alias("y")))
    steps = cut(turns.select("root", F.struct(F.col("v").alias("x"), F.col("u").alias("y")).alias("step"), after.alias("next"), F.when(last, 0).otherwise(1).cast("long").alias("far")))
    while not (going := steps.where("next IS NOT NULL")).isEmpty():
        target = steps.select(F.col("step").alias("next"), F.col("next").alias("next2"), F.col("far").alias("far2"))
        moved = going.join(target, "next").select("root", "step", F.col("next2").alias("next"), (F.col("far") + F.col("far2")).alias("far"))
        steps = cut(steps.where("next IS NULL").unionByName(moved))
    ways = steps.groupBy("root", F.least("step.x", "step.y").alias("p"), F.greatest("step.x", "step.y").alias("q"))
    down = ways.agg(F.max(F.struct("far", "step")).alias("m"), F.min("far").alias("left"))
    return down.select("root", F.col("m.step.y").alias("node"), F.col("m.step.x").alias("up"), (-F.col("m.far")).alias("start"), (-F.col("left")).alias("end"))


def range_extremes(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(node, low, high)``: extremes of ``values`` ``(root, pos, low, high)``, one at every ``pos`` of a root, in ``ranges`` ``(root, node, start, end)``.

    A range is covered by two of a power of two in width, whose extremes are built up by
    doubling; only one width is held at a time.
    """
    width = F.floor(F.log2((F.col("end") - F.col("start") + 1).cast("double"))).cast("int")
    asked = cut(ranges.select("root", "node", width.alias("w"), F.explode(F.array("start", F.col("end") + 1 - F.pow(F.lit(2.0), width).cast("long"))).alias("pos")))
    widest = asked.agg(F.max("w")).first()[0]
    found = []
    for w in range(0 if widest is None else widest + 1):
        found.append(cut(asked.where(F.col("w") == w).join(values, ["root", "pos"]).select("node", "low", "high")))
        ahead = values.select("root", (F.col("pos") - (1 << w)).alias("pos"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        values = cut(values.join(ahead, ["root", "pos"]).select("root", "pos", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
    rows = asked.select("node", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    for more in found:
        rows = rows.unionByName(more)
    return rows.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def blocks(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(a, b, block)``: edges of a spanning forest, of which those of one block have the same ``block``, a node.

    Two edges are in one block if a ring holds both. An edge is named by its lower end. With the
    positions of a walk around the tree, an edge off the tree joins its ends' edges if neither
    is above the other, and a tree edge joins the one above if an edge off the tree leads from
    below it to outside of what hangs on its upper end. Rounds grow with the logarithm of the
    graph, whatever its depth, and rows with its edges. A node's neighbours in the tree are
    sorted in one task, which spills.
    """
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    forest, roots = spanning_forest(e)
    walk = cut(euler_tour(forest, roots))
    outer = roots.where("node = root").select("root", "node", F.lit(None).cast(e.schema["a"].dataType).alias("up"), F.lit(-(1 << 62)).alias("start"), F.lit(1).cast("long").alias("end"))
    placed = walk.unionByName(outer)
    at = placed.select("node", "start", "end")
    tree = walk.select(F.least("node", "up").alias("a"), F.greatest("node", "up").alias("b"))
    off = e.join(tree, ["a", "b"], "left_anti").join(at.toDF("a", "a1", "a2"), "a").join(at.toDF("b", "b1", "b2"), "b")
    off = cut(off)
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b1").alias("to")), F.struct(F.col("b").alias("node"), F.col("a1").alias("to"))))
    reach = off.select(ends.alias("e")).groupBy("e.node").agg(F.min("e.to").alias("low"), F.max("e.to").alias("high"))
    own = walk.join(reach, "node", "left")
    nothing = F.lit(None).cast("long")
    steps = own.select("root", F.explode(F.array(F.struct(F.col("start").alias("pos"), "low", "high"), F.struct(F.col("end").alias("pos"), nothing.alias("low"), nothing.alias("high")))).alias("s"))
    below = range_extremes(cut(steps.select("root", "s.*")), walk)
    above = walk.join(below, "node").join(walk.select(F.col("node").alias("up"), F.col("start").alias("u1"), F.col("end").alias("u2")), "up")
    same = above.where("low < u1 OR high > u2").select(F.col("node").alias("a"), F.col("up").alias("b"))
    same = same.unionByName(off.where("a1 > b2 OR b1 > a2").select("a", "b"))
    joined = cut(connected_components(cut(same)))
    named = walk.join(joined.toDF("node", "block"), "node", "left")
    return named.select(F.least("node", "up").alias("a"), F.greatest("node", "up").alias("b"), F.coalesce("block", "node").alias("block"))


def articulation_points(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes ``node`` whose removal parts what was connected: those where two :func:`blocks` of edges meet."""
    met = both_ways(blocks(edges, a, b), "a", "b", "block").select(F.col("u").alias("node"), "block").distinct()
    return met.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")


def parted(edges: DataFrame, removals: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Removals ``(removal, nodes)`` after which the rest isn't connected, or nothing is left; all are tried at once, as components by removal."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    left = both_ways(e).select(F.col("u").alias("node")).distinct().join(F.broadcast(removals), F.lit(True)).where(~F.array_contains("nodes", F.col("node")))
    links = e.join(F.broadcast(removals), F.lit(True)).where(~F.array_contains("nodes", F.col("a")) & ~F.array_contains("nodes", F.col("b")))
    key = lambda c: F.struct("removal", F.col(c).alias("node"))
    roots = connected_components(links.select(key("a").alias("a"), key("b").alias("b")))
    placed = left.select("removal", key("node").alias("node")).join(roots, "node", "left").select("removal", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("removal").agg(F.count_distinct("root").alias("parts"))
    return removals.join(parts, "removal", "left").where("coalesce(parts, 0) <> 1").select(*removals.columns)


#: Edges of a graph that may go whole to every task.
SMALL_GRAPH = 100_000


def bounded(edges: DataFrame, most: int = SMALL_GRAPH) -> pd.DataFrame:
    """A small edge table as a frame; an error if it has more rows than allowed."""
    rows = edges.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"analysis of whole graphs takes at most {most} edges")
    return rows


def cut_sets(edges: DataFrame, size: int = 2, pool: int = 20, a: str = "a", b: str = "b") -> DataFrame:
    """Sets of ``size`` of the ``pool`` nodes of highest degree that disconnect the graph: ``(nodes, degree)``, heaviest first.

    There are as many sets as the pool allows, whatever the graph's size; each costs a copy of the edges in :func:`parted`.
    """
    top = cut(degree_rank(edges, pool, a, b))
    sets = top.select(F.array("node").alias("nodes"), "degree", F.col("node").alias("last"))
    for _ in range(size - 1):
        sets = sets.join(top.select(F.col("node").alias("n2"), F.col("degree").alias("d2")), F.col("n2") > F.col("last")).select(
            F.concat("nodes", F.array("n2")).alias("nodes"), (F.col("degree") + F.col("d2")).alias("degree"), F.col("n2").alias("last")
        )
    sets = cut(sets.drop("last").withColumn("removal", F.array_join(F.col("nodes").cast("array<string>"), "~")))
    return parted(edges, sets, a, b).select("nodes", "degree").orderBy(F.desc("degree"), "nodes")


def _neighbours(pdf: pd.DataFrame) -> dict:
    near: dict = {}
    for a, b in zip(pdf["a"], pdf["b"]):
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def _separator(near: dict, s, t) -> list:
    """Fewest nodes that part ``s`` from ``t``, which aren't neighbours: augmenting paths, each node used once."""
    used: dict = {}  # (node, side) to what flow leads on to; a node's sides are 0 (in) and 1 (out)

    def steps(x, side):
        """Sides that can be reached with what is left of capacity."""
        if side == 0 and x != s:
            if ((x, 0), (x, 1)) not in used:
                yield (x, 1)
            yield from (p for p in ((y, 1) for y in near[x]) if (p, (x, 0)) in used)
        else:
            if x != s and ((x, 0), (x, 1)) in used:
                yield (x, 0)
            yield from ((y, 0) for y in near[x] if y != s)  # nodes alone are limited

    while True:
        came, todo = {(s, 1): None}, [(s, 1)]
        for x, side in todo:
            if x == t:
                break
            for p in steps(x, side):
                if p not in came:
                    came[p] = (x, side)
                    todo.append(p)
        if (t, 0) not in came:
            return sorted(x for x in near if x not in (s, t) and (x, 0) in came and (x, 1) not in came)
        p = (t, 0)
        while came[p] is not None:
            q = came[p]
            if (p, q) in used:
                del used[p, q]
            else:
                used[q, p] = True
            p = q


def node_connectivity(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(k, nodes)``: the fewest nodes whose removal parts the graph, and such nodes, first by name of equals.

    A node of least degree is parted from each that isn't its neighbour, and its neighbours
    from each other; these pairs run in tasks of their own on the whole graph, whose size is
    checked. Complete graphs have no such nodes: ``k`` is one less than their number, ``nodes`` null.
    """
    small = bounded(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    near = _neighbours(small)
    spark, kind = edges.sparkSession, edges.schema[a].dataType.simpleString()
    out = f"k int, nodes array<{kind}>"
    if not near:
        return spark.createDataFrame([(0, None)], out)
    first = min(near, key=lambda x: (len(near[x]), x))
    around = sorted(near[first])
    pairs = [(first, x) for x in sorted(near) if x != first and x not in near[first]]
    pairs += [(x, y) for i, x in enumerate(around) for y in around[i + 1 :] if y not in near[x]]
    if not pairs:
        return spark.createDataFrame([(len(near) - 1, None)], out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cuts = [_separator(near, s, t) for s, t in zip(f["s"], f["t"])]
            yield pd.DataFrame({"k": [len(c) for c in cuts], "nodes": cuts})

    each = spark.createDataFrame(pairs, f"s {kind}, t {kind}").repartition(8).mapInPandas(run, out)
    return each.orderBy("k", "nodes").limit(1)


def greedy_disconnection(edges: DataFrame, a: str = "a", b: str = "b") -> list:
    """Nodes taken out by falling degree until the rest falls apart, less those that weren't needed; empty if it never does."""
    small = bounded(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    near, gone = _neighbours(small), []
    for x in sorted(near, key=lambda x: (-len(near[x]), x)):
        if len(near) - len(gone) <= 2:
            return []
        gone.append(x)
        if not is_connected(small, gone):
            break
    else:
        return []
    for x in list(gone):
        if not is_connected(small, [y for y in gone if y != x]):
            gone.remove(x)
    return gone
