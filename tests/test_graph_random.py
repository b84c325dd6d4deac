"""Graph operators on random graphs, against plain enumeration."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pytest

from meshloom.operators import discover, graph

EDGE = "a string, b string, length_km double"


def made(rng, n: int, share: float) -> list[tuple]:
    return [(f"n{i:02d}", f"n{j:02d}", float(rng.integers(1, 9))) for i, j in itertools.combinations(range(n), 2) if rng.random() < share]


def near(rows) -> dict:
    out = defaultdict(dict)
    for a, b, w in rows:
        out[a][b] = out[b][a] = w
    return out


def parts(nodes: set, of: dict) -> int:
    left, n = set(nodes), 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            new = set(of[todo.pop()]) & left
            left -= new
            todo += new
    return n


def simple_paths(of: dict, a: str, b: str):
    todo = [(0.0, [a])]
    while todo:
        km, nodes = todo.pop()
        if nodes[-1] == b:
            yield km, nodes
            continue
        todo += [(km + w, [*nodes, y]) for y, w in of[nodes[-1]].items() if y not in nodes]


@pytest.mark.parametrize("seed", range(2))
def test_several_shortest_paths(spark, seed):
    rows = made(np.random.default_rng(seed), 8, 0.4)
    of, nodes = near(rows), sorted({x for r in rows for x in r[:2]})
    pairs = list(itertools.combinations(nodes, 2))[:12] + [("n00", "missing")]
    got = graph.k_shortest_paths(spark.createDataFrame(rows, EDGE), spark.createDataFrame(pairs, "a string, b string"), 4)
    found = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: r.path_index):
        found[r.a, r.b].append((r.length_km, r.nodes))
    for a, b in pairs:
        assert found[a, b] == sorted(simple_paths(of, a, b))[:4]


@pytest.mark.parametrize("seed", range(2))
def test_articulation_points_and_cut_sets(spark, seed):
    rng = np.random.default_rng(10 + seed)
    rows = made(rng, 12, 0.16)
    of = near(rows)
    nodes = set(of)
    e = spark.createDataFrame(rows + [("loop", "loop", 1.0)] * (seed == 1), EDGE)
    base = parts(nodes, of)
    want = sorted(x for x in nodes if parts(nodes - {x}, of) > base - (not of[x]))
    assert sorted(r.node for r in graph.articulation_points(e).collect()) == want
    top = sorted(nodes, key=lambda x: (-len(of[x]), x))[:6]
    if seed != 1:
        sets = sorted(sorted(c) for c in itertools.combinations(top, 2) if parts(nodes - set(c), of) != 1)
        assert sorted(sorted(r.nodes) for r in graph.cut_sets(e, 2, 6).collect()) == sets


def test_blocks_of_deep_graphs(spark, monkeypatch):
    """Rings on a long chain, with chords: blocks and points against plain enumeration, in far fewer rounds than the depth."""
    rows, rng, n = [], np.random.default_rng(5), 0
    for width in (1, 30, 1, 1, 12, 1, 40, 1):  # a chain of rings and bridges
        first = n
        for i in range(width):
            rows.append((f"d{n:03d}", f"d{n + 1:03d}", 1.0))
            n += 1
        if width > 1:
            rows.append((f"d{first:03d}", f"d{n:03d}", 1.0))
            rows += [(f"d{first + i:03d}", f"d{first + j:03d}", 1.0) for i, j in rng.integers(0, width, (3, 2)) if abs(i - j) > 1]
    rows += [("s0", f"s{i}", 1.0) for i in range(1, 6)] + [("s1", "s2", 1.0)]
    of = near(rows)
    nodes, base, rounds = set(of), parts(set(of), of), []
    monkeypatch.setattr(graph, "cut", lambda df, real=graph.cut: rounds.append(1) or real(df))
    found = [tuple(r) for r in graph.blocks(spark.createDataFrame(rows, EDGE)).collect()]
    assert len(rounds) < 90 and len(found) == len(nodes) - base
    at = defaultdict(set)
    for a, b, block in found:
        at[a].add(block)
        at[b].add(block)
    assert {x for x in nodes if len(at[x]) > 1} == {x for x in nodes if parts(nodes - {x}, of) > base}
    # a block's nodes stay in one part whichever of them is taken out
    for block in {r[2] for r in found}:
        inside = {x for x in nodes if block in at[x]}
        assert all(parts(inside - {x}, {y: set(of[y]) & inside for y in inside}) <= 1 for x in inside)


def test_long_chains_rings_and_loops(spark):
    """A chain of 40 edges, a ring of 9 nodes, a loop from a junction back to itself, and parallel chains."""
    rows = [(f"c{i:02d}", f"c{i + 1:02d}", 1.0) for i in range(40)]
    rows += [(f"r{i}", f"r{(i + 1) % 9}", 2.0) for i in range(9)]
    rows += [("j", "l1", 1.0), ("l1", "l2", 1.0), ("l2", "j", 1.0), ("j", "k", 5.0), ("j", "p", 1.0), ("p", "k", 1.0), ("k", "q", 0.5)]
    got = {(r.a, r.b): r for r in graph.contract_chains(spark.createDataFrame(rows, EDGE)).collect()}
    assert got["c00", "c40"].nodes == [f"c{i:02d}" for i in range(41)] and got["c00", "c40"].length_km == 40
    ring = got["r0", "r4"]
    assert ring.nodes == ["r0", "r1", "r2", "r3", "r4", "r5", "r6", "r7", "r8", "r0"] and (ring.length_km, ring.n_edges) == (18, 9)
    assert got["j", "j"].nodes == ["j", "l1", "l2", "j"] and got["j", "k"].nodes == ["j", "p", "k"] and got["k", "q"].n_edges == 1 and len(got) == 5


def test_corridors_over_roads(spark):
    roads = [("a", "x", 1.0), ("x", "y", 1.0), ("y", "b", 1.0), ("y", "z", 5.0), ("z", "c", 1.0), ("a", "b", 9.0)]
    e = spark.createDataFrame(roads, EDGE)
    anchors = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "c")], "metro_id string, node string")
    pairs = spark.createDataFrame([("1", "2"), ("1", "3"), ("3", "4"), ("2", "5")], "metro_a string, metro_b string")
    paths = discover.road_corridors(e, anchors, pairs)
    assert sorted((r.metro_a, r.metro_b, r.length_km, r.nodes) for r in paths.collect()) == [("1", "2", 3.0, ["a", "y", "b"]), ("1", "3", 8.0, ["a", "y", "c"])]
    whole = {(r.metro_a, r.metro_b): (r.road_nodes, r.n_edges, r.segments) for r in discover.registry(e, anchors, pairs).collect()}
    assert whole == {("1", "2"): (["a", "x", "y", "b"], 3, ["a~y", "b~y"]), ("1", "3"): (["a", "x", "y", "z", "c"], 4, ["a~y", "c~y"])}
    tags = {(r.a, r.b): [(t.metro_a, t.metro_b) for t in r.tags] for r in discover.tags(paths).collect()}
    assert tags == {("a", "y"): [("1", "2"), ("1", "3")], ("b", "y"): [("1", "2")], ("c", "y"): [("1", "3")]}
    assert [r.pos for r in discover.path_edges(paths).where("metro_b = '3'").orderBy("pos").collect()] == [0, 1]
    with pytest.raises(ValueError):
        discover.road_corridors(e, anchors, pairs, max_km=1.0, check=True)
