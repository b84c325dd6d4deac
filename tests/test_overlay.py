"""Unions of polygons, held against counting of small squares."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import metros, overlay

SCHEMA = "code string, parts array<array<struct<x:double,y:double>>>"


def shapes(spark, rows):
    return spark.createDataFrame([(k, None if p is None else [[(float(x), float(y)) for x, y in ring] for ring in p]) for k, p in rows], SCHEMA)


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def table(frame, group=None):
    found = overlay.ring_table(overlay.union(frame, group, 1.0), 1.0, straight=False).collect()
    return sorted((r.group_key or "", r.hole, r.n_vertices, r.area) for r in found), found


def test_shared_borders_holes_and_corners(spark):
    ring = [box(0, 0, 3, 1), box(0, 2, 3, 1), box(0, 1, 1, 1), box(2, 1, 1, 1)]  # a frame of four, with a hole
    rows = [("f", [b]) for b in ring] + [("c", [box(0, 0, 1, 1)]), ("c", [box(1, 1, 1, 1)])]
    rows += [("t", [box(0, 0, 4, 2)]), ("t", [box(1, 2, 2, 1)]), ("d", [box(0, 0, 9, 9), box(2, 2, 3, 3)]), ("d", [box(2, 2, 3, 3)]), ("r", [box(0, 0, 1, 1)]), ("r", [box(0, 0, 1, 1)])]
    got, found = table(shapes(spark, rows), "code")
    assert got == sorted([
        ("f", False, 4, 9.0), ("f", True, 4, 1.0), ("c", False, 4, 1.0), ("c", False, 4, 1.0), ("t", False, 8, 10.0), ("d", False, 4, 81.0), ("r", False, 4, 1.0),
    ])
    frame = next(r for r in found if r.group_key == "f" and not r.hole)
    assert [tuple(v) for v in frame.vertices] == [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]


def test_crossing_overlap_and_odd_rows(spark):
    star = [[(0, 0), (800, 0), (400, 800)], [(0, 600), (800, 600), (400, -200)]]
    got, _ = table(shapes(spark, [("s", [star[0]]), ("s", [star[1]]), ("n", None), ("e", []), ("l", [[(0, 0), (5, 0)]]), ("z", [[(0, 0), (2, 2), (4, 4)]])]), "code")
    assert len(got) == 1 and got[0][:3] == ("s", False, 12) and got[0][3] == pytest.approx(430_000, rel=0.002)
    one, _ = table(shapes(spark, [("a", [box(0, 0, 2, 2)]), (None, [box(1, 1, 2, 2)])]))
    assert one == [("", False, 8, 7.0)]
    two, _ = table(shapes(spark, [("a", [box(0, 0, 2, 2)]), (None, [box(1, 1, 2, 2)])]), "code")
    assert two == [("", False, 4, 4.0), ("a", False, 4, 4.0)]
    assert overlay.dissolve(shapes(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_boxes_by_counting(spark, seed):
    rng = np.random.default_rng(seed)
    rows, cover = [], {}
    for _ in range(60):
        g = "gh"[int(rng.integers(0, 2))]
        x, y, w, h = (int(v) for v in (*rng.integers(0, 24, 2), *rng.integers(1, 6, 2)))
        ring = box(x, y, w, h)
        rows.append((g, [ring if rng.random() < 0.5 else ring[::-1]]))
        cover.setdefault(g, np.zeros((32, 32), bool))[x : x + w, y : y + h] = True
    got, found = table(shapes(spark, rows), "code")
    for g, raster in cover.items():
        own = [r for r in found if r.group_key == g]
        assert sum(-r.area if r.hole else r.area for r in own) == raster.sum()
        p = np.pad(raster, 1).astype(int)
        corners = {(x, y) for x in range(33) for y in range(33) if (k := p[x : x + 2, y : y + 2]).sum() % 2 or (k.sum() == 2 and k[0, 0] == k[1, 1])}
        assert {tuple(v) for r in own for v in r.vertices} == corners
        label, n = np.zeros_like(p), 0
        for at in zip(*np.nonzero(p)):
            if not label[at]:
                n, todo = n + 1, [at]
                while todo:
                    i, j = todo.pop()
                    if p[i, j] and not label[i, j]:
                        label[i, j] = n
                        todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        assert sum(not r.hole for r in own) == n


def test_cells_decide_nothing(spark):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(25):
        a = np.sort(rng.uniform(0, 2 * np.pi, 7))
        rows.append(("g", [[(int(x), int(y)) for x, y in zip(rng.uniform(0, 300) + 60 * np.cos(a), rng.uniform(0, 300) + 60 * np.sin(a))]]))
    edges = overlay.directed(shapes(spark, rows), "code", 1.0)
    net = overlay.netted(overlay.noded(edges))
    key = lambda d: sorted(map(tuple, d.collect()))
    want = key(overlay.borders(net))
    assert want and all(key(overlay.borders(net, size)) == want for size in (7, 1000))
    assert key(overlay.netted(overlay.noded(edges, 13))) == key(net)


def test_a_dissolved_mask_keeps_what_its_parts_keep(spark):
    states = shapes(spark, [(str(i), [box(2 * i, 0, 2, 3)]) for i in range(5)])
    areas = shapes(spark, [(str(i), [box(i, i % 5 - 2, 0.5, 0.5)]) for i in range(14)]).withColumnRenamed("code", "uac_code")
    mask = overlay.dissolve(states).select(F.lit("all").alias("statefp"), "parts")
    want = sorted(r.uac_code for r in metros.within(areas, states.withColumnRenamed("code", "statefp")).collect())
    assert sorted(r.uac_code for r in metros.within(areas, mask).collect()) == want and 0 < len(want) < 14


def test_guessed_size_does_not_square_with_rounds(spark):
    n = 100
    stairs = [p for i in range(n) for p in ((i, i), (i + 1, i))] + [(n, n), (-1, n), (-1, 0)]  # one ring of over 200 vertices
    points = overlay.union(shapes(spark, [("s", [stairs]), ("b", [box(0, 0, 1, 1)])]), "code", 1.0)
    assert points.groupBy("group_key").count().orderBy("group_key").collect() == [("b", 4), ("s", len(stairs))]
    assert sorted(r.pos for r in points.where("group_key = 's'").collect()) == list(range(len(stairs)))
    guess = points._jdf.queryExecution().optimizedPlan().stats().simpleString()  # like sizeInBytes=1.41E+32 B
    assert "E+" not in guess or int(guess.split("E+")[1].split()[0].rstrip(",")) < 400
