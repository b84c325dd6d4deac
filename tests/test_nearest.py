"""Nearest neighbours against all pairs, on dense, sparse and repeated places, and how many are compared."""

from __future__ import annotations

import numpy as np

from meshloom.operators import metros


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(8)
    dense = rng.normal(0, 400, (3000, 2))  # a town, seen against a limit of 600 km
    wide = rng.uniform(-2e6, 2e6, (150, 2))
    lattice = np.array([(x * 1e5, y * 1e5) for x in range(-6, 7) for y in range(5, 12)], dtype=float)  # ties
    same = np.repeat(np.array([[3e5, -7e5]]), 300, axis=0)
    far = np.array([[9e7, 9e7]])
    xy = np.concatenate([dense, wide, lattice, same, far])
    ids = [f"{i:05d}" for i in rng.permutation(len(xy))]
    rows = [(i, float(x), float(y)) for i, (x, y) in zip(ids, xy)] + [("nowhere", None, 1.0)]
    compared, real = [], metros._around
    monkeypatch.setattr(metros, "_around", lambda *a: compared.append(real(*a)) or compared[-1])
    k, limit = 3, 600_000.0
    got = {}
    for r in metros.nearest(spark.createDataFrame(rows, "id string, x double, y double"), k, limit).collect():
        got.setdefault(r.a, {})[r.r] = r.b
    d = np.sqrt(((xy[:, None, :] - xy[None]) ** 2).sum(2))
    rank = np.empty(len(ids), dtype=int)
    rank[np.argsort(ids)] = np.arange(len(ids))
    np.fill_diagonal(d, np.inf)
    for i, a in enumerate(ids):
        best = [j for j in np.lexsort((rank, d[i]))[:k] if d[i, j] <= limit]
        assert [got.get(a, {}).get(r + 1) for r in range(len(best))] == [ids[j] for j in best] and len(got.get(a, {})) == len(best)
    # by cells as wide as the limit, the town alone would be nine million
    assert sum(c.count() for c in compared) < 200 * len(xy)


def test_as_far_as_the_limit(spark):
    """Places just as far apart as the limit, half-way between two cells of that width."""
    at = spark.createDataFrame([("a", 500.0, 0.0, 1.0), ("b", 1500.0, 0.0, 1.0)], "metro_id string, x double, y double, radius_km double")
    assert [tuple(r) for r in metros.neighbours(at, 1, 1.0).collect()] == [("a", "b", 1.0)]
    assert [tuple(r) for r in metros.anchors(at.where("metro_id = 'a'"), at.where("metro_id = 'b'").select("x", "y"), 1.0).collect()] == [("a", 1500.0, 0.0, 1.0)]


def test_none_and_one(spark):
    empty = spark.createDataFrame([], "id string, x double, y double")
    assert metros.nearest(empty, 2, 1000.0).collect() == []
    assert metros.nearest(empty.unionByName(spark.createDataFrame([("a", 0.0, 0.0)], empty.schema)), 2, 1000.0).collect() == []
