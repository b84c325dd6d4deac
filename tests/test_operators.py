"""Numeric cases of single operators on tiny inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import numeric, text
from meshloom.operators import audits, corridors, expand, flows, graph, metros, roads, sites, traffic

LINE = "line_id string, pos int, x double, y double"
EDGE = "a string, b string, length_km double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapped_length_of_right_triangle(spark):
    e = roads.snapped_edges(spark.createDataFrame([("l", 0, 0.0, 0.0), ("l", 1, 3000.0, 4000.0)], LINE), 10.0)
    assert rows(e) == [(0, 0, 300, 400, 5.0)]


def test_points_in_one_cell_give_no_edge(spark):
    assert rows(roads.snapped_edges(spark.createDataFrame([("l", 0, 1.0, 1.0), ("l", 1, 2.0, 2.0)], LINE), 10.0)) == []


def test_parallel_edges_keep_the_shortest(spark):
    e = spark.createDataFrame([(0, 0, 1, 1, 3.0), (1, 1, 0, 0, 2.0), (5, 5, 6, 6, 0.0)], "ax long, ay long, bx long, by long, length_km double")
    assert rows(roads.merge_edges(e)) == [(0, 0, 1, 1, 2.0)]


def test_multipart_lines(spark):
    p = [((0.0, 0.0), (1.0, 0.0)), ((5.0, 5.0),)]
    df = spark.createDataFrame([("l", p)], "line_id string, parts array<array<struct<x:double,y:double>>>")
    assert [r.line_id for r in roads.parts(df).collect()] == ["l#0"]


def test_snap_must_be_positive(spark):
    with pytest.raises(ValueError):
        roads.snapped_edges(spark.createDataFrame([], LINE), 0)


def test_chain_is_contracted(spark):
    e = spark.createDataFrame([("a", "b", 50.0), ("b", "c", 50.0), ("c", "d", 50.0)], EDGE)
    assert rows(graph.contract_chains(e)) == [("a", "d", 150.0, 3, ["a", "b", "c", "d"])]


def test_ring_becomes_one_edge(spark):
    e = spark.createDataFrame([("a", "b", 100.0), ("b", "c", 100.0), ("c", "d", 100.0), ("d", "a", 100.0)], EDGE)
    [(a, b, km, n, nodes)] = rows(graph.contract_chains(e))
    assert (a, b, km, n) == ("a", "c", 400.0, 4) and nodes == ["a", "b", "c", "d", "a"]


def test_star_with_long_arm(spark):
    e = spark.createDataFrame([("o", "a", 50.0), ("o", "b", 50.0), ("o", "m", 100.0), ("m", "c", 50.0)], EDGE)
    assert sorted(r[2] for r in rows(graph.contract_chains(e))) == [50.0, 50.0, 150.0]


def test_protected_node_stays(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], EDGE)
    kept = spark.createDataFrame([("b",)], "node string")
    assert len(rows(graph.contract_chains(e, kept))) == 2


def test_components_and_largest(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("x", "y", 1.0), ("s", "s", 1.0)], EDGE)
    assert rows(graph.connected_components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("s", "s"), ("x", "x"), ("y", "x")]
    assert len(rows(graph.keep_largest(e))) == 3


def test_slivers_go_by_strict_limit(spark):
    e = spark.createDataFrame([("a", "b", 0.005), ("b", "c", 0.01)], EDGE)
    assert rows(graph.drop_slivers(e, 0.01)) == [("b", "c", 0.01)]


def test_core_numbers(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0)], EDGE)
    assert rows(graph.core_numbers(e)) == [("a", 2), ("b", 2), ("c", 2), ("d", 1)]


def test_two_shortest_paths_of_a_diamond(spark):
    e = spark.createDataFrame([("a", "b", 500.0), ("b", "d", 520.0), ("a", "c", 510.0), ("c", "d", 510.0)], EDGE)
    pairs = spark.createDataFrame([("a", "d")], "a string, b string")
    found = rows(graph.k_shortest_paths(e, pairs, 2))
    assert [(r[2], r[3], r[4]) for r in found] == [(0, 1020.0, ["a", "b", "d"]), (1, 1020.0, ["a", "c", "d"])]
    assert [r[4] for r in rows(graph.k_shortest_paths(e, pairs))] == [["a", "b", "d"]]
    assert rows(graph.k_shortest_paths(e, pairs, 2, 1000.0)) == []


def test_unreachable_pair_has_no_path(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("x", "y", 1.0)], EDGE)
    assert rows(graph.k_shortest_paths(e, spark.createDataFrame([("a", "y")], "a string, b string"))) == []


def test_articulation_and_cuts(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], EDGE)
    assert rows(graph.articulation_points(e)) == [("b",), ("c",)]
    assert sorted(r.nodes for r in graph.cut_sets(e, 2, 4).collect()) == [["a", "c"], ["b", "c"], ["b", "d"]]


@pytest.mark.parametrize(
    ("raw", "name"),
    [("New York--Newark, NY--NJ", "new-york-newark"), ("Salt Lake City", "salt-lake-city"), (" Big  Town ", "big-town"), ("A&B's", "abs"), ("x" * 40, "x" * 30), ("", "")],
)
def test_sanitize(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "n string").select(text.metro_slug(F.col("n"))).first()[0] == name


@pytest.mark.parametrize("k", range(8))
def test_bearings_are_on_the_circle(spark, k):
    e, n = numeric.bearing_offset(F.lit(45.0 * k), F.lit(1.0))
    got = spark.range(1).select(e, n).first()
    assert got[0] == pytest.approx(math.sin(math.radians(45 * k)), abs=1e-12) and got[1] == pytest.approx(math.cos(math.radians(45 * k)), abs=1e-12)


def test_demand_ends(spark):
    df = spark.createDataFrame([("^metro3/dc1/.*",), ("(metro[0-9]+/dc[0-9]+)",), ("^^metro04/x",)], "e string")
    assert [r[0] for r in df.select(text.metro_index(F.col("e"))).collect()] == [3, None, 4]
    assert [r[0] for r in df.select(text.dc_key(F.col("e"))).collect()] == ["metro3/dc1", None, None]


def test_neighbours_lists_from_the_smaller_id(spark):
    m = spark.createDataFrame([("1", 0.0, 0.0), ("2", 1000.0, 0.0), ("3", 1500.0, 0.0)], "metro_id string, x double, y double")
    assert rows(metros.neighbours(m, 1, 10.0).select("a", "b")) == [("1", "2"), ("2", "3")]
    assert rows(metros.neighbours(m, 1, 0.6).select("a", "b")) == [("2", "3")]


def test_radius_of_area_is_capped(spark):
    a = spark.createDataFrame([("50000000",), ("x",), (None,)], "aland string")
    got = metros.with_radius(a, 3.0).collect()
    assert [(r.land_area_km2, r.radius_km) for r in got][0] == (50.0, 3.0) and got[1].aland is None and got[2].aland is None


def test_selection_refuses_doubles(spark):
    a = spark.createDataFrame([("1", "York", 5.0), ("2", "Lake", 4.0)], "uac_code string, name_orig string, aland double")
    with pytest.raises(ValueError):
        metros.select(a, 2, ["york", "y"], check=True)
    assert [r.uac_code for r in metros.select(a, 2, ["lake"], check=True).orderBy("sel_pos").collect()] == ["2", "1"]


def _paths(spark):
    return spark.createDataFrame([("a", "b", 0, 150.0), ("a", "b", 1, 120.0), ("a", "b", 2, 120.0)], "metro_a string, metro_b string, path_index int, length_km double")


def test_best_path_is_shortest_then_first(spark):
    assert rows(corridors.best_paths(_paths(spark))) == [("a", "b", 1, 120.0)]


def test_corridor_takes_on_all_risks_of_its_edges(spark):
    edges = spark.createDataFrame([("a", "b", 1, 0, "e1"), ("a", "b", 1, 1, "e2")], "metro_a string, metro_b string, path_index int, pos int, edge_id string")
    risks = spark.createDataFrame([("e1", "r1"), ("e1", "r2"), ("e2", "r3"), ("e3", "r4")], "edge_id string, risk_group string")
    m = spark.createDataFrame([("a", 0.0, 0.0), ("b", 100000.0, 0.0)], "metro_id string, x double, y double")
    [c] = corridors.extract(_paths(spark), edges, risks, m).collect()
    assert c.risk_groups == ["r1", "r2", "r3"] and c.euclidean_km == 100.0 and c.detour_ratio == pytest.approx(1.2)


def test_risk_distance_folds_path_suffix(spark):
    c = spark.createDataFrame([("a", "b", 100.2, ["r_A_B", "r_A_B_path1", "other"])], "metro_a string, metro_b string, length_km double, risk_groups array<string>")
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "metro_id string, name string")
    assert rows(corridors.risk_distances(c, names, "r")) == [("other", 101), ("r_A_B", 101), ("r_A_B_path1", 101)]


def _dcs(spark, far=2000.0, mws=(100.0, 100.0, 100.0)):
    xs = (0.0, 1000.0, far)
    return spark.createDataFrame([(i + 1, i + 1, "ABC"[i], 1, xs[i], 0.0, mws[i]) for i in range(3)], "dc_pos long, metro_idx int, metro string, dc_idx int, x double, y double, mw double")


def test_gravity_conserves_class_totals(spark):
    d, kinds = _dcs(spark), traffic.classes(spark, {0: 0.5, 1: 0.5})
    got = traffic.gravity(d, kinds, 10.0).groupBy("priority").agg(F.sum("demand").alias("s")).collect()
    assert all(r.s == pytest.approx(1500.0, abs=0.05) for r in got) and len(got) == 2
    stepped = traffic.gravity(d, kinds, 10.0, step=20.0).groupBy("priority").agg(F.sum("demand").alias("s")).collect()
    assert all(r.s == pytest.approx(1500.0, abs=20.0) for r in stepped)


def test_top_partner_keeps_nearest(spark):
    weighed = traffic.gravity_weights(_dcs(spark, 100000.0), min_km=0.1)
    assert rows(traffic.top_partners(weighed, 1).select("a_pos", "b_pos")) == [(1, 2), (2, 3)]


def _many_dcs(spark, n, places, powers, seed=3):
    """Data centres whose places, metros and powers often repeat."""
    import random

    rng = random.Random(seed)
    spots = [(i % 3 + 1, "ABC"[i % 3], rng.randint(0, 300) * 1000.0, rng.randint(0, 300) * 1000.0) for i in range(places)]
    found = [(pos, *rng.choice(spots), float(rng.choice(powers))) for pos in rng.sample(range(10 * n), n)]
    return spark.createDataFrame([(p, m, name, k + 1, x, y, mw) for k, (p, m, name, x, y, mw) in enumerate(found)], "dc_pos long, metro_idx int, metro string, dc_idx int, x double, y double, mw double")


@pytest.mark.parametrize(("places", "k", "apart"), [(1, 2, False), (4, 1, False), (7, 3, True), (40, 2, False)])
def test_heaviest_pairs_are_those_of_all_pairs(spark, places, k, apart):
    d = _many_dcs(spark, 60, places, (0, 100, 100, 120, 150))
    want = traffic.top_partners(traffic.gravity_weights(d, 1.0, 1.5, 10.0, apart), k)
    got = traffic.heaviest_pairs(d, k, 1.0, 1.5, 10.0, apart)
    assert rows(got.select(*want.columns)) == rows(want)


def test_bundles_give_every_pair_once_and_whole_steps(spark, monkeypatch):
    monkeypatch.setattr(traffic, "BUNDLE", 4)
    d = _many_dcs(spark, 50, 3, (100, 150))
    p = {r.dc_pos: r for r in d.collect()}
    got = [(r.a_pos, r.b_pos, r.a_dc, r.b_dc, round(r.weight, 6)) for r in traffic.gravity_weights(d).collect()]
    km = lambda a, b: 10.0 if a.metro == b.metro else max(math.hypot(a.x - b.x, a.y - b.y) / 1000, 10.0)
    want = [(a, b, p[a].dc_idx, p[b].dc_idx, round(p[a].mw * p[b].mw / km(p[a], p[b]), 6)) for a in p for b in p if a < b]
    assert traffic.bundles(d).count() < 50 and sorted(got) == sorted(want)
    # rounding is the same whether pairs come as bundles or by themselves
    kinds, total = traffic.classes(spark, {0: 0.5, 1: 0.5}), traffic.offered(d, 1.0)
    for policy in ("nearest", "floor", "ceil"):
        both = [traffic.conserve(traffic.allocate(w, kinds, total), 10.0, policy).select("a_pos", "b_pos", "priority", "gbps") for w in (traffic.bundle_weights(d), traffic.gravity_weights(d))]
        assert rows(both[0]) == rows(both[1]) and both[0].count() == 2 * len(want)


def test_heaviest_of_bundles_are_those_of_all_pairs(spark):
    d = _many_dcs(spark, 40, 5, (100, 110, 150))
    want = traffic.gravity_weights(d).orderBy(F.desc("weight"), "a_pos", "b_pos").select("a_pos", "b_pos", "weight").limit(7)
    assert [tuple(r) for r in traffic.heaviest(traffic.bundle_weights(d), 7).select("a_pos", "b_pos", "weight").collect()] == [tuple(r) for r in want.collect()]


def test_core_numbers_take_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "cut", lambda df, real=graph.cut: made.append(1) or real(df))
    # each core within the last by one node: by peeling, cores would be as many rounds
    links = [(i, j) for i in range(31) for j in range(i) if i + j >= 30] + [(40, 40)]
    near = {n: {b if a == n else a for a, b in links if n in (a, b)} - {n} for link in links for n in link}
    want, left, k = {}, {n: set(v) for n, v in near.items()}, 0
    while left:
        low = min(left, key=lambda n: len(left[n]))
        k = max(k, len(left[low]))
        want[low] = k
        for other in left.pop(low):
            left[other].discard(low)
    got = {r.node: r.core for r in graph.core_numbers(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want and len(made) <= 12


def test_hose_margins_and_reruns(spark):
    d = _dcs(spark, mws=(100.0, 200.0, 150.0))
    cells = traffic.hose_matrices(d, 10.0, samples=2, seed=5)
    out = {(r["sample"], r["i"]): r["s"] for r in cells.groupBy("sample", "i").agg(F.sum("gbps").alias("s")).collect()}
    back = {(r["sample"], r["j"]): r["s"] for r in cells.groupBy("sample", "j").agg(F.sum("gbps").alias("s")).collect()}
    for s in (1, 2):
        for i, mw in enumerate((100.0, 200.0, 150.0)):
            assert out[s, i + 1] == pytest.approx(mw * 10, rel=1e-4) and back[s, i + 1] == pytest.approx(mw * 10, rel=1e-4)
    assert rows(cells) == rows(traffic.hose_matrices(d, 10.0, samples=2, seed=5))


def test_hose_bands_are_rows_of_one_matrix(spark, monkeypatch):
    sites = [(i, i % 3 + 1, f"m{i % 3}", i // 3 + 1, 5000.0 * (i % 3), 0.0, 100.0 + i % 7) for i in range(3, 43)]
    d = spark.createDataFrame(sites, "dc_pos long, metro_idx int, metro string, dc_idx int, x double, y double, mw double").repartition(3)
    whole = traffic.hose_matrices(d, 10.0, samples=2, seed=5, tilt=0.5).toPandas()
    rng = random.Random(5 * 1000003 + 2)  # numbers are those of one generator a sample, row by row
    lean = lambda i, j: 1.0 if i % 3 == j % 3 else (1 / max(abs(i % 3 - j % 3) * 5.0, 1.0)) ** 0.5
    m = np.array([[0.0 if i == j else (1e-9 + rng.random()) * lean(i, j) for j in range(40)] for i in range(40)])
    want = np.array([10 * (100.0 + i % 7) for i in range(3, 43)])
    for _ in range(60):
        m *= (want / m.sum(axis=1))[:, None]
        m *= want / m.sum(axis=0)
    monkeypatch.setattr(traffic, "WHOLE", 10)
    monkeypatch.setattr(traffic, "BAND", 7)
    monkeypatch.setattr(traffic, "SEGMENT", 9)
    banded = traffic.hose_matrices(d, 10.0, samples=2, seed=5, tilt=0.5).toPandas()
    for got in (whole, banded):
        got = got[got["sample"] == 2]
        found = np.zeros((40, 40))
        found[got["i"] - 1, got["j"] - 1] = got["gbps"]
        assert np.abs(found - m).max() < 1e-5
    assert not hasattr(traffic, "MAX_HOSE")  # no size is refused


def test_hose_carved_from_bands(spark, monkeypatch):
    d = spark.createDataFrame([(i, 1, "m", i, 0.0, 0.0, 100.0 + i % 2) for i in range(30)], "dc_pos long, metro_idx int, metro string, dc_idx int, x double, y double, mw double")
    made = []
    for whole in (traffic.WHOLE, 10):
        monkeypatch.setattr(traffic, "WHOLE", whole)
        made.append(traffic.hose_matrices(d, 10.0, samples=1, seed=3, carve_top_k=6).toPandas().sort_values(["i", "j"]))
    one, banded = made
    assert one[["i", "j"]].values.tolist() == banded[["i", "j"]].values.tolist() and 2 * 30 * 6 >= len(one) >= 30 * 6
    assert np.abs(one["gbps"].to_numpy() - banded["gbps"].to_numpy()).max() < 1e-5


def test_hose_carves_the_heaviest_pairs_from_few_cells(spark, monkeypatch):
    sites = [(i, i % 3 + 1, f"m{i % 3}", i, 4000.0 * (i % 3), 0.0, 0.0 if i == 17 else 100.0 + i % 9) for i in range(150)]
    d = spark.createDataFrame(sites, "dc_pos long, metro_idx int, metro string, dc_idx int, x double, y double, mw double").repartition(2)
    monkeypatch.setattr(traffic, "WHOLE", 10)
    monkeypatch.setattr(traffic, "BAND", 32)
    args, whole, met, made = (d, 10.0, 2, 5, 0.5), np.zeros((3, 150, 150)), [], []
    got = traffic.hose_matrices(*args).toPandas()
    whole[got["sample"], got["i"] - 1, got["j"] - 1] = got["gbps"]
    both = whole + whole.transpose(0, 2, 1)
    want = [(s, i + 1, int(j) + 1) for s in (1, 2) for i in range(150) if i != 17 for j in np.argsort(-both[s, i], kind="stable")[:2]]
    asked = traffic._asked
    for name, kept in (("_cells_from", met), ("_heaviest_cells", made)):
        monkeypatch.setattr(traffic, name, lambda *a, real=getattr(traffic, name), kept=kept: kept.append(real(*a)) or kept[-1])
    for high in (1, 1.7):  # what is asked for first may be too heavy for some, who ask again
        met.clear()
        monkeypatch.setattr(traffic, "_asked", lambda b, many, lean, high=high: asked(b, many, lean) * (high if many < 30 else 1))
        traffic.hose_matrices(*args, carve_top_k=2)
        assert rows(made.pop()) == sorted(want)
        assert len(met) == (1 if high == 1 else 2) and met[0].count() < 0.5 * 2 * 150 * 149


def test_hose_carved_too_far_still_sends_all(spark, monkeypatch):
    # two heavy data centres are the only partners that the others keep, and can't receive all that these send
    mws = [1000.0 if i < 2 else 100.0 + i for i in range(40)]
    d = spark.createDataFrame([(i, 1, "m", i, 0.0, 0.0, mws[i]) for i in range(40)], "dc_pos long, metro_idx int, metro string, dc_idx int, x double, y double, mw double")
    for whole in (traffic.WHOLE, 10):
        monkeypatch.setattr(traffic, "WHOLE", whole)
        sent = traffic.hose_matrices(d, 10.0, samples=2, seed=3, carve_top_k=1).groupBy("sample", "i").agg(F.sum("gbps").alias("s"))
        assert {(r["sample"], r["i"]): round(r.s, 3) for r in sent.collect()} == {(s, i + 1): 10 * mws[i] for s in (1, 2) for i in range(40)}


@pytest.mark.parametrize(("step", "policy"), [(0.0, "nearest"), (1.0, "nearest"), (40.0, "floor"), (40.0, "ceil")])
def test_hose_pairs_of_blocks_are_not_shuffled(spark, monkeypatch, step, policy):
    sites = [(2 * i, i % 3 + 1, f"m{i % 3}", i, 4000.0 * (i % 3), 0.0, 0.0 if i == 17 else 100.0 + i % 9) for i in range(50)]
    d = spark.createDataFrame(sites, "dc_pos long, metro_idx int, metro string, dc_idx int, x double, y double, mw double").repartition(2)
    kinds, options = traffic.classes(spark, {0: 0.5, 1: 0.25, 2: 0.25}), {"samples": 2, "seed": 5, "tilt": 0.5}
    want = rows(traffic.hose(d, kinds, 10.0, step, policy, **options))
    monkeypatch.setattr(traffic, "WHOLE", 10)
    monkeypatch.setattr(traffic, "BAND", 4)
    monkeypatch.setattr(traffic, "BLOCK_BANDS", 3)
    monkeypatch.setattr(traffic, "hose_matrices", None)  # its cells are shuffled to add both ways
    assert rows(traffic.hose(d, kinds, 10.0, step, policy, **options)) == want and len(want) > 1000


def test_demands_of_bundles_are_both_ways_of_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(traffic, "BUNDLE", 4)
    d = _many_dcs(spark, 40, 3, (100, 150))
    assert dict(traffic.bundles(d).dtypes)["members"] == "array<bigint>"  # no structs, which are made anew for each pair
    made = [traffic.allocate(w, traffic.classes(spark, {0: 0.5, 1: 0.5}), traffic.offered(d, 10.0)) for w in (traffic.bundle_weights(d), traffic.gravity_weights(d))]
    got, want = (traffic.directed(rows) for rows in made)
    assert rows(got) == rows(want) and got.count() == 2 * 40 * 39


def test_last_step_is_found_without_the_rows_of_its_bin(spark, monkeypatch):
    # all pairs of three places tie: steps end among them, and what is kept are the class's ends
    monkeypatch.setattr(traffic, "BUNDLE", 8)
    d, kept = _many_dcs(spark, 60, 3, (100,)), []
    kinds, total = traffic.classes(spark, {0: 0.5, 1: 0.5}), traffic.offered(d, 1.0)
    monkeypatch.setattr(traffic, "cut", lambda df, real=traffic.cut: kept.append(real(df)) or kept[-1])
    for w in (traffic.bundle_weights(d), traffic.gravity_weights(d)):
        allocated = traffic.allocate(w, kinds, total).select("a_pos", "b_pos", "priority", "gbps", "class_gbps", *[c for c in ("n_pairs", "a_members", "b_members", "a_dcs", "b_dcs") if c in w.columns])
        got = rows(traffic.conserve(allocated, 10.0, "floor").select("priority", "a_pos", "b_pos", "gbps"))
        all_rows = [(r.priority, r.a_pos, r.b_pos, r.gbps) for r in traffic.spread(allocated).collect()]
        want = []
        for p in (0, 1):
            own = sorted((-round(g % 10, 9), a, b, g // 10 * 10) for q, a, b, g in all_rows if q == p)
            steps = round((3000.0 - sum(o[3] for o in own)) / 10)
            want += [(p, a, b, q + (10.0 if k < steps else 0.0)) for k, (_, a, b, q) in enumerate(own)]
        assert got == sorted(want) and len(got) == 60 * 59
    assert max(k.count() for k in kept) < 10


def test_conserve_adds_missing_steps_to_largest_remainders(spark):
    df = spark.createDataFrame([(1, 2, 0, 14.0, 40.0), (1, 3, 0, 13.0, 40.0), (2, 3, 0, 13.0, 40.0)], "a_pos int, b_pos int, priority int, gbps double, class_gbps double")
    assert rows(traffic.conserve(df, 10.0, "floor").select("a_pos", "b_pos", "gbps")) == [(1, 2, 20.0), (1, 3, 10.0), (2, 3, 10.0)]


def test_natural_order_stripes(spark):
    d = spark.createDataFrame([("b", f"leaf{i}") for i in (10, 9, 1, 2)], "blueprint string, device string")
    assert rows(sites.stripes_by_width(d, 2).select("device", "stripe")) == [("leaf1", "g1"), ("leaf10", "g2"), ("leaf2", "g1"), ("leaf9", "g2")]
    with pytest.raises(ValueError):
        sites.stripes_by_width(d, 3)
    with pytest.raises(ValueError):
        sites.stripes_by_width(d, 0)


def test_builtin_blueprints_inner_links(spark):
    groups, links = expand.blueprint_tables(spark)
    s = spark.createDataFrame([(n, n) for n in expand.BLUEPRINTS], "node string, blueprint string")
    n = {r.site: r.n for r in expand.inner_links(s, groups, links).groupBy("site").agg(F.count("*").alias("n")).collect()}
    assert n["FullMesh4"] == 6 and n["Clos_L16_S4"] == 64 and n["DragonFly_CustomG4"] == 40 and n["Dragonfly_A3H2G7"] == 42 and "SingleRouter" not in n and "DCRegion" not in n


def _two_sites(spark, first, second):
    groups = spark.createDataFrame([("A", "core", first, "c{n}", "core"), ("B", "core", second, "c{n}", "core")], "blueprint string, grp string, n int, template string, role string")
    s = spark.createDataFrame([("x", "A"), ("y", "B")], "node string, blueprint string")
    e = spark.createDataFrame([("e", "x", "y", 3200.0, 1)], "edge_key string, u string, v string, base_capacity double, cost long")
    return groups, s, e


def test_base_capacity_is_split_over_device_links(spark):
    groups, s, e = _two_sites(spark, 4, 4)
    assert rows(expand.per_link_capacity(e, expand.link_counts(e, s, groups)).select("n_links", "capacity")) == [(4, 800.0)]


def test_short_side_wraps(spark):
    groups, s, e = _two_sites(spark, 4, 1)
    assert len(rows(expand.site_links(e, expand.nodes(s, groups)))) == 4


def test_sizes_that_do_not_divide_are_refused(spark):
    groups, s, e = _two_sites(spark, 4, 3)
    with pytest.raises(Exception, match="neither side divides"):
        expand.site_links(e, expand.nodes(s, groups)).collect()


def test_assignments_zip_and_product(spark):
    r = spark.createDataFrame([(1, {"a": ["1", "2"], "b": ["x", "y", "z"]}), (2, {"a": []})], "rule int, vars map<string,array<string>>")
    count = lambda mode: {k: n for k, n in expand.assignments(r, mode).groupBy("rule").count().collect()}
    assert count("zip") == {1: 2, 2: 1} and count("cartesian") == {1: 6, 2: 1}


def test_parallel_corridors_share_load(spark):
    e = spark.createDataFrame([(f"k{i}", "fwd", 1, 2, 5) for i in range(3)] + [(f"k{i}", "rev", 2, 1, 5) for i in range(3)], "edge_key string, way string, a int, b int, cost long")
    d = spark.createDataFrame([(1, 2, 30.0), (2, 1, 15.0)], "s int, t int, demand double")
    assert rows(flows.ecmp_loads(e, d)) == [(f"k{i}", w, x) for i in range(3) for w, x in (("fwd", 10.0), ("rev", 5.0))]


def test_sized_up_in_quanta(spark):
    cols = "u string, v string, edge_key string, link_type string, base_capacity double, cost long, adjacency_id string, source_metro string, target_metro string"
    e = spark.createDataFrame([("metro1/pop1", "metro2/pop1", "k", "inter_metro_corridor", 100.0, 5, "x", "A", "B")], cols)
    loads = spark.createDataFrame([("k", "fwd", 5000.0), ("k", "rev", 10.0)], "edge_key string, way string, load double")
    assert flows.size_corridors(e, loads, 3200.0, 1.3).first().base_capacity == 9600.0


def test_dc_audit_flags_egress_alone(spark):
    dcs = spark.createDataFrame([("metro1/dc1", 1000.0)], "dc string, capacity double")
    d = spark.createDataFrame([("^metro1/dc1/.*", "^metro2/dc1/.*", 1200.0), ("^metro2/dc1/.*", "^metro01/dc1/.*", 800.0)], "source_path string, sink_path string, demand double")
    assert ("dc_capacity", "metro1/dc1", "egress over capacity") in rows(audits.dc_capacity(dcs, d))
    assert ("dc_capacity", "metro1/dc1", "ingress over capacity") not in rows(audits.dc_capacity(dcs, d))


@pytest.mark.parametrize(("ports", "found"), [(8, 0), (2, 1)])
def test_port_budget(spark, ports, found):
    nodes = spark.createDataFrame([("n1", "box", 1), ("n2", "big", 1)], "node string, component string, n int")
    parts = spark.createDataFrame([("box", ports, 1e6), ("big", 99, 1e6), ("opt", 1, 100.0)], "name string, ports int, capacity double")
    links = spark.createDataFrame([("e", "n1", "n2", 400.0)], "edge_key string, u string, v string, capacity double")
    roles = spark.createDataFrame([("n1", "core"), ("n2", "core")], "node string, role string")
    rules = spark.createDataFrame([("core|core", "opt")], "pair string, optic string")
    assert audits.ports(nodes, links, roles, rules, parts).count() == found


def test_node_connectivity_against_all_subsets(spark):
    from itertools import combinations

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    for n, p in ((7, 0.5), (8, 0.6), (6, 0.9)):
        pairs = [(f"n{i}", f"n{j}", 1.0) for i in range(n) for j in range(i + 1, n) if rng.random() < p]
        pdf = pd.DataFrame(pairs, columns=["a", "b", "length_km"])
        names = sorted({x for e in pairs for x in e[:2]})
        cuts = [(k, list(c)) for k in range(len(names) - 1) for c in combinations(names, k) if not graph.is_connected(pdf, c)]
        row = graph.node_connectivity(spark.createDataFrame(pairs, EDGE)).first()
        assert row.k == (cuts[0][0] if cuts else len(names) - 1)
        assert not cuts or (row.k, row.nodes) in cuts


def test_complete_graph_has_no_cut(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)], EDGE)
    assert tuple(graph.node_connectivity(e).first()) == (2, None) and graph.greedy_disconnection(e) == []


def test_greedy_disconnection(spark):
    e = spark.createDataFrame([("h", "a", 1.0), ("h", "b", 1.0), ("h", "c", 1.0), ("a", "b", 1.0)], EDGE)
    assert graph.greedy_disconnection(e) == ["h"]
