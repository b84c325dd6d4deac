"""Audits of hardware, optics and expansions on small tables with nulls, blanks and unknown names."""

from __future__ import annotations

import pytest

from meshloom.operators import audits

LINK = "adjacency_id string, u string, v string, capacity double, u_component string, u_count double, v_component string, v_count double"


def found(df) -> set[tuple[str, str]]:
    rows = [(r.key, r.message) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame([("big", 100.0), ("small", 10.0), ("none", None)], "name string, capacity double")


def test_role_hardware(spark, parts):
    nodes = spark.createDataFrame([("a", "core", "big"), ("b", "core", " "), ("c", " core ", None), ("d", "core", "gone"), ("e", "exempt", None), ("f", "new", None), ("g", None, None), ("h", "", "gone")], "node string, role string, component string")
    mapping = spark.createDataFrame([("core", "big"), ("exempt", ""), ("unused", None)], "role string, component string")
    assert found(audits.role_hardware(nodes, mapping, parts)) == {("new", "no mapping for role"), ("b", "no hardware for role core"), ("c", "no hardware for role core"), ("d", "unknown component gone")}
    assert found(audits.role_hardware(nodes, mapping.limit(0), parts)) == set()
    assert found(audits.role_hardware(nodes.limit(0), mapping, parts)) == set()


def test_declared_optics(spark):
    said = [("a|b", "x"), ("c|d", "y"), ("d|c", "z"), ("e-f", "p"), (" e - f", "q"), ("g|g", "x"), ("g|g", "y"), ("h|", "x"), ("h", "x"), ("i-j-k", "x"), (None, "x"), ("l|m", None), ("b-a", "w")]
    rules = spark.createDataFrame(said, "pair string, optic string")
    assert {tuple(r) for r in audits.declared_optics(rules).collect()} == {
        ("a", "b", "x"), ("b", "a", "x"), ("b", "a", "w"), ("c", "d", "y"), ("d", "c", "z"), ("e", "f", "p"), ("e", "f", "q"), ("g", "g", "x"), ("g", "g", "y"), ("i", "j-k", "x"),
    }
    assert found(audits.optic_conflicts(rules)) == {("b|a", "conflicting optics w, x"), ("e|f", "conflicting optics p, q"), ("g|g", "conflicting optics x, y")}


def test_link_hardware(spark, parts):
    roles = spark.createDataFrame([("c1", "core"), ("c2", "core"), ("l", "leaf"), ("n", None), ("m", "")], "node string, role string")
    rules = spark.createDataFrame([("core-leaf", "big")], "pair string, optic string")
    links = [
        ("A", "c1", "l", 50.0, "big", None, "big", 1.0), ("B", "c1", "l", 50.0, "big", 1.0, None, None), ("C", "c1", "l", 50.0, None, None, "small", 1.0),
        ("D", "c1", "l", 50.0, "gone", 1.0, "big", 1.0), ("E", "c1", "l", 50.0, "small", 5.0, "small", 4.0), ("F", "c1", "l", None, "none", 1.0, " ", None), ("G", "c1", "l", 1.0, "none", 1.0, "big", None),
        ("z", "c1", "l", 1.0, None, None, None, None), ("y", "c1", "l", 1.0, None, None, None, None), (" ", "c1", "l", 1.0, None, None, None, None), ("x", "c1", "l", 1.0, None, None, None, None), ("w", "c1", "l", 1.0, None, None, None, None),
        (None, "c1", "c2", 1.0, None, None, None, None), ("N", "n", "l", 1.0, None, None, None, None), ("N", "m", "l", 1.0, None, None, None, None), ("N", "c1", "unknown", 1.0, None, None, None, None),
    ]
    df = spark.createDataFrame(links, LINK)
    assert found(audits.link_hardware(df, roles, rules, parts)) == {
        ("leaf|core", "hardware only at the source: 1 (B)"), ("core|leaf", "hardware only at the target: 1 (C)"), ("core|leaf", "unknown component at the source: 1 (D)"),
        ("core|leaf", "hardware too small: 3 (D, E, G)"), ("core|leaf", "no hardware at the source, which a rule asks for: 5 (w, x, y)"), ("leaf|core", "no rule for the target: 5 (w, x, y)"),
        ("core|core", "no rule for the source: 1"), ("core|core", "no rule for the target: 1"),
    }
    assert found(audits.link_hardware(df, roles, rules.limit(0), parts)) == set()


def test_expansions(spark):
    groups = spark.createDataFrame([("X", "a", 2, "core"), ("X", "b", 1, "core"), ("X", "z", 0, "core"), ("Y", "a", 0, "core")], "blueprint string, grp string, n int, role string")
    sites = spark.createDataFrame([("s", "X"), ("t", "Y"), ("u", "unknown"), ("v", None)], "node string, blueprint string")
    assert found(audits.empty_groups(sites, groups)) == {(x, "group expands to 0 nodes") for x in "tuv"}
    edges = spark.createDataFrame([("e1", "s", "t"), ("e2", "s", "s"), ("e3", "s", "u")], "edge_key string, u string, v string")
    counts = spark.createDataFrame([("e1", 0), ("e2", 3)], "edge_key string, n_links int")
    assert {k for k, _ in found(audits.empty_links(edges, counts))} == {"e1", "e3"}
    links = [("a", "a", "mesh"), ("b", "b", "mesh"), ("b", "b", "one_to_one"), ("a", "b", "mesh"), ("a", "z", "mesh"), ("a", "missing", "one_to_one"), ("a", "b", "2:1"), ("a", "b", "1:2"), ("a", "b", "0:1")]
    got = audits.empty_blueprint_links(groups, spark.createDataFrame([("X", *x) for x in links], "blueprint string, src_grp string, dst_grp string, pattern string"))
    want = [("b", "b", "mesh"), ("a", "z", "mesh"), ("a", "missing", "one_to_one"), ("a", "b", "1:2"), ("a", "b", "0:1")]
    assert found(got) == {("X", f"link expands to 0 links ({a} to {b}, {p})") for a, b, p in want}
