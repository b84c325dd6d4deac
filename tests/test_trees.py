"""Documents laid over others, against a merge in plain Python."""

from __future__ import annotations

import json
import random

import pytest

from meshloom.operators import trees
from meshloom.sources import library

DOC = "name string, text string"


def laid(base, over):
    if not isinstance(over, dict):
        return over
    out = dict(base) if isinstance(base, dict) else {}
    for k, v in over.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = laid(out.get(k), v)
    return out


def made(rng, depth: int):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        return rng.choice([None, True, 7, "a \"b\" \\ é\n", "", [1, {"x": None}], [], {}])
    return {rng.choice(["a", "b", "c.d", 'q"', "é", ""]): made(rng, depth - 1) for _ in range(3)}


def rows(df) -> dict:
    found = [(r.name, json.loads(r.text)) for r in df.collect()]
    assert len(found) == len({n for n, _ in found})
    return dict(found)


def test_overlay_of_random_documents(spark):
    rng = random.Random(4)
    base = {f"n{i}": made(rng, 4) if i else {} for i in range(40)}
    over = {f"n{i}": made(rng, 4) for i in range(20, 60)}
    frame = lambda d: spark.createDataFrame([(k, json.dumps(v)) for k, v in d.items()], DOC)
    want = {k: laid(base.get(k), over[k]) if k in over else base[k] for k in {**base, **over}}
    want = {k: v for k, v in want.items() if k not in over or over[k] is not None}
    assert rows(trees.merged(frame(base), frame(over), deep=True)) == want
    assert rows(trees.merged(frame(base), frame(over))) == {**base, **over}
    assert rows(trees.documents(trees.nodes(frame(base)))) == base


def test_odd_documents(spark):
    odd = spark.createDataFrame([(None, "{}"), ("n", None), ("bad", "{"), ("twice", '{"a":1}'), ("twice", '{"a":2}'), ("twice", '{"a":2}'), ("number", "12345678901234567890")], DOC)
    none = odd.limit(0)
    for deep in (False, True):
        assert rows(trees.merged(odd, none, deep)) == {"twice": {"a": 2}, "number": 12345678901234567890} == rows(trees.merged(none, odd, deep))
        assert rows(trees.merged(none, none, deep)) == {}


def test_users_definitions(spark, tmp_path):
    own = tmp_path / "failure_policies.yml"
    own.write_text("mine: {modes: []}\nsingle_random_link_failure: {attrs: {description: own}}\n")
    whole = rows(library.definitions(spark, "failure_policies", str(own)))
    assert set(whole) == {"empty", "mc_baseline", "mine", "single_random_link_failure"} and whole["single_random_link_failure"] == {"attrs": {"description": "own"}}
    deep = rows(library.definitions(spark, "failure_policies", str(own), deep=True))["single_random_link_failure"]
    assert deep["attrs"] == {"description": "own"} and deep["modes"][0]["rules"][0]["count"] == 1
    assert [s["step_type"] for s in rows(library.definitions(spark, "workflows"))["design_analysis_brief"]] == ["NetworkStats", "MaximumSupportedDemand", "TrafficMatrixPlacement", "CostPower"]
    for text in ("- a list\n", "a: {\n"):
        own.write_text(text)
        with pytest.raises(ValueError):
            library.definitions(spark, "failure_policies", str(own))
    own.write_text("")
    assert len(rows(library.definitions(spark, "failure_policies", str(own)))) == 3


def test_users_blueprints(spark, tmp_path):
    from meshloom.operators import expand

    own = tmp_path / "blueprints.yml"
    own.write_text(
        "Pair: {nodes: {edge: {count: 2, template: 'edge{n}', attrs: {role: edge}}}, links: [{source: /edge, target: /edge, pattern: mesh}]}\n"
        "SingleRouter: {nodes: {core: {count: 3, template: 'r{n}', attrs: {role: core}}}}\n"
    )
    groups, links = library.blueprint_tables(library.definitions(spark, "blueprints", str(own)))
    builtin, inner = expand.blueprint_tables(spark)
    fields = lambda df: sorted(map(tuple, df.collect()))
    assert fields(groups) == sorted([*(r for r in fields(builtin) if r[0] != "SingleRouter"), ("Pair", "edge", 2, "edge{n}", "edge"), ("SingleRouter", "core", 3, "r{n}", "core")])
    assert fields(links) == sorted([*fields(inner), ("Pair", "edge", "edge", "mesh")])
