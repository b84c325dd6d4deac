"""The configuration file, settings of metros, the scenario's text, and values of odd form."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meshloom import config
from meshloom.functions import numeric
from meshloom.operators import audits, expand, scenario, settings, sites


@pytest.fixture
def file(tmp_path):
    def write(text: str) -> str:
        path = tmp_path / "c.yml"
        path.write_text(text)
        return str(path)

    return write


def test_defaults_and_given_values(spark, file):
    found = config.load(spark, file("clustering: {metro_clusters: '1_0'}\ntraffic: {priority_ratios: {'0': 0.5, 1: 0.5}, model: gravity}\nbuild: {build_defaults: {intra_metro_link: {capacity: '12_800', attrs: {a: b}}}}"))
    assert found["clustering"] == {**config.DEFAULTS["clustering"], "metro_clusters": 10}
    assert found["traffic"]["priority_ratios"] == {0: 0.5, 1: 0.5} and found["traffic"]["gravity"]["rounding_policy"] == "nearest"
    link = found["build"]["build_defaults"]["intra_metro_link"]
    assert (link["capacity"], link["cost"], link["attrs"], link["mode"]) == (12800, 1, {"a": "b"}, "mesh")
    assert config.resolve(None) == config.resolve({}) and config.resolve({})["corridors"]["k_nearest"] == 3


@pytest.mark.parametrize(
    "given, text",
    [
        ({"typo": 1}, "unknown keys: typo"), ({"traffic": {"gravity": {"delta": 1}}}, "traffic.gravity has unknown keys"), ({"traffic": []}, "has to be a mapping"),
        ({"clustering": {"metro_clusters": 0}}, "has to be positive"), ({"clustering": {"metro_clusters": "many"}}, "no whole number"), ({"traffic": {"gbps_per_mw": -1}}, "0 or more"),
        ({"traffic": {"model": "other"}}, "one of uniform"), ({"traffic": {"priority_ratios": {0: 0.5, 2: 0.5}}}, "classes 0, 1, 2"), ({"traffic": {"priority_ratios": {0: 0.5}}}, "add up to 1"),
        ({"traffic": {"flow_policy_config": {9: "x"}}}, "known classes"), ({"build": {"build_overrides": [{"pop_per_metro": 1}]}}, "mapping with metros"),
        ({"build": {"build_overrides": [{"metros": "a", "pops": 1}]}}, "unknown keys: pops"), ({"build": {"build_overrides": [{"metros": [1]}]}}, "have to be names"),
        ({"corridors": {"risk_groups": {"enabled": "yes"}}}, "true or false"), ({"traffic": {"hose": {"carve_top_k": 0}}}, "positive"), ({"output": {"formatting": {"yaml_anchors": 1}}}, "true or false"),
    ],
)
def test_errors(given, text):
    with pytest.raises(ValueError, match=text):
        config.resolve(given)


@pytest.mark.parametrize("text", ["", "a: [", "- 1", "just text"])
def test_files_that_are_no_configuration(spark, file, text):
    with pytest.raises(ValueError):
        config.load(spark, file(text))


def test_disabled_traffic_may_have_any_ratios():
    assert config.resolve({"traffic": {"enabled": False, "priority_ratios": {0: 0.2}}})["traffic"]["priority_ratios"] == {0: 0.2}


def test_settings_of_metros(spark):
    made = config.resolve({"build": {"build_overrides": [
        {"metros": ["New York, NY"], "pop_per_metro": 5, "intra_metro_link": {"capacity": "1_000", "attrs": {"x": "y"}}}, {"metros": "old-name", "dc_regions_per_metro": 0, "dc_to_pop_link": {"striping": {"width": 2}}},
    ]}})
    tables = config.build_tables(spark, made)
    m = spark.createDataFrame([(1, "new-york", "New York, NY--NJ"), (2, "renamed", "Old Name"), (3, "plain", None)], "metro_idx int, name string, name_orig string")
    got = {r.metro_idx: r for r in settings.metro_settings(m, tables).collect()}
    assert (got[1].pops, got[2].pops, got[2].dcs, got[3].pops, got[3].dcs, got[3].site_blueprint) == (5, 2, 0, 2, 2, "SingleRouter")
    links = {(r.metro_idx, r.family): r for r in settings.link_settings(m, tables).collect()}
    assert len(links) == 9 and links[1, "intra_metro_link"].capacity == 1000 and links[1, "intra_metro_link"].attrs == {"link_type": "intra_metro", "x": "y"}
    assert links[2, "dc_to_pop_link"].stripe_width == 2 and links[3, "dc_to_pop_link"].stripe_width is None and links[3, "inter_metro_link"].capacity == 100
    assert settings.unknown_overrides(m.where("metro_idx = 3"), tables["site_overrides"]).count() == 2
    assert settings.problems(settings.metro_settings(m, tables), settings.link_settings(m, tables)).count() == 0
    bad = settings.link_settings(m, tables).withColumn("cost", F.lit(0)).withColumn("capacity", F.lit(0))
    assert settings.problems(settings.metro_settings(m, tables).withColumn("pops", F.lit(0)), bad).count() == 3 + 9 + 3


def test_scenario_text_and_back(spark, tmp_path):
    share = {"link_type": "intra_metro"}
    doc = {
        "seed": 7, "network": {"nodes": {"metro1/pop[1-2]": {"blueprint": "B", "attrs": {"x": 1.5}}}, "links": [
            {"source": "a", "target": "b", "capacity": 10.0, "cost": 1, "attrs": share}, {"source": "b", "target": "c", "capacity": 20.0, "cost": 2, "attrs": share},
            {"source": "c", "target": "d", "capacity": 5.0, "cost": 3, "attrs": {"link_type": "inter_metro_corridor"}}]},
        "risk_groups": [{"name": "r", "attrs": {"distance_km": 3.0}}], "traffic_matrix_set": {"m": [{"source_path": "s", "sink_path": "t", "priority": 1, "demand": 2.5}], "none": []},
    }
    import yaml

    text = scenario.to_yaml(doc)
    assert yaml.safe_load(text) == doc and list(yaml.safe_load(text)) == list(doc)
    lines = [x for x in text.splitlines() if "#" in x]
    assert lines == ["  # Links within metros", "  # Links between metros, along corridors"]
    assert "&id" not in scenario.to_yaml({**doc, "risk_groups": [share, share]}, anchors=False) and "&id" in scenario.to_yaml({**doc, "risk_groups": [share, share]})
    path = tmp_path / "s.yml"
    path.write_text(text)
    tables = scenario.from_yaml(spark, str(path))
    assert [(r.source, r.capacity, r.attrs["link_type"]) for r in tables["links"].collect()] == [("a", 10.0, "intra_metro"), ("b", 20.0, "intra_metro"), ("c", 5.0, "inter_metro_corridor")]
    assert tables["groups"].first().attrs == {"x": "1.5"} and tables["demands"].first().matrix == "m" and tables["risks"].first().distance_km == 3.0
    path.write_text("- 1")
    with pytest.raises(ValueError):
        scenario.from_yaml(spark, str(path))


def test_sections(spark):
    assert scenario.workflow_section({"w": [1, 2]}, "w") == [1, 2]
    with pytest.raises(ValueError, match="known are w"):
        scenario.workflow_section({"w": []}, "other")
    groups = spark.createDataFrame([("B", "g", 1, "x{n}", None)], "blueprint string, grp string, n int, template string, role string")
    hw = spark.createDataFrame([("core", "C")], "role string, component string")
    for name in ("B", "unknown"):
        with pytest.raises(Exception, match="no role|unknown blueprint"):
            scenario.blueprint_section(groups, spark.createDataFrame([(name,)], "blueprint string"), hw).collect()


def test_values_of_odd_form(spark):
    rows = spark.createDataFrame([("12_800",), ("3200.9",), (" 7 ",), ("",), ("x",), (None,), ("-5",)], "t string")
    got = rows.select(numeric.whole_number(F.col("t")).alias("w"), F.isnan(numeric.float_or_nan(F.col("t"))).alias("n")).collect()
    assert [r.w for r in got] == [12800, 3200, 7, None, None, None, -5] and [r.n for r in got] == [True, False, False, True, True, True, False]


def test_stripes_by_attribute_in_natural_order(spark):
    named = spark.createDataFrame([("B", "g", "leaf10"), ("B", "g", "leaf2"), ("B", "h", "leaf1"), ("B", "i", "leaf3")], "blueprint string, grp string, device string")
    labels = spark.createDataFrame([("B", "g", "p1"), ("B", "h", "p2"), ("B", "i", None)], "blueprint string, grp string, label string")
    got = sorted((r.stripe, r.place, r.device) for r in sites.stripes_by_attribute(named, labels).collect())
    assert got == [("p1", 1, "leaf2"), ("p1", 2, "leaf10"), ("p2", 1, "leaf1")]
    striped = sites.stripes_by_attribute(named, labels).union(spark.createDataFrame([("D", "x1", 1, "p1")], "blueprint string, device string, place int, stripe string"))
    assert [(r.stripe, r.on) for r in sites.unmatched_stripes(striped, spark.createDataFrame([("q", "B", "D")], "pair string, left string, right string")).collect()] == [("p2", "left")]


def test_contract_and_failing_stages(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert audits.contract("t", df, "a int, b string").count() == 0
    assert sorted((r.key, r.message) for r in audits.contract("t", df, "a long, c string").collect()) == [("t.a", "int instead of bigint"), ("t.b", "not in the contract"), ("t.c", "missing")]
    got = audits.run_all(spark, {"ok": lambda: audits.no_groups(df), "bad": lambda: audits.issues(df.select(F.raise_error(F.lit("why")).alias("k")), "x", "k", "m")}).collect()
    assert [r.audit for r in got] == ["bad"] and got[0].key == "bad"


def test_optics_that_are_unknown_or_carry_nothing(spark):
    links = spark.createDataFrame([("e", "u", "v", 100.0)], "edge_key string, u string, v string, capacity double")
    roles = spark.createDataFrame([("u", "core"), ("v", "core")], "node string, role string")
    parts = spark.createDataFrame([("good", 40.0), ("none", 0.0)], "name string, capacity double")
    for optic, n in (("good", [3]), ("none", []), ("other", [])):
        rules = spark.createDataFrame([("core|core", optic)], "pair string, optic string")
        assert [r.n_modules for r in expand.assign_optics(links, roles, rules, parts).collect()] == n
        if n:
            assert expand.assign_optics(links, roles, rules, parts, check=True).count() == 1
        else:
            with pytest.raises(ValueError):
                expand.assign_optics(links, roles, rules, parts, check=True)


def test_rules_on_devices_and_conditions(spark):
    d = spark.createDataFrame([("m1/p1/g/leaf1", "m1/p1", "leaf"), ("m1/p1/g/leaf11", "m1/p1", "leaf"), ("m1/p2/g/leaf1", "m1/p2", "spine")], "name string, site string, role string")
    rules = spark.createDataFrame(
        [(1, "^m1/p1/[^/]+/leaf1$", "s", "a"), (2, "^m1/p1/[^/]+/leaf1$", "s", "b"), (0, "^m1/p1/[^/]+/leaf1$", "s", "c"), (3, "/p2/", "role", "core"), (4, "nothing", "s", "x")],
        "pos int, path string, attribute string, label string",
    )
    ruled = expand.apply_rules(d, rules)
    assert {r.name: r.attrs for r in ruled.collect()} == {"m1/p1/g/leaf1": {"role": "leaf", "s": "b"}, "m1/p1/g/leaf11": {"role": "leaf"}, "m1/p2/g/leaf1": {"role": "core"}}
    names = lambda *c, logic="or": sorted(r.name[3:] for r in ruled.where(expand.match(c, logic)).collect())
    assert names(("role", "==", "core"), ("s", "==", "b")) == ["p1/g/leaf1", "p2/g/leaf1"] and names(("role", "==", "leaf"), ("s", "==", "b"), logic="and") == ["p1/g/leaf1"]
    assert names(("s", "!=", "b")) == ["p1/g/leaf11", "p2/g/leaf1"] and len(names()) == 3
    with pytest.raises(ValueError):
        expand.match([("a", "~", "b")])


def test_whole_numbers_as_text():
    assert [config.whole(v, "x") for v in ("9007199254740993", "12_800", "3200.0", 7.9)] == [9007199254740993, 12800, 3200, 7]
    for bad in ("inf", "nan", "many", float("inf"), None):
        with pytest.raises(ValueError, match="x is no whole number"):
            config.whole(bad, "x")
