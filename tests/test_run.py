"""From zipped source files to corridors, by the command line."""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pytest
import yaml

from meshloom import config, run, stages
from meshloom.__main__ import main

PRJ = 'GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983"]]'


def archive(path, kind: int, columns: list[str], rows: list[tuple]) -> str:
    """A zipped shapefile of one-part lines (3) or polygons (5), by the published format."""
    shp, dbf = io.BytesIO(), io.BytesIO()
    shp.write(b"\0" * 100)
    for k, (_, points) in enumerate(rows):
        body = struct.pack("<i", kind) + struct.pack("<4d", 0, 0, 0, 0) + struct.pack("<2i", 1, len(points)) + struct.pack("<i", 0) + np.array(points, "<f8").tobytes()
        shp.write(struct.pack(">2i", k + 1, len(body) // 2) + body)
    dbf.write(struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 * len(columns) + 1, 1 + 20 * len(columns)))
    for c in columns:
        dbf.write(c.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20, 0]) + b"\0" * 14)
    dbf.write(b"\r")
    for values, _ in rows:
        dbf.write(b" " + b"".join(v.encode().ljust(20) for v in values))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.shp", shp.getvalue())
        z.writestr("a.dbf", dbf.getvalue())
        z.writestr("a.prj", PRJ)
    return str(path)


def square(x: float, y: float, half: float) -> list[tuple]:
    return [(x - half, y - half), (x - half, y + half), (x + half, y + half), (x + half, y - half), (x - half, y - half)]


def given_files(tmp_path) -> dict:
    """A configuration of three towns in reach and one beyond the boundary, and its files."""
    towns = {"Ash, KS": (-98.0, 38.0), "Beech Town": (-97.0, 38.0), "Cedar": (-97.0, 39.0), "Far": (-60.0, 38.0)}
    areas = [((f"{k:05d}", name, str(90_000_000 - k)), square(*at, 0.02)) for k, (name, at) in enumerate(towns.items())]
    line = lambda p, q: [(p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t) for t in np.linspace(0, 1, 9)]
    ash, beech, cedar = list(towns.values())[:3]
    lines = [(("S1100",), line(ash, beech)), (("S1200",), line(beech, cedar)), (("S1400",), line(ash, cedar))]
    return {
        "data_sources": {
            "tiger_roads": archive(tmp_path / "roads.zip", 3, ["MTFCC"], lines), "uac_polygons": archive(tmp_path / "areas.zip", 5, ["UACE20", "NAME20", "ALAND20"], areas),
            "conus_boundary": archive(tmp_path / "states.zip", 5, ["STATEFP"], [(("20",), square(-98.0, 38.0, 5.0)), (("02",), square(-60.0, 38.0, 5.0))]),
        },
        "clustering": {"metro_clusters": 3}, "corridors": {"k_nearest": 2},
    }


def test_build_and_info(spark, tmp_path, capsys):
    given = given_files(tmp_path)
    path, out = tmp_path / "config.yml", tmp_path / "out"
    path.write_text(yaml.safe_dump(given))
    assert main(["build", str(path), "-o", str(out)], spark) == 0
    found = {(r.metro_a, r.metro_b): r for r in spark.read.parquet(f"{out}/corridors").collect()}
    assert set(found) == {("00000", "00001"), ("00000", "00002"), ("00001", "00002")}
    # the third class of road isn't kept, so the way from Ash to Cedar is by Beech
    direct = [found["00000", "00001"].length_km, found["00001", "00002"].length_km]
    assert 80 < direct[0] < 95 and 105 < direct[1] < 118 and abs(found["00000", "00002"].length_km - sum(direct)) < 0.1
    names = {r.metro_id: (r.metro_idx, r.name) for r in spark.read.parquet(f"{out}/metros").collect()}
    assert names == {"00000": (1, "ash"), "00001": (2, "beech-town"), "00002": (3, "cedar")}
    assert spark.read.parquet(f"{out}/corridor_edges").count() >= 4 and "corridors: 3 rows" in capsys.readouterr().out
    assert main(["info", str(path)], spark) == 0 and yaml.safe_load(capsys.readouterr().out)["corridors"]["k_nearest"] == 2
    path.write_text(yaml.safe_dump({**given, "highway_processing": {"highway_classes": ["S9999"]}}))
    assert main(["build", str(path), "-o", str(out)], spark) == 1
    path.write_text(yaml.safe_dump({**given, "corridors": {"k_nearest": 1}}))
    capsys.readouterr()
    assert main(["build", str(path), "-o", str(out)], spark) == 0
    out_text = capsys.readouterr().out
    assert "metros: 3 rows, as they were" in out_text and "corridors: 1 rows\n" in out_text
    path.write_text("typo: 1")
    assert main(["build", str(path), "-o", str(out)], spark) == 2 and main(["info", str(tmp_path / "none.yml")], spark) == 2


def test_only_what_follows_from_a_change_is_made_again(spark, tmp_path, monkeypatch):
    given, out = config.resolve(given_files(tmp_path)), str(tmp_path / "out")
    monkeypatch.setattr(run, "STAGES", tuple(s._replace(make=lambda *a: spark.range(1)) for s in run.STAGES))  # only the order counts here
    every = [s.name for s in run.STAGES]
    assert run.build(spark, given, out)[1] == every and run.build(spark, given, out)[1] == []
    nearer = {**given, "corridors": {**given["corridors"], "k_nearest": 1}}
    assert run.build(spark, nearer, out)[1] == ["corridors", "corridor_edges"]
    areas = tmp_path / "areas.zip"
    areas.write_bytes(areas.read_bytes() + b" ")  # other content of one file
    assert run.build(spark, nearer, out)[1] == ["metros", "anchors", "corridors", "corridor_edges"]
    assert run.build(spark, nearer, out, force=True)[1] == every
    whole, lost = run.STAGES, tuple(s._replace(make=lambda *a: 1 / 0) if s.name == "corridors" else s for s in run.STAGES)
    monkeypatch.setattr(run, "STAGES", lost)
    with pytest.raises(ZeroDivisionError):
        run.build(spark, given, out)
    monkeypatch.setattr(run, "STAGES", whole)
    assert run.build(spark, given, out)[1] == ["corridors", "corridor_edges"]  # goes on after the last whole stage
    monkeypatch.setattr(stages.inspect, "getsource", lambda module: f"other {module.__name__}" if module is run.discover else "same")
    run.build(spark, given, out)
    monkeypatch.setattr(stages.inspect, "getsource", lambda module: "new" if module is run.discover else "same")
    assert run.build(spark, given, out)[1] == ["corridors", "corridor_edges"]


def test_batch(spark, tmp_path, capsys):
    given, configs, out = given_files(tmp_path), tmp_path / "configs", tmp_path / "all"
    configs.mkdir()
    (configs / "small_a.yml").write_text(yaml.safe_dump(given))
    (configs / "small_b.yaml").write_text("typo: 1")
    (configs / "large.yml").write_text(yaml.safe_dump({**given, "highway_processing": {"highway_classes": ["S9999"]}}))
    (configs / "notes.txt").write_text("no configuration")
    assert main(["batch", str(configs), str(out), "--exclude", "*_b*", "--include", "small_*"], spark) == 0
    assert capsys.readouterr().out == "small_a.yml: ok, made roads, metros, anchors, corridors, corridor_edges\n"
    assert main(["batch", str(configs), str(out)], spark) == 1
    lines = capsys.readouterr().out.splitlines()
    assert [x.split(",")[0] for x in lines] == ["large.yml: failed", "small_a.yml: ok", "small_b.yaml: config"] and lines[1].endswith("made nothing")
    assert main(["batch", str(tmp_path / "none"), str(out)], spark) == 1


def test_validate(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.yml").write_text("seed: 1\nnetwork: {nodes: {}}\n")
    (docs / "b.json").write_text('{"seed": "x"}')
    (docs / "c.yml").write_text("a: [1")
    rules = tmp_path / "rules.json"
    rules.write_text('{"type": "object", "required": ["network"], "properties": {"seed": {"type": "integer"}}}')
    assert main(["validate", str(docs), "--schema", str(rules)], spark) == 3
    lines = capsys.readouterr().out.splitlines()
    assert [x.split("/")[-1] for x in lines[:-1]] == ["b.json $ required: network is missing", "b.json $.seed type: not integer", "c.yml $ json: no JSON"] and lines[-1] == "3 issues"
    assert main(["validate", str(docs / "a.yml"), "--schema", str(rules)], spark) == 0
    assert main(["validate", str(docs), "--schema", str(docs / "none")], spark) == 1


def test_scenario(spark, tmp_path, capsys):
    given, out = given_files(tmp_path), tmp_path / "out"
    given |= {"traffic": {"model": "gravity", "mw_per_dc_region": 10.0, "gravity": {"exclude_same_metro": True}}, "build": {"build_overrides": [{"metros": "Ash", "pop_per_metro": 3, "site_blueprint": "FullMesh4"}]}}
    given["corridors"] = {"k_nearest": 2, "risk_groups": {"exclude_metro_radius_shared": False}}  # the roads have no node outside the towns
    path = tmp_path / "config.yml"
    path.write_text(yaml.safe_dump(given))
    assert main(["scenario", str(path), "-o", str(out)], spark) == 0 and capsys.readouterr().out.endswith("scenario.yml: 0 issues\n")
    doc = yaml.safe_load((out / "scenario.yml").read_text())
    names = {r.metro_id: r.metro_idx for r in spark.read.parquet(f"{out}/metros").collect()}
    ash, beech, cedar = names["00000"], names["00001"], names["00002"]
    nodes = doc["network"]["nodes"]
    assert set(nodes) == {f"metro{ash}/pop[1-3]", *(f"metro{k}/pop[1-2]" for k in (beech, cedar)), *(f"metro{k}/dc[1-2]" for k in (ash, beech, cedar))}
    assert nodes[f"metro{ash}/pop[1-3]"]["blueprint"] == "FullMesh4" and nodes[f"metro{cedar}/dc[1-2]"]["attrs"]["mw_per_dc_region"] == 10.0
    links = {}
    for x in doc["network"]["links"]:
        links.setdefault(x["attrs"]["link_type"], []).append(x)
    # pairs within metros 3 + 1 + 1; data centres to sites 6 + 4 + 4; between metros 6 + 6 + 4
    assert {k: len(v) for k, v in links.items()} == {"intra_metro": 5, "dc_to_pop": 14, "inter_metro_corridor": 16}
    inner = [x["capacity"] for x in links["intra_metro"] if x["source"].startswith(f"metro{ash}/")]
    assert inner == [100.0] * 3 and {x["capacity"] for x in links["inter_metro_corridor"]} == {25.0, 100.0}  # over four device links, or one
    demands = doc["traffic_matrix_set"]["baseline_traffic_matrix"]
    assert len(demands) == 12 * 2 * 3 and abs(sum(x["demand"] for x in demands) - 6 * 10 * 1000) < 0.5  # each is in hundredths
    assert {r["name"] for r in doc["risk_groups"]} and all(r["attrs"]["distance_km"] > 80 for r in doc["risk_groups"])
    before = (out / "scenario.yml").read_bytes()
    assert main(["scenario", str(path), "-o", str(out)], spark) == 0 and (out / "scenario.yml").read_bytes() == before
    path.write_text(yaml.safe_dump({**given, "traffic": {"gbps_per_mw": 0.0}}))
    capsys.readouterr()
    assert main(["scenario", str(path), "-o", str(out)], spark) == 3 and "matrix default: empty although traffic is enabled" in capsys.readouterr().out
