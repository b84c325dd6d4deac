"""Readers, writers, libraries, polygons, the scenario's document and the stream."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest

from meshloom.functions import polygon
from meshloom.operators import scenario
from meshloom.sources import graph_json, library, shapes, single
from meshloom.streaming import events

PRJ = 'GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983"]]'


def archive(path, rows, column, prj=PRJ):
    """A zipped shapefile of polylines, by the published format."""
    shp, dbf = io.BytesIO(), io.BytesIO()
    shp.write(b"\0" * 100)
    for k, (_, parts) in enumerate(rows):
        points = [p for part in parts for p in part]
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
        body = struct.pack("<i", 3) + struct.pack("<4d", 0, 0, 0, 0) + struct.pack("<2i", len(parts), len(points)) + starts.astype("<i4").tobytes() + np.array(points, "<f8").tobytes() if points else struct.pack("<i", 0)
        shp.write(struct.pack(">2i", k + 1, len(body) // 2) + body)
    dbf.write(struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 + 1, 1 + 10))
    dbf.write(column.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14 + b"\r")
    for value, _ in rows:
        dbf.write(b" " + value.encode().ljust(10))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.shp", shp.getvalue())
        z.writestr("a.dbf", dbf.getvalue())
        if prj is not None:
            z.writestr("a.prj", prj)


def test_shapefile(spark, tmp_path):
    f = tmp_path / "roads.zip"
    archive(f, [("S1100", [[(-96.0, 23.0), (-96.0, 24.0)]]), ("S1200", [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]]), ("", [])], "MTFCC")
    rows = shapes.read(spark, str(f), ["MTFCC"]).orderBy("record").collect()
    assert [(r.MTFCC, len(r.parts), r.archive, r.record) for r in rows] == [("S1100", 1, "roads.zip", 1), ("S1200", 2, "roads.zip", 2), (None, 0, "roads.zip", 3)]
    first = shapes.roads(spark, str(f), ["S1100"]).first()
    assert first.line_id == "roads.zip#1" and [r.line_id for r in shapes.roads(spark, str(f), ["S1200"]).collect()] == ["roads.zip#2"]
    assert abs(first.parts[0][0].x) < 1e-6 and abs(first.parts[0][0].y) < 1e-6 and first.parts[0][1].y == pytest.approx(110_000, rel=0.02)


@pytest.mark.parametrize("prj", [None, "", 'PROJCS["x"]'])
def test_shapefile_needs_a_geographic_system(spark, tmp_path, prj):
    f = tmp_path / "x.zip"
    archive(f, [("a", [[(0.0, 0.0), (1.0, 1.0)]])], "MTFCC", prj)
    with pytest.raises(Exception, match="shapefile"):
        shapes.read(spark, str(f), ["MTFCC"]).collect()


def test_missing_attribute(spark, tmp_path):
    f = tmp_path / "y.zip"
    archive(f, [("a", [[(0.0, 0.0), (1.0, 1.0)]])], "OTHER")
    with pytest.raises(Exception, match="MTFCC"):
        shapes.read(spark, str(f), ["MTFCC"]).collect()


def test_one_archive_is_decoded_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shapes, "RUN", 7)
    f = tmp_path / "many.zip"
    lines = [[[(float(k), 0.0), (float(k), 1.0)], [(0.0, 0.0), (1.0, float(k))]] for k in range(100)]
    archive(f, [("AB"[k % 2], line) for k, line in enumerate(lines)], "KIND")
    content = f.read_bytes()
    cut = list(shapes.runs(content, ["KIND"], {"KIND": {"A"}}, {}))
    assert [len(n) for n, _, _ in cut] == [7] * 7 + [1] and [n for x, _, _ in cut for n in x] == list(range(1, 101, 2))
    assert [p for _, _, data in cut for p in shapes.geometries(data)] == [[[{"x": x, "y": y} for x, y in part] for part in line] for line in lines[::2]]
    assert list(shapes.runs(content, [], {}, {"KIND": {"A", "B"}})) == []
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(shapes.read(spark, str(f), ["KIND"])._jdf.queryExecution(), "simple")
    assert "hashpartitioning(archive" in plan and plan.count("MapInPandas") == 2


SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)


def test_polygons():
    hole = SQUARE / 2 + 1
    assert polygon.contains([SQUARE, hole], 0.5, 0.5) and not polygon.contains([SQUARE, hole], 2, 2)
    x, y = polygon.interior_point([SQUARE, hole])
    assert polygon.contains([SQUARE, hole], x, y) and polygon.interior_point([]) is None
    assert polygon.intersects([SQUARE], [SQUARE + 3]) and polygon.intersects([SQUARE], [hole]) and not polygon.intersects([SQUARE], [SQUARE + 5])
    cross = np.array([(-1, 1), (5, 1), (5, 2), (-1, 2)], float)
    assert polygon.intersects([SQUARE], [cross])


def test_graph_document(spark, tmp_path):
    doc = {
        "target_crs": "EPSG:5070",
        "nodes": [{"id": [1.0, 2.0], "node_type": "metro", "metro_id": "01", "name": "a", "radius_km": 3.0, "x": 1.0, "y": 2.0}, {"id": [5.0, 5.0]}],
        "edges": [{"source": [1.0, 2.0], "target": [5.0, 5.0], "length_km": 7.5, "risk_groups": ["r"]}],
        "corridor_paths": [{"metro_a": "2", "metro_b": "1", "path_index": 0}, {"metro_a": "2"}],
    }
    f = tmp_path / "g.json"
    f.write_text(json.dumps(doc, indent=2))
    g = graph_json.read(spark, str(f))
    assert g["crs"].first()[0] == "EPSG:5070" and g["nodes"].count() == 2 and g["edges"].first().risk_groups == ["r"]
    [p] = g["paths"].collect()
    assert (p.metro_a, p.metro_b, p.length_km, p.segment_ids) == ("1", "2", 0.0, [])
    assert [tuple(r) for r in graph_json.metro_rows(g["nodes"]).collect()] == [("01", "a", None, 1.0, 2.0, 3.0)]
    graph_json.write({"nodes": g["nodes"]}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).count() == 2


def test_library_overlay(spark, tmp_path):
    f = tmp_path / "components.yml"
    f.write_text("CoreRouter: {component_type: chassis, capacity: 1, ports: 2}\nMine: {component_type: optic}\n")
    both = {r.name: r for r in library.components(spark, str(f)).collect()}
    assert len(both) == len(library.COMPONENTS) + 1 and both["CoreRouter"].capacity == 1.0
    f.write_text("- a\n- b\n")
    with pytest.raises(ValueError):
        library.components(spark, str(f))
    used = spark.createDataFrame([("Mine",)], "name string")
    with pytest.raises(ValueError):
        library.referenced(library.components(spark), used, check=True)


def test_document_refuses_large_tables(spark):
    with pytest.raises(ValueError):
        scenario.document({"groups": spark.range(5)}, most=3)


def test_stream_closes_windows_as_batch_counts(spark, data, tmp_path):
    batch = {(r.start, r.event_type): r.n for r in events.windowed(spark.read.parquet(f"{data}/events.parquet")).collect()}
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    events.run(events.windowed(events.read(spark, str(tmp_path / "in"))), out, str(tmp_path / "c")).awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(out).collect()}
    assert got and all(batch[k] == n for k, n in got.items()) and len(got) >= len(batch) - 20


def test_site_graph_keeps_parallel_edges(spark, tmp_path):
    nodes = spark.createDataFrame([("metro1/pop1", "pop", 1.5), ("metro1/pop2", "pop", 2.5)], "node string, kind string, x double")
    edges = spark.createDataFrame([("metro1/pop1", "metro1/pop2", "k1", 1), ("metro1/pop1", "metro1/pop2", "k2", 2)], "u string, v string, edge_key string, cost int")
    graph_json.write(graph_json.site_tables(nodes, edges), str(tmp_path / "g"))
    lines = [json.loads(x) for f in (tmp_path / "g" / "edges").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted((r["source"], r["target"], r["key"], r["cost"]) for r in lines) == [("metro1/pop1", "metro1/pop2", "k1", 1), ("metro1/pop1", "metro1/pop2", "k2", 2)]
    assert {r.id for r in spark.read.json(str(tmp_path / "g" / "nodes")).collect()} == {"metro1/pop1", "metro1/pop2"}


def scenario_tables(spark, n=3):
    kinds = ["intra_metro", "dc_to_pop", "inter_metro_corridor", "other"]
    links = [(f"metro{k:03d}/pop1", f"metro{k + 1:03d}/pop{j}", 100.0 / (j + 1), k, {"link_type": kinds[(k + j) % 4], "note": "a long text, with words " * 6}) for k in range(n) for j in range(4)]
    return {
        "groups": spark.createDataFrame([(f"metro{k:03d}/pop[1-2]", "FullMesh4", "pop", f"town {k}: é", None if k % 2 else 7.5) for k in range(n)], "path string, blueprint string, node_type string, metro_name string, mw double"),
        "links": spark.createDataFrame(links, "source string, target string, capacity double, cost long, attrs map<string,string>"),
        "risks": spark.createDataFrame([(f"r{k}", 1.5 * k) for k in range(n)], "risk_group string, distance_km double"),
        "demands": spark.createDataFrame([(f"^metro{k:03d}/dc1/.*", f"^metro{k + 1:03d}/dc1/.*", k % 3, 10.0 + k) for k in range(n)], "source_path string, sink_path string, priority int, demand double"),
    }


@pytest.mark.parametrize("n", [0, 3, 60])
def test_one_yaml_file_from_sorted_fragments(spark, tmp_path, n):
    tables = scenario_tables(spark, n)
    order = {"groups": ["path"], "links": ["source", "target"], "risks": ["risk_group"], "demands": ["source_path", "sink_path"]}
    want = scenario.to_yaml(scenario.document({k: t.orderBy(*order[k]) for k, t in tables.items()}))
    for k in range(2):  # the same bytes however rows are dealt, and over an earlier file
        path = tmp_path / "scenario.yml"
        single.scenario_yaml({k_: t.repartition(5 - 3 * k) for k_, t in tables.items()}, str(path))
        assert path.read_text() == want and [p.name for p in tmp_path.glob("scenario*")] == ["scenario.yml"]
    assert scenario.from_yaml(spark, str(path))["links"].count() == 4 * n


def test_one_graph_document(spark, tmp_path):
    nodes = spark.createDataFrame([([1.0, float(k)], "metro", f"{k:02d}", "n") for k in range(9)] + [([0.5, 0.5], None, None, None)] * 3, "id array<double>, node_type string, metro_id string, name string")
    edges = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], 7.5, ["r"])] * 2, "source array<double>, target array<double>, length_km double, risk_groups array<string>")
    none = spark.createDataFrame([], graph_json.PATH)
    path = str(tmp_path / "graph.json")
    single.graph_json("EPSG:5070", {"nodes": nodes.repartition(4), "edges": edges, "corridor_paths": none}, path)
    text = open(path).read()
    doc = json.loads(text)
    assert len(doc["nodes"]) == 12 and len(doc["edges"]) == 2 and doc["corridor_paths"] == [] and doc["target_crs"] == "EPSG:5070"
    single.graph_json("EPSG:5070", {"nodes": nodes.repartition(2), "edges": edges, "corridor_paths": none}, path)
    assert open(path).read() == text
    back = graph_json.read(spark, path)
    assert back["nodes"].count() == 12 and back["edges"].first().risk_groups == ["r"] and back["paths"].count() == 0
