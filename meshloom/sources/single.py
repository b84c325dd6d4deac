"""One document from tables of any size: fragments are made and sorted by Spark, and joined by copying.

Each row of a table becomes a fragment of text in a task; a range sort puts all fragments in
order, so every part file is a stretch of the document. The parts are then copied one after
another into one file, as a stream: nothing whole is held anywhere. Equal rows are equal
text, and ties are sorted by their text, so the same tables give the same bytes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.scenario import COMMENTS
from meshloom.session import shared_dir

FRAGMENT = "section int, key string, body string, place int, text string"


def _dump(x: object) -> str:
    return yaml.dump(x, Dumper=yaml.SafeDumper, sort_keys=False, default_flow_style=False, allow_unicode=True, width=float("inf"))


def _indented(text: str, by: int) -> str:
    return "\n".join(" " * by + line for line in text.splitlines())


def _rows(table: DataFrame, section: int, key: Column, make: Callable[[dict], str]) -> DataFrame:
    """Fragments of a table: ``make`` gives the text of a row, of which null columns are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            body = [make(json.loads(r)) for r in f["row"]]
            yield pd.DataFrame({"section": section, "key": f["key"], "body": body, "place": 1, "text": body})

    return table.select(key.cast("string").alias("key"), F.to_json(F.struct("*")).alias("row")).mapInPandas(run, FRAGMENT)


def _line(spark: SparkSession, section: int, text: str) -> DataFrame:
    """A fragment that begins a section."""
    return spark.createDataFrame([(section, "", "", 0, text)], FRAGMENT)


def write(spark: SparkSession, fragments: DataFrame, path: str) -> None:
    """The fragments in order, a line break after each, as one file at ``path``, which is there when it is whole."""
    folder = f"{shared_dir(spark).rstrip('/')}/fragments-{uuid.uuid4().hex}"
    fragments.orderBy("section", "key", "body", "place").select("text").write.text(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    made, source = place(f"{path}.making"), place(folder)
    fs, there = made.getFileSystem(conf), source.getFileSystem(conf)
    out = fs.create(made, True)
    try:
        for name in sorted(s.getPath().toString() for s in there.globStatus(place(f"{folder}/part-*"))):
            part = there.open(place(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    fs.delete(place(path), False)
    if not fs.rename(made, place(path)):
        raise OSError(f"cannot write {path}")
    there.delete(source, True)


def _plain(row: dict, *skip: str) -> dict:
    return {k: v for k, v in row.items() if k not in skip}


def scenario_yaml(tables: dict[str, DataFrame], path: str, seed: int = 42) -> None:
    """A scenario's tables ``groups``, ``links``, ``risks`` and ``demands`` as one YAML file: what ``to_yaml`` of ``document`` gives for tables in order.

    Groups are in order of path, links of source and target, risks of name, demands of their
    ends; a comment stands before the first link of a type.
    """
    spark = tables["groups"].sparkSession
    node = lambda r: _indented(_dump({r["path"]: {"blueprint": r.get("blueprint"), "attrs": _plain(r, "path", "blueprint")}}), 4)
    risk = lambda r: _dump([{"name": r["risk_group"], "attrs": {"distance_km": r.get("distance_km")}}]).rstrip("\n")
    ends = lambda *c: F.concat_ws("\x01", *c)
    links = _rows(tables["links"], 4, ends("source", "target"), lambda r: _indented(_dump([r]), 2))
    kinds = tables["links"].select(F.element_at("attrs", F.lit("link_type")).alias("kind"), ends("source", "target").alias("key"), F.to_json(F.struct("*")).alias("row"))
    first = kinds.where(F.col("kind").isin(*COMMENTS)).groupBy("kind").agg(F.min("key").alias("key"))

    def comment(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"section": 4, "key": f["key"], "body": "", "place": 0, "text": [f"  # {COMMENTS[k]}" for k in f["kind"]]})

    rows = {
        2: (tables["groups"], _rows(tables["groups"], 2, F.col("path"), node), "  nodes:", "  nodes: {}"),
        4: (tables["links"], links.unionByName(first.mapInPandas(comment, FRAGMENT)), "  links:", "  links: []"),
        6: (tables["risks"], _rows(tables["risks"], 6, F.col("risk_group"), risk), "risk_groups:", "risk_groups: []"),
        8: (
            tables["demands"], _rows(tables["demands"], 8, ends("source_path", "sink_path"), lambda r: _indented(_dump([r]), 2)),
            "traffic_matrix_set:\n  baseline_traffic_matrix:", "traffic_matrix_set:\n  baseline_traffic_matrix: []",
        ),
    }
    found = [_line(spark, 0, f"seed: {seed}\nnetwork:")]
    for section, (table, fragments, begins, empty) in rows.items():
        found += [_line(spark, section - 1, empty if table.isEmpty() else begins), fragments]
    write(spark, reduce(DataFrame.unionByName, found), path)


def graph_json(crs: str, tables: dict[str, DataFrame], path: str) -> None:
    """A graph's tables ``nodes``, ``edges`` and ``corridor_paths`` as the JSON document that :func:`meshloom.sources.graph_json.read` reads; one row a line, null fields left out."""
    spark = next(iter(tables.values())).sparkSession
    found = [_line(spark, 0, "{" + f'"target_crs": {json.dumps(crs)}')]
    for k, (name, table) in enumerate(tables.items()):
        text = table.select(F.to_json(F.struct("*")).alias("body")).groupBy("body").agg(F.count("*").cast("int").alias("n"))
        first = text.agg(F.min("body")).first()[0]
        joined = F.concat(F.when(F.col("body") == F.lit(first), F.lit("")).otherwise(F.lit(",")), F.array_join(F.array_repeat("body", F.col("n")), "\n,"))
        found += [
            _line(spark, 3 * k + 1, f', "{name}": ['),
            text.select(F.lit(3 * k + 2).alias("section"), F.lit("").alias("key"), "body", F.lit(1).alias("place"), joined.alias("text")),
            _line(spark, 3 * k + 3, "]"),
        ]
    found.append(_line(spark, 3 * len(tables) + 1, "}"))
    write(spark, reduce(DataFrame.unionByName, found), path)
