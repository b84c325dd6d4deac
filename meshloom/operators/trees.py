"""Nested documents as tables of nodes, documents laid over others by path, and documents from nodes.

Documents are ``(name, text)``, text being JSON. A node is ``(name, path, value)``: an array of
keys from the document down to it, and its JSON; null for a mapping, whose entries are nodes
of their own. Lists are values. A null name or text, and text that isn't JSON, is no document;
of several documents of one name the last by text counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.session import cut


def nodes(documents: DataFrame) -> DataFrame:
    """All nodes of all documents; one round, without a shuffle, for each level of nesting."""
    last = documents.where("name IS NOT NULL").withColumn("v", F.try_parse_json("text")).where("v IS NOT NULL").groupBy("name").agg(F.max("text").alias("text"))
    front = last.select("name", F.array().cast("array<string>").alias("path"), F.parse_json("text").alias("v"))
    found = None
    while True:
        mapping = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
        level = cut(front.select("name", "path", F.when(~mapping, F.coalesce(F.to_json("v"), F.lit("null"))).alias("value"), F.when(mapping, F.col("v").cast("map<string,variant>")).alias("entries")))
        found = level.select("name", "path", "value") if found is None else found.unionByName(level.select("name", "path", "value"))
        below = level.where("entries IS NOT NULL").select("name", "path", F.explode("entries").alias("k", "v"))
        front = below.select("name", F.concat("path", F.array("k")).alias("path"), "v")
        if front.isEmpty():
            return found


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """Nodes of documents with those of others of the same name laid over them by path.

    A mapping over a mapping adds its entries; anything else takes the place of all at and
    below its path; null takes it away, and makes no node. Names of either side alone stay.
    """
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda i: F.slice("path", 1, i))).alias("at")
    seen = base.select("name", "path", above).join(over.select("name", F.col("path").alias("at"), F.col("value").alias("by")), ["name", "at"])
    covered = seen.where("by IS NOT NULL OR at = path").select("name", "path").distinct()
    return base.join(covered, ["name", "path"], "left_anti").unionByName(over.where("value IS NULL OR value <> 'null'"))


def documents(found: DataFrame) -> DataFrame:
    """``(name, text)`` of documents from their nodes, keys in order; an aggregate for each level, from the deepest up."""
    found = cut(found.withColumn("depth", F.size("path")))
    deepest = found.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = found.where(F.col("depth") == depth).drop("depth")
        inner = F.lit(None).cast("string")
        if below is not None:
            level, inner = level.join(below, ["name", "path"], "left"), F.col("inner")
        level = level.select("name", "path", F.coalesce("value", F.concat(F.lit("{"), F.coalesce(inner, F.lit("")), F.lit("}"))).alias("text"))
        quoted = F.regexp_extract(F.to_json(F.array(F.element_at("path", -1))), r"(?s)^\[(.*)\]$", 1)
        entry = F.struct(F.element_at("path", -1).alias("k"), F.concat(quoted, F.lit(":"), "text").alias("e"))
        if depth:
            each = level.select("name", F.slice("path", 1, depth - 1).alias("path"), entry.alias("entry")).groupBy("name", "path")
            below = each.agg(F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["e"]), ",").alias("inner"))
    return level.select("name", "text") if deepest is not None else found.select("name", F.col("value").alias("text"))


def merged(base: DataFrame, over: DataFrame, deep: bool = False) -> DataFrame:
    """Documents with others over them: whole documents of the same name, or with ``deep`` their nodes by path."""
    if deep:
        return documents(overlay(nodes(base), nodes(over)))
    last = lambda df: df.where("name IS NOT NULL AND try_parse_json(text) IS NOT NULL").groupBy("name").agg(F.max("text").alias("text"))
    own = cut(last(over))
    return own.unionByName(last(base).join(own, "name", "left_anti"))
