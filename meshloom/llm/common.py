"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.session import shared_dir

#: Characters that separate words, as a Java and DuckDB character class.
SPACE = r"\x20\x09-\x0D"
#: Folders that have been written and not discarded, in order.
written: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Files in the shared folder outlive executors, and are compressed and columnar,
    so they take less room than a checkpoint of rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that :func:`materialize` has written, for use where nothing reads them any more."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        written.remove(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder; Spark's cleaner removes it when unused."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lowest(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """A sample of at most ``n`` rows that differ in ``columns``: those of lowest hash.

    Hashes alone are gathered to find the highest that is in; each task then keeps its rows
    below it, so that what a task holds is in proportion to the sample.
    """
    hashed = df.withColumn("_h", F.xxhash64(*columns))
    top = hashed.select("_h").distinct().orderBy("_h").limit(n).agg(F.max("_h")).first()[0]
    return hashed.where(F.col("_h") <= F.lit(top).cast("long")).dropDuplicates(["_h"]).drop("_h")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable node of every node that occurs in ``edges``.

    Returns ``(node, root)``. Alternates large-star and small-star steps, each a
    pre-aggregated minimum and an equi-join (so a hub's rows can be split), until
    the edges are stars. Self-loops are ignored; no edges give an empty table.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    pairs = checkpoint(pairs.distinct())
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))
        )
        pairs = checkpoint(small.distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
