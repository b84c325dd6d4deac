"""What operators need of the session: the shared folder, checkpoints and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where it is unset, one in the warehouse."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder: ends the lineage of a loop, and outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, if it has the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def not_empty(df: DataFrame, message: str) -> DataFrame:
    """``df``, if it has a row; an action, so that plans stay lazy where it isn't asked for."""
    if df.isEmpty():
        raise ValueError(message)
    return df
