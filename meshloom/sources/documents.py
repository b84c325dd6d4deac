"""YAML and JSON documents as rows of JSON text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession


def _plain(text: str) -> str | None:
    """A document as JSON; None for what is no YAML."""
    try:
        return json.dumps(yaml.safe_load(text), default=str)
    except yaml.YAMLError:
        return None


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: each file at ``path`` as one row of JSON, read from YAML, of which JSON is a part; null for what is neither."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [_plain(c.decode("utf-8", "replace")) for c in f["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def one(spark: SparkSession, path: str) -> dict:
    """The mapping in one file."""
    row = read(spark, path).first()  # none of an empty file
    found = json.loads((row.text if row else None) or "null")
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no mapping")
    return found
