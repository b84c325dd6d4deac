"""Stages that are made again only if something that they depend on has changed.

A stage's key is a hash of the sections of the configuration that it names, of the content of
the files it reads, of the source code of its modules, and of the keys of the stages it
follows. The key is written once the stage's table is complete, so a run that was lost goes
on after the last whole stage, and a changed section makes again what follows from it.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Sequence
from types import ModuleType
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.config import at


class Stage(NamedTuple):
    """``make(spark, config, made)`` gives the table; ``sections`` and ``files`` are dotted names in the configuration."""

    name: str
    make: Callable[[SparkSession, dict, dict[str, DataFrame]], DataFrame]
    sections: Sequence[str] = ()
    files: Sequence[str] = ()
    after: Sequence[str] = ()
    code: Sequence[ModuleType] = ()


def content(spark: SparkSession, path: str) -> str:
    """Hash of the files at ``path``, whose content is hashed where it is read; one line a file reaches the driver."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha")).orderBy("path").collect()
    return _hash(*[r.sha for r in rows])


def _hash(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def key(spark: SparkSession, stage: Stage, config: dict, before: dict[str, str]) -> str:
    """The key of a stage, given those of the stages before it."""
    given = json.dumps([at(config, s) for s in stage.sections], sort_keys=True, default=str)
    return _hash(stage.name, given, *(content(spark, at(config, f)) for f in stage.files), *map(inspect.getsource, stage.code), *(before[a] for a in stage.after))


def _recorded(spark: SparkSession, place: str) -> str | None:
    """The key that was written with a whole table, if one was."""
    try:
        found = spark.read.schema("value string").text(place).head()
    except AnalysisException:
        return None
    return found.value if found else None


def _record(spark: SparkSession, place: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(place)


def run(spark: SparkSession, stages: Sequence[Stage], config: dict, folder: str, force: bool = False) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables of all stages, as written under ``folder``, and the names of those that were made; ``force`` makes all."""
    folder, made, keys, fresh = folder.rstrip("/"), {}, {}, []
    for stage in stages:
        keys[stage.name] = key(spark, stage, config, keys)
        path, place = f"{folder}/{stage.name}", f"{folder}/_stages/{stage.name}"
        if force or _recorded(spark, place) != keys[stage.name]:
            _record(spark, place, "")  # the table is not whole from here on
            stage.make(spark, config, made).write.mode("overwrite").parquet(path)
            _record(spark, place, keys[stage.name])
            fresh.append(stage.name)
        made[stage.name] = spark.read.parquet(path)
    return made, fresh
