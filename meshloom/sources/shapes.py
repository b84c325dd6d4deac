"""Zipped shapefiles as DataFrames.

Files are read by Spark's binary reader, so any store that Spark reaches will do. An archive
can't be entered in its middle, so one task streams through it: it reads the attributes that
are asked for, drops records by them, and cuts what is left into runs of records, still as
bytes. The runs are dealt to all tasks and decoded there. Geometry is ``parts``: an array of
parts, each an array of ``(x, y)``. A row is known by the name of its archive and its record.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Collection, Iterator, Mapping, Sequence
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.numeric import albers

PARTS = "array<array<struct<x:double,y:double>>>"
#: Datum names of the two geographic systems that are taken (fixed values).
DATUMS = ("NORTH_AMERICAN_1983", "WGS_1984")


#: Records in a run, and bytes after which a run of large ones ends.
RUN, RUN_BYTES = 4096, 16 << 20


def _member(archive: zipfile.ZipFile, ending: str) -> str | None:
    return next((n for n in archive.namelist() if n.lower().endswith(ending)), None)


def check_crs(prj: str | None) -> None:
    """An error unless the system is geographic, on NAD83 or WGS84."""
    if not prj or not prj.strip():
        raise ValueError("shapefile has no coordinate reference system")
    if not prj.lstrip().upper().startswith("GEOGCS") or not any(d in prj.upper().replace(" ", "_") for d in DATUMS):
        raise ValueError("shapefile is not in geographic coordinates of NAD83 or WGS84")


def geometries(records: bytes) -> list[list[list[dict[str, float]]]]:
    """Parts of each record, of records one after another; none for an empty geometry. Points are parts of one vertex."""
    at, out = 0, []
    while at + 12 <= len(records):
        length = struct.unpack(">i", records[at + 4 : at + 8])[0] * 2
        body = records[at + 8 : at + 8 + length]
        at += 8 + length
        kind = struct.unpack("<i", body[:4])[0] % 10
        parts: list[np.ndarray] = []
        if kind == 1:
            parts = [np.frombuffer(body, "<f8", 2, 4).reshape(1, 2)]
        elif kind in (3, 5):
            n_parts, n_points = struct.unpack("<2i", body[36:44])
            starts = np.frombuffer(body, "<i4", n_parts, 44)
            xy = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
            parts = np.split(xy, starts[1:])
        out.append([[{"x": float(x), "y": float(y)} for x, y in p] for p in parts])
    return out


def attributes(dbf: BinaryIO, wanted: Sequence[str]) -> Iterator[dict[str, str | None]]:
    """The wanted attributes of each record, read as they come, as text, blank ones null; an error if one is missing."""
    n, head, size = struct.unpack("<IHH", dbf.read(12)[4:])
    rest = dbf.read(head - 12)
    fields, at, offset = {}, 20, 1
    while rest[at] != 0x0D:
        name, width = rest[at : at + 11].split(b"\0")[0].decode("ascii"), rest[at + 16]
        fields[name] = (offset, width)
        offset += width
        at += 32
    if missing := [c for c in wanted if c not in fields]:
        raise ValueError(f"shapefile lacks {', '.join(missing)}")
    for _ in range(n):
        row = dbf.read(size)
        yield {c: row[fields[c][0] : sum(fields[c])].decode("utf-8", "replace").strip() or None for c in wanted}


def runs(content: bytes, wanted: Sequence[str], keep: Mapping[str, Collection[str]], leave: Mapping[str, Collection[str]]) -> Iterator[tuple[list[int], list[dict], bytes]]:
    """``(records, attributes, bytes)`` of runs of an archive's records that have a value of ``keep`` and none of ``leave``."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        prj, shp, dbf = (_member(archive, e) for e in (".prj", ".shp", ".dbf"))
        if shp is None or dbf is None:
            raise ValueError("archive holds no shapefile")
        check_crs(None if prj is None else archive.read(prj).decode("utf-8", "replace"))
        with archive.open(shp) as shapes, archive.open(dbf) as table:
            shapes.read(100)
            numbers, rows, data, size = [], [], [], 0
            for number, row in enumerate(attributes(table, [*dict.fromkeys([*wanted, *keep, *leave])]), 1):
                head = shapes.read(8)
                if len(head) < 8:
                    break
                body = shapes.read(struct.unpack(">i", head[4:])[0] * 2)
                if all(row[c] in v for c, v in keep.items()) and not any(row[c] in v for c, v in leave.items()):
                    numbers.append(number)
                    rows.append(row)
                    data += [head, body]
                    size += len(body)
                if len(numbers) >= RUN or size >= RUN_BYTES:
                    yield numbers, rows, b"".join(data)
                    numbers, rows, data, size = [], [], [], 0
            if numbers:
                yield numbers, rows, b"".join(data)


def read(spark: SparkSession, path: str, columns: Sequence[str], keep: Mapping[str, Collection[str]] | None = None, leave: Mapping[str, Collection[str]] | None = None) -> DataFrame:
    """``columns`` (text), ``parts``, ``archive`` and ``record`` of all archives at ``path``; only these are decoded.

    ``keep`` and ``leave`` are values by attribute, with which records stay or go before their
    geometry is moved or decoded. Names of archives should differ, as rows are known by them.
    """
    wanted, kept, left = list(columns), {c: frozenset(v) for c, v in (keep or {}).items()}, {c: frozenset(v) for c, v in (leave or {}).items()}

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                for numbers, rows, data in runs(content, wanted, kept, left):
                    values = [json.dumps([row[c] for c in wanted]) for row in rows]
                    yield pd.DataFrame({"archive": [name.rsplit("/", 1)[-1]], "records": [numbers], "attributes": [values], "data": [data]})

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, numbers, values, data in zip(f["archive"], f["records"], f["attributes"], f["data"]):
                found = pd.DataFrame([json.loads(v) for v in values], columns=wanted, dtype=object)
                yield found.assign(parts=geometries(data), archive=name, record=np.asarray(numbers))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cuts = files.mapInPandas(cut, "archive string, records array<int>, attributes array<string>, data binary")
    dealt = cuts.repartition("archive", F.element_at("records", 1))
    return dealt.mapInPandas(decode, ", ".join([*(f"{c} string" for c in wanted), f"parts {PARTS}", "archive string", "record int"]))


def project(shapes: DataFrame) -> DataFrame:
    """``parts`` from degrees to projected metres, in Spark's own functions."""

    def point(p):
        x, y = albers(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return shapes.withColumn("parts", F.transform("parts", lambda part: F.transform(part, point)))


def roads(spark: SparkSession, path: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Road lines ``(line_id, mtfcc, parts)`` in projected metres, of some classes or of all; ids name the archive and the record."""
    rows = project(read(spark, path, ["MTFCC"], None if classes is None else {"MTFCC": classes}))
    return rows.select(F.concat_ws("#", "archive", "record").alias("line_id"), F.col("MTFCC").alias("mtfcc"), "parts")


def urban_areas(spark: SparkSession, path: str) -> DataFrame:
    """Urban areas ``(uac_code, name_orig, aland, parts)`` in degrees, as the boundary filter comes before projection."""
    rows = read(spark, path, ["UACE20", "NAME20", "ALAND20"])
    return rows.select(F.col("UACE20").alias("uac_code"), F.col("NAME20").alias("name_orig"), F.col("ALAND20").alias("aland"), "parts")


#: Codes of states and territories outside the conterminous area (fixed values).
OUTSIDE = ("02", "15", "60", "66", "69", "72", "78")


def states(spark: SparkSession, path: str, leave: Sequence[str] = OUTSIDE) -> DataFrame:
    """State boundaries ``(statefp, parts)`` without the codes in ``leave``."""
    return read(spark, path, ["STATEFP"], leave={"STATEFP": leave}).select(F.col("STATEFP").alias("statefp"), "parts")
