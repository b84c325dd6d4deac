"""Column expressions for names, identifiers and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest sanitized name.
NAME_LENGTH = 30


def sanitize(name: Column) -> Column:
    """A display name as an identifier: up to the first comma, lower case, hyphens for blanks, 30 characters."""
    head = F.lower(F.element_at(F.split(name, ","), 1))
    hyphened = F.regexp_replace(head, r"[\s-]+", "-")
    plain = F.regexp_replace(F.regexp_replace(hyphened, r"[^a-z0-9-]", ""), r"-+", "-")
    return F.substring(F.regexp_replace(plain, r"^-+|-+$", ""), 1, NAME_LENGTH)


def metro_slug(name: Column) -> Column:
    """:func:`sanitize` of anything castable to a string, blanks around it ignored."""
    return sanitize(F.regexp_replace(name.cast("string"), r"^\s+|\s+$", ""))


def path_slug(name: Column) -> Column:
    """The looser slug of traffic paths: lower case, hyphens for spaces."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def site_id(metro_idx: Column, kind: Column, ordinal: Column) -> Column:
    """``metro3/pop2``."""
    return F.concat(F.lit("metro"), metro_idx, F.lit("/"), kind, ordinal)


def metro_index(endpoint: Column) -> Column:
    """Metro number at the start of a demand's endpoint pattern, or null."""
    return F.nullif(F.regexp_extract(endpoint, r"^\^*metro([0-9]+)", 1), F.lit("")).try_cast("int")


def dc_key(endpoint: Column) -> Column:
    """``metro3/dc1`` found anywhere in an endpoint, numbers without leading zeros, or null."""
    metro = F.nullif(F.regexp_extract(endpoint, r"metro([0-9]+)/dc([0-9]+)", 1), F.lit("")).try_cast("int")
    dc = F.nullif(F.regexp_extract(endpoint, r"metro([0-9]+)/dc([0-9]+)", 2), F.lit("")).try_cast("int")
    return F.when(metro.isNotNull(), F.concat(F.lit("metro"), metro, F.lit("/dc"), dc))


def risk_group(a: Column, b: Column, path_index: Column, prefix: str = "corridor_risk") -> Column:
    """Name of a metro pair's shared-risk group; alternative paths are numbered."""
    base = F.concat_ws("_", F.lit(prefix), F.least(a, b), F.greatest(a, b))
    return F.when(path_index > 0, F.concat(base, F.lit("_path"), path_index)).otherwise(base)


def segment_id(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Identifier of a segment from its rounded ends, the smaller end first."""
    ends = [F.struct(F.rint(x).cast("long").alias("x"), F.rint(y).cast("long").alias("y")) for x, y in ((ax, ay), (bx, by))]
    first, last = F.least(*ends), F.greatest(*ends)
    return F.concat_ws("_", first["x"], first["y"], F.lit(""), last["x"], last["y"])


def natural_prefix(name: Column) -> Column:
    """All characters of a device name that are no digits."""
    return F.regexp_replace(name, "[0-9]", "")


def natural_number(name: Column) -> Column:
    """All digits of a device name as a number, 0 if there are none."""
    return F.coalesce(F.nullif(F.regexp_replace(name, "[^0-9]", ""), F.lit("")).try_cast("long"), F.lit(0))


def roles(role_pairs: Column) -> Column:
    """Distinct roles of an array of ``a|b`` pairs, sorted; blank parts are ignored."""
    parts = F.flatten(F.transform(role_pairs, lambda p: F.split(p, r"\|")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, F.trim), lambda r: r != "")))
