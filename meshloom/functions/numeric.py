"""Column expressions for distances, grids, rounding and projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(value: Column, step: float) -> Column:
    """Grid cell of a coordinate; half-way values go to the even cell."""
    return F.rint(value / F.lit(step)).cast("long")


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Straight-line distance in the coordinates' unit."""
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def quantize_up(value: Column, quantum: float) -> Column:
    """The next multiple of ``quantum``; the value itself if the quantum is not positive."""
    return quantum * F.ceil(value / F.lit(quantum)) if quantum > 0 else value


def quantize(value: Column, step: float, policy: str = "nearest") -> Column:
    """A multiple of ``step``: the nearest (halves to even), the next, or the last."""
    steps = value / F.lit(step)
    return {"nearest": F.rint, "ceil": F.ceil, "floor": F.floor}[policy](steps).cast("double") * F.lit(step)


def half(value: Column, step: float) -> Column:
    """Half of a value, to multiples of half a step; to two decimals without a step."""
    part = step / 2
    return F.rint(value / 2 / F.lit(part)) * F.lit(part) if part > 0 else F.bround(value / 2, 2)


def ring_arc(n: Column, i: Column, j: Column, radius_km: Column, base_cost: Column) -> Column:
    """Whole kilometres along a ring of ``n`` places, the shorter way round; ``base_cost`` without a ring."""
    delta = F.pmod(F.abs(i - j), n)
    steps = F.least(delta, n - delta)
    arc = F.ceil(steps * (F.lit(2 * math.pi) * radius_km / n))
    return F.when((n <= 1) | (radius_km <= 0), base_cost).otherwise(arc).cast("long")


def detour(length: Column, straight: Column) -> Column:
    """Ratio of a path's length to the straight line; null if the latter is 0."""
    return F.when(straight > 0, length / straight)


def bearing_offset(bearing: Column, length: Column) -> tuple[Column, Column]:
    """East and north offsets of a compass bearing in degrees."""
    return length * F.sin(F.radians(bearing)), length * F.cos(F.radians(bearing))


# The Albers equal-area projection of the conterminous United States on GRS80.
A, E2 = 6378137.0, 0.006694380022903416
LAT0, LON0, LAT1, LAT2 = (math.radians(d) for d in (23.0, -96.0, 29.5, 45.5))


def _q(lat: float) -> float:
    e, s = math.sqrt(E2), math.sin(lat)
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Projected metres of a longitude and latitude in degrees (published closed form)."""
    m1, m2 = (math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2) for p in (LAT1, LAT2))
    n = (m1 * m1 - m2 * m2) / (_q(LAT2) - _q(LAT1))
    c = m1 * m1 + n * _q(LAT1)
    rho0 = A * math.sqrt(c - n * _q(LAT0)) / n
    e, s = math.sqrt(E2), F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = A * F.sqrt(c - n * q) / n, n * (F.radians(lon) - LON0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def thousands(value: Column, decimals: int = 2) -> Column:
    """A number as text with commas between thousands."""
    return F.format_number(value, decimals)


def whole_number(text: Column) -> Column:
    """A whole number from text such as ``12_800`` or ``3200.7``, decimals cut off; null for anything else."""
    return F.trim(F.replace(text.cast("string"), F.lit("_"))).try_cast("double").try_cast("long")


def float_or_nan(value: Column) -> Column:
    """A number, or NaN for null and for what is none."""
    return F.coalesce(value.try_cast("double"), F.lit(float("nan")))


def hardware(attrs: Column) -> tuple[Column, Column]:
    """Component and count of a node's ``hardware`` (JSON text): no component means null and 0, a count that is no number 1."""
    name = F.nullif(F.trim(F.get_json_object(attrs, "$.hardware.component")), F.lit(""))
    count = F.coalesce(F.get_json_object(attrs, "$.hardware.count").try_cast("double"), F.lit(1.0))
    return name, F.when(name.isNull(), F.lit(0.0)).otherwise(count)
