"""Rounding and small arithmetic with the engine's conventions: halves round up, guards instead of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity, as a bigint."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def round_to(x: Column, digits: int) -> Column:
    m = float(10**digits)
    return F.floor(x * F.lit(m) + F.lit(0.5)).cast("double") / F.lit(m)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def smoothstep(a: Column, b: Column, v: Column) -> Column:
    t = clamp((v - a) / F.greatest(F.lit(1e-6), b - a), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a bounded fold; 64 steps are enough for any pair of bigints below 10^12."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s["a"])


def file_size(n: Column) -> Column:
    """Bytes in words: 0 B, 512 B, 1.5 KB; one figure after the point above bytes, at most gigabytes."""
    unit = F.least(F.lit(3), F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1024.0))).cast("int"))
    value = n / F.pow(F.lit(1024.0), unit)
    tenth = round_to(value, 1)
    whole = half_up(value).cast("string")
    shown = F.when(unit == 0, whole).when(tenth == F.floor(tenth), F.floor(tenth).cast("string")).otherwise(F.format_string("%.1f", tenth))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").otherwise(F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1)))
