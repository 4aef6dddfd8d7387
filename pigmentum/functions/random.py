"""A seeded 32-bit generator as bit arithmetic on bigints: equal seeds give equal numbers everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK).cast("bigint"))


def _times(a: Column, b: Column) -> Column:
    """Product modulo 2^32 of two numbers below 2^32, in halves so that nothing overflows."""
    high = _low(a * F.shiftright(b, 16))
    return _low(a * b.bitwiseAND(F.lit(0xFFFF).cast("bigint")) + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF).cast("bigint")), 16))


def uniform(seed: Column, n: int = 1) -> Column:
    """The n-th number in [0, 1) of the mulberry32 generator from a seed."""
    a = _low(seed.cast("bigint") + F.lit(0x6D2B79F5 * n & MASK))
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("bigint")))
    t = _low(t.bitwiseXOR(_low(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("bigint"))))))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(2.0**32)
