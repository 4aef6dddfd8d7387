"""Timeline arithmetic: ticks, snapping and drags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import clamp, round_to

SNAP = 0.05


def tick_step(duration: Column, short: float = 10.0, middle: float = 30.0) -> Column:
    return F.when(duration < short, 0.5).when(duration < middle, 1.0).otherwise(2.0)


def ticks(duration: Column, step: Column) -> Column:
    """Numbers of the ticks from 0 to the end."""
    return F.sequence(F.lit(0).cast("bigint"), F.floor(duration / step).cast("bigint"))


def snap(t: Column) -> Column:
    return round_to(t / SNAP, 0) * SNAP


def drag(t_in: Column, t_out: Column, edge: str, delta: Column, start: Column, end: Column, least: float = 0.1) -> Column:
    """struct(t_in, t_out) after a drag of an edge or of both, inside the scene and at least `least` long."""
    if edge == "in":
        return F.struct(clamp(snap(t_in + delta), start, t_out - least).alias("t_in"), t_out.alias("t_out"))
    if edge == "out":
        return F.struct(t_in.alias("t_in"), clamp(snap(t_out + delta), t_in + least, end).alias("t_out"))
    d = clamp(snap(delta), start - t_in, end - t_out)
    return F.struct((t_in + d).alias("t_in"), (t_out + d).alias("t_out"))
