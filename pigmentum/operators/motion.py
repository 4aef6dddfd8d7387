"""Layer motion: arrays of keys struct(t, dx, dy, scale, opacity), their state at a time, and edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.easing import ease_any
from ..functions.numeric import round_to

#: A layer's state without motion.
REST = {"dx": 0.0, "dy": 0.0, "scale": 1.0, "opacity": 1.0}
FIELDS = tuple(REST)


def state_at(keys: Column, t: Column, easing: Column | None = None) -> Column:
    """struct(dx, dy, scale, opacity): before the first key its state, after the last its state, eased in between; at rest without keys."""
    before = F.try_element_at(F.filter(keys, lambda k: k["t"] <= t), F.lit(-1))
    after = F.get(F.filter(keys, lambda k: k["t"] > t), 0)
    share = (t - before["t"]) / F.greatest(F.lit(1e-6), after["t"] - before["t"])
    share = ease_any(easing, share) if easing is not None else F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    value = lambda f: F.coalesce(F.when(before.isNull(), after[f]).when(after.isNull(), before[f]).otherwise(before[f] + (after[f] - before[f]) * share), F.lit(REST[f]))
    return F.struct(*(value(f).alias(f) for f in FIELDS))


def _moved(k: Column, delta: float) -> Column:
    return k.withField("t", round_to(k["t"] + delta, 3))


def retime(t_in: Column, t_out: Column, keys: Column, edge: str, delta: float) -> Column:
    """struct(t_in, t_out, keys) with the in edge, the out edge or both moved; keys before the middle belong to the entrance."""
    mid = (t_in + t_out) / 2
    moves = lambda k: F.when(k["t"] < mid, edge != "out").otherwise(edge != "in")
    new_in, new_out = t_in + (0.0 if edge == "out" else delta), t_out + (0.0 if edge == "in" else delta)
    return F.struct(round_to(new_in, 3).alias("t_in"), round_to(new_out, 3).alias("t_out"), F.transform(keys, lambda k: F.when(moves(k), _moved(k, delta)).otherwise(k)).alias("keys"))


def apply_preset(t_in: Column, t_out: Column, entrance: str, duration: float, distance: float, fade_out: bool = False, out_duration: float = 0.3) -> Column:
    """Keys of an animation preset: the entrance is centred on t_in, a fading exit on t_out."""
    shift = {"slide-up": (0.0, distance), "slide-down": (0.0, -distance), "slide-left": (distance, 0.0), "slide-right": (-distance, 0.0)}.get(entrance, (0.0, 0.0))
    key = lambda t, dx, dy, scale, o: F.struct(round_to(t, 3).alias("t"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(scale).alias("scale"), F.lit(o).alias("opacity"))
    out = []
    if entrance != "none":
        start = t_in - duration / 2
        out += [key(start, *shift, 0.8 if entrance == "scale" else 1.0, 0.0), key(start + duration, 0.0, 0.0, 1.0, 1.0)]
    if fade_out:
        start = t_out - out_duration / 2
        out += [key(start, 0.0, 0.0, 1.0, 1.0), key(start + out_duration, 0.0, 0.0, 1.0, 0.0)]
    return F.array(*out)
