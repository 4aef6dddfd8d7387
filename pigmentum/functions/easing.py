"""Cubic-Bézier easing as pure array folds, and where a layer is at a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control points of the named curves.
CURVES = {
    "linear": (0.0, 0.0, 1.0, 1.0),
    "ease": (0.25, 0.1, 0.25, 1.0),
    "ease-in": (0.42, 0.0, 1.0, 1.0),
    "ease-out": (0.0, 0.0, 0.58, 1.0),
    "ease-in-out": (0.42, 0.0, 0.58, 1.0),
    "standard": (0.4, 0.0, 0.2, 1.0),
    "decelerate": (0.0, 0.0, 0.2, 1.0),
    "out-cubic": (0.33, 1.0, 0.68, 1.0),
    "out-quint": (0.22, 1.0, 0.36, 1.0),
    "out-expo": (0.16, 1.0, 0.3, 1.0),
}
BISECTIONS = 30


def _curve(t: Column, a: float, b: float) -> Column:
    u = 1 - t
    return 3 * a * t * u * u + 3 * b * t * t * u + t * t * t


def ease(curve: str, x: Column) -> Column:
    """Progress at time share x: the curve's time axis is inverted by halving, inside one expression."""
    x1, y1, x2, y2 = CURVES[curve]
    if curve == "linear":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    # the state is the middle of what is left, one number; all middles are exact, so they are those of two ends
    halve = lambda mid, width: F.when(_curve(mid, x1, x2) < x, mid + width).otherwise(mid - width)
    widths = F.array(*(F.lit(0.5 ** (i + 2)) for i in range(BISECTIONS)))
    found = F.aggregate(widths, F.lit(0.5), halve, lambda mid: _curve(mid, y1, y2))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(found)


def ease_any(name: Column, x: Column) -> Column:
    out = ease("linear", x)
    for curve in CURVES:
        if curve != "linear":
            out = F.when(name == curve, ease(curve, x)).otherwise(out)
    return out


def css(curve: str) -> str:
    return "linear" if curve == "linear" else f"cubic-bezier({', '.join(f'{v:g}' for v in CURVES[curve])})"


def entrance(keys: Column, size: Column) -> Column:
    """Kind of a layer's entrance from its keys array<struct(t, dx, dy, scale, opacity)>: the first hidden key before a shown one."""
    pairs = F.filter(F.arrays_zip(keys.alias("k"), F.slice(keys, 2, F.greatest(F.size(keys), F.lit(1))).alias("n")), lambda p: (p["k"]["opacity"] < 0.05) & (F.coalesce(p["n"]["opacity"], F.lit(0.0)) > 0.95))
    k = F.get(pairs, 0)["k"]
    grows, shift = F.abs(k["scale"] - 1) >= 0.06, F.sqrt(k["dx"] * k["dx"] + k["dy"] * k["dy"])
    return (
        F.when(k.isNull(), None).when(grows & (shift <= 0.25 * size), "scale")
        .when((F.abs(k["dy"]) >= 12) & (F.abs(k["dy"]) >= F.abs(k["dx"])), F.when(k["dy"] > 0, "slide-up").otherwise("slide-down"))
        .when(F.abs(k["dx"]) >= 12, F.when(k["dx"] > 0, "slide-left").otherwise("slide-right")).when(grows, "scale").otherwise("fade")
    )


# How entrances are described.
ENTRANCE_WORDS = {"fade": "fades in", "slide-up": "slides up", "slide-down": "slides down", "slide-left": "slides in from the right", "slide-right": "slides in from the left", "scale": "scales in"}


def describe(keys: Column, size: Column) -> Column:
    """`slides up · fades out`, or null without motion."""
    kind = entrance(keys, size)
    words = F.lit(None).cast("string")
    for k, v in ENTRANCE_WORDS.items():
        words = F.when(kind == k, v).otherwise(words)
    last, before = F.try_element_at(keys, F.lit(-1)), F.try_element_at(keys, F.lit(-2))
    out = F.when((F.size(keys) >= 2) & (last["opacity"] < 0.05) & (before["opacity"] > 0.95), "fades out")
    return F.nullif(F.concat_ws(" · ", words, out), F.lit(""))
