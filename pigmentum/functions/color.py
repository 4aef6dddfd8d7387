"""Colour arithmetic on integer channels 0 to 255 and hex strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_up

# Upper hue bounds of the colour names.
HUE_NAMES = [(15, "Red"), (40, "Orange"), (65, "Yellow"), (80, "Lime"), (160, "Green"), (190, "Teal"), (210, "Cyan"), (250, "Blue"), (280, "Indigo"), (320, "Purple"), (345, "Magenta")]
# Upper hue bounds of the search families; red also from 345 on.
HUE_FAMILIES = [(15, "red"), (40, "orange"), (70, "yellow"), (160, "green"), (200, "teal"), (255, "blue"), (290, "purple"), (345, "pink")]


def to_hex(r: Column, g: Column, b: Column) -> Column:
    two = lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def from_hex(text: Column) -> Column:
    """struct(r, g, b) of #abc or #aabbcc, with or without the sign."""
    bare = F.regexp_replace(text, "^#", "")
    full = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def hsl(r: Column, g: Column, b: Column) -> Column:
    """struct(h, s, l): degrees and percents as whole numbers; the first largest channel decides the hue."""
    r, g, b = (c.cast("double") / 255 for c in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = high - low, (high + low) / 2
    safe = F.when(d == 0, 1.0).otherwise(d)
    s = F.when(d == 0, 0.0).when(light > 0.5, d / F.greatest(F.lit(1e-12), 2 - high - low)).otherwise(d / F.greatest(F.lit(1e-12), high + low))
    h = F.when(d == 0, 0.0).when(high == r, (g - b) / safe + F.when(g < b, 6.0).otherwise(0.0)).when(high == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4)
    return F.struct(half_up(h * 60).cast("int").alias("h"), half_up(s * 100).cast("int").alias("s"), half_up(light * 100).cast("int").alias("l"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    def linear(c):
        v = c.cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    x, y = luminance(*a), luminance(*b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def redmean(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Perceptual distance with weights that follow the mean red."""
    m = (a[0] + b[0]) / 2
    dr, dg, db = (x.cast("double") - y.cast("double") for x, y in zip(a, b, strict=True))
    return F.sqrt((2 + m / 256) * dr * dr + 4 * dg * dg + (2 + (255 - m) / 256) * db * db)


def euclid(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def _bounded(value: Column, bounds: list[tuple[int, str]], beyond: str) -> Column:
    return reduce(lambda rest, row: F.when(value < row[0], row[1]).otherwise(rest), reversed(bounds), F.lit(beyond))


def name(h: Column, s: Column, light: Column) -> Column:
    hue = _bounded(h, HUE_NAMES, "Red")
    tone = F.when(light < 25, "Deep ").when(light < 42, "Dark ").when(light > 75, "Light ").when(s > 80, "Vivid ").otherwise("")
    grey = F.when(light < 30, "Charcoal").when(light < 60, "Slate Grey").otherwise("Silver")
    return (
        F.when(light < 8, "Black").when(light > 94, "White").when(s < 12, grey)
        .when((hue == "Orange") & (light < 40), "Brown").when((hue == "Yellow") & (s < 70) & (light < 60), "Gold").otherwise(F.concat(tone, hue))
    )


def family(h: Column, s: Column, light: Column) -> Column:
    hue = _bounded(h, HUE_FAMILIES, "red")
    hue = F.when((hue == "orange") & (light < 40), "brown").otherwise(hue)
    return F.when(light < 10, "black").when(light > 92, "white").when(s < 12, "grey").otherwise(hue)


def is_skin(r: Column, g: Column, b: Column) -> Column:
    """A red, green and blue rule together with a box in YCbCr, in millionths, so that colours on its sides are inside."""
    cb = 128_000_000 - 168_736 * r - 331_264 * g + 500_000 * b
    cr = 128_000_000 + 500_000 * r - 418_688 * g - 81_312 * b
    warm = (r > 95) & (g > 40) & (b > 20) & (r > g) & (r > b) & (r - F.least(g, b) > 15) & (F.abs(r - g) > 15)
    return warm & cb.between(77_000_000, 127_000_000) & cr.between(133_000_000, 173_000_000)


def saturation(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(high == 0, 0.0).otherwise((high - low) / F.greatest(high, F.lit(1)) * 100)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer grey level of video frames."""
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)
