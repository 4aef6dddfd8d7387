"""Objects from image regions: candidate filter, kinds by an ordered list of rules, rings around boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring(pixels: DataFrame, box: tuple[int, int, int, int], pad: int) -> DataFrame:
    """Pixels (px, py, ...) within `pad` of a box but not in it."""
    x, y, w, h = box
    inside = lambda p: F.col("px").between(x - p, x + w - 1 + p) & F.col("py").between(y - p, y + h - 1 + p)
    return pixels.where(inside(pad) & ~inside(0))


def candidates(regions: DataFrame, area: float) -> DataFrame:
    """Regions (w, h, conf as fill, text_share) that can be objects: neither specks, strips nor text."""
    share, shape = F.col("w") * F.col("h") / area, F.col("h") / F.col("w")
    return regions.where(share.between(0.004, 0.7) & shape.between(0.15, 6) & (F.col("conf") > 0.15) & (F.col("text_share") < 0.5))


def kind(canvas: tuple[float, float]) -> Column:
    """The first rule that fits a region (x, y, w, h, fill, skin, has_text, flat, commercial, sat)."""
    c = F.col
    a, asp = c("w") * c("h") / (canvas[0] * canvas[1]), c("h") / c("w")
    cx, cy = (c("x") + c("w") / 2) / canvas[0], (c("y") + c("h") / 2) / canvas[1]
    band = (cy < 0.16) | (cy > 0.84) | (cx < 0.12) | (cx > 0.88)
    compact = (asp > 0.6) & (asp < 1.6)
    bottom = c("y") + c("h") >= 0.99 * canvas[1]
    # fixed values: the rules' order and thresholds
    return (
        F.when((c("skin") > 0.07) & (asp > 0.9) & (a > 0.03), "person")
        .when(c("has_text") & (asp < 0.5) & (c("fill") > 0.75) & (a < 0.08), F.when((cy > 0.8) & band, "logo").otherwise("object"))
        .when((a < 0.06) & compact & c("flat"), "icon")
        .when((a < 0.06) & band & (asp > 0.3) & (asp < 3), "logo")
        .when((a < 0.05) & compact & (c("fill") > 0.55), "logo")
        .when((a < 0.012) & (asp > 0.5) & (asp < 2) & (c("fill") > 0.25), "icon")
        .when(c("commercial") & (a > 0.03) & (a < 0.6), "product")
        .when((a > 0.08) & (asp < 0.62) & (cy > 0.5), "vehicle")
        .when((a > 0.12) & bottom & (asp > 1.1) & (c("sat") < 25), "building")
        .when((a > 0.02) & (a < 0.35) & (c("fill") > 0.45) & (F.abs(cx - 0.5) < 0.3), "product")
        .otherwise("object")
    )


def letter_blobs(blobs: DataFrame, width: float, height: float, key: str = "pid") -> DataFrame:
    """Blobs (x, y, w, h, area) that can be letters: no frames around the page, nothing huge, no thin rings, no panels around three others."""
    c = F.col
    frame = (c("w") > 0.9 * width) & (c("h") > 0.9 * height)
    huge = c("h") > 0.5 * height
    ring_ = (c("area") < 0.12 * c("w") * c("h")) & (F.least("w", "h") > 0.05 * max(width, height))
    some = blobs.where(~(frame | huge | ring_))
    a, b = some.alias("a"), some.alias("b")
    inner = (F.col("b.x") > F.col("a.x")) & (F.col("b.y") > F.col("a.y")) & (F.col("b.x") + F.col("b.w") < F.col("a.x") + F.col("a.w")) & (F.col("b.y") + F.col("b.h") < F.col("a.y") + F.col("a.h"))
    big = F.least("a.w", "a.h") > 0.015 * max(width, height)
    panels = a.where(big).join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & inner).groupBy(f"a.{key}", "a.ord").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return some.join(panels, [key, "ord"], "left_anti")
