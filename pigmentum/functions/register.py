"""The engine's scalar functions for SQL users, as temporary SQL functions: Catalyst inlines their bodies."""

from __future__ import annotations

from pyspark.sql import SparkSession

_LINEAR = "CASE WHEN {0} / 255D <= 0.03928D THEN {0} / 255D / 12.92D ELSE pow(({0} / 255D + 0.055D) / 1.055D, 2.4D) END"
_BOTH = "greatest(0D, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0D, least(ay + ah, by_ + bh) - greatest(ay, by_))"
FUNCTIONS = {
    "half_up": ("x DOUBLE", "BIGINT", "CAST(floor(x + 0.5D) AS BIGINT)"),
    "luminance": ("r INT, g INT, b INT", "DOUBLE", " + ".join(f"{k}D * {_LINEAR.format(c)}" for k, c in ((0.2126, "r"), (0.7152, "g"), (0.0722, "b")))),
    "contrast_ratio": ("a DOUBLE, b DOUBLE", "DOUBLE", "(greatest(a, b) + 0.05D) / (least(a, b) + 0.05D)"),
    "color_distance": ("r1 INT, g1 INT, b1 INT, r2 INT, g2 INT, b2 INT", "DOUBLE", "sqrt((2 + (r1 + r2) / 2D / 256) * (r1 - r2) * (r1 - r2) + 4 * (g1 - g2) * (g1 - g2) + (2 + (255 - (r1 + r2) / 2D) / 256) * (b1 - b2) * (b1 - b2))"),
    "box_iou": ("ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, bx DOUBLE, by_ DOUBLE, bw DOUBLE, bh DOUBLE", "DOUBLE", f"CASE WHEN aw * ah + bw * bh - {_BOTH} <= 0 THEN 0D ELSE {_BOTH} / (aw * ah + bw * bh - {_BOTH}) END"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates the functions in the session and gives their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
