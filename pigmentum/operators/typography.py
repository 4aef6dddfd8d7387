"""Typography of text lines from their boxes and wording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numeric import half_up


def estimate(lines: DataFrame, canvas_w: float, key: str = "pid") -> DataFrame:
    """Adds size_px, width_ratio, weight, align and role to lines (txt, x, w, h, conf as share of ink, ord).

    Size is the height over the share of an em that the wording's shapes take: capitals 0.74,
    with descenders 1, else 0.8. Weight goes by the share of ink. The largest line of a design is
    its headline unless it is a score. One shuffle, on the design.
    """
    t = F.col("txt")
    em = F.when((F.upper(t) == t) & t.rlike("[A-Za-z]"), 0.74).when(t.rlike("[gjpqy,]"), 1.0).otherwise(0.8)
    size = F.col("h") / em
    out = lines.withColumn("_px", size).withColumn("_own", text.role(t))
    by = Window.partitionBy(key)
    out = out.withColumn("_place", F.row_number().over(by.orderBy(F.desc("_px"), "ord"))).withColumn("_top", F.max("_px").over(by))
    ink, px = F.col("conf"), F.col("_px")
    middle = F.col("x") + F.col("w") / 2
    special = F.col("_own").isNotNull()
    return out.withColumns(
        {
            "size_px": half_up(px),
            "width_ratio": F.col("w") / F.greatest(F.lit(1), F.length(t)) / px,
            "weight": F.when(ink < 0.16, 300).when(ink < 0.24, 400).when(ink < 0.31, 600).when(ink < 0.4, 700).otherwise(800),
            "align": F.when(F.abs(middle - canvas_w / 2) < canvas_w * 0.05, "center").when(middle < canvas_w / 2, "left").otherwise("right"),
            "role": F.when((F.col("_place") == 1) & (F.coalesce(F.col("_own"), F.lit("")) != "score"), "headline").when(special, F.col("_own")).when(px >= 0.55 * F.col("_top"), "subheadline").when(px < 0.28 * F.col("_top"), "caption").otherwise("body"),
        }
    ).drop("_px", "_own", "_place", "_top")
