"""Palettes: nearest centres, merging of twins, weights and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.numeric import round_to


def nearest_centre(rgb: tuple[Column, Column, Column], centres: list[tuple[int, int, int, int]]) -> Column:
    """The number of the nearest centre (k, r, g, b) by perceptual distance, the first on ties; an expression, not a join."""
    near = F.array(*(F.struct(color.redmean(rgb, tuple(F.lit(v) for v in c[1:])).alias("d"), F.lit(c[0]).alias("k")) for c in centres))
    return F.array_min(near)["k"]


def merge_twins(items: Column, limit: float = 40.0) -> Column:
    """Clusters (r, g, b, cnt) in falling order: each joins the first kept one nearer than the limit, adding its count."""

    def step(kept, x):
        d = lambda k: color.redmean(tuple(k[c] for c in "rgb"), tuple(x[c] for c in "rgb"))
        at = F.array_position(F.transform(kept, lambda k: d(k) < limit), True)
        return F.when(at > 0, F.transform(kept, lambda k, i: F.when(i + 1 == at, k.withField("cnt", k["cnt"] + x["cnt"])).otherwise(k))).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 1, 1), step)


def build(clusters: DataFrame, key: str = "pid", order: str = "ord") -> DataFrame:
    """(key, place, hex, r, g, b, weight, role): a design's palette from its clusters (r, g, b, cnt).

    Twins are merged, at most two strong and light-weighted colours are accents, the first two of
    the others are primary, and grey ones among the rest neutral.
    """
    gathered = clusters.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("_neg"), order, "r", "g", "b", F.col("cnt").cast("bigint").alias("cnt")))).alias("items"))
    one = gathered.select(key, F.explode(merge_twins(F.col("items"))).alias("k")).select(key, f"k.{order}", "k.r", "k.g", "k.b", "k.cnt")
    by = Window.partitionBy(key)
    x = one.withColumn("w", F.col("cnt") / F.sum("cnt").over(by)).withColumn("hsl", color.hsl(*(F.col(c) for c in "rgb"))).select("*", "hsl.h", "hsl.s", "hsl.l")
    may = (F.col("s") > 45) & (F.col("w") < 0.25)
    strength = F.col("s") * (1 - F.abs(F.col("l") - 50) / 60)
    x = x.withColumn("_a", F.when(may, F.row_number().over(by.orderBy(F.desc(may), F.desc(strength), F.desc("cnt"), order))))
    accent = F.coalesce(F.col("_a") <= 2, F.lit(False))
    x = x.withColumn("_accent", accent).withColumn("place", F.row_number().over(by.orderBy(F.desc("cnt"), order)))
    x = x.withColumn("_other", F.sum(F.when(~F.col("_accent"), 1).otherwise(0)).over(by.orderBy("place")))
    role = F.when(F.col("_accent"), "accent").when(F.col("_other") <= 2, "primary").when(F.col("s") < 10, "neutral").otherwise("secondary")
    return x.select(key, "place", color.to_hex(*(F.col(c) for c in "rgb")).alias("hex"), "r", "g", "b", "h", "s", "l", round_to(F.col("w"), 3).alias("weight"), role.alias("role"))
