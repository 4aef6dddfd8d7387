"""Evaluation against answer keys: comparison with a baseline and summary metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels

#: Differences within half a thousandth count as none.
DEAD_BAND = 0.0005
#: How far a cut may be off in frames, and a fade in seconds.
CUT_FRAMES, FADE_SECONDS = 2, 0.3


def compare(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, delta, verdict) of two tables (metric, v)."""
    j = now.alias("n").join(baseline.alias("b"), "metric").select("metric", (F.col("n.v") - F.col("b.v")).alias("delta"))
    return j.withColumn("verdict", F.when(F.col("delta") > DEAD_BAND, "better").when(F.col("delta") < -DEAD_BAND, "worse").otherwise("same"))


def failures(rows: DataFrame) -> DataFrame:
    """Rows (conf, kind, source, ...) that failed, with the first reason that fits."""
    c = F.col("conf")
    why = F.when(c < 0.2, "missed text").when(F.col("kind") == "face", "wrong kind").when(c < 0.3, "wrong colour").when((F.col("source") == "external") & (c > 0.9), "false object")
    return rows.withColumn("failure", why).where("failure is not null")


def summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Metrics of score rows (found, acc, ok, seconds): recall, mean accuracy of found ones, share right, median and worst seconds."""
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    aggs = [F.count(F.lit(1)).alias("n"), share(F.col("found")).alias("recall"), F.avg(F.when(F.col("found"), F.col("acc"))).alias("accuracy"), F.avg(F.when(F.col("found"), F.when(F.col("ok"), 1.0).otherwise(0.0))).alias("right"), F.expr("percentile(seconds, 0.5)").alias("median_s"), F.max("seconds").alias("worst_s")]
    return rows.rollup(by).agg(*aggs) if by else rows.agg(*aggs)


def match_cuts(want: DataFrame, have: DataFrame, key: str, fps: float) -> DataFrame:
    """(key, ord, other) of every wanted cut (key, ord, t, kind): the nearest unused cut (key, ord, t) that was found, or null.

    Wanted cuts choose in their order, on ties the lowest ord. A cut may be two frames off, a fade
    0.3 seconds. A video is divided where no wanted cut reaches a found one across, so its stretches
    are matched side by side.
    """
    reach = F.when(F.col("kind") == "cut", CUT_FRAMES / fps + 1e-3).otherwise(FADE_SECONDS)
    both = want.select(key, "ord", "t", reach.alias("most")).unionByName(have.select(key, "ord", "t", F.lit(0.0).alias("most")).withColumn("found", F.lit(True)), allowMissingColumns=True)
    both = both.withColumn("_lo", F.col("t") - F.col("most")).withColumn("_hi", F.col("t") + F.col("most"))
    # stretches from the distinct spans only, however many cuts have one
    order = Window.partitionBy(key).orderBy("_lo", "_hi")
    spans = both.select(key, "_lo", "_hi").distinct().withColumn("_past", F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("_part", F.sum(F.when(F.col("_lo") <= F.col("_past"), 0).otherwise(1)).over(order))
    kind = dict(want.dtypes)[key]
    joined = both.join(spans.select(key, "_lo", "_hi", "_part"), [key, "_lo", "_hi"])
    # stretches without a wanted cut have no rows; the work on a stretch is far more than its bytes, so they are dealt out by number
    rows = joined.select(key, "ord", "t", "most", "found", "_part").repartition(4 * want.sparkSession.sparkContext.defaultParallelism, key, "_part").groupBy(key, "_part").agg(
        F.array_sort(F.collect_list(F.when(F.col("found").isNull(), F.struct("ord", "t", "most")))).alias("want"), F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("ord", "t")))).alias("have")
    ).where(F.size("want") > 0).select(key, *(F.col(f"{n}.{c}").alias(f"{n}_{c}") for n, c in (("want", "ord"), ("want", "t"), ("want", "most"), ("have", "ord"), ("have", "t"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [kernels.match_nearest(np.column_stack([s.want_ord, s.want_t, s.want_most]), np.column_stack([s.have_ord, s.have_t])) for s in pdf.itertuples(index=False)]
            flat = [m for stretch in got for m in stretch]
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), [len(g) for g in got]), "ord": pd.Series([o for o, _ in flat], dtype="int32"), "other": pd.Series([m for _, m in flat], dtype="Int32")})

    return rows.mapInPandas(run, f"{key} {kind}, ord int, other int")
