"""Results of outside services as tables: replies with JSON inside, detector rows, recognised words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_to


def parse_reply(reply: Column, schema: str) -> Column:
    """The object from the first { to the last } of a reply, by schema; null fields where there is none."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("")), schema, {"mode": "PERMISSIVE"})


def detector_rows(rows: DataFrame, canvas: float, kinds: dict[str, str]) -> DataFrame:
    """Detections with class names mapped to kinds (others: object), boxes in shares of the canvas, confidences of three figures."""
    names = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return rows.withColumns({"kind": F.coalesce(F.try_element_at(names, F.col("label")), F.lit("object")), "conf": round_to(F.col("conf"), 3)} | {f"n{c}": round_to(F.col(c) / canvas, 4) for c in "xywh"})


def region_text(words: DataFrame, least: float, key: str = "pid") -> DataFrame:
    """(key, x, x1, conf, text): a region's certain words with at least two letters or figures, joined from left to right."""
    good = words.where((F.col("conf") > least) & (F.regexp_count("text", F.lit(r"[\p{L}\p{N}]")) >= 2))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), lambda s: s["text"]), " ")
    return good.groupBy(key).agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x1"), F.avg("conf").alias("conf"), said.alias("text"))


def statuses(results: DataFrame, limit_ms: int = 60_000) -> DataFrame:
    """Provider rows (provider, enabled, duration_ms, error) with their status: skipped, error (also for time-outs) or ok."""
    late = F.col("duration_ms") > limit_ms
    return results.withColumn("status", F.when(~F.col("enabled"), "skipped").when(F.col("error").isNotNull() | late, "error").otherwise("ok"))


def health(results: DataFrame) -> DataFrame:
    """One row: how many providers are enabled, how many answered, and whether the engine can do without them."""
    s = statuses(results)
    return s.agg(F.count_if("enabled").alias("enabled"), F.count_if(F.col("status") == "ok").alias("ok"), F.lit(True).alias("local_engine"))
