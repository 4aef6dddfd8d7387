"""Design-type classifier: linear evidence from wording and counts, then calibrated confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..functions.text import EDGE, LEFT, RIGHT

# Wording that counts for a design type.
KEYWORDS = {
    "Sports Poster": "vs|v\\.|match|fc|cup|league|final|goal|derby|champion|game ?day|season|tournament|united|rugby|soccer|football|basketball|cricket|kick ?off|full ?time|ft",
    "Marketing Banner": "sale|offer|discount|off|deals?|clearance|save|join|sign up|subscribe|learn more|stocks last|black friday",
    "Product Advertisement": "new|launch|introducing|available|edition|drop|flavou?r|made with|meet the|formula|collection",
    "Event Flyer": "live|concert|festival|tickets?|venue|doors|party|night|tour|presents|rsvp|register|summit|conference|talks?|workshops?|music|entry|open house|lineup|speakers?|exhibition|gig",
    "Technical Diagram": "fig|diagram|input|output|api|server|flow|step|module",
}
# The types in the order that breaks ties.
TYPES = ["Sports Poster", "Marketing Banner", "Product Advertisement", "Event Flyer", "Social Media Graphic", "Infographic", "Magazine Page", "Technical Diagram", "Visual Artwork"]


def evidence(texts: DataFrame, objects: DataFrame, facts: DataFrame, key: str = "pid") -> DataFrame:
    """One row per design of `facts` (key, aspect, edge_density, colorfulness) with the counts that the types are scored on."""
    t = texts.groupBy(key).agg(
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "txt"))), lambda s: s["txt"]), " ")).alias("all"), F.count(F.lit(1)).alias("lines"),
        *(F.count(F.when(F.col("role") == r, 1)).alias(f"{r}s") for r in ("score", "statistic", "date")),
    )
    o = objects.groupBy(key).agg(F.count(F.lit(1)).alias("objects"), *(F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}s") for k in ("person", "logo", "product")))
    x = facts.join(t, key, "left").join(o, key, "left")
    return x.withColumns({"all": F.coalesce("all", F.lit(""))} | {c: F.coalesce(c, F.lit(0)) for c in ("lines", "scores", "statistics", "dates", "objects", "persons", "logos", "products")})


def scores(x: DataFrame) -> dict[str, Column]:
    hits = lambda pattern: F.regexp_count("all", F.lit(pattern))
    words = lambda name: hits(f"{EDGE}(?:{KEYWORDS[name]}){EDGE}")
    c, aspect, edges = F.col, F.col("aspect"), F.col("edge_density")
    if_ = lambda cond, v: F.when(cond, float(v)).otherwise(0.0)
    tall = aspect < 0.85
    # fixed values: the types' weights and thresholds
    return {
        "Sports Poster": 2.2 * words("Sports Poster") + 1.5 * c("scores") + 1.1 * c("persons") + 0.4 * c("logos"),
        "Marketing Banner": 1.4 * words("Marketing Banner") + 1.6 * hits(r"[0-9]+\s?%") + if_(aspect > 1.6, 2) + 0.3 * c("logos"),
        "Product Advertisement": 1.6 * words("Product Advertisement") + 0.5 * hits(rf"[$€£]\s?[0-9]|{LEFT}r\s?[0-9]") + 1.4 * c("products") + if_(c("persons") == 0, 0.5),
        "Event Flyer": 1.3 * words("Event Flyer") + 1.2 * c("dates") + if_(tall, 0.6),
        "Social Media Graphic": if_(F.abs(aspect - 1) < 0.08, 1.2) + if_((aspect > 0.75) & tall, 1.2) + hits("[#@][A-Za-z0-9_]+"),
        "Infographic": 0.9 * c("statistics") + if_(c("lines") > 10, 1.4) + if_(edges > 0.12, 0.6),
        "Magazine Page": F.when(c("lines") > 14, 2.0).when(c("lines") > 9, 1.0).otherwise(0.0) + if_(tall, 0.8) + 0.4 * c("persons"),
        "Technical Diagram": if_(c("colorfulness") < 18, 1.2) + if_(edges > 0.14, 1.2) + 0.8 * words("Technical Diagram"),
        "Visual Artwork": if_(c("lines") <= 2, 1.6) + if_(c("colorfulness") > 45, 1) + if_(c("objects") <= 2, 0.5),
    }


def classify(x: DataFrame, n: int = 5, key: str = "pid") -> DataFrame:
    """(key, place, label, confidence): the n likeliest types of each design of `evidence`."""
    s = scores(x)
    rows = x.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("label"), s[name].cast("double").alias("v")) for i, name in enumerate(TYPES)))).alias("e")).select(key, "e.*")
    by = Window.partitionBy(key)
    place = by.orderBy(F.desc("v"), "i")
    r = rows.withColumn("place", F.row_number().over(place))
    r = r.withColumn("top", F.max(F.when(F.col("place") == 1, F.col("v"))).over(by)).withColumn("second", F.max(F.when(F.col("place") == 2, F.col("v"))).over(by)).where(F.col("place") <= n)
    top = F.col("top")
    best = F.when(top <= 0.2, 0.52).otherwise(F.least(F.lit(0.97), 0.62 + F.least(F.lit(0.2), top * 0.035) + F.least(F.lit(0.15), (top - F.col("second")) * 0.05)))
    share = F.when(top > 0, F.col("v") / F.when(top > 0, top).otherwise(1.0)).otherwise(0.5)
    rest = F.greatest(F.lit(0.05), F.least(best - 0.02, best * share * 0.95))
    return r.select(key, "place", "label", round_to(F.when(F.col("place") == 1, best).otherwise(rest), 2).alias("confidence"))


def blend(cloud: DataFrame, local: DataFrame, n: int = 5, key: str = "pid") -> DataFrame:
    """(key, place, label, confidence) of two category tables (key, label, conf, ord): the cloud's weigh three quarters."""
    j = cloud.select(key, "label", F.col("conf").alias("c"), F.col("ord").alias("co")).join(local.select(key, "label", F.col("conf").alias("l"), F.col("ord").alias("lo")), [key, "label"], "full")
    v = F.coalesce("c", F.lit(0.0)) * 0.75 + F.coalesce("l", F.lit(0.0)) * 0.25
    first = F.col("co") == F.min("co").over(Window.partitionBy(key))
    # the cloud's first label never falls below its own confidence
    j = j.withColumn("v", round_to(F.least(F.lit(0.99), F.when(F.coalesce(first, F.lit(False)), F.greatest(v, F.col("c"))).otherwise(v)), 2))
    by = Window.partitionBy(key).orderBy(F.desc("v"), F.col("co").asc_nulls_last(), F.col("lo").asc_nulls_last())
    return j.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).select(key, "place", "label", F.col("v").alias("confidence"))
