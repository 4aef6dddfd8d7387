"""Design quality scores of typography, colour and layout, 0 to 100."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.numeric import half_up, round_to
from .layout import agreed, boxes, edges, mirrored, object_mass, score100, text_mass, votes


def _mean(*cols: str) -> Column:
    return reduce(lambda a, b: a + b, (F.col(c).cast("double") for c in cols)) / len(cols)


def typography(texts: DataFrame, key: str = "pid") -> DataFrame:
    """(key, font_consistency, hierarchy, type_scale, weight_discipline, typography) from lines (size, weight, family)."""
    return texts.groupBy(key).agg(*_types(F.lit(True))).select(key, *_type_scores()).withColumn("typography", _typography())


def _types(text: Column) -> list[Column]:
    """What typography is scored by, as aggregates over a design's rows that are texts. Sets, since several distinct counts would spread each row anew."""
    of = lambda x: F.when(text, x)
    kinds = lambda x: F.size(F.collect_set(of(x)))
    return [
        kinds(F.col("family")).alias("families"), kinds(F.col("weight")).alias("weights"), kinds(half_up(F.log(F.col("size")) / F.log(F.lit(1.25)))).alias("tiers"),
        F.count(of(F.lit(1))).alias("n_texts"), (F.max(of(F.col("size"))) / F.greatest(F.lit(1.0), F.percentile(of(F.col("size")), F.lit(0.5)))).alias("ratio"),
    ]


def _type_scores() -> list[Column]:
    r, t = F.col("ratio"), F.col("tiers")
    return [
        F.when(F.col("families") <= 2, 96).when(F.col("families") == 3, 78).otherwise(55).alias("font_consistency"),
        F.when(F.col("n_texts") == 1, 80).when(r >= 2.2, 95).when(r >= 1.6, 82).when(r >= 1.25, 64).otherwise(45).alias("hierarchy"),
        F.when(t.between(2, 5), 90).when(t > 5, 60).otherwise(72).alias("type_scale"), F.when(F.col("weights") <= 3, 90).otherwise(68).alias("weight_discipline"),
    ]


def _typography() -> Column:
    return score100(_mean("font_consistency", "hierarchy", "type_scale", "weight_discipline"))


def _readable(text: Column, background: tuple[int, int, int]) -> Column:
    ratio = color.contrast(tuple(F.col(c) for c in "rgb"), tuple(map(F.lit, background)))
    return F.avg(F.when(text, F.when(ratio >= 4.5, 1.0).otherwise(0.0))).alias("aa")


def colours(texts: DataFrame, palette: DataFrame, background: tuple[int, int, int] = (255, 255, 255), key: str = "pid") -> DataFrame:
    """(key, contrast, balance, harmony, palette_size, scheme, color) from lines (r, g, b) and palettes (place, h, s, weight, role)."""
    x = _palettes(palette, key).join(texts.groupBy(key).agg(_readable(F.lit(True), background)), key, "left")
    return x.select(key, *_colour_scores()).withColumn("color", _colour())


def _palettes(palette: DataFrame, key: str) -> DataFrame:
    main = F.when(F.col("role") != "accent", F.struct("place", "weight"))
    p = palette.groupBy(key).agg(
        F.array_sort(F.collect_list(main)).alias("main"), F.coalesce(F.sum(F.when(F.col("role") == "accent", F.col("weight"))), F.lit(0.0)).alias("accent"),
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("s") > 25, F.col("h")))).alias("hues"),
    )
    # differences of all pairs of one palette's hues, as an array: a palette has a handful of colours
    apart = lambda a, b: F.least(F.abs(a - b), 360 - F.abs(a - b))
    diffs = F.flatten(F.transform("hues", lambda a, i: F.transform(F.slice(F.col("hues"), i + 2, F.greatest(F.lit(1), F.size("hues"))), lambda b: apart(a, b))))
    return p.withColumn("diffs", diffs)


def _colour_scores() -> list[Column]:
    fits = F.transform("diffs", lambda d: F.least(*(F.abs(d - v) for v in (0, 30, 120, 150, 180))))
    mean = F.aggregate(fits, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.lit(1), F.size("diffs"))
    weight = lambda i, default: F.coalesce(F.get("main", i)["weight"], F.lit(default))
    off = F.abs(weight(0, 0.6) - 0.6) + F.abs(weight(1, 0.3) - 0.3) + F.abs(F.col("accent") - 0.1)
    widest, several = F.array_max("diffs"), F.size("hues") >= 2
    return [
        score100(40 + F.coalesce("aa", F.lit(1.0)) * 60).alias("contrast"), score100(100 - off * 90).alias("balance"),
        F.when(several, score100(100 - mean * 1.6)).otherwise(80).alias("harmony"), F.when(F.col("n").between(4, 7), 92).when(F.col("n") <= 3, 76).otherwise(62).alias("palette_size"),
        F.when(~several, "Monochrome").when(widest < 45, "Analogous").when(widest > 150, "Complementary").otherwise("Triadic / split").alias("scheme"),
    ]


def _colour() -> Column:
    return score100(_mean("contrast", "balance", "harmony", "palette_size"))


def spacing(texts: DataFrame, key: str = "pid") -> DataFrame:
    """(key, cv): variation of the vertical distances over 2 between lines' tops, sorted."""
    gap = F.col("y") - F.lag("y").over(Window.partitionBy(key).orderBy("y", "ord"))
    g = texts.select(key, gap.alias("gap")).where("gap > 2").groupBy(key).agg(F.avg("gap").alias("mean"), F.avg(F.col("gap") * F.col("gap")).alias("square"))
    return g.select(key, (F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))) / F.col("mean")).alias("cv"))


def layout(analysis: DataFrame, hierarchy: DataFrame, texts: DataFrame, canvas: tuple[float, float], key: str = "pid") -> DataFrame:
    """(key, alignment_score, spacing, dominance, margin_balance, symmetry_score, layout)."""
    top = hierarchy.where("place <= 2").groupBy(key).agg(F.max(F.when(F.col("place") == 1, F.col("weight"))).alias("w0"), F.max(F.when(F.col("place") == 2, F.col("weight"))).alias("w1"))
    x = analysis.join(top, key).join(spacing(texts, key), key, "left")
    return x.select(key, *_layout_scores(canvas)).withColumn("layout", _layout())


def _layout_scores(canvas: tuple[float, float]) -> list[Column]:
    lead = F.when(F.col("w1").isNull(), 2.0).otherwise(F.col("w0") / F.greatest(F.lit(0.01), F.col("w1")))
    h = score100(100 - F.abs(F.col("left") - F.col("right")) / canvas[0] * 400)
    v = score100(100 - F.abs(F.col("top") - F.col("bottom")) / canvas[1] * 250)
    return [
        F.when(F.col("alignment") == "mixed", 62).otherwise(92).alias("alignment_score"), score100(100 - F.coalesce("cv", F.lit(0.0)) * 45).alias("spacing"),
        F.when(lead >= 1.5, 92).when(lead >= 1.15, 76).otherwise(58).alias("dominance"), half_up((h + v) / 2).alias("margin_balance"), score100(50 + F.col("symmetry") * 50).alias("symmetry_score"),
    ]


def _layout() -> Column:
    return score100(_mean("alignment_score", "spacing", "dominance", "margin_balance", "symmetry_score"))


def _facts(scene: DataFrame, text: Column, object: Column, canvas: tuple[float, float], key: str, *more: Column) -> DataFrame:
    """All that layout scores need of a design, gathered on its key once. Scene: one row per box, which is a text, an object or neither."""
    by = Window.partitionBy(key)
    el = scene.where(text | object).withColumn("_text", text)
    el = el.withColumns(edges(canvas, lambda x: x.over(by)) | {"_mass": F.when(F.col("_text"), text_mass(canvas)).otherwise(object_mass(canvas))})
    tops = F.slice(F.sort_array(F.collect_list("_mass"), False), 1, 2).alias("_tops")
    ys = F.array_sort(F.collect_list(F.when(F.col("_text"), F.col("y")))).alias("_ys")
    d = el.groupBy(key).agg(*(F.first(c).alias(c) for c in ("left", "top", "right", "bottom")), *votes(canvas), boxes(), tops, ys, *more)
    gaps = F.filter(F.transform("_ys", lambda y, i: y - F.when(i > 0, F.get(F.col("_ys"), i - 1))), lambda g: g > 2)
    d = mirrored(d.withColumn("_gaps", gaps).drop("_ys"), canvas)
    mean = lambda f: F.aggregate("_gaps", F.lit(0.0), lambda s, g: s + f(g)) / F.nullif(F.size("_gaps"), F.lit(0))
    d = d.withColumn("_mean", mean(lambda g: g))
    cv = F.sqrt(F.greatest(F.lit(0.0), mean(lambda g: g * g) - F.col("_mean") * F.col("_mean"))) / F.col("_mean")
    return d.withColumns({"alignment": agreed(), "cv": cv, "w0": round_to(F.get("_tops", F.lit(0)), 2), "w1": round_to(F.get("_tops", F.lit(1)), 2)})


def scene_layout(scene: DataFrame, text: Column, object: Column, canvas: tuple[float, float], key: str = "pid") -> DataFrame:
    """The rows of `layout` from one table of boxes (key, x, y, w, h, role), of which `text` and `object` choose."""
    return _facts(scene, text, object, canvas, key).select(key, *_layout_scores(canvas)).withColumn("layout", _layout())


def scene_dna(scene: DataFrame, text: Column, object: Column, palette: DataFrame, canvas: tuple[float, float], background: tuple[int, int, int] = (255, 255, 255), key: str = "pid") -> DataFrame:
    """(key, typography, color, layout, dna) of designs with texts and a palette; lines are gathered once for all three."""
    d = _facts(scene, text, object, canvas, key, *_types(F.col("_text")), _readable(F.col("_text"), background)).where("n_texts > 0")
    x = d.join(_palettes(palette, key), key).select(key, *_type_scores(), *_colour_scores(), *_layout_scores(canvas))
    x = x.select(key, _typography().alias("typography"), _colour().alias("color"), _layout().alias("layout"))
    return x.withColumn("dna", overall(F.col("typography"), F.col("color"), F.col("layout")))


def overall(t: Column, c: Column, lay: Column) -> Column:
    return score100(t * 0.34 + c * 0.33 + lay * 0.33)
