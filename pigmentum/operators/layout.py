"""Layout of designs: elements, margins, columns and rows, alignment, symmetry, visual hierarchy.

Every function takes elements (key, src, ord, x, y, w, h, ...) and gives one row per design unless
said otherwise. (src, ord) is the elements' order, which decides ties. All of them shuffle on the
design's key only, so after the first one the rest reuse its partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.numeric import clamp, half_up, round_to

# How much a text's role weighs in the hierarchy.
ROLE_WEIGHTS = {"headline": 1.0, "score": 0.95, "subheadline": 0.7, "statistic": 0.6, "cta": 0.6, "name": 0.55, "date": 0.5, "body": 0.35, "caption": 0.25}
OTHER_WEIGHT = 0.3


def role_weight(role: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, w in ROLE_WEIGHTS.items():
        out = F.when(role == name, w).otherwise(out)
    return out


def _share(canvas: tuple[float, float]) -> Column:
    return F.sqrt(F.col("w") * F.col("h") / (canvas[0] * canvas[1]))


def text_mass(canvas: tuple[float, float]) -> Column:
    return role_weight(F.col("role")) * _share(canvas) * 3


def object_mass(canvas: tuple[float, float]) -> Column:
    return F.lit(0.8) * _share(canvas) * 2


def elements(texts: DataFrame, objects: DataFrame, canvas: tuple[float, float], key: str = "pid") -> DataFrame:
    """Texts, then objects other than faces, with their visual weight; a label of at most 28 characters for texts."""
    label = F.concat(F.lit("“"), F.substring("txt", 1, 28), F.when(F.length("txt") > 28, "…").otherwise(""), F.lit("”"))
    cols = [key, "src", "ord", "label", "x", "y", "w", "h", "weight"]
    t = texts.withColumns({"src": F.lit(0), "label": label, "weight": text_mass(canvas)}).select(cols)
    o = objects.where(F.col("kind") != "face").withColumns({"src": F.lit(1), "weight": object_mass(canvas)}).select(cols)
    return t.unionByName(o)


def hierarchy(el: DataFrame, n: int = 10, key: str = "pid") -> DataFrame:
    """(key, place, src, ord, label, weight): a design's n heaviest elements."""
    by = Window.partitionBy(key).orderBy(F.desc("weight"), "src", "ord")
    top = el.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)
    return top.select(key, "place", "src", "ord", "label", round_to(F.col("weight"), 2).alias("weight"))


def margins(el: DataFrame, canvas: tuple[float, float], key: str = "pid") -> DataFrame:
    return el.groupBy(key).agg(*(v.alias(k) for k, v in edges(canvas).items()))


def edges(canvas: tuple[float, float], over: Callable[[Column], Column] = lambda x: x) -> dict[str, Column]:
    """The margins as aggregates, or over a window."""
    w, h = canvas
    edge = lambda x: F.greatest(F.lit(0), half_up(x))
    ends = over(F.max(F.col("x") + F.col("w"))), over(F.max(F.col("y") + F.col("h")))
    return {"left": edge(over(F.min("x"))), "top": edge(over(F.min("y"))), "right": edge(F.lit(w) - ends[0]), "bottom": edge(F.lit(h) - ends[1])}


def gaps(spans: DataFrame, least: float, key: str = "pid") -> DataFrame:
    """(key, a, b): empty strips between spans (a, b, start, end), not counting the first one after the start.

    A running maximum of the spans' ends, in order of their beginnings, is the cursor.
    """
    by = Window.partitionBy(key).orderBy("a", "src", "ord").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.greatest(F.col("start").cast("double"), F.coalesce(F.max("b").over(by), F.col("start").cast("double")))
    x = spans.withColumn("_cursor", cursor)
    found = (F.col("a") - F.col("_cursor") > least) & (F.col("_cursor") > F.col("start")) & (F.col("a") <= F.col("end"))
    return x.where(found & (F.col("_cursor") >= F.col("start"))).select(key, F.col("_cursor").alias("a"), F.col("a").alias("b"))


def _axis(el: DataFrame, m: DataFrame, axis: str, canvas: tuple[float, float], key: str) -> DataFrame:
    size, start, end, full, least = ("w", "left", F.lit(canvas[0]) - F.col("right"), canvas[0], canvas[0] * 0.02) if axis == "x" else ("h", "top", F.lit(canvas[1]) - F.col("bottom"), canvas[1], canvas[1] * 0.012)
    some = el.where(F.col("w") < 0.9 * full) if axis == "x" else el
    return gaps(some.join(m, key).select(key, "src", "ord", F.col(axis).alias("a"), (F.col(axis) + F.col(size)).alias("b"), F.col(start).alias("start"), end.alias("end")), least, key)


def grid(el: DataFrame, canvas: tuple[float, float], key: str = "pid") -> DataFrame:
    """Margins, columns and rows with their guides, gutter and padding."""
    m = margins(el, canvas, key)

    def side(axis: str, count: str, most: int, gap: str, guides: str) -> DataFrame:
        g = _axis(el, m, axis, canvas, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(b - a, 0.5)").alias("mid"), F.array_sort(F.collect_list(half_up((F.col("a") + F.col("b")) / 2))).alias(guides))
        return g.select(key, F.least(F.lit(most), F.col("n") + 1).alias(count), half_up(F.col("mid")).alias(gap), guides)

    out = m.join(side("x", "columns", 6, "gutter", "column_guides"), key, "left").join(side("y", "rows", 12, "padding", "row_guides"), key, "left")
    none = F.array().cast("array<bigint>")
    fill = {"columns": F.lit(1), "rows": F.lit(1), "gutter": half_up(F.lit(canvas[0] * 0.04)), "padding": half_up(F.lit(canvas[1] * 0.03)), "column_guides": none, "row_guides": none}
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def alignment(el: DataFrame, canvas: tuple[float, float], key: str = "pid") -> DataFrame:
    """(key, alignment): left, center or right if over 55 % of the votes agree, else mixed."""
    x = el.join(margins(el, canvas, key), key)
    n = x.groupBy(key).agg(*votes(canvas))
    return n.select(key, agreed().alias("alignment"))


def votes(canvas: tuple[float, float]) -> list[Column]:
    """Counts of a design's elements on its left side, in the centre and on its right; elements have the design's margins."""
    w = canvas[0]
    centre = F.abs(F.col("x") + F.col("w") / 2 - w / 2) < w * 0.04
    left = F.abs(F.col("x") - F.col("left")) < w * 0.03
    right = F.abs(F.col("x") + F.col("w") - (w - F.col("right"))) < w * 0.03
    vote = F.when(centre, "center").when(left, "left").when(right, "right")
    return [F.count(F.when(vote == v, 1)).alias(f"n_{v}") for v in ("left", "center", "right")]


def agreed() -> Column:
    l, c, r = (F.col(f"n_{v}") for v in ("left", "center", "right"))  # noqa: E741
    total, most = F.greatest(F.lit(1), l + c + r), F.greatest(l, c, r)
    name = F.when(l == most, "left").when(c == most, "center").otherwise("right")
    return F.when(most / total > 0.55, name).otherwise("mixed")


#: Elements whose cells are worked out at once.
ELEMENTS = 8192


def symmetry(el: DataFrame, canvas: tuple[float, float], cells: int = 12, key: str = "pid") -> DataFrame:
    """(key, symmetry): mirrored mass of a coarse grid of occupancy, 1 where it is the same left and right.

    One shuffle brings a design's boxes together, four numbers each; their cells exist in the task only,
    some thousand elements at a time.
    """
    return mirrored(el.groupBy(key).agg(boxes()), canvas, cells)


def boxes() -> Column:
    return F.flatten(F.collect_list(F.array(*(F.col(c).cast("double") for c in "xywh")))).alias("boxes")


def mirrored(designs: DataFrame, canvas: tuple[float, float], cells: int = 12) -> DataFrame:
    """Designs with their symmetry instead of their boxes; other columns stay."""
    size, k = (canvas[0] / cells, canvas[1] / cells), np.arange(cells)
    kept = [f for f in designs.schema if f.name != "boxes"]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flat, mass = np.concatenate(pdf["boxes"].tolist()).reshape(-1, 4) if len(pdf) else np.empty((0, 4)), np.zeros((len(pdf), cells, cells))
            owner = np.repeat(np.arange(len(pdf)), [len(v) // 4 for v in pdf["boxes"]])
            for lo in range(0, len(flat), ELEMENTS):
                box, own = flat[lo : lo + ELEMENTS], owner[lo : lo + ELEMENTS]
                x, y = (np.maximum(0, np.minimum((k + 1) * size[i], box[:, [i]] + box[:, [i + 2]]) - np.maximum(k * size[i], box[:, [i]])) for i in (0, 1))
                first = np.flatnonzero(np.diff(own, prepend=-1))
                mass[own[first]] += np.add.reduceat(y[:, :, None] * x[:, None] / (size[0] * size[1]), first)
            mass = np.minimum(1, mass)
            left, right = mass[..., : cells // 2], mass[..., ::-1][..., : cells // 2]
            yield pdf.drop(columns="boxes").assign(_diff=np.abs(left - right).sum((1, 2)), _mass=(left + right).sum((1, 2)))

    s = designs.select(*(F.col(f"`{f.name}`") for f in kept), "boxes").mapInPandas(spread, StructType([*kept, StructField("_diff", DoubleType()), StructField("_mass", DoubleType())]))
    # a hair above, so that exact halves don't depend on the order of the sums
    share = F.when(F.col("_mass") > 0, F.greatest(F.lit(0.0), 1 - F.col("_diff") / F.col("_mass"))).otherwise(1.0)
    return s.withColumn("symmetry", round_to(share + 1e-9, 2)).drop("_diff", "_mass")


def baseline(texts: DataFrame, key: str = "pid", size: str = "size") -> DataFrame:
    """(key, baseline): 1.25 of the size a third up the sorted sizes, in fours."""
    sizes = texts.groupBy(key).agg(F.sort_array(F.collect_list(size)).alias("s"))
    return sizes.select(key, F.greatest(F.lit(4), half_up(F.get(F.col("s"), F.floor(F.size("s") / 3).cast("int")) * 1.25 / 4) * 4).alias("baseline"))


def analyse(texts: DataFrame, objects: DataFrame, canvas: tuple[float, float], key: str = "pid") -> DataFrame:
    el = elements(texts, objects, canvas, key)
    out = grid(el, canvas, key).join(alignment(el, canvas, key), key).join(symmetry(el, canvas, key=key), key)
    return out.join(baseline(texts, key), key, "left").withColumn("baseline", F.coalesce("baseline", F.lit(20)))


def score100(x: Column) -> Column:
    return half_up(clamp(x, 0.0, 100.0))
