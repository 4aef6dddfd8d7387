"""Scenes: ordered layers of a design, built from its elements and edited by pure functions.

A scene is rows (key, z, id, type, x, y, w, h, ...); z counts from 0 at the bottom. Edits give a
new DataFrame and renumber z where the order changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up


def z_order(texts: DataFrame, objects: DataFrame, key: str = "pid") -> DataFrame:
    """(key, src, ord, z): objects by falling area, then texts by rising size; the background is 0."""
    o = objects.select(key, F.lit(1).alias("src"), "ord", (-F.col("w") * F.col("h")).alias("_k"))
    t = texts.select(key, F.lit(2).alias("src"), "ord", F.col("size").cast("double").alias("_k"))
    return o.unionByName(t).withColumn("z", F.row_number().over(Window.partitionBy(key).orderBy("src", "_k", "ord"))).drop("_k")


def renumber(layers: DataFrame, order: Column, key: str = "pid") -> DataFrame:
    return layers.withColumn("z", (F.row_number().over(Window.partitionBy(key).orderBy(order, "z")) - 1).cast("int"))


def patch(layers: DataFrame, which: Column, **values: Column) -> DataFrame:
    """New values in the rows that `which` names; null values count as not given."""
    return layers.withColumns({c: F.when(which, F.coalesce(v, F.col(c))).otherwise(F.col(c)) for c, v in values.items()})


def reorder(layers: DataFrame, which: Column, to: str, key: str = "pid") -> DataFrame:
    """One layer up, down, to the top or the bottom; never below a background layer."""
    z, floor = F.col("z").cast("double"), F.max(F.when(F.col("type") == "background", F.col("z"))).over(Window.partitionBy(key))
    floor = F.coalesce(floor, F.lit(-1)).cast("double")
    target = {"up": z + 1.5, "down": F.greatest(z - 1.5, floor + 0.5), "top": F.lit(1e9), "bottom": floor + 0.5}[to]
    moved = layers.withColumn("_o", F.when(which & (F.col("type") != "background"), target).otherwise(z))
    return renumber(moved, F.col("_o"), key).drop("_o")


def remove(layers: DataFrame, which: Column, key: str = "pid") -> DataFrame:
    return renumber(layers.where(~which), F.col("z").cast("double"), key)


def duplicate(layers: DataFrame, which: Column, shift: float = 16.0, key: str = "pid") -> DataFrame:
    """A copy right above: moved by `shift`, unlocked, named `... copy`."""
    copy = layers.where(which).withColumns({"id": F.concat("id", F.lit("-copy")), "name": F.concat("name", F.lit(" copy")), "x": F.col("x") + shift, "y": F.col("y") + shift, "locked": F.lit(False), "_o": F.col("z") + 0.5})
    return renumber(layers.withColumn("_o", F.col("z").cast("double")).unionByName(copy), F.col("_o"), key).drop("_o")


def add(layers: DataFrame, new: DataFrame, key: str = "pid") -> DataFrame:
    """New layers on top."""
    return renumber(layers.withColumn("_o", F.col("z").cast("double")).unionByName(new.withColumn("_o", F.lit(1e9)), allowMissingColumns=True), F.col("_o"), key).drop("_o")


def move(layers: DataFrame, which: Column, dx: float, dy: float) -> DataFrame:
    free = which & ~F.col("locked")
    return patch(layers, free, x=half_up(F.col("x") + dx).cast("double"), y=half_up(F.col("y") + dy).cast("double"))


def rotate(layers: DataFrame, which: Column, angle: Column, snap: bool = False) -> DataFrame:
    """Degrees within 0 to 360, in steps of 15 when snapping."""
    a = half_up(angle / 15) * 15 if snap else half_up(angle)
    return patch(layers, which & ~F.col("locked"), rotation=F.pmod(a, F.lit(360)).cast("double"))


def resize(layers: DataFrame, which: Column, handle: str, dx: float, dy: float, least: float = 8.0) -> DataFrame:
    """Drag a handle (n, ne, e, ...): the opposite edge stays, sizes never fall below `least`; corners scale text."""
    w0, h0 = F.col("w"), F.col("h")
    w = F.greatest(F.lit(least), w0 + (dx if "e" in handle else -dx if "w" in handle else 0.0))
    h = F.greatest(F.lit(least), h0 + (dy if "s" in handle else -dy if "n" in handle else 0.0))
    new = {"w": half_up(w).cast("double"), "h": half_up(h).cast("double")}
    if "w" in handle:
        new["x"] = half_up(F.col("x") + w0 - w).cast("double")
    if "n" in handle:
        new["y"] = half_up(F.col("y") + h0 - h).cast("double")
    if len(handle) == 2:
        new["size"] = F.when(F.col("type") == "text", F.greatest(F.lit(4.0), half_up(F.col("size") * h / h0).cast("double")))
    return patch(layers, which & ~F.col("locked"), **new)


def switch(scenes: DataFrame, active: Column) -> DataFrame:
    return scenes.withColumn("active", active)


def build(texts: DataFrame, objects: DataFrame, designs: DataFrame, key: str = "pid") -> DataFrame:
    """(key, z, type, ord): a background, the cut-out objects by falling area, the texts by rising size."""
    body = z_order(texts, objects.where(F.col("kind") != "face"), key).select(key, "z", F.when(F.col("src") == 1, "image").otherwise("text").alias("type"), "ord")
    return designs.select(key, F.lit(0).alias("z"), F.lit("background").alias("type"), F.lit(0).alias("ord")).unionByName(body)


def default_text(first: DataFrame, w: float, h: float) -> DataFrame:
    """A new text layer for designs (key, family): placed and sized in shares of the canvas."""
    return first.withColumns({"x": half_up(F.lit(w * 0.3)), "y": half_up(F.lit(h * 0.45)), "w": half_up(F.lit(w * 0.4)), "size": half_up(F.lit(h * 0.06)), "txt": F.lit("New text")})
