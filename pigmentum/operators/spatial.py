"""Joins of boxes: an equality key first, and a grid where one key holds many boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box


def pairs(a: DataFrame, b: DataFrame, keys: list[str], cell: float | None = None, canvas: float = 600.0) -> DataFrame:
    """Rows of a and b (aliases a and b) whose boxes can overlap.

    Without `cell`, an equi-join on the keys. With it, both sides also go to the grid cells they
    cover, and of the cells that a pair shares only the first counts, so no distinct is needed.
    """
    if cell is None:
        return a.alias("a").join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])

    def spread(df: DataFrame, side: str) -> DataFrame:
        x, y, w, h = box()
        span = lambda v, n: F.sequence(F.floor(v / cell).cast("int"), F.floor((v + n) / cell).cast("int"))
        return df.withColumn("_cx", F.explode(span(x, w))).withColumn("_cy", F.explode(span(y, h))).alias(side)

    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_cx", "_cy"]]
    first = lambda v: F.floor(F.greatest(F.col(f"a.{v}"), F.col(f"b.{v}")) / cell)
    return spread(a, "a").join(spread(b, "b"), on).where((F.col("a._cx") == first("x")) & (F.col("a._cy") == first("y")))


def without(a: DataFrame, b: DataFrame, keys: list[str], clash: Column) -> DataFrame:
    """Rows of a that clash with no row of b of the same keys (both aliased a and b)."""
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.alias("a").join(b.alias("b"), [*on, clash], "left_anti")


def having(a: DataFrame, b: DataFrame, keys: list[str], clash: Column) -> DataFrame:
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.alias("a").join(b.alias("b"), [*on, clash], "left_semi")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], t: str, idx: str, name: str, cell: float = 16.0) -> DataFrame:
    """Each left row with the idx of the right row nearest in time; the earlier one on ties, of one time the least idx.

    An as-of join of the distinct times by running windows inside cells of time, so that one key's rows
    are dealt over its time. What lies before and after a cell comes from a table of one row a cell.
    """
    from pyspark.sql import Window

    same = [*keys, "_cell"]
    cells = lambda df: df.withColumn("_cell", F.floor(F.col("_t") / cell))
    r = right.groupBy(*keys, F.col(t).alias("_t")).agg(F.min(idx).alias("_i")).withColumn("_q", F.lit(0))
    q = left.select(*keys, F.col(t).alias("_t")).distinct().withColumns({"_i": F.lit(None).cast(dict(right.dtypes)[idx]), "_q": F.lit(1)})
    both = cells(q.unionByName(r)).withColumn("_point", F.when(F.col("_q") == 0, F.struct(F.col("_t").alias("t"), F.col("_i").alias("i"))))
    known = lambda by, p, to=0: F.last(p, True).over(by.rowsBetween(Window.unboundedPreceding, to))
    up, down = (lambda of, *o: Window.partitionBy(*of).orderBy(*o)), (lambda of, *o: Window.partitionBy(*of).orderBy(*(F.desc(c) for c in o)))
    ends = both.groupBy(*same).agg(F.min("_point").alias("_first"), F.max("_point").alias("_last"))
    ends = ends.select(*same, known(up(keys, "_cell"), "_last", -1).alias("_earlier"), known(down(keys, "_cell"), "_first", -1).alias("_later"))
    # both windows run forwards: a frame that ends at the last row would be read anew for every row
    near = both.withColumn("_before", known(up(same, "_t", "_q"), "_point")).withColumn("_after", known(down(same, "_t", "_q"), "_point")).where("_q = 1")
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in same]
    near = near.alias("n").join(ends.alias("e"), on, "left").select(*(f"n.{k}" for k in keys), "n._t", F.coalesce("_before", "_earlier").alias("_before"), F.coalesce("_after", "_later").alias("_after"))
    later = F.col("_before").isNull() | (F.col("_after.t") - F.col("_t") < F.col("_t") - F.col("_before.t"))
    near = near.select(*keys, "_t", F.coalesce(F.when(later, F.col("_after.i")), F.col("_before.i")).alias(name))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return left.alias("l").join(near.alias("n"), [*on, F.col(f"l.{t}").eqNullSafe(F.col("n._t"))], "left").select("l.*", f"n.{name}")


def best_overlap(rows: DataFrame, others: DataFrame, key: str, start: str, end: str, order: str, value: str, cell: float = 1.0) -> DataFrame:
    """rows with the `value` of the other interval of the same key that overlaps longest (ties: least `order`), and `overlap`.

    Rows without any overlap go. Equal intervals are compared once, whatever their number, and
    intervals meet in the cells of time they share, so one key's rows are dealt over its time; a
    pair counts in the cell where its overlap begins.
    """
    cells = lambda df: df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    a = cells(rows.select(key, start, end).distinct()).alias("a")
    b = cells(others.groupBy(key, start, end).agg(F.min(F.struct(order, value)).alias("_b"))).alias("b")
    begin = F.greatest(f"a.{start}", f"b.{start}")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._cell") == F.col("b._cell")) & (F.floor(begin / cell) == F.col("a._cell")))
    met = met.select(f"a.{key}", f"a.{start}", f"a.{end}", F.col(f"b._b.{order}").alias("_order"), F.col(f"b._b.{value}").alias(value), (F.least(f"a.{end}", f"b.{end}") - begin).alias("overlap")).where("overlap > 0")
    best = met.groupBy(key, start, end).agg(F.max_by(value, F.struct("overlap", -F.col("_order"))).alias(value), F.max("overlap").alias("overlap"))
    return rows.join(best, [key, start, end])
