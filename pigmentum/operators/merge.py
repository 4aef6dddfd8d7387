"""Order-dependent matching as folds over ordered arrays: every step sees what earlier ones kept.

All folds are per design (or video); the arrays hold one design's elements, so they stay small
while designs spread over the cluster. They are built by one shuffle on the design's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou, same_line

Pair = Callable[[Column, Column], Column]


def box_of(s: Column) -> tuple[Column, ...]:
    return tuple(s[c] for c in "xywh")


def gathered(rows: DataFrame, key: str, order: list[str], fields: list[str], name: str = "items", when: Column | None = None) -> DataFrame:
    """(key, name): a key's rows as an array of structs in order; empty where none fits `when`."""
    item = F.struct(*order, *(f for f in fields if f not in order))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(when, item) if when is not None else item)).alias(name))


def greedy_keep(items: Column, clash: Pair) -> Column:
    """The items that clash with none kept before them (non-maximum suppression in the given order)."""
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 1, 1), lambda kept, x: F.when(F.exists(kept, lambda k: clash(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def contest(items: Column, clash: Pair, beats: Pair) -> Column:
    """A newcomer enters if it beats every kept item it clashes with; those are then removed."""

    def step(kept, x):
        rivals = F.filter(kept, lambda k: clash(k, x))
        wins = F.forall(rivals, lambda k: beats(x, k))
        return F.when(wins, F.concat(F.filter(kept, lambda k: ~clash(k, x)), F.array(x))).otherwise(kept)

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 1, 1), step)


def merge_first(local: Column, external: Column, match: Pair, patch: Pair) -> Column:
    """Each external item patches the first item it matches, or is appended, where later ones can match it."""

    def step(acc, x):
        at = F.array_position(F.transform(acc, lambda k: F.coalesce(match(k, x), F.lit(False))), True)
        return F.when(at > 0, F.transform(acc, lambda k, i: F.when(i + 1 == at, patch(k, x)).otherwise(k))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(external, local, step)


def assign_best(wanted: Column, offered: Column, score: Pair, least: float) -> Column:
    """Greedy one-to-one assignment in the order of `wanted`: array<struct(ord, other, score)>, the best unused offer of at least `least`."""

    def step(acc, w):
        free = F.filter(offered, lambda o: ~F.exists(acc, lambda a: F.coalesce(a["other"] == o["ord"], F.lit(False))))
        # highest score, first offer on ties
        best = F.array_max(F.transform(free, lambda o: F.struct(score(w, o).alias("score"), (-o["ord"]).alias("neg"))))
        good = F.coalesce(best["score"] >= least, F.lit(False))
        none = F.struct(w["ord"].alias("ord"), F.lit(None).cast("int").alias("other"), F.lit(0.0).alias("score"))
        hit = F.struct(w["ord"].alias("ord"), (-best["neg"]).cast("int").alias("other"), best["score"].cast("double").alias("score"))
        return F.concat(acc, F.array(F.when(good, hit).otherwise(none)))

    return F.aggregate(wanted, F.array().cast("array<struct<ord:int,other:int,score:double>>"), step)


def overlaps(k: Column, x: Column) -> Column:
    return iou(box_of(k), box_of(x))


def line_clash(k: Column, x: Column) -> Column:
    return (overlaps(k, x) > 0.3) | same_line(box_of(k), box_of(x))
