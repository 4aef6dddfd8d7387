"""Folds that hold one number, and lines that are gathered once."""

from pyspark.sql import functions as F

from pigmentum.functions import easing
from pigmentum.operators import video


def halved(curve, x):
    x1, y1, x2, y2 = easing.CURVES[curve]
    of = lambda t, a, b: 3 * a * t * (1 - t) * (1 - t) + 3 * b * t * t * (1 - t) + t * t * t
    lo, hi = 0.0, 1.0
    for _ in range(30):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if of(mid, x1, x2) < x else (lo, mid)
    return of((lo + hi) / 2, y1, y2)


def test_easing_holds_one_number(spark):
    """The same doubles as by two ends; a step of the fold makes no struct."""
    rows = spark.range(1, 400).select((F.col("id") / 400).alias("x")).select("x", *(easing.ease(c, F.col("x")).alias(c) for c in easing.CURVES))
    for r in rows.collect():
        assert all(r[c] == halved(c, r.x) for c in easing.CURVES if c != "linear")
    assert "struct" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_gathered_once(spark):
    """One grouping and no window; lines of signs only have no row, signs inside a line stay."""
    words = [(1, 0, "*", 0.5, 0.0, 5.0), (1, 1, "a", 0.5, 6.0, 10.0), (1, 2, "-", 0.7, 11.0, 12.0), (1, 3, "b", 0.9, 13.0, 15.0), (1, 4, "!", 0.1, 16.0, 17.0), (1, 5, "c", None, 80.0, 90.0), (1, 6, "**", 0.2, 200.0, 210.0), (2, 0, "--", 1.0, 0.0, 1.0), (3, 0, " ", 1.0, 0.0, 1.0)]
    table = spark.createDataFrame([(*w, 20.0, 30.0) for w in reversed(words)] + [(1, 7, "off", 1.0, 18.0, 19.0, 40.0, 50.0), (1, 8, "high", 1.0, 18.0, 19.0, 5.0, 45.0)], "pid int, word int, text string, conf double, x0 double, x1 double, y0 double, y1 double")
    got = video.split_words(table, ["pid"])
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [(1, 0, "a - b", (0.5 + 0.7 + 0.9) / 3, 6.0, 15.0), (1, 1, "c", None, 80.0, 90.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate [") == 1
