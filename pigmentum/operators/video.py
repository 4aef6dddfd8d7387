"""Video timing on frame tables (video, f, t, v array<double> of w x h grey values)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels

EDGE = 18.0
MIN_STEP, STEP_RATIO, KEPT = 2.5, 3.0, 0.45
MIN_SCENE = 0.7
#: Frames of a clip.
CLIP = 1500


def frames(pixels: DataFrame, keys: list[str], w: int) -> DataFrame:
    """One row per frame with its values row by row, from pixel rows (px, py, v)."""
    rows = pixels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((F.col("py") * w + F.col("px")).alias("i"), "v"))).alias("p"))
    return rows.select(*keys, F.transform("p", lambda s: s["v"]).alias("v"))


def mean_diff(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def edges(v: Column, w: int, h: int, threshold: float = EDGE) -> Column:
    """array<int> of 0 and 1: interior pixels whose left-right and up-down differences sum to over the threshold."""

    def one(x: Column, i: Column) -> Column:
        inside = (i % w > 0) & (i % w < w - 1) & (i >= w) & (i < w * (h - 1))
        at = lambda d: F.get(v, i + d)
        return F.when(inside & (F.abs(at(1) - at(-1)) + F.abs(at(w) - at(-w)) > threshold), 1).otherwise(0)

    return F.transform(v, one)


def ones(e: Column) -> Column:
    return F.aggregate(e, F.lit(0), lambda s, x: s + x)


def persistence(a: Column, b: Column, w: int) -> Column:
    """Share of the edges a that b still has within a pixel; 1 with fewer than 8 edges."""
    near = lambda i: F.greatest(*(F.coalesce(F.get(b, i + d), F.lit(0)) for d in (0, 1, -1, w, -w)))
    kept = ones(F.transform(a, lambda x, i: F.when(x == 1, near(i)).otherwise(0)))
    total = ones(a)
    return F.when(total < 8, 1.0).otherwise(kept / F.greatest(total, F.lit(1)))


def in_clips(table: DataFrame, margin: int, size: int = CLIP) -> DataFrame:
    """Frames dealt out into clips (`clip`) of so many frames, with `margin` frames of the clips on either side.

    f numbers a video's frames in the order of their times. Frames that are only a margin have
    another f than the clip's own ones, so they go again by `own_frames`.
    """
    near = F.array_distinct(F.array(*(F.floor((F.col("f") + d) / size) for d in (-margin, 0, margin))))
    return table.withColumn("clip", F.explode(near))


def own_frames(table: DataFrame, size: int = CLIP) -> DataFrame:
    return table.where(F.floor(F.col("f") / size) == F.col("clip")).drop("clip")


def steps(table: DataFrame, w: int, h: int, key: str = "video", size: int = CLIP) -> DataFrame:
    """Frames with their mean difference from the one before, their edges, and how much the former edges persist.

    Windows run over clips of `size` frames, so no task ever holds a long video.
    """
    by = Window.partitionBy(key, "clip").orderBy("t", "f")
    x = in_clips(table, 1, size).withColumn("e", edges(F.col("v"), w, h)).withColumn("_v", F.lag("v").over(by)).withColumn("_e", F.lag("e").over(by)).withColumn("t0", F.lag("t").over(by))
    return x.withColumn("step", F.when(F.col("_v").isNull(), 0.0).otherwise(mean_diff(F.col("v"), F.col("_v")))).withColumn("kept", F.when(F.col("_e").isNotNull(), persistence(F.col("_e"), F.col("e"), w))).drop("_v", "_e").transform(own_frames, size)


def hard_cuts(stepped: DataFrame, key: str = "video", size: int = CLIP) -> DataFrame:
    """(key, time, f, lo, hi): steps much larger than the two on either side, with the old frame's edges gone.

    lo and hi are the times of the frames on either side of the cut, which is called halfway.
    """
    stepped = in_clips(stepped.select(key, "f", "t", "t0", "step", "kept"), 2, size)
    by = Window.partitionBy(key, "clip").orderBy("t", "f")
    around = F.greatest(*(F.coalesce(F.lag("step", n).over(by) if n > 0 else F.lead("step", -n).over(by), F.lit(0.0)) for n in (2, 1, -1, -2)))
    x = own_frames(stepped.withColumn("_around", around), size)
    found = x.where((F.col("step") >= MIN_STEP) & (F.col("step") >= STEP_RATIO * F.col("_around")) & (F.col("kept") < KEPT))
    return found.select(key, ((F.col("t0") + F.col("t")) / 2).alias("time"), "f", F.col("t0").alias("lo"), F.col("t").alias("hi"))


def cuts(table: DataFrame, w: int, h: int, key: str = "video", clip: float = 60.0, margin: float = 5.0) -> DataFrame:
    """(key, time, kind, length) of hard cuts and crossfades, from frames (key, t, v).

    Clips of so many seconds are judged side by side, each with a margin of its neighbours' frames;
    an error says so where frames lie too far apart for the margin. Candidates over APART seconds
    from all others are chosen from by themselves. Videos of under three frames have no cuts.
    """
    kind = dict(table.dtypes)[key]
    ends = table.groupBy(F.col(key).alias("_of")).agg(F.min("t").alias("_first"), F.max("t").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 2").drop("_n")
    at = lambda d: F.floor((F.col("t") + d) / clip)
    dealt = table.select(key, "t", "v").join(ends, F.col(key).eqNullSafe(F.col("_of"))).drop("_of").withColumn("_clip", F.explode(F.sequence(at(-margin), at(margin))))

    def named(k, found: list[tuple], columns: list[str]) -> pd.DataFrame:
        return pd.DataFrame([(k, *c) for c in found], columns=[key, *columns], dtype=object)

    def judge(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        times, first, last = pdf["t"].to_numpy(), float(pdf["_first"].iloc[0]), float(pdf["_last"].iloc[0])
        lo, hi = np.searchsorted(times, [k[1] * clip, (k[1] + 1) * clip])
        found = []
        if lo < hi:
            before, after = np.searchsorted(times, times[lo] - kernels.REACH), len(times) - np.searchsorted(times, times[hi - 1] + kernels.REACH, "right")
            if (times[0] > first and before < kernels.AROUND) or (times[-1] < last and after < kernels.AROUND):
                raise ValueError(f"frames lie too far apart for a margin of {margin} s")
            found = kernels.cut_candidates(np.stack(pdf["v"]).reshape(-1, h, w), times, int(lo), int(hi), first, last)
        return named(k[0], found, ["time", "kind", "length", "share"])

    def choose(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = kernels.choose_cuts(list(pdf[["time", "kind", "length", "share"]].itertuples(index=False, name=None)))
        return named(k[0], found, ["time", "kind", "length"])

    found = dealt.groupBy(key, "_clip").applyInPandas(judge, f"{key} {kind}, time double, kind string, length double, share double")
    order = Window.partitionBy(key).orderBy("time")
    begins = F.when(F.col("time") - F.lag("time").over(order) <= kernels.APART, 0).otherwise(1)
    groups = found.withColumn("_new", begins).withColumn("_group", F.sum("_new").over(order))
    return groups.groupBy(key, "_group").applyInPandas(choose, f"{key} {kind}, time double, kind string, length double")


def refine_cuts(found: DataFrame, table: DataFrame, key: str = "video", bucket: float = 1.0, least: float = 1 / 60) -> DataFrame:
    """(key, time): cuts (key, time, lo, hi) between two sampled frames, bisected to `least` seconds on all frames (key, t, v).

    Each probe takes the frame shown at that time, and the half whose end it is more like is left.
    Frames meet the cuts whose gap they lie in by time buckets and are reduced to which end they are
    like before anything is gathered, so a cut's bisection is a fold over the few times in its gap,
    and all cuts are refined at once. Cuts whose ends aren't frames of the table keep their time.
    """
    at = lambda c: F.floor(F.col(c) / bucket)
    gaps = found.select(key, "time", "lo", "hi").distinct()
    near = gaps.withColumn("_b", F.explode(F.sequence(at("lo"), at("hi"))))
    inside = table.select(key, "t", "v", at("t").alias("_b")).join(near, [key, "_b"]).where(F.col("t").between(F.col("lo"), F.col("hi"))).drop("_b")
    ends = inside.groupBy(key, "time").agg(F.max(F.when(F.col("t") == F.col("lo"), F.col("v"))).alias("a"), F.max(F.when(F.col("t") == F.col("hi"), F.col("v"))).alias("b"))
    like = inside.join(ends.where("a is not null and b is not null"), [key, "time"])
    like = like.select(key, "time", "t", (mean_diff(F.col("v"), F.col("a")) <= mean_diff(F.col("v"), F.col("b"))).alias("early"))
    shown = like.groupBy(key, "time").agg(F.array_sort(F.collect_list(F.struct("t", "early"))).alias("shown"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        early = F.try_element_at(F.filter(F.col("shown"), lambda f: f["t"] <= mid), F.lit(-1))["early"]
        done = s["hi"] - s["lo"] <= least
        return F.struct(F.when(done | ~early, s["lo"]).otherwise(mid).alias("lo"), F.when(done | early, s["hi"]).otherwise(mid).alias("hi"))

    rounds = F.greatest(F.ceil(F.log2((F.col("hi") - F.col("lo")) / least)) + 1, F.lit(0).cast("bigint"))
    last = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(rounds, F.lit(1).cast("bigint"))), F.struct("lo", "hi"), halve)
    refined = gaps.join(shown, [key, "time"], "left").withColumn("_s", F.when(F.col("shown").isNotNull(), last))
    return refined.select(key, F.coalesce((F.col("_s.lo") + F.col("_s.hi")) / 2, F.col("time")).alias("time"))


def suppress(fades: Column, cuts: Column) -> Column:
    """Cuts with the best fades added: array<struct(time, length)>; fades come best first and keep a distance to all before."""
    apart = lambda c, f: F.abs(c["time"] - f["time"]) < F.greatest(F.lit(0.5), (c["length"] + f["length"]) / 2)
    return F.array_sort(F.aggregate(fades, cuts, lambda kept, f: F.when(F.exists(kept, lambda c: apart(c, f)), kept).otherwise(F.concat(kept, F.array(f)))))


def spaced(times: Column, least: float = 0.3) -> Column:
    """Sorted times that are more than `least` after the one before, kept or not."""
    return F.filter(times, lambda c, i: (i == 0) | (c - F.get(times, i - 1) > least))


def fold_short(times: Column, duration: Column, least: float = MIN_SCENE) -> Column:
    """Cut times without those that leave a scene under `least`, from the last to the first with what is left then."""

    def step(kept: Column, c: Column) -> Column:  # kept: later cuts that stayed, nearest last
        after = F.coalesce(F.try_element_at(kept, F.lit(-1)), duration)
        before = F.coalesce(F.array_max(F.filter(times, lambda t: t < c)), F.lit(0.0))
        return F.when((c - before < least) | (after - c < least), kept).otherwise(F.concat(kept, F.array(c)))

    return F.array_sort(F.aggregate(F.reverse(F.array_sort(times)), F.array().cast("array<double>"), step))


def visibility(distances: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, in, out): when a layer is on screen, from rows (t, d, start, end, key_t) of its box's difference to its keyframe.

    It counts as visible below half of the largest difference; at either edge the crossing is
    interpolated with the neighbouring frame. A layer that never changes is there all the scene.
    """
    by, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("t")
    x = distances.withColumn("half", F.max("d").over(by) / 2)
    for name, n in (("p", 1), ("n", -1)):
        x = x.withColumn(f"{name}t", F.lag("t", n).over(order)).withColumn(f"{name}d", F.lag("d", n).over(order))
    cross = lambda s: F.col(f"{s}t") + (F.col("t") - F.col(f"{s}t")) * (F.col(f"{s}d") - F.col("half")) / F.greatest(F.lit(1e-6), F.col(f"{s}d") - F.col("d"))
    seen = F.col("d") < F.col("half")
    x = x.withColumn("_in", F.when(seen, F.struct("t", F.when(F.col("pt").isNull(), F.col("start")).otherwise(cross("p")).alias("v"))))
    x = x.withColumn("_out", F.when(seen, F.struct("t", F.when(F.col("nt").isNull(), F.col("end")).otherwise(cross("n")).alias("v"))))
    a = x.groupBy(*keys).agg(F.max("d").alias("most"), F.min("_in").alias("a"), F.max("_out").alias("b"), F.first("start").alias("start"), F.first("end").alias("end"), F.first("key_t").alias("key_t"))
    still, never = F.col("most") < 6, F.col("a").isNull()
    return a.select(*keys, F.when(still, F.col("start")).when(never, F.col("key_t")).otherwise(F.col("a.v")).alias("t_in"), F.when(still, F.col("end")).when(never, F.col("key_t")).otherwise(F.col("b.v")).alias("t_out"))


def split_words(words: DataFrame, keys: list[str], gap: float = 1.2) -> DataFrame:
    """(keys, part, text, conf, x0, x1): a line's words split at gaps over `gap` median heights, trimmed of signs at both ends.

    Words (x0, x1, y0, y1, text, conf) off the line's middle or much too high are dropped first.
    """
    found = words.where(F.trim("text") != "").select(*keys, F.struct("x0", "word", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("mid"), (F.col("y1") - F.col("y0")).alias("hh"), "text", "conf").alias("_w"))
    each = lambda a, c: F.transform(a, lambda w: w[c])
    upper_mid = lambda c: F.element_at(F.sort_array(F.filter(each("_w", c), lambda v: v.isNotNull())), (F.floor(F.size("_w") / 2) + 1).cast("int"))
    # a line is gathered once, by the keys; all else is worked out inside its array
    x = found.groupBy(*keys).agg(F.array_sort(F.collect_list("_w")).alias("_w")).withColumns({"_cy": upper_mid("mid"), "_wh": upper_mid("hh")})
    x = x.withColumn("_w", F.filter("_w", lambda w: (F.abs(w["mid"] - F.col("_cy")) < 0.5 * F.col("_wh")) & (w["hh"] < 1.8 * F.col("_wh"))))
    starts = F.transform("_w", lambda w, i: F.when((i == 0) | (w["x0"] - F.get("_w", i - 1)["x1"] > gap * F.col("_wh")), i))
    x = x.withColumn("_at", F.filter(starts, lambda i: i.isNotNull()))
    parts = F.transform("_at", lambda i, n: F.struct(n.cast("bigint").alias("part"), F.slice("_w", i + 1, F.coalesce(F.get("_at", n + 1), F.size("_w")) - i).alias("w")))
    place = lambda w: F.struct(w["x0"].alias("x0"), w["word"].alias("word"))
    x = x.select(*keys, F.inline(parts))
    good = F.transform(F.filter("w", lambda w: w["text"].rlike(r"[\p{L}\p{N}]")), place)
    x = x.withColumn("_g", F.struct(F.array_min(good).alias("a"), F.array_max(good).alias("b")))
    x = x.select(*keys, "part", F.filter("w", lambda w: place(w).between(F.col("_g.a"), F.col("_g.b"))).alias("w")).where(F.size("w") > 0)
    conf = F.filter(each("w", "conf"), lambda v: v.isNotNull())
    mean = F.when(F.size(conf) > 0, F.aggregate(conf, F.lit(0.0), lambda s, v: s + v) / F.size(conf))
    return x.select(*keys, "part", F.array_join(each("w", "text"), " ").alias("text"), mean.alias("conf"), F.array_min(each("w", "x0")).alias("x0"), F.array_max(each("w", "x1")).alias("x1"))


def cues(items: DataFrame, key: str, order: str, near: float = 0.15) -> DataFrame:
    """(key, start, end, lines array<struct(y, n, text)>): caption cues from rows (start, end, y, text) in order.

    A row joins the first cue whose first member is within `near` at both ends, else it begins one.
    Which cue that is depends on its start and end only, so the fold runs over a video's distinct
    spans; its lines, by y and then in their order, are gathered per cue.
    """
    close = lambda c, x: (F.abs(c["start"] - x["start"]) < near) & (F.abs(c["end"] - x["end"]) < near)
    spans = items.groupBy(key, "start", "end").agg(F.min(order).alias("_first"))
    held = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_first", "start", "end"))).alias("_spans"))
    span = F.transform("_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    begun = F.aggregate(span, F.array().cast("array<struct<start:double,end:double>>"), lambda acc, x: F.when(F.exists(acc, lambda c: close(c, x)), acc).otherwise(F.concat(acc, F.array(x))))
    of = held.select(key, span.alias("_spans"), begun.alias("_begun")).select(key, F.explode(F.transform("_spans", lambda x: F.struct(x.alias("own"), F.get(F.filter("_begun", lambda c: close(c, x)), 0).alias("cue")))).alias("_s"))
    of = of.select(key, F.col("_s.own.start").alias("start"), F.col("_s.own.end").alias("end"), F.col("_s.cue").alias("_cue"))
    numbered = items.join(of, [key, "start", "end"]).withColumn("_n", (F.row_number().over(Window.partitionBy(key, "_cue").orderBy(order)) - 1).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("_n").alias("n"), "text")))
    return numbered.groupBy(key, "_cue").agg(lines.alias("lines")).select(key, F.col("_cue.start").alias("start"), F.col("_cue.end").alias("end"), "lines")
