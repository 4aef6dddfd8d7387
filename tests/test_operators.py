"""Operators on hand-made rows: golden values, properties, kernels, streams against batch."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pigmentum.functions import color, easing, geometry, text
from pigmentum.operators import history, kernels, merge, search, spatial, video
from pigmentum.sources import uploads
from pigmentum.streaming import frames as stream_frames
from pigmentum.streaming import rate_limit


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_colours(spark):
    rgb = lambda *v: tuple(F.lit(x) for x in v)
    assert tuple(one(spark, color.hsl(*rgb(255, 0, 0)).alias("x")).x) == (0, 100, 50)
    assert one(spark, color.to_hex(*rgb(1, 171, 255)).alias("x")).x == "#01ABFF"
    assert tuple(one(spark, color.from_hex(F.lit("#fa0")).alias("x")).x) == (255, 170, 0)
    assert abs(one(spark, color.contrast(rgb(0, 0, 0), rgb(255, 255, 255)).alias("x")).x - 21) < 1e-9
    names = one(spark, *(color.name(*rgb(*v)).alias(f"n{i}") for i, v in enumerate([(0, 0, 5), (0, 0, 96), (200, 5, 45), (30, 60, 30), (50, 50, 50), (230, 90, 50)])))
    assert list(names) == ["Black", "White", "Slate Grey", "Brown", "Gold", "Vivid Blue"]


def test_roles(spark):
    rows = [("2 - 1", "score"), ("12 March", "date"), ("12.03.2024", "date"), ("95%", "statistic"), ("John Smith", "name"), ("Buy it today", None), ("R 199", "statistic"), ("1999-2000", "date"), ("Émile Zola", None)]
    got = spark.createDataFrame(rows, "t string, want string").select("t", "want", text.role(F.col("t")).alias("role")).collect()
    assert [r.role for r in got][:8] == [w for _, w in rows][:8]


def test_easing(spark):
    x = [i / 20 for i in range(-2, 23)]
    for curve in easing.CURVES:
        got = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select("x", easing.ease(curve, F.col("x")).alias("y")).orderBy("x").collect()]
        assert got[0] == 0 and got[-1] == 1 and all(b >= a - 1e-9 for a, b in zip(got, got[1:], strict=False)) or curve in ("out-cubic", "out-quint", "out-expo")
        assert np.allclose(got, kernels.eased(curve, np.array(x)), atol=1e-9)


def plain_iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


def boxes(seed, n, size=100):
    rng = random.Random(seed)
    return [(rng.randint(0, size), rng.randint(0, size), rng.randint(1, 60), rng.randint(1, 60)) for _ in range(n)]


def test_iou_bounds_and_grid(spark):
    rows = [(i % 3, i, *map(float, b)) for i, b in enumerate(boxes(1, 60))] + [(0, 99, 5.0, 5.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "pid int, ord int, x double, y double, w double, h double")
    a, b = geometry.box("a."), geometry.box("b.")
    hit = geometry.overlap(a, b) > 0
    flat = spatial.pairs(df, df, ["pid"]).where(hit).select("a.ord", F.col("b.ord").alias("o"), geometry.iou(a, b).alias("iou")).collect()
    grid = spatial.pairs(df, df, ["pid"], cell=20.0).where(hit).select("a.ord", F.col("b.ord").alias("o"), geometry.iou(a, b).alias("iou")).collect()
    assert sorted(map(tuple, flat)) == sorted(map(tuple, grid))
    by = {(r.ord, r.o): r.iou for r in flat}
    assert all(abs(by[o, i] - v) < 1e-12 and 0 <= v <= 1 for (i, o), v in by.items())


def items(spark, bs):
    df = spark.createDataFrame([(1, i, *map(float, b)) for i, b in enumerate(bs)], "pid int, ord int, x double, y double, w double, h double")
    return merge.gathered(df, "pid", ["ord"], ["x", "y", "w", "h"])


@pytest.mark.parametrize("seed", range(4))
def test_greedy_folds_equal_loops(spark, seed):
    bs = boxes(seed, 25)
    kept = []
    for i, b in enumerate(bs):
        if all(plain_iou(bs[k], b) <= 0.3 for k in kept):
            kept.append(i)
    g = items(spark, bs).withColumn("k", merge.greedy_keep(F.col("items"), lambda k, x: merge.overlaps(k, x) > 0.3))
    got = g.first()
    assert [r.ord for r in got.k] == kept
    again = g.withColumn("k", merge.greedy_keep(F.col("k"), lambda k, x: merge.overlaps(k, x) > 0.3)).first().k
    assert [r.ord for r in again] == kept  # suppression of the kept changes nothing
    other = boxes(seed + 50, 12)
    used, want = set(), []
    for i, b in enumerate(bs):
        best = max(((plain_iou(b, o), -j) for j, o in enumerate(other) if j not in used), default=(0, 0))
        hit = -best[1] if best[0] >= 0.2 else None
        used |= {hit} - {None}
        want.append((i, hit))
    both = items(spark, bs).join(items(spark, other).withColumnRenamed("items", "have"), "pid")
    got = both.select(merge.assign_best(F.col("items"), F.col("have"), merge.overlaps, 0.2).alias("m")).first().m
    assert [(r.ord, r.other) for r in got] == want


def test_merge_appends_can_match_later_ones(spark):
    local, ext = items(spark, [(0, 0, 10, 10)]), items(spark, [(50, 50, 10, 10), (51, 50, 10, 10), (0, 1, 10, 10)]).withColumnRenamed("items", "ext")
    m = local.join(ext, "pid").select(merge.merge_first(F.col("items"), F.col("ext"), lambda k, x: merge.overlaps(k, x) > 0.3, lambda k, x: k.withField("w", F.lit(99.0))).alias("m")).first().m
    assert [(r.x, r.w) for r in m] == [(0, 99), (50, 99)]


def test_search_quirks(spark):
    say = {"headlines over 60px": "Headlines", "team names": "Names", "sub-headlines": "Headlines", "blue text": "All text layers", "gold": "Gold colours", "gray shades": "Gray colours", "textures": "Background layers", "fonts over 60": "Text larger than 60px", "": "Type a query", "été": "Matches for “été”"}
    got = search.compile_intents(spark.createDataFrame([(q,) for q in say], "query string")).collect()
    assert {r.query: r.intent for r in got} == say


def test_history(spark):
    log = [("edit", 1), ("edit", 2), ("edit", 3), ("undo", None), ("undo", None), ("undo", None), ("redo", None), ("edit", 9), ("redo", None)]
    df = spark.createDataFrame([("a", i, a, v) for i, (a, v) in enumerate(log)], "k string, i int, action string, version int")
    assert tuple(history.current(df, "k", "i").first()) == ("a", 9, 2, 0)
    assert history.current(df, "k", "i", limit=1).first().undos == 1


# -------------------------------------------------------------------- kernels


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_labels_are_the_components(seed):
    m = np.random.default_rng(seed).random((9, 11)) < 0.5
    labels, n = kernels.label(m)
    assert (labels > 0).tolist() == m.tolist() and set(labels[m].tolist()) == set(range(1, n + 1))
    down, right = m[1:] & m[:-1], m[:, 1:] & m[:, :-1]
    assert (labels[1:][down] == labels[:-1][down]).all() and (labels[:, 1:][right] == labels[:, :-1][right]).all()
    for k in range(1, n + 1):  # and no two numbers in one component
        seen, todo = set(), [tuple(np.argwhere(labels == k)[0])]
        while todo:
            y, x = todo.pop()
            if 0 <= y < 9 and 0 <= x < 11 and m[y, x] and (y, x) not in seen:
                seen.add((y, x))
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        assert len(seen) == int((labels == k).sum())


def poster(seed=0):
    rng = np.random.default_rng(seed)
    a = np.full((90, 120, 3), (240, 240, 230), float) + rng.normal(0, 1, (90, 120, 3))
    a[20:50, 10:40], a[30:70, 70:110] = (200, 30, 40), (20, 60, 160)
    return np.clip(a, 0, 255)


def test_segment_finds_shapes():
    found = sorted(kernels.segment(poster())["regions"], key=lambda g: g["x"])
    assert len(found) == 2
    for g, want in zip(found, [(10, 20, 30, 30), (70, 30, 40, 40)], strict=True):
        assert plain_iou((g["x"], g["y"], g["w"], g["h"]), want) > 0.7


def test_kmeans_and_fills():
    a = poster()
    top = kernels.kmeans(a[::2, ::2].reshape(-1, 3), 4)
    assert np.abs(np.array(top[0][0]) - (240, 240, 230)).max() <= 2 and sum(n for _, n in top) == 45 * 60
    hole = np.ones((90, 120), bool)
    hole[20:50, 10:40] = False
    assert np.abs(kernels.inpaint(a, hole)[25:45, 15:35] - (240, 240, 230)).max() < 6
    ramp = np.repeat(np.linspace(0, 250, 60)[None, :, None], 40, 0).repeat(3, 2)
    assert kernels.gradient(ramp)["name"] == "left → right" and kernels.gradient(np.full((20, 20, 3), 7.0)) is None
    assert kernels.resample(ramp, 30, 20).shape == (20, 30, 3)
    m = np.zeros((9, 9), bool)
    m[4, 4] = True
    assert kernels.dilate(m, 2).sum() == 25 and (kernels.erode(kernels.dilate(m, 2), 2) == m).all()


def test_documents(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(kernels.png(poster()))
    (tmp_path / "b.txt").write_bytes(b"x")
    r = uploads.images(spark, str(tmp_path / "a.png")).first()
    from pigmentum.operators.raster import image

    assert np.abs(image(r) - np.rint(poster())).max() == 0
    assert {f.name: f.outcome for f in uploads.files(spark, str(tmp_path)).collect()} == {"a.png": "accepted", "b.txt": "unsupported type"}
    page = kernels.pdf(poster())
    at = int(page.rsplit(b"startxref\n", 1)[1].split()[0])
    assert page[at:].startswith(b"xref") and zlib.crc32(page) and struct.calcsize(">I") == 4


def test_motion_is_recovered():
    plate, n = np.full((60, 80), 50.0), 16
    rng = np.random.default_rng(3)
    layer = rng.uniform(120, 250, (14, 20))
    frames, times = np.repeat(plate[None], n, 0), np.arange(n) / 25
    for k in range(n):
        o = min(1.0, k / 8)
        dy = int(round((1 - o) * 12))
        part = frames[k, 20 + dy : 34 + dy, 30:50]
        part[:] = part * (1 - o) + layer * o
    got = kernels.track_layer(frames, times, plate, (30, 20, 20, 14), n - 1)
    assert len(got) == n and got[-1, 5] == 1 and abs(got[5, 2] - 4) <= 2 and abs(got[5, 4] - 5 / 8) < 0.1
    keys = kernels.fit_motion(got, 10.0, 1.0, 17)
    assert len(keys) == 2 and 8 <= keys[0]["dy"] <= 16 and keys[1]["opacity"] == 1


def clip(cuts=(20, 43), n=60, seed=5, fade=None):
    """Frames at 25 a second with hard cuts, and a crossfade of a second whose middle is frame `fade`."""
    rng = np.random.default_rng(seed)
    scenes = []
    for k in range(len(cuts) + 2):
        a = np.full((16, 16), 40.0)
        a[2 + 3 * (k % 4) : 6 + 3 * (k % 4), 1 + 4 * (k % 3) : 5 + 4 * (k % 3)] = 220
        scenes.append(a)
    out = []
    for i in range(n):
        v = scenes[sum(i >= c for c in cuts)]
        if fade is not None and i > fade - 13:
            share = min(1.0, (i - fade + 12.5) / 25)
            v = (1 - share) * v + share * scenes[-1]
        out.append((float(i) / 25, (v + rng.normal(0, 0.2, (16, 16))).ravel().tolist()))
    return out


def detected(rows):
    return kernels.detect_cuts(np.array([v for _, v in rows]).reshape(-1, 16, 16), np.array([t for t, _ in rows]))


CLIPS = {1: clip(), 2: clip((20, 118), 120, 6, None), 3: clip((30,), 160, 7, fade=90), 4: clip((), 2), 5: clip((1, 3), 5, 8), 6: clip((), 70, 9, fade=35)}


def test_cuts_by_clips_as_of_the_whole_video(spark):
    assert [k for _, k, _ in detected(CLIPS[3])] == ["cut", "fade"]
    assert np.allclose([t for t, *_ in detected(CLIPS[1])], [19.5 / 25, 42.5 / 25])
    rows = spark.createDataFrame([(v, t, x) for v, own in CLIPS.items() for t, x in own], "video long, t double, v array<double>")
    for length in (0.4, 2.0, 60.0):
        got = video.cuts(rows, 16, 16, clip=length, margin=1.0).collect()
        for v, own in CLIPS.items():
            assert sorted((r.time, r.kind, r.length) for r in got if r.video == v) == detected(own)
    with pytest.raises(Exception, match="too far apart"):
        video.cuts(rows, 16, 16, clip=1.0, margin=0.1).collect()


def drained(stream, path):
    q = stream.writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table("out").collect(), q.lastProgress


def test_cuts_stream_as_in_batch(spark, tmp_path, rocksdb):
    """All cuts and fades, those of a video's last frames too, whatever the order within the delay; then no state is left."""
    import datetime as dt

    t0 = dt.datetime(1970, 1, 1)
    at = lambda t: t0 + dt.timedelta(microseconds=round(t * 1e6))
    clips = {v: [((at(t + 3600) - t0).total_seconds(), x) for t, x in own] for v, own in CLIPS.items()}
    rows = sorted((t, v, x) for v, own in clips.items() for t, x in own)
    rng = random.Random(4)
    rows = [r for _, r in sorted(((r[0] + rng.uniform(0, 0.9), r) for r in rows), key=lambda x: x[0])]  # late by under a second
    rows.insert(50, rows[49])  # a frame that comes twice
    parts = [rows[i : i + 70] for i in range(0, len(rows), 70)]
    end = [(t, 9, [0.0] * 256) for t in (3700.0, 3800.0, 3900.0)]
    for i, part in enumerate([*parts, end[:1], end[1:2], end[2:]]):
        spark.createDataFrame([(v, at(t), x) for t, v, x in part], "video long, ts timestamp, v array<double>").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i:03}"))
    stream = spark.readStream.schema("video long, ts timestamp, v array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got, progress = drained(stream_frames.cuts(stream, 16, 16), tmp_path / "c")
    for v, own in clips.items():
        mine = sorted((r.time, r.kind, r.length) for r in got if r.video == v)
        assert [k for _, k, _ in mine] == [k for _, k, _ in detected(own)], v
        assert np.allclose([t for t, *_ in mine], [t for t, *_ in detected(own)])
    assert progress["stateOperators"][0]["numRowsTotal"] <= 6  # of the last video only: a frame, its judgement, its timer


def test_cuts_refined_on_all_frames(spark):
    rows = [(1, t, v) for t, v in clip((21, 44, 58), 75)]
    whole = spark.createDataFrame(rows, "video long, t double, v array<double>")
    found = spark.createDataFrame([(1, 0.8, 0.6, 1.0), (1, 1.8, 1.6, 2.0), (1, 2.3, 2.2, 2.4), (1, 9.0, 8.0, 10.0)], "video long, time double, lo double, hi double")
    got = sorted(r.time for r in video.refine_cuts(found, whole).collect())
    assert len(got) == 4
    assert all(c / 25 - 1 / 25 - 1 / 60 <= t <= c / 25 + 1 / 60 for c, t in zip((21, 44, 58), got, strict=False))
    assert got[3] == 9.0  # no frames there


def test_rate_limit_stream_as_in_batch(spark, tmp_path, rocksdb):
    import datetime as dt

    rng, t0 = random.Random(1), dt.datetime(2024, 1, 1)
    times = sorted(rng.sample(range(2000), 80))
    rows = [(i % 3, t0 + dt.timedelta(seconds=s), i) for i, s in enumerate(times)]
    schema = "client int, ts timestamp, id int"
    want = {r.id: (r.allowed, r.retry_after) for r in rate_limit.decide(spark.createDataFrame(rows, schema), "client", "ts", "id", 4, 300.0).collect()}
    opened, plain = {}, {}
    for c, ts, i in rows:
        s = ts.timestamp()
        if c not in opened or s >= opened[c][0] + 300:
            opened[c] = [s, 0]
        opened[c][1] += 1
        ok = opened[c][1] <= 4
        plain[i] = (ok, 0 if ok else int(opened[c][0] + 300 - s))
    assert want == plain
    last = (9, t0 + dt.timedelta(days=1), 99)
    for i, part in enumerate([*(rows[k : k + 20] for k in range(0, 80, 20)), [last]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got, progress = drained(rate_limit.decide_stream(stream, "client", "ts", "id", 4, 300.0), tmp_path / "c")
    assert {r.id: (r.allowed, r.retry_after) for r in got if r.client != 9} == want
    assert progress["stateOperators"][0]["numRowsTotal"] <= 3  # the windows of all but the last client have ended


def test_stream_dedupe_and_autosave(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(milliseconds=m)) for m in (0, 0, 40, 40, 80, 5000)]
    spark.createDataFrame(rows, "video long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video long, ts timestamp").parquet(str(tmp_path / "in"))
    q = stream_frames.distinct_frames(stream).writeStream.format("memory").queryName("frames").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("frames").count() == 4
    saves = stream_frames.autosaves(stream, "video", delay="0 seconds").writeStream.format("memory").queryName("saves").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    saves.awaitTermination()
    assert [r.edits for r in spark.table("saves").collect()][:1] == [5]


def test_abbreviated_versus_needs_a_word_after_it(spark):
    """An edge after "v." means that a word goes on there."""
    from pigmentum.operators import classify

    rows = [(1, "team v. other"), (2, "team v.other"), (3, "vs fc"), (4, "cup-final"), (5, "cups")]
    facts = spark.createDataFrame(rows, "pid int, all string").selectExpr("*", "1.0D aspect", "0.0D edge_density", "50.0D colorfulness", "1 lines", "0 scores", "0 statistics", "0 dates", "0 objects", "0 persons", "0 logos", "0 products")
    got = {r.pid: r.s for r in facts.select("pid", classify.scores(facts)["Sports Poster"].alias("s")).collect()}
    assert got == {1: 0.0, 2: 2.2, 3: 4.4, 4: 4.4, 5: 0.0}


def test_refined_masks_against_each_pixel():
    """Closing and opening by the element, pixel by pixel; outside the image counts for nothing."""
    element = [(y, x) for y in range(-2, 3) for x in range(-2, 3) if abs(y) < 2 or x == 0]

    def passed(m, pick):
        h, w = m.shape
        return np.array([[pick(m[y + a, x + b] for a, b in element if 0 <= y + a < h and 0 <= x + b < w) for x in range(w)] for y in range(h)])

    rng = np.random.default_rng(0)
    for shape in ((1, 1), (3, 9), (16, 16), (11, 4)):
        for share in (0.3, 0.6, 0.9):
            matte = np.where(rng.random(shape) < share, rng.integers(128, 256, shape), rng.integers(0, 128, shape))
            want = passed(passed(passed(passed(matte > 127, max), min), min), max)
            assert (kernels.refine_mask(matte) == want).all()


def test_plates_keep_known_pixels_and_fill_from_them():
    rng = np.random.default_rng(1)
    rgb = np.repeat(rng.integers(60, 90, (24, 36, 1)).astype(float), 3, axis=2)
    rgb[8:14, 10:18] = 250
    small = kernels.resample(rgb, 12, 8)
    whole, own = kernels.plate(rgb, small, kernels.luminance(small) > 127, [(27.0, 3.0, 4.0, 5.0)])
    assert (whole[own] == rgb[own]).all()
    assert not own[8:14, 10:18].any()
    assert not own[0:9, 24:33].any()
    assert 59 <= whole[~own].min() <= whole[~own].max() <= 90
    none, known = kernels.plate(rgb, small, np.zeros((8, 12), bool), [])
    assert known.all()
    assert (none == rgb).all()


def test_clips_give_what_whole_videos_give(spark):
    """Windows over clips of four frames find the steps and cuts of one window over all frames."""
    rows = [(v, i, t, x) for v, own in CLIPS.items() for i, (t, x) in enumerate(own)]
    table = spark.createDataFrame(rows, "video long, f long, t double, v array<double>")
    found = [sorted((r.video, r.f, r.time, r.lo, r.hi) for r in video.hard_cuts(video.steps(table, 16, 16, size=n), size=n).collect()) for n in (4, 1500)]
    assert found[0] == found[1]
    assert len(found[0]) > 3
