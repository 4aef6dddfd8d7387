"""Queries over a video's layers take all of them, however many it has."""

import pytest

from pigmentum.plans import QUERIES


@pytest.fixture(scope="module")
def long_videos(spark, tmp_path_factory):
    """Two videos of 90 layers, one of five."""
    d = str(tmp_path_factory.mktemp("long"))
    rows = [(i * 13 % 997, i % 2) for i in range(180)] + [(2000 + 7 * i, 2) for i in range(5)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{d}/events.parquet")
    return d, rows


def layers(rows):
    """(vid, ord, t_in) as in fx_timing."""
    return [(v, o + 1, float(e % 50) / 10) for v in range(3) for o, e in enumerate(sorted(e for e, u in rows if u == v))]


def test_cut_match(spark, long_videos):
    d, rows = long_videos
    want = []
    for v in range(3):
        used = set()
        mine = [(o, t, lid) for w, lid, o, t, *_ in spans(rows) if w == v]
        for o, t, lid in mine:
            if o % 2 == 0:
                most = 0.3 if lid % 3 == 0 else 2 / 25 + 1e-3
                free = [(abs(t - s), p) for p, s, _ in mine if p % 2 == 1 and p not in used and abs(t - s) <= most]
                other = min(free)[1] if free else None
                used.add(other)
                want.append((v, o, other))
    got = sorted((r.vid, r.ord, r.other) for r in QUERIES["join_21_cut_match"](spark, d).collect())
    assert got == sorted(want) and any(o > 30 and p for _, o, p in got) and any(p is None for _, _, p in got)


def test_fit_tween(spark, long_videos):
    d, rows = long_videos
    got = QUERIES["iter_06_fit_tween"](spark, d).select("vid", "ord", "easing").collect()
    assert sorted((r.vid, r.ord) for r in got) == [(v, o) for v, o, _ in layers(rows)]
    assert {r.easing for r in got if r.ord > 3} == {"ease-out"}


def spans(rows):
    """(vid, lid, ord, t_in, t_out, y) as in fx_timing."""
    return [(v, e, o + 1, e % 50 / 10, e % 50 / 10 + 0.5 + e % 9 / 4, float(e % 100)) for v in range(3) for o, e in enumerate(sorted(e for e, u in rows if u == v))]


def test_scene_overlap(spark, long_videos):
    d, rows = long_videos
    want = []
    for v, lid, o, a, b, _ in spans(rows):
        if o % 2 == 0:
            found = [(-(min(b, d2) - max(a, c)), p, m) for w, m, p, c, d2, _ in spans(rows) if w == v and p % 2 == 1 and min(b, d2) - max(a, c) > 0]
            if found:
                want.append((v, lid, min(found)[2], round(-min(found)[0], 6)))
    got = sorted((r.vid, r.lid, r.other, round(r.overlap, 6)) for r in QUERIES["join_20_scene_overlap"](spark, d).collect())
    assert got == sorted(want) and len(got) > 80


def test_fades_and_short_scenes(spark, long_videos):
    d, rows = long_videos
    fades, cuts = [], []
    for v in range(3):
        kept = []
        mine = [(-(lid % 97) / 97, o, a * 3, 0.6 if lid % 2 == 0 else 0.9) for w, lid, o, a, _, _ in spans(rows) if w == v]
        for _, _, t, n in sorted(mine):
            if not any(abs(k - t) < max(0.5, (m + n) / 2) for k, m in kept):
                kept.append((t, n))
        times = sorted(t for t, _ in kept)
        fades += [(v, round(t, 3)) for i, t in enumerate(times) if i == 0 or t - times[i - 1] > 0.3]
        times, after = sorted({a * 4 for w, _, _, a, _, _ in spans(rows) if w == v}), 21.0
        for i in range(len(times) - 1, -1, -1):
            if not (times[i] - (times[i - 1] if i else 0.0) < 0.7 or after - times[i] < 0.7):
                cuts.append((v, round(times[i], 3)))
                after = times[i]
    for name, want in (("win_05_fade_suppression", fades), ("win_06_fold_short_scenes", cuts)):
        assert sorted((r.vid, round(r.time, 3)) for r in QUERIES[name](spark, d).collect()) == sorted(want), name


def test_caption_cues(spark, long_videos):
    d, rows = long_videos
    want, lines = [], 0
    for v in range(3):
        held = []
        for w, lid, _, a, b, y in spans(rows):
            a, b = max(0.0, a), min(5.0, b)
            if w == v and b - a >= 0.1:
                cue = next((c for c in held if abs(c[0] - a) < 0.15 and abs(c[1] - b) < 0.15), None)
                if cue is None:
                    held.append(cue := (a, b, []))
                cue[2].append((y, len(cue[2]), f"LINE {lid}"))
        want += [(v, round(a, 6), round(b, 6), "/".join(t for *_, t in sorted(x))) for a, b, x in held]
    got = QUERIES["agg_34_caption_cues"](spark, d).collect()
    assert sorted((r.vid, round(r.s, 6), round(r.e, 6), r.lines) for r in got) == sorted(want)
    srt = {r.vid: r.srt for r in QUERIES["snk_15_captions"](spark, d).collect()}
    assert all(srt[v].count("LINE") == sum(x[3].count("LINE") for x in want if x[0] == v) for v in srt)


def test_one_row_per_layer(spark, long_videos):
    d, rows = long_videos
    for name, n in (("edt_08_crossfade", 1), ("iter_07_fit_motion", 2)):
        got = QUERIES[name](spark, d).select("vid", "ord").collect()
        assert sorted((r.vid, r.ord) for r in got) == sorted((v, o) for v, _, o, *_ in spans(rows) for _ in range(n)), name
