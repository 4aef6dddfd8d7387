"""What the third review found: work that grew too fast, and values at the edge of a rule."""

import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pigmentum.functions import color
from pigmentum.operators import evaluation, kernels, layout, spatial
from pigmentum.plans import SQL, q_joins


def test_fits_of_many_layers():
    """Layers that share their times are one fit; 20,000 alone take minutes."""
    q, rng = kernels.eased("ease-out", np.linspace(0.1, 0.9, 7)), np.random.default_rng(1)
    t, hidden = 2 + np.linspace(0.05, 0.45, 7), rng.uniform(-30, 30, (20_000, 2))
    moves = np.concatenate([(1 - q)[:, None] * hidden[:, None], np.ones((len(hidden), 7, 1))], 2)
    begin = time.process_time()
    tw = kernels.fit_tweens(t, q, moves, (2.0, 2.01), (2.49, 2.5), True)
    assert time.process_time() - begin < 20
    assert set(tw["easing"]) == {"ease-out"} and set(tw["t0"]) == {2.0} and set(tw["t1"]) == {2.5}
    assert np.abs(np.stack([tw["dx"], tw["dy"]], 1) - hidden).max() < 1e-6


def test_motions_of_many_layers():
    """Noisy layers at once get the keys of each alone."""
    rng, t, o = np.random.default_rng(2), np.arange(12) / 25, np.array([0, 0, 0.2, 0.5, 0.8, 1, 1, 1, 0.7, 0.3, 0, 0])
    moves = np.concatenate([rng.normal(0, 8, (50, 12, 2)), 1 + rng.normal(0, 0.1, (50, 12, 1))], 2)
    keys = kernels.fit_motions(t, o, o == 1, moves, 5.0, 1.0, 17)
    assert len(keys) == 4
    for i in range(50):
        alone = kernels.fit_motion(np.column_stack([t, moves[i], o, o == 1]), 5.0, 1.0, 17)
        assert alone == [{f: v[i] for f, v in k.items()} for k in keys]


def test_nearest_in_time(spark):
    """Any number of rows of one key, empty cells between, repeated times; no window reads its rows anew for each row."""
    rng = np.random.default_rng(3)
    points = [(k, float(t), i) for k in (0, 1) for i, t in enumerate([*rng.choice(np.arange(-40, 90, 0.5), 150), 400.0, 400.0])]
    asked = [(k, n, float(t)) for n, (k, t) in enumerate(zip(rng.integers(0, 3, 400), rng.choice(np.arange(-60, 450, 0.25), 400), strict=True))]
    asked = [(int(k), n, t) for k, n, t in asked]
    left, right = spark.createDataFrame(asked, "k int, n int, t double"), spark.createDataFrame(points, "k int, t double, i int")
    got = spatial.nearest_in_time(left, right, ["k"], "t", "i", "near")
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    want = [(n, min(((abs(p - t), p, i) for j, p, i in points if j == k), default=(0, 0, None))[2]) for k, n, t in asked]
    assert sorted((r.n, r.near) for r in got.collect()) == sorted(want)


def test_skin_on_the_sides_of_the_box(spark):
    """Colours whose Cr is 173 exactly are inside, as in the SQL of both queries; in doubles some are a hair above."""
    edge = [(178, 88, 88), (187, 97, 97), (196, 106, 106), (243, 153, 153), (252, 162, 162), (253, 162, 162), (200, 120, 100)]
    df = spark.createDataFrame([(i, 0, *c) for i, c in enumerate(edge)], "vec_id long, i int, r int, g int, b int")
    got = [x.skin for x in df.select("vec_id", color.is_skin(*map(F.col, "rgb")).alias("skin")).orderBy("vec_id").collect()]
    db = duckdb.connect()
    db.execute("create table fx_samples as select * from (values " + ", ".join(str((i, 0, *c)) for i, c in enumerate(edge)) + ") t(vec_id, i, r, g, b)")
    skin = SQL["sc_07_skin_test"]
    assert got == [x[0] for x in db.execute(skin[skin.rindex("SELECT vec_id, i") :].replace("SELECT vec_id, i,", "SELECT") + " ORDER BY vec_id").fetchall()]
    assert got == [True] * 5 + [False, True]
    assert kernels.skin(np.array([edge])).tolist() == [got]
    box = SQL["agg_28_skin_box"]
    assert sorted(x[0] for x in db.execute(box[box.rindex("SELECT vec_id, min") :]).fetchall()) == [i for i, inside in enumerate(got) if inside]


def test_cut_match_of_many_stretches(spark):
    """Stretches are matched many at a time, with no pandas group each; one without wanted cuts has no rows."""
    rng = np.random.default_rng(4)
    want = [(v, 2 * o, float(t), "fade" if o % 3 == 0 else "cut") for v in range(40) for o, t in enumerate(rng.choice(np.arange(0, 60, 0.05), 12))]
    have = [(v, 2 * o + 1, float(t)) for v in range(45) for o, t in enumerate(rng.choice(np.arange(0, 60, 0.05), 200))]
    df = evaluation.match_cuts(spark.createDataFrame(want, "v int, ord int, t double, kind string"), spark.createDataFrame(have, "v int, ord int, t double"), "v", 25.0)
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    used, expected = set(), []
    for v, o, t, kind in want:
        free = [(abs(s - t), p) for w, p, s in have if w == v and (v, p) not in used and abs(s - t) <= (0.3 if kind == "fade" else 2 / 25 + 1e-3)]
        other = min(free)[1] if free else None
        used.add((v, other))
        expected.append((v, o, other))
    assert sorted((r.v, r.ord, r.other) for r in df.collect()) == sorted(expected)


def test_text_share(spark):
    """Shares of overlapping texts as points of the grid, by comparison with bits instead of a look at every text for every point."""
    rng = np.random.default_rng(5)
    rows = [(p, o, *map(float, rng.integers(0, 300, 2)), *map(float, rng.integers(60, 260, 2)), "external" if rng.random() < 0.4 else "local") for p in range(30) for o in range(8)]
    df = spark.createDataFrame(rows, "pid int, ord int, x double, y double, w double, h double, source string")
    got = q_joins.join14(df, df)
    plan = got._jdf.queryExecution().toString()
    assert "exists(" not in plan and "lambda" not in plan
    want = []
    for p, o, x, y, w, h, side in rows:
        if side == "local":
            texts = [r[2:6] for r in rows if r[0] == p and r[6] == "external"]
            hits = sum(any(a <= x + (i + 0.5) * w / 16 <= a + c and b - 0.6 * d <= y + (j + 0.5) * h / 16 <= b + 1.6 * d for a, b, c, d in texts) for i in range(16) for j in range(16))
            want.append((p, o, np.floor(hits / 256 * 1e6 + 0.5) / 1e6))
    assert sorted((r.pid, r.ord, r.share) for r in got.collect()) == sorted(want) and len({w[2] for w in want}) > 20


def test_symmetry(spark, monkeypatch):
    """Cells of elements exist in tasks only: no shuffle on them. Designs of any length, also beyond a slice, and boxes over the edges."""
    monkeypatch.setattr(layout, "ELEMENTS", 7)
    rng = np.random.default_rng(6)
    rows = [(d, *map(float, rng.integers(-50, 500, 2)), *map(float, rng.integers(5, 260, 2))) for d in range(40) for _ in range(1 + d % 13)] + [(40, 700.0, 10.0, 5.0, 5.0)]
    df = layout.symmetry(spark.createDataFrame(rows, "pid int, x double, y double, w double, h double"), (600.0, 600.0))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    want = []
    for d in range(41):
        cover = lambda g, a, n: max(0.0, min((g + 1) * 50.0, a + n) - max(g * 50.0, a))
        o = np.array([[min(1.0, sum(cover(i, x, w) * cover(j, y, h) / 2500 for p, x, y, w, h in rows if p == d)) for i in range(12)] for j in range(12)])
        a, b = o[:, :6], o[:, ::-1][:, :6]
        share = max(0.0, 1 - np.abs(a - b).sum() / (a + b).sum()) if o.sum() > 0 else 1.0
        want.append((d, np.floor((share + 1e-9) * 100 + 0.5) / 100))
    assert sorted((r.pid, r.symmetry) for r in df.collect()) == want
