"""Scenes drawn, painted and merged many at a time, as one by one."""

import random

import numpy as np
import pyarrow as pa

from pigmentum.operators import kernels, raster
from pigmentum.plans import QUERIES

D = "/root/testdata/sf0.001"


def test_scenes_side_by_side(spark, monkeypatch):
    """Canvases and pictures of all sizes, layers over the edges, scenes without layers; a large canvas is drawn by itself."""
    rng, layers = random.Random(4), []
    for pid in range(40):
        for z in range(rng.choice([0, 1, 3, 9])):
            w, h = rng.randrange(1, 5), rng.randrange(1, 4)
            picture = (w, h, bytearray(rng.randrange(256) for _ in range(4 * w * h))) if rng.random() < 0.5 else None
            kind = rng.choice(["shape", "image", "text"])
            layers.append((pid, z, kind, rng.uniform(-90, 200), rng.uniform(-90, 200), rng.uniform(0.1, 150), rng.uniform(0.1, 150), rng.choice([None, 0.0, 90.0, rng.uniform(-400, 400)]), rng.choice([None, 1.0, rng.random()]), rng.random() < 0.9, rng.choice([None, 0.0, 7.5, 900.0]), rng.randrange(256), None, rng.randrange(256), picture))
    names = "pid int, z int, type string, x double, y double, w double, h double, rotation double, opacity double, visible boolean, radius double, r int, g int, b int, picture struct<w:int,h:int,data:binary>"
    scenes = spark.createDataFrame([(p, rng.choice([1, 30, 77, 140]), rng.choice([1, 40, 95]), p, 9, 250) for p in range(42)], "pid int, width int, height int, r int, g int, b int").coalesce(2)
    table = spark.createDataFrame(layers, names)
    of = lambda: sorted(raster.render(scenes, table, 0.7).collect())
    together = of()
    monkeypatch.setattr(raster, "SIDE_BY_SIDE", 0)
    assert len(together) == 42 and together == of()
    for r in together:
        assert r.sums == np.frombuffer(r.data, np.uint8).reshape(-1, 3).sum(axis=0).tolist()


def test_painted_as_over():
    rng = random.Random(9)
    names, rows = ["x", "y", "w", "h", "opacity", "r", "g", "b"], []
    for _ in range(30):
        layers = [(rng.randrange(-9, 30), rng.randrange(-9, 30), rng.randrange(1, 20), rng.randrange(1, 20), rng.random(), *(rng.randrange(256) for _ in "rgb")) for _ in range(rng.choice([0, 2, 5]))]
        rows.append([dict(zip(names, x, strict=True)) for x in layers])
    kind = pa.list_(pa.struct([(n, pa.float64() if n == "opacity" else pa.int32()) for n in names]))
    got = raster.painted(pa.array(rows, kind), 24, 18)
    for have, layers in zip(got, rows, strict=True):
        canvas = np.full((18, 24, 3), 255.0)
        for q in layers:
            canvas = kernels.over(canvas, np.tile(np.array([q["r"], q["g"], q["b"], 255.0]), (q["h"], q["w"], 1)), q["x"], q["y"], q["opacity"])
        assert (have == canvas).all()


def test_regions_merged_many_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    for most in (kernels.MANY, 20):
        monkeypatch.setattr(kernels, "MANY", most)
        count = rng.integers(0, 12, 300)
        n = int(count.sum())
        g = {c: rng.integers(0, 120, n).astype(float) for c in "xy"} | {c: rng.choice([2, 9, 30, 30, 60], n).astype(float) for c in "wh"}
        g |= {"area": np.trunc(g["w"] * g["h"] * 0.6), "fill": rng.choice([0.3, 0.7, 0.9], n), "skin": rng.random(n), "mean": rng.integers(0, 256, (n, 3)).astype(float)}
        stays, merged = kernels.merge_many(count, g, 3, 20000)
        rows = [{"label": i, **{c: v[i].tolist() for c, v in g.items()}} for i in range(n)]
        want = [r for e, k in zip(np.cumsum(count), count, strict=True) for r in kernels.merge_regions(rows[e - k : e], 3, 20000)]
        assert 0 < len(want) < n
        assert want == [{"label": int(i), **{c: v[i].tolist() for c, v in merged.items()}} for i in np.flatnonzero(stays)]


def test_no_python_rows(spark):
    """Scenes reach the kernels as Arrow columns, not as rows of Python objects."""
    for name in ("snk_06_render_pixels", "snk_06_render", "iter_02_merge_regions"):
        plan = QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan
        assert plan.count("l_orderkey#") and len([x for x in plan.splitlines() if "Scan parquet" in x and "l_orderkey" in x]) == 1
