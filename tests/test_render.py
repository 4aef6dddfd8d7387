"""Rendered scenes against a loop over pixels."""

import math
import random

from pigmentum.operators import raster

LAYERS = "pid int, z int, type string, x double, y double, w double, h double, rotation double, opacity double, visible boolean, radius double, r int, g int, b int, picture struct<w:int,h:int,data:binary>"


def pixel(layers, px, py, ground):
    c = [float(v) for v in ground]
    for q in layers:
        dx, dy, t = px - (q["x"] + q["w"] / 2), py - (q["y"] + q["h"] / 2), math.radians(q["rotation"])
        u, v = dx * math.cos(t) + dy * math.sin(t), dy * math.cos(t) - dx * math.sin(t)
        if not (-q["w"] / 2 <= u < q["w"] / 2 and -q["h"] / 2 <= v < q["h"] / 2):
            continue
        rad = min(q["radius"], q["w"] / 2, q["h"] / 2) if q["type"] == "shape" else 0
        if math.hypot(max(abs(u) - (q["w"] / 2 - rad), 0), max(abs(v) - (q["h"] / 2 - rad), 0)) > rad > 0:
            continue
        colour, a = (q["r"], q["g"], q["b"]), q["opacity"]
        if q["picture"]:
            pw, ph, data = q["picture"]
            at = 4 * (int((v + q["h"] / 2) / q["h"] * ph) * pw + int((u + q["w"] / 2) / q["w"] * pw))
            colour, a = data[at : at + 3], a * data[at + 3] / 255
        c = [s * (1 - a) + k * a for s, k in zip(c, colour, strict=True)]
    return bytes(math.floor(v + 0.5) for v in c)


def test_render_as_by_pixels(spark):
    rng, rows = random.Random(6), []
    for pid in range(6):
        for z in range(7):
            kind = rng.choice(["shape", "image"])
            picture = (3, 2, bytearray(rng.randrange(256) for _ in range(24))) if kind == "image" else None
            rows.append((pid, z, kind, rng.uniform(-20, 60), rng.uniform(-20, 40), rng.uniform(1, 50), rng.uniform(1, 50), rng.uniform(-180, 360), rng.random(), True, rng.uniform(0, 30), rng.randrange(256), rng.randrange(256), rng.randrange(256), picture))
    names = [f.split()[0] for f in LAYERS.split(", ")]
    hidden = [(0, 9, "shape", 0.0, 0.0, 60.0, 40.0, 0.0, 1.0, False, 0.0, 1, 2, 3, None), (0, 10, "text", 0.0, 0.0, 60.0, 40.0, 0.0, 1.0, True, 0.0, 1, 2, 3, None), (0, 11, "shape", 0.0, 0.0, 0.0, 40.0, 0.0, 1.0, True, 0.0, 1, 2, 3, None), (0, 12, "shape", None, 0.0, 9.0, 40.0, 0.0, 1.0, True, 0.0, 1, 2, 3, None), (0, 13, "shape", 500.0, 500.0, 9.0, 40.0, 0.0, 1.0, True, 0.0, 1, 2, 3, None)]
    mixed = rows + hidden
    rng.shuffle(mixed)
    scenes = spark.createDataFrame([(p, 60, 40, 10, 200, 30) for p in range(7)], "pid int, width int, height int, r int, g int, b int")
    got = {r.pid: r for r in raster.render(scenes, spark.createDataFrame(mixed, LAYERS).repartition(3), 0.5).collect()}
    assert sorted(got) == list(range(7)) and bytes(got[6].data) == bytes([10, 200, 30]) * 600 and got[6].drawn == 0
    for pid in range(6):
        mine = [dict(zip(names, r, strict=True)) for r in rows if r[0] == pid]
        want = b"".join(pixel(mine, (j + 0.5) / 0.5, (i + 0.5) / 0.5, (10, 200, 30)) for i in range(20) for j in range(30))
        assert (got[pid].w, got[pid].h) == (30, 20) and bytes(got[pid].data) == want
    assert got[1].drawn == 7 and got[0].drawn == 8  # one of them lies outside the canvas
    assert bytes(got[1].png)[1:4] == b"PNG"
