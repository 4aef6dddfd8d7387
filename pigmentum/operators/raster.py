"""Kernels over tables of images: rows (keys, w, h, data), data being w * h * 3 bytes or an array of grey values."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Images worked on at once.
BATCH = 16


def grey_image(v, w: int, h: int) -> np.ndarray:
    """(h, w, 3) of an array of grey values, clipped to bytes."""
    g = np.clip(np.rint(np.asarray(v, float)), 0, 255).reshape(h, w)
    return np.repeat(g[..., None], 3, axis=2)


def image(row) -> np.ndarray:
    """(h, w, 3) in RGB of an image source's row, whose bytes are in BGR(A) order."""
    a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels).astype(float)
    return np.repeat(a, 3, axis=2) if row.nChannels == 1 else a[..., 2::-1]


def per_row(table: DataFrame, fn: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """mapInPandas of a function from one row to result rows, a few rows at a time because rows are images."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                yield pd.DataFrame([r for row in pdf.iloc[at : at + BATCH].itertuples(index=False) for r in fn(row)], columns=names)

    return table.mapInPandas(run, schema)


def region_rows(table: DataFrame, w: int, h: int, key: str = "f") -> DataFrame:
    """Regions of each grey image, merged to objects."""

    def one(row):
        rgb = grey_image(row.v, w, h)
        found = kernels.merge_regions(kernels.segment(rgb)["regions"], 1.0, w * h)
        return [(getattr(row, key), i, g["x"], g["y"], g["w"], g["h"], g["area"], float(g["fill"])) for i, g in enumerate(found)]

    return per_row(table.select(key, "v"), one, f"{key} bigint, n int, x int, y int, w int, h int, area int, fill double")


def cluster_rows(samples: DataFrame, k: int = 6, key: str = "vec_id") -> DataFrame:
    """(key, n, r, g, b, cnt): colour clusters of each image's samples (i, r, g, b)."""
    g = samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "r", "g", "b"))).alias("s"))

    def one(row):
        pts = np.array([[p["r"], p["g"], p["b"]] for p in row.s], float)
        return [(getattr(row, key), n, *c, count) for n, (c, count) in enumerate(kernels.kmeans(pts, k))]

    return per_row(g, one, f"{key} bigint, n int, r int, g int, b int, cnt int")


LAYER = "layer int, kind string, x int, y int, w int, h int, own int, data binary, png binary"


def salient(small: np.ndarray) -> np.ndarray:
    return kernels.segment(small)["mask"]


def layers_of(rgb: np.ndarray, boxes: list[tuple[float, float, float, float]], raster: int, mask_of: Callable[[np.ndarray], np.ndarray] = salient) -> tuple[list[tuple], np.ndarray]:
    """An image's layers (layer, kind, x, y, RGB or RGBA values), the plate first, and which of the plate's pixels are the image's own."""
    h, w = rgb.shape[:2]
    _, small_w, small_h = fitted(w, h, raster)
    small = kernels.resample(rgb, small_w, small_h)
    whole, own = kernels.plate(rgb, small, mask_of(small), boxes)
    out = [(0, "background", 0, 0, whole)]
    solid = kernels.refine_mask(kernels.luminance(rgb))
    for n, (x, y, bw, bh) in enumerate(boxes, 1):
        x0, y0, x1, y1 = max(0, int(x)), max(0, int(y)), min(w, int(np.ceil(x + bw))), min(h, int(np.ceil(y + bh)))
        if x0 < x1 and y0 < y1:
            out.append((n, "object", x0, y0, np.dstack([rgb, solid * 255.0])[y0:y1, x0:x1]))
    return out, own


def scene_layers(images: DataFrame, boxes: DataFrame, w: int, h: int, raster: int, mask_of: Callable[[np.ndarray], np.ndarray] = salient, key: str = "f") -> DataFrame:
    """(key, layer, kind, x, y, w, h, own, data, png): an image's background plate, layer 0, and a cut-out of each box.

    `images` has the key and grey values v of w x h; `boxes` the key, ord, x, y, w, h of detected
    elements, whose number per image is bounded by the detector. The longest side of the raster
    that masks are made on is `raster` pixels. data holds RGB bytes of the plate and RGBA bytes of
    a cut-out, row by row; own counts the plate's pixels that are the image's, and a cut-out's
    opaque ones. Boxes reaching over the image are clipped to it, those outside have no row.
    """
    listed = boxes.groupBy(F.col(key).alias("_of")).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("boxes"))
    joined = images.select(key, "v").join(listed, F.col(key).eqNullSafe(F.col("_of")), "left").select(key, "v", "boxes")

    def one(row):
        layers, own = layers_of(grey_image(row.v, w, h), [tuple(b[c] for c in "xywh") for b in (row.boxes if row.boxes is not None else [])], raster, mask_of)
        count = lambda a: int((a[..., 3] > 0).sum() if a.shape[-1] == 4 else own.sum())
        pack = lambda a: np.ascontiguousarray(a).astype(np.uint8).tobytes()
        return [(getattr(row, key), n, kind, x, y, a.shape[1], a.shape[0], count(a), pack(a), kernels.png(a)) for n, kind, x, y, a in layers]

    return per_row(joined, one, f"{key} {dict(images.dtypes)[key]}, {LAYER}")


#: Longest side an image is worked at, width of its thumbnail, longest sides of its rasters.
LONGEST, THUMBNAIL, RASTERS = 2400, 480, (360, 1800)


def fitted(w: int, h: int, longest: int) -> tuple[float, int, int]:
    """Scale (source pixels a raster pixel, 1 or more) and size of an image whose longer side is to be at most `longest`."""
    scale = max(1.0, max(w, h) / longest)
    return scale, max(1, int(w / scale + 0.5)), max(1, int(h / scale + 0.5))


def normalise(images: DataFrame, key: str = "origin", longest: int = LONGEST, thumbnail: int = THUMBNAIL, rasters: tuple[int, ...] = RASTERS) -> DataFrame:
    """(key, orig_w, orig_h, w, h, original, thumb_w, thumb_h, thumbnail, rasters) of images as the image source gives them.

    An image is reduced to its working size by area means and rounded to bytes; thumbnail and rasters
    are made of that, none is ever enlarged. original and thumbnail are PNG files, rasters have longest,
    scale, w, h and RGB bytes row by row. Alpha is dropped. Rows without data, or whose data isn't of their size, have no result.
    One image at a time is in memory as numbers; how many are in a batch as bytes is the session's Arrow limit.
    """

    def one(row):
        if row.data is None or not row.width or not row.height or len(row.data) != row.width * row.height * row.nChannels:
            return []
        rgb = image(row)
        _, w, h = fitted(row.width, row.height, longest)
        byte = lambda a: np.floor(np.clip(a, 0, 255) + 0.5).astype(np.uint8)
        work = byte(kernels.resample(rgb, w, h))
        wide = work.astype(float)
        tw = min(thumbnail, w)
        th = max(1, int(tw * (h / w) + 0.5))
        sizes = [(n, *fitted(w, h, n)) for n in rasters]
        made = [{"longest": n, "scale": s, "w": rw, "h": rh, "data": byte(kernels.resample(wide, rw, rh)).tobytes()} for n, s, rw, rh in sizes]
        return [(getattr(row, key), int(row.width), int(row.height), w, h, kernels.png(work), tw, th, kernels.png(byte(kernels.resample(wide, tw, th))), made)]

    out = f"{key} {dict(images.dtypes)[key]}, orig_w int, orig_h int, w int, h int, original binary, thumb_w int, thumb_h int, thumbnail binary, rasters array<struct<longest:int,scale:double,w:int,h:int,data:binary>>"
    return per_row(images.select(key, "width", "height", "nChannels", "data"), one, out)


def _draw(canvas: np.ndarray, layer, scale: float) -> None:
    """One layer on a canvas of numbers: pixels whose centre lies in its turned, rounded rectangle are blended."""
    w, h = layer["w"], layer["h"]
    turn, reach = math.radians(layer["rotation"]), math.hypot(w, h) / 2 + 1 / scale
    cx, cy = layer["x"] + w / 2, layer["y"] + h / 2
    cut = lambda c, n: slice(max(0, math.floor((c - reach) * scale)), max(0, min(n, math.ceil((c + reach) * scale))))
    rows, cols = cut(cy, canvas.shape[0]), cut(cx, canvas.shape[1])
    dx = (np.arange(cols.start, max(cols.start, cols.stop)) + 0.5)[None, :] / scale - cx
    dy = (np.arange(rows.start, max(rows.start, rows.stop)) + 0.5)[:, None] / scale - cy
    u, v = dx * math.cos(turn) + dy * math.sin(turn), dy * math.cos(turn) - dx * math.sin(turn)
    inside = (u >= -w / 2) & (u < w / 2) & (v >= -h / 2) & (v < h / 2)
    round_ = min(layer["radius"] or 0.0, w / 2, h / 2) if layer["type"] == "shape" else 0.0
    if round_ > 0:
        qx, qy = np.maximum(np.abs(u) - (w / 2 - round_), 0), np.maximum(np.abs(v) - (h / 2 - round_), 0)
        inside &= qx * qx + qy * qy <= round_ * round_
    colour, alpha = np.array([layer["r"], layer["g"], layer["b"]], float), np.full(inside.shape, float(layer["opacity"]))
    if (picture := layer["picture"]) is not None:
        ph, pw = int(picture["h"]), int(picture["w"])  # as floats where other layers have no picture
        rgba = np.frombuffer(picture["data"], np.uint8).reshape(ph, pw, 4).astype(float)
        at = lambda c, side, n: np.clip(np.floor((c + side / 2) / side * n), 0, n - 1).astype(int)
        seen = rgba[at(v, h, ph), at(u, w, pw)]
        colour, alpha = seen[..., :3], alpha * (seen[..., 3] / 255)
    a = np.where(inside, alpha, 0.0)[..., None]
    canvas[rows, cols] = canvas[rows, cols] * (1 - a) + colour * a


def _draw_many(canvas: np.ndarray, start: np.ndarray, side: tuple[np.ndarray, np.ndarray], q: dict[str, np.ndarray], scale: float) -> None:
    """Layers on canvases as by `_draw`, each on a canvas of its own; canvases of `side` (w, h) lie one after the other, from `start` on."""
    w, h = q["w"], q["h"]
    reach = np.hypot(w, h) / 2 + 1 / scale
    cx, cy = q["x"] + w / 2, q["y"] + h / 2
    cut = lambda c, n: (np.clip(np.floor((c - reach) * scale), 0, n).astype(int), np.clip(np.ceil((c + reach) * scale), 0, n).astype(int))
    (top, bottom), (left, right) = cut(cy, side[1]), cut(cx, side[0])
    of, py, px = kernels.rectangles(top, left, bottom, right)
    dx, dy, cos, sin = (px + 0.5) / scale - cx[of], (py + 0.5) / scale - cy[of], q["cos"][of], q["sin"][of]
    u, v, half_w, half_h = dx * cos + dy * sin, dy * cos - dx * sin, (w / 2)[of], (h / 2)[of]
    inside = (u >= -half_w) & (u < half_w) & (v >= -half_h) & (v < half_h)
    round_ = np.where(q["shape"], np.minimum(np.minimum(q["radius"], w / 2), h / 2), 0.0)
    if (round_ > 0).any():
        r = round_[of]
        qx, qy = np.maximum(np.abs(u) - (half_w - r), 0), np.maximum(np.abs(v) - (half_h - r), 0)
        inside &= ~(r > 0) | (qx * qx + qy * qy <= r * r)
    seen = np.flatnonzero(inside)
    of, u, v = of[seen], u[seen], v[seen]
    at = start[of] + py[seen] * side[0][of] + px[seen]
    colour, alpha = q["rgb"][of], q["opacity"][of]
    if len(p := np.flatnonzero(q["picture"][of] >= 0)):
        k = of[p]
        to = lambda c, side, n: np.clip(np.floor((c + side / 2) / side * n), 0, n - 1).astype(int)
        pixel = q["picture"][k] + 4 * (to(v[p], h[k], q["picture_h"][k]) * q["picture_w"][k] + to(u[p], w[k], q["picture_w"][k]))
        colour[p] = q["bytes"][pixel[:, None] + np.arange(3)]
        alpha[p] = alpha[p] * (q["bytes"][pixel + 3] / 255)
    a = alpha[:, None]
    canvas[at] = canvas[at] * (1 - a) + colour * a


FIELDS = ["z", "type", "x", "y", "w", "h", "rotation", "opacity", "radius", "r", "g", "b", "picture"]
#: Pixels of the canvases that are drawn side by side; a larger canvas is drawn by itself.
SIDE_BY_SIDE = 1 << 16


def listed(layers: DataFrame, key: str = "pid") -> DataFrame:
    """(key, layers): each scene's layers that are drawn, bottom to top. See `render`."""
    shown = F.expr("visible AND w > 0 AND h > 0 AND x IS NOT NULL AND y IS NOT NULL AND (type <> 'text' OR picture IS NOT NULL)")
    zero = {c: F.coalesce(c, F.lit(d)) for c, d in (("rotation", 0.0), ("opacity", 1.0), ("r", 0), ("g", 0), ("b", 0))}
    return layers.withColumns(zero).groupBy(key).agg(F.sort_array(F.collect_list(F.when(shown, F.struct(*FIELDS)))).alias("layers"))


def _numbers(column: pa.ListArray) -> dict[str, np.ndarray]:
    """The numbers of all layers of a column of scenes, one after the other."""
    of = dict(zip(FIELDS, column.flatten().flatten(), strict=True))
    number = lambda c: np.asarray(of[c].cast(pa.float64()).fill_null(0), float)
    q = {c: number(c) for c in ("x", "y", "w", "h", "opacity", "radius")}
    turn = [math.radians(t) for t in number("rotation").tolist()]
    q |= {"cos": np.array([math.cos(t) for t in turn]), "sin": np.array([math.sin(t) for t in turn])}
    q |= {"rgb": np.stack([number(c) for c in "rgb"], axis=1), "shape": np.asarray(pc.equal(of["type"], "shape").fill_null(False))}
    w, h, data = of["picture"].flatten()
    size = np.asarray(pc.binary_length(data).fill_null(0)).astype(np.int64)
    q |= {"picture": np.where(np.asarray(of["picture"].is_valid()), np.cumsum(size) - size, -1), "bytes": np.frombuffer(b"".join(data.drop_null().to_pylist()), np.uint8)}
    return q | {"picture_w": np.asarray(w.fill_null(0)).astype(np.int64), "picture_h": np.asarray(h.fill_null(0)).astype(np.int64)}


def draw(rows: DataFrame, scale: float = 1.0, key: str = "pid") -> DataFrame:
    """`render` of scenes (key, width, height, r, g, b, layers) that have their layers listed.

    Small canvases lie side by side in one array and get their lowest layers together, then their second ones, and so on.
    """

    def canvases(b: pa.RecordBatch, w: np.ndarray, h: np.ndarray, count: np.ndarray, q: dict[str, np.ndarray], first: np.ndarray):
        """(scenes from, to, their pixels in rows of RGB), a few scenes at a time."""
        ground = np.stack([np.asarray(b.column(c), float) for c in "rgb"], axis=1)
        size, each = w * h, {k: v for k, v in q.items() if k != "bytes"}
        at = 0
        while at < len(size):
            end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), SIDE_BY_SIDE, "right")))
            canvas = np.repeat(ground[at:end], size[at:end], axis=0)
            if size[at] > SIDE_BY_SIDE:
                whole = canvas.reshape(h[at], w[at], 3)
                for layer in b.column("layers")[at].as_py() or []:
                    _draw(whole, layer, scale)
            else:
                start, n = np.cumsum(size[at:end]) - size[at:end], count[at:end]
                for k in range(int(n.max())):
                    scenes = np.flatnonzero(n > k)
                    some = {c: v[first[at + scenes] + k] for c, v in each.items()}
                    _draw_many(canvas, start[scenes], (w[at + scenes], h[at + scenes]), some | {"bytes": q["bytes"]}, scale)
            yield at, end, np.floor(np.clip(canvas, 0, 255) + 0.5).astype(np.uint8)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, h = (np.maximum(1, (np.asarray(b.column(c), float) * scale + 0.5).astype(int)) for c in ("width", "height"))
            count = np.asarray(pc.list_value_length(b.column("layers")).fill_null(0)).astype(int)
            for at, end, pixels in canvases(b, w, h, count, _numbers(b.column("layers")), np.cumsum(count) - count):
                size = w[at:end] * h[at:end]
                to = np.cumsum(size)
                scenes = [pixels[e - n : e].reshape(y, x, 3) for e, n, x, y in zip(to.tolist(), size.tolist(), w[at:end].tolist(), h[at:end].tolist(), strict=True)]
                sums = np.add.reduceat(pixels, to - size, axis=0, dtype=np.int64)
                columns = [b.column(key).slice(at, end - at), *(pa.array(x[at:end], pa.int32()) for x in (w, h, count)), pa.array([x.tobytes() for x in scenes], pa.binary()), pa.array([kernels.png(x) for x in scenes], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.arange(end - at + 1) * 3, pa.int32()), pa.array(sums.ravel()))], [key, "w", "h", "drawn", "data", "png", "sums"])

    rows = rows.select(key, "width", "height", "r", "g", "b", "layers")
    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, w int, h int, drawn int, data binary, png binary, sums array<long>")


def render(scenes: DataFrame, layers: DataFrame, scale: float = 1.0, key: str = "pid") -> DataFrame:
    """(key, w, h, drawn, data, png, sums): each scene (key, width, height, r, g, b of its background) with its visible layers, bottom to top.

    Layers have (key, z, type, x, y, w, h, rotation in degrees about the centre, opacity, visible, radius,
    r, g, b, picture struct<w, h, data> of RGBA bytes, null for a plain fill). `scale` is canvas pixels a
    scene pixel; sums are those of the canvas's red, green and blue. Text is not drawn: there are no glyphs on a cluster;
    its layers come with a picture or stay out. Layers of no size, or with a null box, are skipped. A scene's layers are one row, its canvas one array.
    """
    found = listed(layers, key).withColumnRenamed(key, "_of")
    return draw(scenes.join(found, F.col(key) == F.col("_of"), "left").drop("_of"), scale, key)


def painted(found: pa.ListArray, w: int, h: int) -> np.ndarray:
    """Canvases (scene, h, w, 3), white under each scene's plain layers, struct<x, y, w, h in pixels, opacity, r, g, b>, bottom to top."""
    q = {f.name: np.asarray(c, float) for f, c in zip(found.type.value_type, found.flatten().flatten(), strict=True)}
    count = np.asarray(pc.list_value_length(found)).astype(int)
    first, canvas = np.cumsum(count) - count, np.full((len(count) * w * h, 3), 255.0)
    for k in range(int(count.max(initial=0))):
        on = np.flatnonzero(count > k)
        i = first[on] + k
        box, rgb = [q[c][i].astype(int) for c in "xywh"], np.stack([q[c][i] for c in "rgb"], axis=1)
        kernels.over_many(canvas, on * (w * h), (w, h), box, rgb, q["opacity"][i])
    return canvas.reshape(len(count), h, w, 3)


def paint(rows: DataFrame, w: int, h: int, key: str = "pid") -> DataFrame:
    """(key, layers, pixels): scenes with their plain layers listed (see `painted`) on canvases of w x h, how many layers and pixels were painted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, max(1, SIDE_BY_SIDE // (w * h))):
                some = b.slice(at, max(1, SIDE_BY_SIDE // (w * h)))
                canvas = painted(some.column("layers"), w, h)
                yield pa.RecordBatch.from_arrays([some.column(key), pc.list_value_length(some.column("layers")).cast(pa.int64()), pa.array([x.shape[0] * x.shape[1] for x in canvas], pa.int32())], [key, "layers", "pixels"])

    return rows.select(key, "layers").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, layers bigint, pixels int")
