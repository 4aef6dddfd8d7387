"""Array kernels over one image or one video scene, in numpy.

Images are arrays (h, w, 3) of 0 to 255, masks (h, w) of bool. The wrappers in `raster` run them
over tables of images in Arrow batches; nothing here knows about Spark.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

from ..functions.easing import BISECTIONS, CURVES


#: Pairs of regions that are looked at together.
MANY = 1 << 18


def luminance(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def sobel(lum: np.ndarray) -> np.ndarray:
    """Gradient magnitude of interior pixels over its maximum."""
    out = np.zeros(lum.shape)
    if min(lum.shape) < 3:
        return out
    smooth_y = lum[:-2] + 2 * lum[1:-1] + lum[2:]
    smooth_x = lum[:, :-2] + 2 * lum[:, 1:-1] + lum[:, 2:]
    out[1:-1, 1:-1] = np.hypot(smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2])
    return out / max(out.max(), 1e-6)


def _windowed(a: np.ndarray, radius: int, fill: float, pick) -> np.ndarray:
    """A square window's extreme, one axis after the other; outside counts as `fill`."""
    for axis in (1, 0):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (radius, radius)
        a = pick(np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, constant_values=fill), 2 * radius + 1, axis=axis), -1)
    return a


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    return _windowed(mask.astype(np.uint8), radius, 0, np.max).astype(bool)


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    return _windowed(mask.astype(np.uint8), radius, 1, np.min).astype(bool)


def ellipse(a: np.ndarray, reach: tuple[int, ...], fill: float, pick) -> np.ndarray:
    """The extreme over a symmetric element: row by row from its middle, how far it reaches to either side.

    A union of row spans: one running extreme per different reach, then one per row. Outside counts as `fill`.
    """
    h, rows = a.shape[0], {}
    for n in set(reach):
        p = np.pad(a, ((0, 0), (n, n)), constant_values=fill)
        rows[n] = np.pad(pick(np.lib.stride_tricks.sliding_window_view(p, 2 * n + 1, axis=1), -1), ((len(reach) - 1, len(reach) - 1), (0, 0)), constant_values=fill)
    at = lambda d: rows[reach[abs(d)]][len(reach) - 1 + d : len(reach) - 1 + d + h]
    return pick(np.stack([at(d) for d in range(1 - len(reach), len(reach))]), 0)


# An element of 5 x 5, its middle three rows whole, one pixel above and below; and where a matte is solid.
ELEMENT, SOLID = (2, 2, 0), 127


def refine_mask(matte: np.ndarray) -> np.ndarray:
    """A matte's solid pixels, closed, then opened, by the element."""
    grow = lambda m: ellipse(m, ELEMENT, 0, np.max)
    shrink = lambda m: ellipse(m, ELEMENT, 1, np.min)
    solid = (matte > SOLID).astype(np.uint8)
    return grow(shrink(shrink(grow(solid)))).astype(bool)


def box_blur(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a square window; the border's values repeat outside."""
    n = 2 * radius + 1
    for axis in (1, 0):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (radius, radius)
        a = np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, mode="edge"), n, axis=axis).mean(-1)
    return a


def otsu(values: np.ndarray, bins: int = 64) -> float:
    """The threshold of values 0 to 1 that parts them best: the first bin with the largest variance between both sides."""
    hist = np.bincount(np.minimum(bins - 1, (values.ravel() * bins).astype(int)), minlength=bins).astype(float)
    i = np.arange(bins)
    low, mass = np.cumsum(hist), np.cumsum(i * hist)
    high = low[-1] - low
    ok = (low > 0) & (high > 0)
    if not ok.any():
        return 0.5
    apart = np.where(ok, low * high * (mass / np.maximum(low, 1) - (mass[-1] - mass) / np.maximum(high, 1)) ** 2, -1)
    return (int(apart.argmax()) + 0.5) / bins if apart.max() > 0 else 0.5


def redmean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    m = (a[..., 0] + b[..., 0]) / 2
    d = (a - b) ** 2
    return np.sqrt((2 + m / 256) * d[..., 0] + 4 * d[..., 1] + (2 + (255 - m) / 256) * d[..., 2])


def kmeans(samples: np.ndarray, k: int, rounds: int = 12) -> list[tuple[tuple[int, ...], int]]:
    """Deterministic clusters ((r, g, b), count), most frequent first.

    The first centre is the middle sample, further ones are those of every third sample that lie
    farthest from the centres so far. Counts are those of the last assignment, before the last move.
    """
    if not len(samples):
        return []
    centres = [samples[len(samples) // 2].astype(float)]
    some = samples[::3]
    near = redmean(some, centres[0])
    while len(centres) < min(k, len(samples)):
        centres.append(some[int(near.argmax())].astype(float))
        near = np.minimum(near, redmean(some, centres[-1]))
    c = np.array(centres)
    counts = np.zeros(len(c), int)
    for _ in range(rounds):
        own = np.argmin([redmean(samples, x) for x in c], axis=0)
        counts = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, weights=samples[:, j], minlength=len(c)) for j in range(3)], axis=1)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    found = [(tuple(np.floor(c[i] + 0.5).astype(int).tolist()), int(counts[i])) for i in range(len(c)) if counts[i]]
    return sorted(found, key=lambda x: -x[1])


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components numbered from 1 in reading order, by joining runs of neighbouring rows."""
    parent: list[int] = [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, above = np.zeros(mask.shape, int), []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        runs = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            hits = [find(n) for s, e, n in above if s < b and e > a]
            if hits:
                n = min(hits)
                for h in hits:
                    parent[h] = n
            else:
                n = len(parent)
                parent.append(n)
            out[y, a:b] = n
            runs.append((a, b, n))
        above = runs
    roots = np.array([find(i) for i in range(len(parent))])
    names, dense = np.unique(roots[1:], return_inverse=True) if len(parent) > 1 else (np.array([]), np.array([], int))
    return np.concatenate([[0], dense + 1])[out], len(names)


def skin(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    cb, cr = 128e6 - 168736 * r - 331264 * g + 500000 * b, 128e6 + 500000 * r - 418688 * g - 81312 * b  # in millionths, as in color.is_skin
    warm = (r > 95) & (g > 40) & (b > 20) & (r > g) & (r > b) & (r - np.minimum(g, b) > 15) & (np.abs(r - g) > 15)
    return warm & (cb >= 77e6) & (cb <= 127e6) & (cr >= 133e6) & (cr <= 173e6)


def regions(rgb: np.ndarray, mask: np.ndarray, least: float = 0.0015) -> tuple[np.ndarray, list[dict]]:
    """Labels, and for each component of at least that share of the image: box, area, fill, skin share, mean colour."""
    labels, n = label(mask)
    flat = labels.ravel()
    area = np.bincount(flat, minlength=n + 1)
    tone = np.bincount(flat, weights=skin(rgb).ravel(), minlength=n + 1)
    means = np.stack([np.bincount(flat, weights=rgb[..., c].ravel(), minlength=n + 1) for c in range(3)], 1) / np.maximum(area, 1)[:, None]
    found = []
    for i in np.flatnonzero(area >= max(1, least * mask.size)):
        if i:
            ys, xs = np.nonzero(labels == i)
            x, y, w, h = int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
            found.append({"label": int(i), "x": x, "y": y, "w": w, "h": h, "area": int(area[i]), "fill": area[i] / (w * h), "skin": tone[i] / area[i], "mean": np.floor(means[i] + 0.5).astype(int).tolist()})
    return labels, found


def border_colours(rgb: np.ndarray, k: int = 6, share: float = 0.06) -> np.ndarray:
    """Colours that make up over 6 % of every second pixel of the image's border ring."""
    h, w = rgb.shape[:2]
    ring = max(1, int(min(h, w) * 0.02 + 0.5))
    y, x = np.mgrid[:h, :w]
    on = ((y < ring) | (y >= h - ring) | (x < ring) | (x >= w - ring)) & ((x + y) % 2 == 0)
    found = kmeans(rgb[on], k)
    total = sum(n for _, n in found)
    good = [c for c, n in found if n > share * total] or [c for c, _ in found[:1]]
    return np.array(good, float).reshape(-1, 3)


def segment(rgb: np.ndarray, sensitivity: float = 0.5) -> dict:
    """Saliency from the distance to the border's colours and local edges, its mask, and the regions in it.

    Large, loosely filled regions are split where a threshold inside them, or an opening, parts them.
    """
    h, w = rgb.shape[:2]
    ground = border_colours(rgb)
    far = np.min([redmean(rgb, c) for c in ground], axis=0)
    edge = sobel(luminance(rgb))
    saliency = 0.72 * np.minimum(1, far / min(max(far.max(), 1e-6), 380)) + 0.28 * np.minimum(1, 3 * box_blur(edge, 2))
    mask = saliency > otsu(saliency) * (1.25 - sensitivity * 0.5)
    r = max(1, int(min(w, h) / 140 + 0.5))
    mask = erode(dilate(mask, r + 1), r)
    labels, found = regions(rgb, mask)
    for _ in range(2):
        changed = False
        for g in found:
            if g["w"] * g["h"] / mask.size <= 0.12 or g["fill"] >= 0.75:
                continue
            own = labels == g["label"]
            parts = lambda m: sum(p["area"] > 0.04 * g["area"] for p in regions(rgb, m)[1])  # noqa: B023, E731
            split = erode(dilate(own & (saliency > otsu(saliency[own])), r), r)
            if parts(split) < 2:
                split = dilate(erode(own, r + 2), r + 2) & own
            if parts(split) >= 2:
                mask = np.where(own, split, mask)
                changed = True
        if not changed:
            break
        labels, found = regions(rgb, mask)
    return {"saliency": saliency, "mask": mask, "labels": labels, "regions": found, "edge_density": float((edge > 0.18).mean())}


def merge_regions(found: list[dict], gap: float, area: float) -> list[dict]:
    """Fragments joined until nothing changes: contained ones unless they stand alone, and small ones that nearly touch."""
    todo = [dict(g) for g in found]

    def joins(a: dict, b: dict) -> bool:
        dx = max(0, max(a["x"], b["x"]) - min(a["x"] + a["w"], b["x"] + b["w"]))
        dy = max(0, max(a["y"], b["y"]) - min(a["y"] + a["h"], b["y"] + b["h"]))
        small, big = sorted((a, b), key=lambda g: g["w"] * g["h"])
        if a["w"] * a["h"] == b["w"] * b["h"]:
            small, big = b, a
        size = small["w"] * small["h"]
        if not (small["fill"] > 0.7 and size > 0.006 * area):
            ow = min(small["x"] + small["w"], big["x"] + big["w"]) - max(small["x"], big["x"])
            oh = min(small["y"] + small["h"], big["y"] + big["h"]) - max(small["y"], big["y"])
            if max(0, ow) * max(0, oh) > 0.6 * size:
                return True
        return max(a["w"] * a["h"], b["w"] * b["h"]) < 0.012 * area and dx <= gap and dy <= gap

    while (pair := next(((i, j) for i in range(len(todo)) for j in range(i + 1, len(todo)) if joins(todo[i], todo[j])), None)) is not None:
        a, b = todo[pair[0]], todo.pop(pair[1])
        x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
        w, h = max(a["x"] + a["w"], b["x"] + b["w"]) - x, max(a["y"] + a["h"], b["y"] + b["h"]) - y
        n = a["area"] + b["area"]
        mix = lambda u, v: (u * a["area"] + v * b["area"]) / n  # noqa: B023, E731
        todo[pair[0]] = a | {"x": x, "y": y, "w": w, "h": h, "area": n, "fill": n / (w * h), "skin": mix(a["skin"], b["skin"]), "mean": [int(mix(u, v) + 0.5) for u, v in zip(a["mean"], b["mean"], strict=True)]}
    return todo


def merge_many(count: np.ndarray, found: dict[str, np.ndarray], gap: float, area: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """`merge_regions` of many images at a time: which of their regions stay, and all regions' numbers.

    `found` has the numbers (x, y, w, h, area, fill, skin, mean) of all regions, image after image, `count` of each.
    Images of as many regions are looked at together, as many as have MANY pairs; one that has more by itself goes pair by pair.
    """
    g = {k: np.array(v, float) for k, v in found.items()}
    stays, first = np.ones(len(g["x"]), bool), np.cumsum(count) - count
    for n in np.unique(count[count > 1]).tolist():
        if n * (n - 1) // 2 > MANY:
            for start in first[count == n].tolist():
                rows = [{"label": k, **{c: v[k].tolist() for c, v in g.items()}} for k in range(start, start + n)]
                stays[start : start + n] = False
                for m in merge_regions(rows, gap, area):
                    stays[m["label"]] = True
                    for c in g:
                        g[c][m["label"]] = m[c]
            continue
        i, j = np.triu_indices(n, 1)  # in the order in which pairs are tried
        images = first[count == n]
        for at in range(0, len(images), max(1, MANY // len(i))):
            todo = images[at : at + max(1, MANY // len(i))]
            while len(todo):
                a, b = todo[:, None] + i, todo[:, None] + j
                hit = _join(g, a, b, gap, area) & stays[a] & stays[b]
                more = hit.any(axis=1)
                todo, pair = todo[more], hit[more].argmax(axis=1)
                _merge(g, todo + i[pair], todo + j[pair])
                stays[todo + j[pair]] = False
    return stays, g


def _join(g: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, gap: float, area: float) -> np.ndarray:
    """Whether regions a and b are one, as in `merge_regions`."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = ([g[c][k] for c in "xywh"] for k in (a, b))
    wide, high = np.minimum(ax + aw, bx + bw) - np.maximum(ax, bx), np.minimum(ay + ah, by + bh) - np.maximum(ay, by)
    sizes = aw * ah, bw * bh
    size, fill = np.minimum(*sizes), np.where(sizes[0] < sizes[1], g["fill"][a], g["fill"][b])
    inside = ~((fill > 0.7) & (size > 0.006 * area)) & (np.maximum(0, wide) * np.maximum(0, high) > 0.6 * size)
    return inside | ((np.maximum(*sizes) < 0.012 * area) & (np.maximum(0, -wide) <= gap) & (np.maximum(0, -high) <= gap))


def _merge(g: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> None:
    x, y = np.minimum(g["x"][a], g["x"][b]), np.minimum(g["y"][a], g["y"][b])
    w, h = np.maximum(g["x"][a] + g["w"][a], g["x"][b] + g["w"][b]) - x, np.maximum(g["y"][a] + g["h"][a], g["y"][b] + g["h"][b]) - y
    n = g["area"][a] + g["area"][b]
    mix = lambda c: ((g[c][a].T * g["area"][a] + g[c][b].T * g["area"][b]) / n).T
    skin, mean = mix("skin"), np.trunc(mix("mean") + 0.5)
    for c, v in (("x", x), ("y", y), ("w", w), ("h", h), ("area", n), ("fill", n / (w * h)), ("skin", skin), ("mean", mean)):
        g[c][a] = v


def inpaint(rgb: np.ndarray, known: np.ndarray, passes: int = 6) -> np.ndarray:
    """Unknown pixels filled from their known neighbours, ring by ring, then smoothed in reading order."""
    data, have = rgb.astype(np.float32), known.copy()
    if not have.any():
        return np.clip(np.rint(data), 0, 255)
    h, w = have.shape
    while not have.all():
        p, k = np.pad(np.where(have[..., None], data, 0), ((1, 1), (1, 1), (0, 0))), np.pad(have, 1)
        total = sum(p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3))
        n = sum(k[dy : dy + h, dx : dx + w].astype(int) for dy in range(3) for dx in range(3))
        new = ~have & (n > 0)
        data[new] = total[new] / n[new][:, None]
        have |= new
    ys, xs = np.nonzero(~known[1:-1, 1:-1])
    for _ in range(passes):
        for y, x in zip((ys + 1).tolist(), (xs + 1).tolist(), strict=True):  # each uses the values already smoothed
            data[y, x] = (data[y, x - 1] + data[y, x + 1] + data[y - 1, x] + data[y + 1, x]) / 4
    return np.clip(np.rint(data), 0, 255)


def band_colours(rgb: np.ndarray, angle: float, bands: int = 5) -> np.ndarray:
    """Mean colours of bands across an axis, from every second pixel each way."""
    h, w = rgb.shape[:2]
    dx, dy = np.sin(np.radians(angle)), -np.cos(np.radians(angle))
    y, x = np.mgrid[:h:2, :w:2]
    reach = abs(w / 2 * dx) + abs(h / 2 * dy)
    t = ((x - w / 2) * dx + (y - h / 2) * dy + reach) / (2 * reach)
    b = np.clip(np.floor(t * bands), 0, bands - 1).astype(int).ravel()
    n = np.bincount(b, minlength=bands)
    sums = np.stack([np.bincount(b, weights=rgb[::2, ::2, c].ravel(), minlength=bands) for c in range(3)], 1)
    return np.where(n[:, None] > 0, np.floor(sums / np.maximum(n, 1)[:, None] + 0.5), 0)


# The axes tried for a gradient, in order.
AXES = {180: "top → bottom", 90: "left → right", 135: "diagonal ↘", 45: "diagonal ↗"}


def gradient(rgb: np.ndarray, least: float = 38.0) -> dict | None:
    """The axis whose ends differ most, with three stops, if they differ enough."""
    best = max(((a, band_colours(rgb, a)) for a in AXES), key=lambda x: float(redmean(x[1][0], x[1][-1])))
    spread = float(redmean(best[1][0], best[1][-1]))
    if spread <= least:
        return None
    hexes = ["#%02X%02X%02X" % tuple(best[1][i].astype(int)) for i in (0, 2, 4)]
    return {"angle": best[0], "name": AXES[best[0]], "css": f"linear-gradient({best[0]}deg, " + ", ".join(f"{c} {i * 50}%" for i, c in enumerate(hexes)) + ")", "confidence": min(0.95, 0.5 + spread / 400)}


def core_ink(pixels: np.ndarray, ground: np.ndarray) -> list[int] | None:
    """Text colour: channel medians of the pixels farthest from the background; None if there is no clear ink."""
    if len(pixels) < 8:
        return None
    d = redmean(pixels, ground)
    far = np.sort(d)[int(len(d) * 0.97)]
    if far < 30:
        return None
    core = np.sort(pixels[d >= 0.8 * far], axis=0)
    return core[len(core) // 2].astype(int).tolist()


def single_colour(pixels: np.ndarray, grounds: np.ndarray) -> bool:
    fg = pixels[np.min([redmean(pixels, g) for g in grounds], axis=0) > 80]
    if len(fg) < 20:
        return False
    return bool((redmean(fg, np.sort(fg, axis=0)[len(fg) // 2]) < 50).mean() > 0.85)


def sharpness(rgb: np.ndarray) -> float:
    """98th percentile of interior gradients: low where there are only soft edges."""
    lum = rgb @ np.array([0.3, 0.59, 0.11])
    g = np.abs(lum[1:-1, 2:] - lum[1:-1, :-2]) + np.abs(lum[2:, 1:-1] - lum[:-2, 1:-1])
    return float(np.sort(g.ravel())[int(g.size * 0.98)]) if g.size else 0.0


def face_box(rgb: np.ndarray) -> tuple[float, float, float, float] | None:
    """A face where skin stands in the top 40 % of a person's image."""
    h, w = rgb.shape[:2]
    ys, xs = np.nonzero(skin(rgb[: int(h * 0.4 + 0.5)]))
    if len(ys) < 20:
        return None
    size = min(float(np.ptp(xs)), float(np.ptp(ys)), 0.6 * w)
    return None if size < 6 else ((xs.min() + xs.max()) / 2 - size / 2, float(ys.min()), size, size * 1.2)


def local_contrast(grey: np.ndarray, polarity: int, least: float = 28) -> np.ndarray:
    """Pixels that are brighter (1) or darker (-1) than their surroundings."""
    return polarity * (grey - box_blur(grey, max(8, int(max(grey.shape) / 60)))) > least


def cutout(rgb: np.ndarray, mask: np.ndarray, feather: int = 1) -> tuple[np.ndarray, float]:
    """RGBA of a masked image with soft edges, and the share of it that is covered."""
    alpha = box_blur(mask.astype(float), feather) * 255
    return np.dstack([rgb, np.clip(np.rint(alpha), 0, 255)]), float(mask.mean())


def over(canvas: np.ndarray, layer: np.ndarray, x: int, y: int, opacity: float = 1.0) -> np.ndarray:
    """A layer (RGBA) painted on a canvas (RGB), clipped to it."""
    h, w = canvas.shape[:2]
    x0, y0, x1, y1 = max(0, x), max(0, y), min(w, x + layer.shape[1]), min(h, y + layer.shape[0])
    if x0 < x1 and y0 < y1:
        part = layer[y0 - y : y1 - y, x0 - x : x1 - x]
        a = part[..., 3:] / 255 * opacity
        canvas[y0:y1, x0:x1] = part[..., :3] * a + canvas[y0:y1, x0:x1] * (1 - a)
    return canvas


def _rows(top: np.ndarray, left: np.ndarray, bottom: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the rectangle, y, width) of all rows of many rectangles, one after the other; none of a rectangle without width."""
    w = np.maximum(0, right - left)
    n = np.where(w > 0, np.maximum(0, bottom - top), 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n - top, n), w[of]


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ..., n of them, of all runs."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)


def rectangles(top: np.ndarray, left: np.ndarray, bottom: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the rectangle, y, x) of all pixels of many rectangles, one after the other."""
    of, y, w = _rows(top, left, bottom, right)
    return np.repeat(of, w), np.repeat(y, w), _runs(left[of], w)


def over_many(canvas: np.ndarray, start: np.ndarray, side: tuple[int, int], box: tuple[np.ndarray, ...], rgb: np.ndarray, opacity: np.ndarray) -> None:
    """Plain opaque layers (x, y, w, h in pixels) painted as by `over`, each on a canvas of its own.

    Canvases of `side` (w, h) lie one after the other in rows of RGB, from `start` on.
    """
    x, y, w, h = box
    left = np.maximum(0, x)
    of, row, n = _rows(np.maximum(0, y), left, np.minimum(side[1], y + h), np.minimum(side[0], x + w))
    at, seen = _runs(start[of] + row * side[0] + left[of], n), np.bincount(of, n, len(x)).astype(int)
    below = np.take(canvas, at, axis=0)
    below *= np.repeat(1 - opacity, seen)[:, None]
    below += np.repeat(rgb * opacity[:, None], seen, axis=0)
    canvas[at] = below


def resample(rgb: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area means at a smaller size."""
    for axis, n in ((0, h), (1, w)):
        edges = np.linspace(0, rgb.shape[axis], n + 1)
        lo = np.minimum(edges[:-1].astype(int), rgb.shape[axis] - 1)
        total = np.add.reduceat(rgb, lo, axis=axis)
        count = np.diff(np.append(lo, rgb.shape[axis]))
        rgb = total / np.maximum(count, 1).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
    return rgb


def enlarge(rgb: np.ndarray, w: int, h: int) -> np.ndarray:
    """Values between pixel centres at a larger size, one axis after the other."""
    for axis, n in ((0, h), (1, w)):
        size = rgb.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        lo = np.floor(at).astype(int)
        share = (at - lo).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        rgb = np.take(rgb, lo, axis) * (1 - share) + np.take(rgb, np.minimum(lo + 1, size - 1), axis) * share
    return rgb


def plate(rgb: np.ndarray, small: np.ndarray, mask: np.ndarray, boxes: list[tuple[float, float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """The background of an image without its foreground, at full size, and which pixels are the image's own.

    `small` is the image's raster and `mask` its salient pixels; these, two pixels around them and
    all boxes (x, y, w, h at full size) with a pixel's margin are unknown. They are filled on the
    raster and enlarged with a soft blur; every other pixel is the image's.
    """
    (full_h, full_w), (h, w) = rgb.shape[:2], mask.shape
    scale = max(full_w / w, full_h / h)
    gone = dilate(mask, 2)
    for x, y, bw, bh in boxes:
        x0, y0 = max(0, int(np.floor(x / scale)) - 1), max(0, int(np.floor(y / scale)) - 1)
        gone[y0 : int(np.ceil((y + bh) / scale)) + 2, x0 : int(np.ceil((x + bw) / scale)) + 2] = True
    filled = enlarge(inpaint(small, ~gone), full_w, full_h)
    radius = max(1, int(scale * 0.8 + 0.5))
    filled = np.stack([box_blur(filled[..., c], radius) for c in range(3)], -1)
    ys, xs = np.minimum(h - 1, (np.arange(full_h) / scale).astype(int)), np.minimum(w - 1, (np.arange(full_w) / scale).astype(int))
    own = ~gone[ys][:, xs]
    return np.where(own[..., None], rgb, np.clip(np.rint(filled), 0, 255)), own


def linear_gradient(w: int, h: int, angle: float, stops: list[tuple[float, tuple[int, int, int]]]) -> np.ndarray:
    y, x = np.mgrid[:h, :w]
    dx, dy = np.sin(np.radians(angle)), -np.cos(np.radians(angle))
    reach = abs(w / 2 * dx) + abs(h / 2 * dy)
    t = ((x - w / 2) * dx + (y - h / 2) * dy + reach) / (2 * reach)
    return np.stack([np.interp(t, [s for s, _ in stops], [c[i] for _, c in stops]) for i in range(3)], -1)


def png(rgb: np.ndarray) -> bytes:
    """A PNG of RGB or RGBA values."""
    a = rgb if rgb.dtype == np.uint8 else np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
    h, w, n = a.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * n)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if n == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def pdf(rgb: np.ndarray) -> bytes:
    """A page that shows one image; the cross-reference table is the running sum of the objects' lengths."""
    h, w = rgb.shape[:2]
    image = zlib.compress(np.clip(np.rint(rgb), 0, 255).astype(np.uint8).tobytes())
    show = f"q {w} 0 0 {h} 0 0 cm /I Do Q".encode()
    stream = lambda head, data: f"<< {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w} {h}] /Resources << /XObject << /I 4 0 R >> >> /Contents 5 0 R >>".encode(),
        stream(f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode", image), stream("", show),
    ]
    out, at = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = b"".join(f"{o:010d} 00000 n \n".encode() for o in at)
    return out + f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n".encode() + table + f"trailer\n<< /Size {len(at) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def eased(curve: str, x: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2 = CURVES[curve]
    bend = lambda t, a, b: 3 * a * t * (1 - t) ** 2 + 3 * b * t * t * (1 - t) + t**3
    if curve == "linear":
        return np.clip(x, 0, 1)
    lo, hi = np.zeros_like(x), np.ones_like(x)
    for _ in range(BISECTIONS):
        mid = (lo + hi) / 2
        low = bend(mid, x1, x2) < x
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return np.where(x <= 0, 0, np.where(x >= 1, 1, bend((lo + hi) / 2, y1, y2)))


@lru_cache(maxsize=256)
def _tweens(times: tuple[float, ...], starts: tuple[float, float], ends: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tweens to try, five by five, and how far each is by every curve at the times: (candidates, curves, times)."""
    t0, t1 = (x.ravel() for x in np.meshgrid(np.linspace(*starts, 5), np.linspace(*ends, 5), indexing="ij"))
    t0, t1 = t0[t1 - t0 >= 0.05], t1[t1 - t0 >= 0.05]
    x = (np.array(times)[None] - t0[:, None]) / (t1 - t0)[:, None]
    return t0, t1, np.stack([eased(curve, x) for curve in CURVES], 1)


#: Numbers that a fit of many layers holds at once.
FIT_CELLS = 1 << 18


def fit_tweens(t: np.ndarray, o: np.ndarray, moves: np.ndarray, starts: tuple[float, float], ends: tuple[float, float], entering: bool) -> dict[str, np.ndarray]:
    """The tweens (t0, t1, easing, hidden dx, dy, scale) with the least error over samples of layers that share their times and opacities.

    `moves` is (layers, times, 3): dx, dy and scale. Five starts, five ends and every curve are tried;
    the hidden offsets of each are a weighted least-squares solution in closed form.
    """
    n = len(moves)
    starts, ends = (float(starts[0]), float(starts[1])), (float(ends[0]), float(ends[1]))
    t0, t1, q = _tweens(tuple(t.tolist()), starts, ends)
    if not q.size:
        return {"t0": np.full(n, starts[0]), "t1": np.full(n, ends[1]), "easing": np.full(n, "ease-out", object), "dx": np.zeros(n), "dy": np.zeros(n), "scale": np.ones(n)}
    shape = q.shape[:2]
    q = (q if entering else 1 - q).reshape(-1, len(t))  # (tried, times)
    rest, weight = 1 - q, o * o
    norm, pull, late = (weight * rest * rest).sum(-1), weight * rest, (((o - q) / 0.1) ** 2).sum(-1)
    solved, unit = norm > 1e-6, np.array([2, 2, 0.03])
    at, off = np.empty(n, int), np.empty((n, 3))
    step = max(1, FIT_CELLS // (q.size * 3))
    for lo in range(0, n, step):
        shift = moves[lo : lo + step] - np.array([0, 0, 1])
        pulled = (pull @ shift.transpose(1, 0, 2).reshape(len(t), -1)).reshape(len(q), -1, 3)
        away = np.where(solved[:, None, None], pulled / np.maximum(norm, 1e-12)[:, None, None], 0)  # (tried, layers, 3)
        total = (weight[:, None] * (shift / unit) ** 2).sum((-1, -2))
        error = late[:, None] + total - (away * pulled / unit**2).sum(-1)
        best = error.argmin(0)
        # what that subtraction can't tell apart is compared by its residuals; the first of equals
        close = error <= error.min(0) + 1e-9 * (1 + total)
        for k in np.flatnonzero(close.sum(0) > 1).tolist():
            c = np.flatnonzero(close[:, k])
            miss = (shift[k] - rest[c, :, None] * away[c, k, None]) / unit
            best[k] = c[(late[c] + (weight[:, None] * miss**2).sum((-1, -2))).argmin()]
        at[lo : lo + step], off[lo : lo + step] = best, away[best, np.arange(len(best))]
    i, j = np.unravel_index(at, shape)
    return {"t0": t0[i], "t1": t1[i], "easing": np.array(list(CURVES), object)[j], "dx": off[:, 0], "dy": off[:, 1], "scale": 1 + off[:, 2]}


def fit_motions(t: np.ndarray, o: np.ndarray, rest: np.ndarray, moves: np.ndarray, end: float, to_scene: float, size: float, hidden: float = 0.08) -> list[dict[str, np.ndarray]]:
    """Keys of the entrances and exits of layers that share times, opacities and rests; none if they never move. `moves` is as in fit_tweens.

    Each key holds one value per layer.
    """
    still_at = np.flatnonzero(rest > 0)
    if len(t) < 3 or not len(still_at) or len(still_at) == len(t):
        return []
    n = len(moves)

    def away(tw: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        wild = (np.hypot(tw["dx"], tw["dy"]) > 2 * size) | ~((tw["scale"] >= 0.5) & (tw["scale"] <= 1.5))
        near = lambda v: np.where(wild | (np.abs(v) < 1.5), 0.0, np.floor(v * to_scene + 0.5))
        return {"dx": near(tw["dx"]), "dy": near(tw["dy"]), "scale": np.where(wild | (np.abs(tw["scale"] - 1) < 0.03), 1.0, np.floor(tw["scale"] * 100 + 0.5) / 100), "opacity": np.zeros(n)}

    still, linear, keys = {"dx": np.zeros(n), "dy": np.zeros(n), "scale": np.ones(n), "opacity": np.ones(n)}, np.full(n, "linear", object), []
    gone = np.flatnonzero(o < hidden)
    first, last = int(still_at[0]), int(still_at[-1])
    before, after = gone[gone < first], gone[gone > last]
    if len(before) and first - before[-1] >= 2:
        b = int(before[-1])
        tw = fit_tweens(t[b + 1 : first], o[b + 1 : first], moves[:, b + 1 : first], (t[b], t[b + 1]), (t[first - 1], t[first]), True)
        keys += [{"t": tw["t0"], **away(tw), "easing": tw["easing"]}, {"t": tw["t1"], **still, "easing": linear}]
    if len(after) and after[0] - last >= 2 and t[after[0]] < end - 0.05:
        a = int(after[0])
        tw = fit_tweens(t[last + 1 : a], o[last + 1 : a], moves[:, last + 1 : a], (t[last], t[last + 1]), (t[a - 1], t[a]), False)
        keys += [{"t": tw["t0"], **still, "easing": tw["easing"]}, {"t": tw["t1"], **away(tw), "easing": linear}]
    return keys


def fit_motion(samples: np.ndarray, end: float, to_scene: float, size: float, hidden: float = 0.08) -> list[dict]:
    """Keys of one layer's entrance and exit from samples (t, dx, dy, scale, opacity, rest)."""
    keys = fit_motions(samples[:, 0], samples[:, 4], samples[:, 5], samples[None, :, 1:4], end, to_scene, size, hidden)
    return [{f: v[0] if f == "easing" else float(v[0]) for f, v in k.items()} for k in keys]


def track_layer(frames: np.ndarray, times: np.ndarray, plate: np.ndarray, box: tuple[int, int, int, int], key: int, reach: int = 6) -> np.ndarray:
    """Samples (t, dx, dy, scale, opacity, rest) of a layer followed both ways from its keyframe.

    In each frame the shift and scale are searched around the last certain place for the largest
    share of the frame that the layer over the background plate explains; opacity comes with it.
    """
    x, y, w, h = box
    layer = frames[key][y : y + h, x : x + w] - plate[y : y + h, x : x + w]
    contrast = float(np.abs(layer).mean()) if layer.size else 0.0
    if min(w, h) < 3 or contrast < 4:
        return np.empty((0, 6))
    height, width = plate.shape
    step = max(1, int(np.sqrt(w * h / 600)))

    def explained(f: np.ndarray, dx: float, dy: float, s: float) -> tuple[float, float]:
        fw, fh = max(1, int(w * s + 0.5)), max(1, int(h * s + 0.5))
        ys, xs = np.arange(0, fh, step), np.arange(0, fw, step)
        py, px = ys + int(np.floor(y + h / 2 + dy - fh / 2 + 0.5)), xs + int(np.floor(x + w / 2 + dx - fw / 2 + 0.5))
        ys, py = ys[(py >= 0) & (py < height)], py[(py >= 0) & (py < height)]
        xs, px = xs[(px >= 0) & (px < width)], px[(px >= 0) & (px < width)]
        if not len(ys) or not len(xs):
            return 0.0, 0.0
        ground = plate[np.ix_(py, px)]
        sy, sx = np.minimum(h - 1, ((ys + 0.5) / s).astype(int)), np.minimum(w - 1, ((xs + 0.5) / s).astype(int))
        g = frames[key][np.ix_(y + sy, x + sx)] - ground
        gg, dg = float((g * g).sum()), float(((f[np.ix_(py, px)] - ground) * g).sum())
        if gg < 1:
            return 0.0, 0.0
        alpha = min(1.0, max(0.0, dg / gg))
        return 2 * alpha * dg - alpha * alpha * gg, alpha

    def around(f, place, reach, step):
        shifts = [(0, 0), *((a, b) for b in range(-reach, reach + 1, step) for a in range(-reach, reach + 1, step) if a or b)]
        tried = [((place[0] + a, place[1] + b, place[2]), explained(f, place[0] + a, place[1] + b, place[2])) for a, b in shifts]
        return max(tried, key=lambda x: x[1][0])

    out: dict[int, tuple] = {}
    for order in (range(key, -1, -1), range(key + 1, len(frames))):
        place = (0.0, 0.0, 1.0)
        for k in order:
            f = frames[k]
            if np.abs(f[y : y + h, x : x + w] - frames[key][y : y + h, x : x + w])[::step, ::step].mean() < max(3, 0.2 * contrast):
                out[k], place = (times[k], 0, 0, 1, 1, 1), (0.0, 0.0, 1.0)
                continue
            best = around(f, around(f, place, reach, 2)[0], 1, 1)
            if w * h >= 150:
                sizes = [around(f, (*best[0][:2], float(np.clip(best[0][2] + d, 0.3, 1.5))), 1, 1) for d in (-0.1, -0.06, -0.03, 0.03, 0.06, 0.1)]
                top = max(sizes, key=lambda x: x[1][0])
                if top[1][0] > best[1][0]:
                    best = around(f, top[0], 2, 1)
            out[k] = (times[k], *best[0], best[1][1], 0)
            if best[1][1] > 0.25:
                place = best[0]
    return np.array([out[k] for k in sorted(out)], float)


#: Half lengths of crossfades, and how far around a frame hard cuts rule them out at most.
HALVES, REACH = (0.3, 0.45, 0.6), 0.7
#: Frames beyond REACH whose steps decide about the hard cuts there.
AROUND = 4
#: Candidates farther apart have no influence on each other.
APART = 1.2


def cut_candidates(frames: np.ndarray, times: np.ndarray, lo: int, hi: int, first: float, last: float) -> list[tuple[float, str, float, float]]:
    """(time, cut or fade, length, share) that frames lo to hi - 1 of a stretch of a video give.

    A cut is given by the frame after it, a fade by its middle. The stretch holds AROUND frames
    beyond REACH seconds on either side, as far as the video, from `first` to `last`, has any.
    """
    n = len(frames)
    edge = np.zeros(frames.shape, bool)
    edge[:, 1:-1, 1:-1] = np.abs(frames[:, 1:-1, 2:] - frames[:, 1:-1, :-2]) + np.abs(frames[:, 2:, 1:-1] - frames[:, :-2, 1:-1]) > 18

    def kept(a: int, b: int) -> float:
        total = int(edge[a].sum())
        if total < 8:
            return 1.0
        e = np.pad(edge[b], 1)
        return float((edge[a] & (e[1:-1, 1:-1] | e[:-2, 1:-1] | e[2:, 1:-1] | e[1:-1, :-2] | e[1:-1, 2:])).sum()) / total

    step = np.concatenate([[0], np.abs(np.diff(frames, axis=0)).mean(axis=(1, 2))])
    s = np.pad(step, 2)
    around = np.max([s[:-4], s[1:-3], s[3:-1], s[4:]], axis=0)
    hard = [i for i in np.flatnonzero((step >= 2.5) & (step >= 3 * around)).tolist() if i and kept(i - 1, i) < 0.45]
    cuts = [(times[i - 1] + times[i]) / 2 for i in hard]
    found = [(float(c), "cut", 0.0, 0.0) for c, i in zip(cuts, hard, strict=True) if lo <= i < hi]
    nearest = lambda t: int(np.argmin(np.abs(times - t)))
    for i in range(max(lo, 1), min(hi, n - 1)):
        t = times[i]
        for half in HALVES:
            if t - half < first or t + half > last or any(abs(c - t) < half + 0.1 for c in cuts):
                continue
            a, b = nearest(t - half), nearest(t + half)
            d = np.abs(frames[a] - frames[b])
            moved = d >= 8
            if moved.sum() < 0.05 * d.size:
                continue
            share = float((np.abs(frames[i] - (frames[a] + frames[b]) / 2) < np.maximum(4, 0.25 * d))[moved].mean())
            if share >= 0.6 and kept(a, b) <= 0.7 and kept(b, a) <= 0.85:
                found.append((float(t), "fade", 2 * half, share - 0.1 * (half - 0.3)))
    return found


def choose_cuts(found: list[tuple[float, str, float, float]]) -> list[tuple[float, str, float]]:
    """Of a group's candidates all cuts and the fades of the highest shares that keep their distance, in order of time, spaced."""
    cuts = [c[:3] for c in found if c[1] == "cut"]
    for t, kind, length, _ in sorted((c for c in found if c[1] == "fade"), key=lambda c: (-c[3], c[0], c[2])):
        if not any(abs(c[0] - t) < max(0.5, (c[2] + length) / 2) for c in cuts):
            cuts.append((t, kind, length))
    cuts.sort()
    return [c for k, c in enumerate(cuts) if k == 0 or c[0] - cuts[k - 1][0] > 0.3]


def detect_cuts(frames: np.ndarray, times: np.ndarray) -> list[tuple[float, str, float]]:
    """(time, cut or fade, length) of a whole video: single large steps, then blends over 0.6 to 1.2 s that fit no cut."""
    if len(frames) < 3:
        return []
    return choose_cuts(cut_candidates(frames, times, 0, len(frames), float(times[0]), float(times[-1])))


def match_nearest(want: np.ndarray, have: np.ndarray) -> list[tuple[int, int | None]]:
    """(ord, other) for each row (ord, t, most) of `want`, in their order: the nearest unused row (ord, t) of `have` at most `most` away, the lowest ord on ties, or None.

    Each distinct time of `have` is a queue; empty ones are skipped by links that shorten as they are followed.
    """
    times, at = np.unique(have[:, 1], return_inverse=True)
    queues: list[list[int]] = [[] for _ in times]
    for i in np.argsort(-have[:, 0], kind="stable").tolist():
        queues[at[i]].append(int(have[i, 0]))  # the lowest ord last
    n, ts = len(times), times.tolist()
    down, up = list(range(n + 1)), list(range(n + 1))  # shifted by one in `down`, where zero is none; n is none in `up`

    def live(link: list[int], i: int) -> int:
        end = i
        while link[end] != end:
            end = link[end]
        while link[i] != end:
            link[i], i = end, link[i]
        return end

    out: list[tuple[int, int | None]] = []
    for o, t, most in want.tolist():
        k = int(np.searchsorted(times, t))
        best: tuple[float, int, int] | None = None
        for link, i, step, none, shift in ((down, k, -1, 0, 1), (up, k, 1, n, 0)):
            i = live(link, i)
            while i != none:
                j = i - shift
                d = abs(t - ts[j])
                if d > most or (best and d > best[0]):
                    break
                best = min(best or (d, queues[j][-1], j), (d, queues[j][-1], j))
                i = live(link, i + step)
        if best:
            j = best[2]
            queues[j].pop()
            if not queues[j]:
                down[j + 1], up[j] = j, j + 1
        out.append((int(o), best and best[1]))
    return out
