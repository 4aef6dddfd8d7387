"""Animation documents: frame clocks, tracks of keys, layers of a composition, crossfades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.easing import CURVES, ease_any
from ..functions.numeric import clamp, half_up, round_to
from .export import number
from .motion import REST

#: Frames a second of a document, and how far beside a key its tracks are sampled, in seconds.
FPS, BESIDE = 30, 1e-4


def frame_times(duration: Column, fps: int) -> Column:
    """Times i / fps of all frames."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), half_up(duration * fps) - 1)), lambda i: i / float(fps))


def opacity_track(t_in: Column, t_out: Column, keys: list[Column], fps: int) -> Column:
    """array<struct(t, s)> at every frame where the layer's visibility or a key changes, sorted; 0 while hidden."""
    a, b = half_up(t_in * fps), half_up(t_out * fps)
    at = F.array_sort(F.array_distinct(F.array(F.lit(0).cast("bigint"), a, b, *(half_up(k * fps) for k in keys))))
    return F.transform(at, lambda f: F.struct(f.alias("t"), F.when((f < a) | (f >= b), 0).otherwise(100).alias("s")))


def image_layer() -> Column:
    """struct of an image layer: number, name, centre, anchor, opacity in percent, rotation."""
    c = F.col
    return F.struct((c("z") + 1).alias("ind"), c("id").alias("nm"), half_up(c("x") + c("w") / 2).alias("px"), half_up(c("y") + c("h") / 2).alias("py"), half_up(c("w") / 2).alias("ax"), half_up(c("h") / 2).alias("ay"), half_up(c("opacity") * 100).alias("o"), c("rotation").alias("r"))


def crossfade(t: Column, boundary: Column, length: Column) -> Column:
    """How much of the next scene shows at t: a fade straddles the boundary."""
    return clamp((t - (boundary - length / 2)) / F.greatest(F.lit(1e-6), length), 0.0, 1.0)


def offsets(times: Column, start: Column, end: Column) -> Column:
    """Times as shares of a scene, 0 to 1."""
    return F.transform(times, lambda t: clamp((t - start) / F.greatest(F.lit(1e-6), end - start), 0.0, 1.0))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once."""
    return F.transform(F.array(x), f)[0]


def layer_state(keys: Column, t_in: Column, t_out: Column, t: Column) -> Column:
    """struct(dx, dy, scale, opacity) of a layer on screen from t_in to t_out; hidden outside that and its hidden outer keys."""
    first, last = F.get(keys, 0), F.try_element_at(keys, F.lit(-1))
    begin = F.least(t_in, F.when(first["opacity"] < 0.05, first["t"]).otherwise(t_in))
    end = F.greatest(t_out, F.when(last["opacity"] < 0.05, last["t"]).otherwise(t_out))
    around = F.struct(F.try_element_at(F.filter(keys, lambda k: k["t"] <= t), F.lit(-1)).alias("b"), F.get(F.filter(keys, lambda k: k["t"] > t), 0).alias("a"))

    def state(s: Column) -> Column:
        b, a = s["b"], s["a"]
        share = F.when(b.isNotNull() & a.isNotNull(), ease_any(b["easing"], (t - b["t"]) / F.greatest(F.lit(1e-6), a["t"] - b["t"])))
        value = lambda f, q: F.coalesce(b[f] + (a[f] - b[f]) * q, b[f], a[f], F.lit(REST[f]))
        hidden = (t < begin) | (t > end)
        return _let(share, lambda q: F.struct(*(F.when(hidden, 0.0).otherwise(value(f, q)).alias(f) if f == "opacity" else value(f, q).alias(f) for f in REST)))

    return _let(around, state)


def _list(*values: Column | int) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(F.lit(str(v)) if isinstance(v, int) else number(round_to(v, 3)) for v in values)), F.lit("]"))


def _fixed(k: Column) -> Column:
    return F.concat(F.lit('{"a":0,"k":'), k, F.lit("}"))


def _points(easing: Column) -> Column:
    """The text of a key's outgoing and the next one's incoming handles."""
    out = F.lit(None).cast("string")
    for name, (x1, y1, x2, y2) in CURVES.items():
        text = f',"o":{{"x":[{x1:g}],"y":[{y1:g}]}},"i":{{"x":[{x2:g}],"y":[{y2:g}]}}'
        out = F.when(easing == name, text).otherwise(out)
    return out


def tracks(keys: Column, t_in: Column, t_out: Column, t0: Column, t1: Column, values: dict[str, tuple[Callable[[Column], list[Column]], Callable[[Column], Column]]]) -> Column:
    """struct of a layer's property texts over t0 to t1, one per name in `values`: (numbers of a state, their text).

    All tracks have a key at every motion key, visibility change and scene end. A key's value is the
    one just after it; a stretch without change holds, others take the easing of the key they begin at.
    """
    rounded = F.transform(F.concat(F.array(t0, t1, t_in, t_out), F.transform(keys, lambda k: k["t"])), lambda t: round_to(t, 4))
    times = F.array_sort(F.filter(F.array_distinct(rounded), lambda t: (t >= t0) & (t <= t1)))

    def sampled(times: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            after = F.get(times, i + 1)
            at = lambda x: layer_state(keys, t_in, t_out, x)
            easing = F.coalesce(F.get(F.filter(keys, lambda k: F.abs(k["t"] - t) < 1e-3), 0)["easing"], F.lit("linear"))
            return F.struct(round_to(t * FPS, 3).alias("frame"), at(F.least(t1, t + BESIDE)).alias("v"), F.when(after.isNotNull(), at(after - BESIDE)).alias("end"), easing.alias("easing"))

        return F.transform(times, one)

    def written(keyed: Column) -> Column:
        def track(numbers, text) -> Column:
            def key(k: Column) -> Column:
                still = F.lit(True)
                for a, b in zip(numbers(k["v"]), numbers(k["end"]), strict=True):
                    still = still & (F.abs(a - b) < 1e-6)
                tail = F.when(k["end"].isNull(), "").when(still, ',"h":1').otherwise(_points(k["easing"]))
                return F.concat(F.lit('{"t":'), number(k["frame"]), F.lit(',"s":'), text(k["v"]), tail, F.lit("}"))

            moving = F.concat(F.lit('{"a":1,"k":['), F.array_join(F.transform(keyed, key), ","), F.lit("]}"))
            return F.when(F.size(keyed) > 1, moving).otherwise(_fixed(text(keyed[0]["v"])))

        return F.struct(*(track(*v).alias(name) for name, v in values.items()))

    return _let(_let(times, sampled), written)


def _quoted(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _texts(order: list[str], text: str) -> Column:
    """The group's texts in order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda s: s[text]), ",")


def document(scenes: DataFrame, layers: DataFrame, key: str) -> DataFrame:
    """(key, json): each video as one animation document, a composition per scene, crossfaded in order, with scene markers.

    Scenes have the key, scene (from 1), start, end, fade (seconds of the transition into it, or 0),
    duration, name, w, h. Layers have the key, scene, z, name, visible, src, nw, nh (the image and
    its size), x, y, w, h, opacity, rotation, t_in, t_out (null: still) and keys
    array<struct(t, dx, dy, scale, opacity, easing)>. Top layers come first. An image used again is
    one asset, numbered by its first use. Numbers are rounded to three places.
    """
    c = F.col
    order = Window.partitionBy(key).orderBy("scene")
    timed = scenes.withColumn("_next", F.coalesce(F.lead("fade").over(order), F.lit(0.0)))
    timed = timed.withColumn("t0", F.greatest(F.lit(0.0), c("start") - c("fade") / 2)).withColumn("t1", F.least(c("duration"), c("end") + c("_next") / 2)).drop("_next")
    place = F.row_number().over(Window.partitionBy(key, "scene").orderBy(F.desc("z")))
    x = layers.withColumn("ind", place).where("visible").join(timed.select(key, "scene", "t0", "t1"), [key, "scene"])
    first = x.groupBy(key, "src").agg(F.min(F.struct("scene", "ind", "nw", "nh")).alias("at"))
    first = first.withColumn("img", (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).cast("string")).withColumn("img", F.concat(F.lit("img_"), "img"))
    sx, sy = c("w") / c("nw"), c("h") / c("nh")
    centre = c("x") + c("w") / 2, c("y") + c("h") / 2
    values = {
        "p": (lambda s: [centre[0] + s["dx"], centre[1] + s["dy"]], lambda s: _list(centre[0] + s["dx"], centre[1] + s["dy"], 0)),
        "s": (lambda s: [s["scale"] * 100], lambda s: _list(s["scale"] * 100 * sx, s["scale"] * 100 * sy, 100)),
        "o": (lambda s: [s["opacity"] * c("opacity") * 100], lambda s: _list(s["opacity"] * c("opacity") * 100)),
    }
    rest = F.struct(*(F.lit(v).alias(n) for n, v in REST.items()))
    still = F.struct(_fixed(values["p"][1](rest)).alias("p"), _fixed(values["s"][1](rest)).alias("s"), _fixed(number(round_to(c("opacity") * 100, 3))).alias("o"))
    none = F.array().cast("array<struct<t:double,dx:double,dy:double,scale:double,opacity:double,easing:string>>")
    x = x.withColumn("keys", F.coalesce("keys", none)).withColumn("_k", F.when(c("t_in").isNull(), still).otherwise(tracks(c("keys"), c("t_in"), c("t_out"), c("t0"), c("t1"), values)))
    num = lambda v: number(round_to(v, 3))
    text = F.concat(
        F.lit('{"ddd":0,"ind":'), c("ind").cast("string"), F.lit(',"ty":2,"nm":'), _quoted(c("name")), F.lit(',"refId":"'), c("img"), F.lit('","sr":1,"ks":{"o":'), c("_k.o"), F.lit(',"r":'), _fixed(num(c("rotation"))), F.lit(',"p":'), c("_k.p"),
        F.lit(',"a":'), _fixed(_list(c("nw") / 2, c("nh") / 2, 0)), F.lit(',"s":'), c("_k.s"), F.lit('},"ao":0,"ip":'), num(c("t0") * FPS), F.lit(',"op":'), num(c("t1") * FPS), F.lit(',"st":0,"bm":0}'))
    own = x.join(first.select(key, "src", "img"), [key, "src"]).withColumn("_text", text).groupBy(key, "scene").agg(_texts(["ind"], "_text").alias("layers"))
    asset = F.concat(F.lit('{"id":"'), c("img"), F.lit('","w":'), half_up(c("at.nw")).cast("string"), F.lit(',"h":'), half_up(c("at.nh")).cast("string"), F.lit(',"u":"","p":'), _quoted(c("src")), F.lit(',"e":1}'))
    images = first.select(key, c("at.scene").alias("scene"), c("at.ind").alias("ind"), asset.alias("_asset")).groupBy(key, "scene").agg(_texts(["ind"], "_asset").alias("images"))
    number_of = c("scene").cast("string")
    composition = F.concat(F.lit('{"id":"scene_'), number_of, F.lit('","nm":"Scene '), number_of, F.lit('","layers":['), F.coalesce("layers", F.lit("")), F.lit("]}"))
    middle = _fixed(_list(c("w") / 2, c("h") / 2, 0))
    entering = F.concat(F.lit('{"a":1,"k":[{"t":'), num(c("t0") * FPS), F.lit(',"s":[0],"o":{"x":[0],"y":[0]},"i":{"x":[1],"y":[1]}},{"t":'), num((c("start") + c("fade") / 2) * FPS), F.lit(',"s":[100]}]}'))
    shown = F.when(c("fade") > 0, entering).otherwise(F.lit('{"a":0,"k":100}'))
    layer = F.concat(
        F.lit('{"ddd":0,"ind":'), number_of, F.lit(',"ty":0,"nm":"Scene '), number_of, F.lit('","refId":"scene_'), number_of, F.lit('","sr":1,"ks":{"o":'), shown, F.lit(',"r":{"a":0,"k":0},"p":'), middle, F.lit(',"a":'), middle,
        F.lit(',"s":{"a":0,"k":[100,100,100]}},"ao":0,"w":'), num(c("w")), F.lit(',"h":'), num(c("h")), F.lit(',"ip":'), num(c("t0") * FPS), F.lit(',"op":'), num(c("t1") * FPS), F.lit(',"st":0,"bm":0}'))
    marker = F.concat(F.lit('{"tm":'), num(c("start") * FPS), F.lit(',"cm":"Scene '), number_of, F.lit('","dr":'), num((c("end") - c("start")) * FPS), F.lit("}"))
    parts = timed.join(own, [key, "scene"], "left").join(images, [key, "scene"], "left").select(key, "scene", "duration", "name", "w", "h", (-c("scene")).alias("_back"), F.concat_ws(",", "images", composition).alias("_assets"), layer.alias("_layer"), marker.alias("_marker"))
    whole = parts.groupBy(key).agg(F.min(F.struct("scene", "duration", "name", "w", "h")).alias("d"), _texts(["scene"], "_assets").alias("assets"), _texts(["_back"], "_layer").alias("layers"), _texts(["scene"], "_marker").alias("markers"))
    head = F.concat(F.lit(f'{{"v":"5.12.1","fr":{FPS},"ip":0,"op":'), half_up(c("d.duration") * FPS).cast("string"), F.lit(',"w":'), num(c("d.w")), F.lit(',"h":'), num(c("d.h")), F.lit(',"nm":'), _quoted(c("d.name")))
    return whole.select(key, F.concat(head, F.lit(',"ddd":0,"assets":['), "assets", F.lit('],"layers":['), "layers", F.lit('],"markers":['), "markers", F.lit("]}")).alias("json"))
