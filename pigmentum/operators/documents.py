"""Whole export documents: scenes as layered-image, design-tool and page JSON, videos as a timeline with its layer files.

Every document is one row, so a scene (a video, for timelines) must fit a row as its text must. Scenes
without layers have empty lists; null values are left out, as JSON writers leave out what is undefined.
Layers have (key, z, id, name, type, x, y, w, h, visible, locked, opacity, rotation, src, fit, fill,
radius, txt, size, weight, family, align, spacing, line_height, upper_case), layers of videos also
(scene, t_in, t_out, motion). Where texts are None, all layers are texts, with a role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.easing import CURVES, css
from ..functions.numeric import half_up, round_to
from .export import ordered

# What the design-tool format says about every document.
CANVAS_COLOR, CANVAS_NAME = "#1E1E1E", "Reconstruction"
BOLD = 600


def _s(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _is(kind: str, c=F.col) -> Column:
    return c("type") == kind


def _picture(c=F.col) -> Column:
    return ~c("type").isin("text", "shape")


def _channels(hex: Column) -> list[Column]:
    return [F.conv(F.substring(hex, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]


def _unit(hex: Column) -> Column:
    """A colour with channels from 0 to 1."""
    r, g, b = (c / F.lit(255.0) for c in _channels(hex))
    return F.when(hex.isNotNull(), _s(r=r, g=g, b=b, a=F.lit(1)))


def _solid(hex: Column) -> Column:
    return _s(type=F.lit("SOLID"), color=_unit(hex))


def _gathered(scenes: DataFrame | list[str], key: str, layers: DataFrame, lists: dict[str, Column], palette: DataFrame, colour: Column, **parts: DataFrame) -> DataFrame:
    """The scenes with a list of each value of their layers, one of their palette's colours as _c, and other (key, v) lists; none is an empty one.

    `lists` gathers a scene's layers in one aggregate. Scenes as SQL expressions over the key stand for
    all scenes that have layers; those are then read once.
    """
    listed = layers.groupBy(key).agg(*(v.alias(name) for name, v in lists.items()))
    whole = listed.selectExpr(*scenes, *lists) if isinstance(scenes, list) else scenes.join(listed, key, "left")
    for name, rows in ({"_c": ordered(palette.withColumn("z", F.col("ord")), colour, "v", key)} | parts).items():
        whole = whole.join(rows.withColumnRenamed("v", name), key, "left")
    return whole.withColumns({name: F.coalesce(name, F.array()) for name in (*lists, "_c", *parts)})


def _list(value: Column, falling: bool = False) -> Column:
    """Values in z order."""
    one = F.struct((-F.col("z") if falling else F.col("z")).alias("z"), value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(one)), lambda s: s["v"])


def layer_document(scenes: DataFrame | list[str], layers: DataFrame, palette: DataFrame, key: str = "pid") -> DataFrame:
    """(key, json): a layered image, the top layer first. Scenes: name, width, height, design_type; palette: ord, hex."""
    c = F.col
    bounds = _s(top=half_up(c("y")), left=half_up(c("x")), bottom=half_up(c("y") + c("h")), right=half_up(c("x") + c("w")))
    kind = F.when(_is("text"), "textLayer").when(_is("shape"), "solidColorLayer").when(_is("background"), "backgroundLayer").otherwise("pixelLayer")
    r, g, b = _channels(c("fill"))
    font = _s(family=c("family"), weight=c("weight"), size=c("size"), tracking=half_up(c("spacing") / c("size") * 1000))
    text = F.when(_is("text"), _s(content=c("txt"), font=font, color=_s(r=r, g=g, b=b), justification=c("align"), allCaps=c("upper_case")))
    one = _s(
        id=c("id"), name=c("name"), kind=kind, visible=c("visible"), locked=c("locked"), opacity=half_up(c("opacity") * 255), blendMode=F.lit("normal"), bounds=bounds, rotation=c("rotation"),
        text=text, fill=F.when(_is("shape"), c("fill")), cornerRadius=F.when(_is("shape"), c("radius")), image=F.when(_picture(), _s(dataUrl=c("src"))),
    )
    whole = _gathered(scenes, key, layers, {"_l": _list(one, falling=True)}, palette, c("hex"))
    about = _s(name=c("name"), width=c("width"), height=c("height"), resolution=F.lit(72), colorMode=F.lit("RGB"), bitsPerChannel=F.lit(8))
    return whole.select(key, F.to_json(F.struct(F.lit("layers@1").alias("$schema"), about.alias("document"), c("_l").alias("layers"), _s(designType=c("design_type"), palette=c("_c")).alias("analysis"))).alias("json"))


def node_document(scenes: DataFrame | list[str], layers: DataFrame, palette: DataFrame, texts: DataFrame | None, key: str = "pid") -> DataFrame:
    """(key, json): a tree of nodes, images by layer, colour styles and the distinct text styles as first seen.

    Scenes: name, width, height, background; palette: ord, hex, name, role; texts: ord, family, weight, size, role.
    """
    def node(c) -> Column:
        style = _s(
            fontFamily=c("family"), fontWeight=c("weight"), fontSize=c("size"), letterSpacing=c("spacing"), lineHeightPx=c("size") * c("line_height"),
            textAlignHorizontal=F.upper(c("align")), textAlignVertical=F.lit("CENTER"), textCase=F.when(c("upper_case"), "UPPER").otherwise("ORIGINAL"),
        )
        fill = _s(type=F.when(_picture(c), "IMAGE").otherwise("SOLID"), color=F.when(~_picture(c), _unit(c("fill"))), scaleMode=F.when(_picture(c), "FILL"), imageRef=F.when(_picture(c), c("id")))
        return _s(
            id=c("id"), name=c("name"), visible=c("visible"), locked=c("locked"), opacity=c("opacity"), rotation=c("rotation"), absoluteBoundingBox=_s(x=c("x"), y=c("y"), width=c("w"), height=c("h")),
            constraints=_s(vertical=F.lit("TOP"), horizontal=F.lit("LEFT")), type=F.when(_is("text", c), "TEXT").otherwise("RECTANGLE"), characters=F.when(_is("text", c), c("txt")),
            style=F.when(_is("text", c), style), cornerRadius=F.when(_is("shape", c), c("radius")), fills=F.array(fill),
        )

    c = F.col
    said = lambda c: _s(name=c("role"), fontFamily=c("family"), fontWeight=c("weight"), fontSize=c("size"))
    named = _s(name=F.concat_ws("/", "role", "name"), color=_unit(c("hex")))
    # layers are gathered as they come and become nodes afterwards: as nodes they are several times as wide
    used = ["id", "name", "type", "x", "y", "w", "h", "visible", "locked", "opacity", "rotation", "src", "fill", "radius", "txt", "size", "weight", "family", "align", "spacing", "line_height", "upper_case"]
    raw = F.struct(*used, *(["role"] if texts is None else []))
    apart = {} if texts is None else {"_t": ordered(texts.withColumn("z", F.col("ord")), said(c), "v", key)}
    whole = _gathered(scenes, key, layers, {"_raw": _list(raw)}, palette, named, **apart)
    each = lambda rows, f: F.transform(rows, lambda s: f(lambda n: s[n]))
    pictures = each(F.filter("_raw", lambda s: _picture(lambda n: s[n])), lambda c: F.struct(c("id").alias("id"), c("src").alias("src")))
    whole = whole.withColumns({"_l": each("_raw", node), "_i": pictures} | ({"_t": each("_raw", said)} if texts is None else {})).drop("_raw")
    box = _s(x=F.lit(0), y=F.lit(0), width=c("width"), height=c("height"))
    frame = _s(id=F.lit("1:1"), type=F.lit("FRAME"), name=c("name"), absoluteBoundingBox=box, fills=F.array(_solid(c("background"))), clipsContent=F.lit(True), children=c("_l"))
    canvas = _s(id=F.lit("0:1"), type=F.lit("CANVAS"), name=F.lit(CANVAS_NAME), backgroundColor=_unit(F.lit(CANVAS_COLOR)), children=F.array(frame))
    root = _s(id=F.lit("0:0"), type=F.lit("DOCUMENT"), children=F.array(canvas))
    styles = _s(colors=c("_c"), text=F.array_distinct("_t"))
    return whole.select(key, F.to_json(F.struct(F.lit("nodes@1").alias("$schema"), c("name"), root.alias("document"), F.map_from_entries("_i").alias("images"), styles.alias("styles"))).alias("json"))


def page_document(scenes: DataFrame | list[str], layers: DataFrame, palette: DataFrame, texts: DataFrame | None, key: str = "pid") -> DataFrame:
    """(key, json): a page of elements with a brand kit of the palette and the distinct fonts as first seen."""
    c = F.col
    text = _s(
        content=F.when(c("upper_case"), F.upper("txt")).otherwise(c("txt")), fontFamily=c("family"), fontWeight=F.when(c("weight") >= BOLD, "bold").otherwise("normal"),
        fontSize=c("size"), color=c("fill"), textAlign=c("align"), letterSpacing=c("spacing"),
    )
    one = _s(
        id=c("id"), name=c("name"), top=c("y"), left=c("x"), width=c("w"), height=c("h"), rotation=c("rotation"), transparency=1 - c("opacity"), locked=c("locked"), hidden=~c("visible"),
        type=F.when(_is("text"), "TEXT").when(_is("shape"), "SHAPE").otherwise("IMAGE"), text=F.when(_is("text"), text), fill=F.when(_is("shape"), _s(color=c("fill"))),
        cornerRadius=F.when(_is("shape"), c("radius")), image=F.when(_picture(), _s(src=c("src"), fit=c("fit"))),
    )
    own = {"_t": _list(c("family"))} if texts is None else {}
    apart = {} if texts is None else {"_t": ordered(texts.withColumn("z", F.col("ord")), c("family"), "v", key)}
    whole = _gathered(scenes, key, layers, {"_l": _list(one)} | own, palette, c("hex"), **apart)
    page = _s(background=_s(color=c("background")), elements=c("_l"))
    size = _s(width=c("width"), height=c("height"), units=F.lit("px"))
    kit = _s(colors=c("_c"), fonts=F.array_distinct("_t"))
    return whole.select(key, F.to_json(F.struct(F.lit("pages@1").alias("$schema"), c("name").alias("title"), size.alias("dimensions"), F.array(page).alias("pages"), kit.alias("brandKit"))).alias("json"))


# -------------------------------------------------------------------- videos

NOTE = "Times are in seconds. Boxes and motion are in scene pixels; times videoScale they are video pixels. The easing of a key holds until the next one."


def _clock(s: Column) -> Column:
    tenths = half_up((s % 60) * 10)
    return F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.lpad(F.floor(tenths / 10).cast("string"), 2, "0"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))


def folder() -> Column:
    """A scene's folder: its number and times."""
    n = F.col("scene").cast("string")
    return F.concat(F.lit("scenes/"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n), F.lit("-"), _clock(F.col("start")), F.lit("-"), _clock(F.col("end")))


def _suffix(src: Column) -> Column:
    return F.when(src.startswith("data:image/png"), ".png").otherwise(".jpg")


def _placed(scenes: DataFrame, layers: DataFrame, key: str) -> DataFrame:
    """Layers with their scene's folder, its times, and the path of their picture: the number in it counts all layers of the scene from 0."""
    k = (F.row_number().over(Window.partitionBy(key, "scene").orderBy("z")) - 1).cast("string")
    slug = F.lower(F.regexp_replace(F.regexp_replace("name", "[^A-Za-z0-9_]+", "-"), "^-|-$", ""))
    name = F.when(_is("background"), "background").otherwise(F.concat(F.lit("layers/"), F.when(F.length("_k") < 2, F.lpad("_k", 2, "0")).otherwise(F.col("_k")), F.lit("-"), F.when(slug == "", "layer").otherwise(slug)))
    x = layers.withColumn("_k", k).join(scenes.select(key, "scene", "start", "end", folder().alias("_folder")), [key, "scene"])
    return x.withColumn("file", F.when(_picture(), F.concat("_folder", F.lit("/"), name, _suffix(F.col("src")))))


def timeline(videos: DataFrame, scenes: DataFrame, layers: DataFrame, key: str = "vid") -> DataFrame:
    """(key, json): where and when each layer of a video appears, and the files that show it.

    Videos: file_name, width, height, duration; scenes: scene (from 1), start, end, transition, keyframes,
    width, height, original; layers as above: those without times of their own have their scene's.
    """
    c = F.col
    easing = F.lit(None).cast("string")
    css_of = lambda e: F.coalesce(*(F.when(e == name, css(name)) for name in CURVES), easing)
    motion = F.transform("motion", lambda m: _s(t=m["t"], dx=m["dx"], dy=m["dy"], scale=m["scale"], opacity=m["opacity"], easing=css_of(m["easing"])))
    text = lambda x: F.when(_is("text"), x)
    one = _s(
        **{"id": c("id"), "name": c("name"), "type": c("type"), "x": half_up(c("x")), "y": half_up(c("y")), "width": half_up(c("w")), "height": half_up(c("h")), "rotation": c("rotation"), "opacity": c("opacity"), "visible": c("visible")},
        **{"in": round_to(F.coalesce("t_in", "start"), 3), "out": round_to(F.coalesce("t_out", "end"), 3), "motion": motion, "file": c("file")},
        text=text(c("txt")), color=text(c("fill")), fontFamily=text(c("family")), fontSize=text(c("size")), fontWeight=text(c("weight")), align=text(c("align")), letterSpacing=text(c("spacing")), lineHeight=text(c("line_height")), uppercase=text(c("upper_case")),
    )
    rows = _placed(scenes, layers, key).groupBy(key, "scene").agg(F.transform(F.array_sort(F.collect_list(F.struct("z", one.alias("v")))), lambda s: s["v"]).alias("_l"))
    size = videos.select(key, c("width").alias("_width"), "file_name", c("height").alias("_height"), "duration")
    scene = _s(
        index=c("scene"), start=round_to(c("start"), 3), end=round_to(c("end"), 3), transition=c("transition"), keyframes=F.transform("keyframes", lambda k: round_to(k, 3)), folder=folder(),
        width=c("width"), height=c("height"), videoScale=round_to(c("_width") / c("width"), 4), layers=F.coalesce("_l", F.array()),
    )
    parts = scenes.join(size.select(key, "_width"), key).join(rows, [key, "scene"], "left").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("scene", scene.alias("v")))), lambda s: s["v"]).alias("_s"))
    about = _s(fileName=c("file_name"), width=c("_width"), height=c("_height"), duration=c("duration"))
    whole = size.join(parts, key, "left")
    return whole.select(key, F.to_json(_s(format=F.lit("video-layers"), version=F.lit(1), video=about, note=F.lit(NOTE), scenes=F.coalesce("_s", F.array()))).alias("json"))


def video_files(videos: DataFrame, scenes: DataFrame, layers: DataFrame, key: str = "vid", rebuilt: DataFrame | None = None) -> DataFrame:
    """(key, path, content): the timeline, each scene's keyframe, its layers' pictures, and its rebuilt frame if given as (key, scene, content)."""
    data = lambda src: F.unbase64(F.substring_index(src, ",", -1)).alias("content")
    out = timeline(videos, scenes, layers, key).select(key, F.lit("timeline.json").alias("path"), F.encode("json", "UTF-8").alias("content"))
    frame = scenes.select(key, F.concat(folder(), F.lit("/keyframe"), _suffix(F.col("original"))).alias("path"), data(F.col("original")))
    pictures = _placed(scenes, layers, key).where(_picture()).select(key, F.col("file").alias("path"), data(F.col("src")))
    out = out.unionByName(frame).unionByName(pictures)
    if rebuilt is not None:
        out = out.unionByName(scenes.join(rebuilt, [key, "scene"]).select(key, F.concat(folder(), F.lit("/rebuilt.png")).alias("path"), "content"))
    return out
