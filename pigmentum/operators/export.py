"""Exports of scenes as JSON, SVG, captions and animation documents, one document per design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..functions.text import stamp, xml



def _lines(c: Column) -> Column:
    return F.array_join(F.transform(c["lines"], lambda x: x["text"]), "\n")


def srt(cues: Column) -> Column:
    """SubRip text of cues (start, end, lines)."""
    one = lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), stamp(c["start"], ","), F.lit(" --> "), stamp(c["end"], ","), F.lit("\n"), _lines(c), F.lit("\n"))
    return F.array_join(F.transform(cues, one), "\n")


def vtt(cues: Column) -> Column:
    one = lambda c: F.concat(stamp(c["start"], "."), F.lit(" --> "), stamp(c["end"], "."), F.lit("\n"), _lines(c), F.lit("\n"))
    return F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(cues, one), "\n"))


def ordered(layers: DataFrame, value: Column, name: str, key: str = "pid", falling: bool = False) -> DataFrame:
    """(key, name): an array of each scene's values in z order."""
    z = -F.col("z") if falling else F.col("z")
    return layers.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(z.alias("z"), value.alias("v")))), lambda s: s["v"]).alias(name))


def number(x: Column) -> Column:
    """A number as documents show it: without a point if it is whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def svg(layers: DataFrame, canvas: tuple[int, int], background: str = "#FFFFFF", key: str = "pid") -> DataFrame:
    """(key, svg): visible layers bottom to top; layers have id, type, x, y, w, h, rotation, opacity, name, txt, ..."""
    c = lambda n: number(F.col(n))
    turn = F.concat(F.lit('transform="rotate('), c("rotation"), F.lit(" "), number(F.col("x") + F.col("w") / 2), F.lit(" "), number(F.col("y") + F.col("h") / 2), F.lit(')" opacity="'), c("opacity"), F.lit('"'))
    frame = F.concat(F.lit('id="'), F.col("id"), F.lit('" x="'), c("x"), F.lit('" y="'), c("y"), F.lit('" width="'), c("w"), F.lit('" height="'), c("h"), F.lit('"'))
    image = F.concat(F.lit("<image "), frame, F.lit(' preserveAspectRatio="none" '), turn, F.lit("><title>"), xml(F.col("name")), F.lit("</title></image>"))
    anchor = F.when(F.col("align") == "left", "start").when(F.col("align") == "right", "end").otherwise("middle")
    at = F.when(F.col("align") == "left", F.col("x")).when(F.col("align") == "right", F.col("x") + F.col("w")).otherwise(F.col("x") + F.col("w") / 2)
    said = xml(F.when(F.col("upper_case"), F.upper("txt")).otherwise(F.col("txt")))
    text = F.concat(F.lit('<text id="'), F.col("id"), F.lit('" x="'), number(at), F.lit('" y="'), number(F.col("y") + F.col("h") / 2), F.lit('" text-anchor="'), anchor, F.lit('" font-family="'), xml(F.col("family")), F.lit('" font-size="'), c("size"), F.lit('" font-weight="'), c("weight"), F.lit('" letter-spacing="'), c("spacing"), F.lit('" fill="'), F.col("fill"), F.lit('" '), turn, F.lit(">"), said, F.lit("</text>"))
    rect = F.concat(F.lit("<rect "), frame, F.lit(' rx="'), c("radius"), F.lit('" fill="'), F.col("fill"), F.lit('" '), turn, F.lit("/>"))
    one = F.when(F.col("type").isin("image", "background"), image).when(F.col("type") == "text", text).otherwise(rect)
    w, h = canvas
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}"><rect width="100%" height="100%" fill="{background}"/>'
    body = F.array_sort(F.collect_list(F.when(F.col("visible"), F.struct("z", one.alias("v")))))
    return layers.groupBy(key).agg(F.concat(F.lit(head), F.array_join(F.transform(body, lambda s: s["v"]), ""), F.lit("</svg>")).alias("svg"))


def layer_stack(layers: DataFrame, key: str = "pid") -> DataFrame:
    """(key, document): a layered-image JSON, top layer first, with whole bounds and 8-bit opacity."""
    b = F.struct(half_up(F.col("y")).alias("top"), half_up(F.col("x")).alias("left"), half_up(F.col("y") + F.col("h")).alias("bottom"), half_up(F.col("x") + F.col("w")).alias("right"))
    kind = F.when(F.col("type") == "text", "textLayer").when(F.col("type") == "shape", "solidColorLayer").when(F.col("type") == "background", "backgroundLayer").otherwise("pixelLayer")
    text = F.when(F.col("type") == "text", F.struct(F.col("txt").alias("content"), F.col("family"), F.col("weight"), half_up(F.col("spacing") / F.greatest(F.lit(1e-6), F.col("size")) * 1000).alias("tracking"), F.col("align").alias("justification")))
    one = F.struct("id", "name", kind.alias("kind"), "visible", "locked", half_up(F.col("opacity") * 255).alias("opacity"), b.alias("bounds"), half_up(F.col("rotation")).alias("rotation"), text.alias("text"))
    return ordered(layers, one, "layers", key, falling=True).select(key, F.to_json(F.struct("layers")).alias("document"))


def nodes(layers: DataFrame, key: str = "pid") -> DataFrame:
    """(key, document): a design-tool JSON with nodes, the distinct text styles in order, and fills."""
    style = F.when(F.col("type") == "text", F.concat_ws(" ", "family", F.col("weight").cast("string"), number(F.col("size"))))
    node = F.struct("id", "name", F.upper("type").alias("type"), half_up(F.col("x")).alias("x"), half_up(F.col("y")).alias("y"), half_up(F.col("w")).alias("width"), half_up(F.col("h")).alias("height"), "visible")
    g = layers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("z", node.alias("node"), style.alias("style")))).alias("l"))
    return g.select(key, F.to_json(F.struct(F.transform("l", lambda s: s["node"]).alias("nodes"), F.array_distinct(F.filter(F.transform("l", lambda s: s["style"]), lambda s: s.isNotNull())).alias("textStyles"))).alias("document"))


def brand_kit(layers: DataFrame, key: str = "pid") -> DataFrame:
    """(key, document): elements with transparency and boldness, and a kit of distinct fonts and colours."""
    one = F.struct("id", "type", half_up((1 - F.col("opacity")) * 100).alias("transparency"), (F.col("weight") >= 600).alias("bold"))
    g = layers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("z", one.alias("e"), F.when(F.col("type") == "text", F.col("family")).alias("font"), F.when(F.col("type") != "background", F.col("fill")).alias("fill")))).alias("l"))
    pick = lambda f: F.array_distinct(F.filter(F.transform("l", lambda s: s[f]), lambda s: s.isNotNull()))
    return g.select(key, F.to_json(F.struct(F.transform("l", lambda s: s["e"]).alias("elements"), F.struct(pick("font").alias("fonts"), pick("fill").alias("colors")).alias("brandKit"))).alias("document"))
