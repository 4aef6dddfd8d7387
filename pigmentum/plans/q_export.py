"""Queries over exports, sinks, sources and scene edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.color import to_hex
from ..functions.easing import CURVES
from ..functions.numeric import half_up, round_to
from ..operators import export, library, motion, scene, timeline
from .q_design import HEX
from .registry import query, r, whole

def RGB():  # noqa: N802
    return tuple(F.col(c) for c in "rgb")

NUM = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS STRING) ELSE CAST({x} AS STRING) END"
XML = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def filled(layers):
    return layers.withColumn("fill", to_hex(*RGB()))


_FRAME = f"""'id="' || id || '" x="' || {NUM('x')} || '" y="' || {NUM('y')} || '" width="' || {NUM('w')} || '" height="' || {NUM('h')} || '"'"""
_TURN = f"""'transform="rotate(' || {NUM('rotation')} || ' ' || {NUM('(x + w / 2)')} || ' ' || {NUM('(y + h / 2)')} || ')" opacity="' || {NUM('opacity')} || '"'"""
_HEAD = '<svg xmlns="http://www.w3.org/2000/svg" width="600" height="600" viewBox="0 0 600 600"><rect width="100%" height="100%" fill="#FFFFFF"/>'


@query("snk_07_svg", "fx_layers", sql=f"""SELECT pid, '{_HEAD}' || coalesce(string_agg(part, '' ORDER BY z) FILTER (visible), '') || '</svg>' AS svg FROM (SELECT *, CASE WHEN type IN ('image', 'background') THEN '<image ' || {_FRAME} || ' preserveAspectRatio="none" ' || {_TURN} || '><title>' || {XML('name')} || '</title></image>'
  WHEN type = 'text' THEN '<text id="' || id || '" x="' || {NUM("(CASE align WHEN 'left' THEN x WHEN 'right' THEN x + w ELSE x + w / 2 END)")} || '" y="' || {NUM('(y + h / 2)')} || '" text-anchor="' || CASE align WHEN 'left' THEN 'start' WHEN 'right' THEN 'end' ELSE 'middle' END || '" font-family="' || {XML('family')} || '" font-size="' || {NUM('size')}
    || '" font-weight="' || CAST(weight AS STRING) || '" letter-spacing="' || {NUM('spacing')} || '" fill="' || {HEX} || '" ' || {_TURN} || '>' || {XML('CASE WHEN upper_case THEN upper(txt) ELSE txt END')} || '</text>'
  ELSE '<rect ' || {_FRAME} || ' rx="' || {NUM('radius')} || '" fill="' || {HEX} || '" ' || {_TURN} || '/>' END AS part FROM fx_layers) GROUP BY pid""")
def snk07(layers):
    return export.svg(filled(layers), (600, 600))


@query("snk_09_layer_stack", "fx_layers", sql=f"""SELECT pid, string_agg(id || ':' || CASE type WHEN 'text' THEN 'textLayer' WHEN 'shape' THEN 'solidColorLayer' WHEN 'background' THEN 'backgroundLayer' ELSE 'pixelLayer' END || ':' || CAST({whole('opacity * 255')} AS STRING) || ':' || CAST({whole('y + h')} AS STRING)
  || ':' || CASE WHEN type = 'text' THEN CAST({whole('spacing / size * 1000')} AS STRING) ELSE '-' END, ' ' ORDER BY z DESC) AS stack FROM fx_layers GROUP BY pid""")
def snk09(layers):
    doc = export.layer_stack(layers)
    shape = "struct<layers:array<struct<id:string,kind:string,opacity:bigint,bounds:struct<bottom:bigint>,text:struct<tracking:bigint>>>>"
    one = lambda x: F.concat_ws(":", x["id"], x["kind"], x["opacity"].cast("string"), x["bounds"]["bottom"].cast("string"), F.coalesce(x["text"]["tracking"].cast("string"), F.lit("-")))
    return doc.select("pid", F.array_join(F.transform(F.from_json("document", shape)["layers"], one), " ").alias("stack"))


@query("snk_10_design_nodes", "fx_layers", sql=f"""SELECT pid, count(*) AS n, sum(CASE WHEN visible THEN 1 ELSE 0 END)::BIGINT AS shown, count(DISTINCT CASE WHEN type = 'text' THEN family || ' ' || CAST(weight AS STRING) || ' ' || {NUM('size')} END) AS styles, string_agg(upper(type), ',' ORDER BY z) AS types FROM fx_layers GROUP BY pid""")
def snk10(layers):
    j = F.from_json("document", "struct<nodes:array<struct<type:string,visible:boolean>>,textStyles:array<string>>")
    d = export.nodes(layers).withColumn("j", j)
    return d.select("pid", F.size("j.nodes").cast("bigint").alias("n"), F.size(F.filter("j.nodes", lambda x: x["visible"])).cast("bigint").alias("shown"), F.size("j.textStyles").cast("bigint").alias("styles"), F.array_join(F.transform("j.nodes", lambda x: x["type"]), ",").alias("types"))


@query("snk_11_brand_kit", "fx_layers", sql=f"""SELECT pid, string_agg(CAST({whole('(1 - opacity) * 100')} AS STRING), ',' ORDER BY z) AS transparency, count(*) FILTER (weight >= 600) AS bold, count(DISTINCT CASE WHEN type = 'text' THEN family END) AS fonts, count(DISTINCT CASE WHEN type <> 'background' THEN {HEX} END) AS colors FROM fx_layers GROUP BY pid""")
def snk11(layers):
    d = export.brand_kit(filled(layers)).withColumn("j", F.from_json("document", "struct<elements:array<struct<transparency:bigint,bold:boolean>>,brandKit:struct<fonts:array<string>,colors:array<string>>>"))
    return d.select("pid", F.array_join(F.transform("j.elements", lambda x: x["transparency"].cast("string")), ",").alias("transparency"), F.size(F.filter("j.elements", lambda x: x["bold"])).cast("bigint").alias("bold"), F.size("j.brandKit.fonts").cast("bigint").alias("fonts"), F.size("j.brandKit.colors").cast("bigint").alias("colors"))


@query("snk_12_file_names", "fx_projects", sql="SELECT id, coalesce(nullif(lower(regexp_replace(name || ' (' || segment || ')', '[^A-Za-z0-9_-]+', '-', 'g')), ''), 'poster') || '.' || CASE id % 3 WHEN 0 THEN 'svg' WHEN 1 THEN 'json' ELSE 'pdf' END AS file FROM fx_projects")
def snk12(p):
    ext = F.element_at(F.array(*map(F.lit, ("svg", "json", "pdf"))), (F.col("id") % 3 + 1).cast("int"))
    return p.select("id", F.concat_ws(".", text.file_slug(F.concat("name", F.lit(" ("), "segment", F.lit(")"))), ext).alias("file"))


@query("snk_13_asset_manifest", "fx_boxes", sql="SELECT pid, ord, lpad(CAST(row_number() OVER (PARTITION BY pid ORDER BY ord) AS STRING), 2, '0') || '-' || kind || '-' || regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g') || '.png' AS file FROM fx_boxes WHERE conf > 0.2")
def snk13(b):
    n = F.row_number().over(Window.partitionBy("pid").orderBy("ord"))
    return b.where("conf > 0.2").withColumn("n", n).select("pid", "ord", F.concat(F.concat_ws("-", text.two(F.col("n")), "kind", text.slug(F.col("label"))), F.lit(".png")).alias("file"))


@query("snk_14_timeline", "fx_layers", "fx_timing", sql=f"SELECT pid, string_agg(id || '@' || CAST({whole('coalesce(t_in, 0) * 1000')} AS STRING) || '-' || CAST({whole('coalesce(t_out, 4) * 1000')} AS STRING), ' ' ORDER BY z) AS timeline FROM fx_layers l LEFT JOIN (SELECT 'S' || CAST(vid AS STRING) || '_' || CAST(ord AS STRING) AS source_id, t_in, t_out FROM fx_timing) t USING (source_id) GROUP BY pid")
def snk14(layers, t):
    t = t.select(F.concat(F.lit("S"), F.col("vid").cast("string"), F.lit("_"), F.col("ord").cast("string")).alias("source_id"), "t_in", "t_out")
    ms = lambda c, d: half_up(F.coalesce(c, F.lit(d)) * 1000).cast("string")
    j = layers.join(t, "source_id", "left")
    return export.ordered(j, F.concat("id", F.lit("@"), ms("t_in", 0.0), F.lit("-"), ms("t_out", 4.0)), "parts").select("pid", F.array_join("parts", " ").alias("timeline"))


LOTTIE_TIMES = "list_sort(list_distinct([0, {a}, {a} + 12, {b}, 60]))"


@query("snk_16_animation_tracks", "fx_timing", sql=f"""SELECT vid, ord, array_to_string(list_transform(list_sort(list_distinct([CAST(0 AS BIGINT), {whole('t_in * 25')}, {whole('(t_in + 0.5) * 25')}, {whole('t_out * 25')}])), lambda f: CAST(f AS STRING) || ':' || CASE WHEN f < {whole('t_in * 25')} OR f >= {whole('t_out * 25')} THEN '0' ELSE '100' END), ' ') AS opacity FROM fx_timing""")
def snk16(t):
    from ..operators.animation import opacity_track

    track = opacity_track(F.col("t_in"), F.col("t_out"), [F.col("t_in") + 0.5], 25)
    return t.select("vid", "ord", F.array_join(F.transform(track, lambda k: F.concat_ws(":", k["t"].cast("string"), k["s"].cast("string"))), " ").alias("opacity"))


def _num(x: str) -> str:
    v = r(x, 3)
    return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"


def _json_list(*xs: str) -> str:
    return " || ',' || ".join(["'['", *(f"({_num(x)})" for x in xs)]).replace("'[' || ',' || ", "'[' || ", 1)


_EASINGS = ("ease-out", "linear", "out-expo")
_BY_LID = lambda i: "CASE lid % 3 " + " ".join(f"WHEN {n} THEN {CURVES[c][i]!r}" for n, c in enumerate(_EASINGS)) + " END"
_POINTS = "CASE {e} " + " ".join(f"""WHEN {n} THEN ',"o":{{{{"x":[{CURVES[c][0]:g}],"y":[{CURVES[c][1]:g}]}}}},"i":{{{{"x":[{CURVES[c][2]:g}],"y":[{CURVES[c][3]:g}]}}}}'""" for n, c in enumerate(_EASINGS)) + " END"
_BEZ = lambda t, a, b: f"(3 * {a} * {t} * (1 - {t}) * (1 - {t}) + 3 * {b} * {t} * {t} * (1 - {t}) + {t} * {t} * {t})"
_ZERO = "{'lo': CAST(0 AS DOUBLE), 'hi': CAST(1 AS DOUBLE)}"
_TRACK = lambda n: f"""CASE WHEN count(*) > 1 THEN '{{"a":1,"k":[' || string_agg('{{"t":' || frame || ',"s":' || {n} || CASE WHEN nxt IS NULL THEN '' WHEN {n}_still THEN ',"h":1' ELSE points END || '}}', ',' ORDER BY t) || ']}}' ELSE '{{"a":0,"k":' || min({n}) || '}}' END AS {n}"""

ANIMATION = f""", sc AS (SELECT *, greatest(0, s0 - fade / 2) AS t0, least(8, s1 + coalesce(lead(fade) OVER (PARTITION BY vid ORDER BY scene), 0) / 2) AS t1 FROM (
    SELECT vid, k AS scene, CAST(CASE k WHEN 1 THEN 0 ELSE 2 END AS DOUBLE) AS s0, CAST(CASE k WHEN 1 THEN 2 ELSE 8 END AS DOUBLE) AS s1, CAST(CASE WHEN k = 2 AND vid % 2 = 0 THEN 0.6 ELSE 0 END AS DOUBLE) AS fade FROM (SELECT DISTINCT vid FROM fx_timing) CROSS JOIN (VALUES (1), (2)) q(k))),
  b AS (SELECT *, row_number() OVER (PARTITION BY vid, scene ORDER BY ord DESC) AS ind FROM (SELECT *, CASE WHEN t_in < 2 THEN 1 ELSE 2 END AS scene FROM fx_timing)),
  l AS (SELECT b.*, t0, t1, CAST(b.ord % 20 * 10 AS DOUBLE) AS x, CAST(100 + lid % 5 * 10 AS DOUBLE) AS w, CAST(40 AS DOUBLE) AS h, 1 - CAST(lid % 3 AS DOUBLE) / 10 AS op, 'data:' || CAST(lid % 7 AS VARCHAR) AS src, lid % 8 = 3 AS fixed, lid % 4 <> 1 AS has, t_in - 0.2 AS k1, t_in + 0.3 AS k2 FROM b JOIN sc USING (vid, scene) WHERE lid % 6 <> 0),
  im AS (SELECT *, 'img_' || CAST(row_number() OVER (PARTITION BY vid ORDER BY scene, ind) - 1 AS VARCHAR) AS img FROM (SELECT vid, src, min((scene, ind)) AS at, arg_min(scene, (scene, ind)) AS scene, arg_min(ind, (scene, ind)) AS ind FROM l GROUP BY vid, src)),
  tt AS (SELECT *, lead(t) OVER (PARTITION BY lid ORDER BY t) AS nxt FROM (SELECT lid, t0, t1, unnest(list_distinct(list_concat([{r('t0', 4)}, {r('t1', 4)}, {r('t_in', 4)}, {r('t_out', 4)}], CASE WHEN has THEN [{r('k1', 4)}, {r('k2', 4)}, {r('t_out', 4)}] ELSE [] END))) AS t FROM l WHERE NOT fixed) WHERE t >= t0 AND t <= t1),
  sm AS (SELECT lid, t, 0 AS e, least(t1, t + 1e-4) AS tau FROM tt UNION ALL SELECT lid, t, 1, nxt - 1e-4 FROM tt WHERE nxt IS NOT NULL),
  sg AS (SELECT *, CASE WHEN NOT has THEN 4 WHEN tau < k1 THEN 0 WHEN tau < k2 THEN 1 WHEN tau < t_out THEN 2 ELSE 3 END AS seg FROM sm JOIN l USING (lid)),
  sx AS (SELECT *, CASE seg WHEN 1 THEN (tau - k1) / greatest(1e-6, k2 - k1) WHEN 2 THEN (tau - k2) / greatest(1e-6, t_out - k2) END AS u, {_BY_LID(0)} AS x1, {_BY_LID(1)} AS y1, {_BY_LID(2)} AS x2, {_BY_LID(3)} AS y2 FROM sg),
  sz AS (SELECT *, list_reduce(list_prepend({_ZERO}, list_transform(range(30), lambda i: {_ZERO})), lambda s, i: CASE WHEN {_BEZ('((s.lo + s.hi) / 2)', 'x1', 'x2')} < u THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END) AS z FROM sx),
  se AS (SELECT *, CASE WHEN seg = 2 OR lid % 3 = 1 THEN least(1, greatest(0, u)) WHEN u <= 0 THEN 0 WHEN u >= 1 THEN 1 ELSE {_BEZ('((z.lo + z.hi) / 2)', 'y1', 'y2')} END AS m FROM sz),
  sv AS (SELECT lid, t, e, CASE seg WHEN 0 THEN dx WHEN 1 THEN dx + (0 - dx) * m ELSE 0 END AS vx, CASE seg WHEN 0 THEN dy WHEN 1 THEN dy + (0 - dy) * m ELSE 0 END AS vy, CASE seg WHEN 0 THEN scale WHEN 1 THEN scale + (1 - scale) * m ELSE 1 END AS vs,
    CASE WHEN tau < least(t_in, CASE WHEN has AND o_first < 0.05 THEN k1 ELSE t_in END) OR tau > t_out THEN 0 ELSE CASE seg WHEN 0 THEN o_first WHEN 1 THEN o_first + (1 - o_first) * m WHEN 2 THEN 1 + (o_last - 1) * m WHEN 3 THEN o_last ELSE 1 END END AS vo FROM se),
  kf AS (SELECT l.lid, tt.t, tt.nxt, {_num('tt.t * 30')} AS frame, {_json_list('x + w / 2 + a.vx', 'y + h / 2 + a.vy')} || ',0]' AS p, {_json_list('a.vs * 100 * (w / 200)', 'a.vs * 100 * (h / 80)')} || ',100]' AS s, {_json_list('a.vo * op * 100')} || ']' AS o,
    abs(x + w / 2 + a.vx - (x + w / 2 + z.vx)) < 1e-6 AND abs(y + h / 2 + a.vy - (y + h / 2 + z.vy)) < 1e-6 AS p_still, abs(a.vs * 100 - z.vs * 100) < 1e-6 AS s_still, abs(a.vo * op * 100 - z.vo * op * 100) < 1e-6 AS o_still,
    CASE WHEN has AND abs(k1 - tt.t) < 1e-3 THEN {_POINTS.format(e='l.lid % 3')} ELSE {_POINTS.format(e='1')} END AS points FROM tt JOIN l USING (lid) JOIN sv a ON a.lid = tt.lid AND a.t = tt.t AND a.e = 0 LEFT JOIN sv z ON z.lid = tt.lid AND z.t = tt.t AND z.e = 1),
  tr AS (SELECT lid, {_TRACK('p')}, {_TRACK('s')}, {_TRACK('o')} FROM kf GROUP BY lid
    UNION ALL SELECT lid, '{{"a":0,"k":' || {_json_list('x + w / 2', 'y + h / 2')} || ',0]}}', '{{"a":0,"k":' || {_json_list('100 * (w / 200)', '100 * (h / 80)')} || ',100]}}', '{{"a":0,"k":' || {_num('op * 100')} || '}}' FROM l WHERE fixed),
  lt AS (SELECT l.vid, l.scene, l.ind, '{{"ddd":0,"ind":' || l.ind || ',"ty":2,"nm":"' || txt || '","refId":"' || img || '","sr":1,"ks":{{"o":' || tr.o || ',"r":{{"a":0,"k":' || lid % 90 || '}},"p":' || tr.p || ',"a":{{"a":0,"k":[100,40,0]}},"s":' || tr.s || '}},"ao":0,"ip":' || {_num('t0 * 30')} || ',"op":' || {_num('t1 * 30')} || ',"st":0,"bm":0}}' AS text FROM l JOIN tr USING (lid) JOIN im ON im.vid = l.vid AND im.src = l.src),
  sl AS (SELECT vid, scene, string_agg(text, ',' ORDER BY ind) AS layers FROM lt GROUP BY vid, scene),
  si AS (SELECT vid, scene, string_agg('{{"id":"' || img || '","w":200,"h":80,"u":"","p":"' || src || '","e":1}}', ',' ORDER BY ind) AS images FROM im GROUP BY vid, scene),
  sd AS (SELECT vid, scene, concat_ws(',', images, '{{"id":"scene_' || scene || '","nm":"Scene ' || scene || '","layers":[' || coalesce(layers, '') || ']}}') AS assets,
    '{{"ddd":0,"ind":' || scene || ',"ty":0,"nm":"Scene ' || scene || '","refId":"scene_' || scene || '","sr":1,"ks":{{"o":' || CASE WHEN fade > 0 THEN '{{"a":1,"k":[{{"t":' || {_num('t0 * 30')} || ',"s":[0],"o":{{"x":[0],"y":[0]}},"i":{{"x":[1],"y":[1]}}}},{{"t":' || {_num('(s0 + fade / 2) * 30')} || ',"s":[100]}}]}}' ELSE '{{"a":0,"k":100}}' END
      || ',"r":{{"a":0,"k":0}},"p":{{"a":0,"k":[320,180,0]}},"a":{{"a":0,"k":[320,180,0]}},"s":{{"a":0,"k":[100,100,100]}}}},"ao":0,"w":640,"h":360,"ip":' || {_num('t0 * 30')} || ',"op":' || {_num('t1 * 30')} || ',"st":0,"bm":0}}' AS layer,
    '{{"tm":' || {_num('s0 * 30')} || ',"cm":"Scene ' || scene || '","dr":' || {_num('(s1 - s0) * 30')} || '}}' AS marker FROM sc LEFT JOIN sl USING (vid, scene) LEFT JOIN si USING (vid, scene))
  SELECT vid, '{{"v":"5.12.1","fr":30,"ip":0,"op":240,"w":640,"h":360,"nm":"Video ' || vid || '","ddd":0,"assets":[' || string_agg(assets, ',' ORDER BY scene) || '],"layers":[' || string_agg(layer, ',' ORDER BY scene DESC) || '],"markers":[' || string_agg(marker, ',' ORDER BY scene) || ']}}' AS json FROM sd GROUP BY vid"""


@query("snk_16_animation_document", "fx_timing", sql=ANIMATION)
def snk16_document(t):
    """A video per user, in two scenes; some layers have no motion, some no timing at all."""
    from ..operators.animation import document

    e = F.expr
    key = lambda at, dx, dy, scale, o, easing: F.struct(at.alias("t"), dx.alias("dx"), dy.alias("dy"), scale.alias("scale"), o.alias("opacity"), easing.alias("easing"))
    zero, one = F.lit(0.0), F.lit(1.0)
    easing = F.element_at(F.array(*map(F.lit, _EASINGS)), (F.col("lid") % 3 + 1).cast("int"))
    keys = F.array(key(F.col("t_in") - 0.2, F.col("dx"), F.col("dy"), F.col("scale"), F.col("o_first"), easing), key(F.col("t_in") + 0.3, zero, zero, one, one, F.lit("linear")), key(F.col("t_out"), zero, zero, one, F.col("o_last"), F.lit("linear")))
    layers = t.select(
        "vid", F.when(F.col("t_in") < 2, 1).otherwise(2).alias("scene"), F.col("ord").alias("z"), F.col("txt").alias("name"), e("lid % 6 <> 0").alias("visible"), e("'data:' || CAST(lid % 7 AS STRING)").alias("src"), F.lit(200.0).alias("nw"), F.lit(80.0).alias("nh"),
        e("CAST(ord % 20 * 10 AS DOUBLE)").alias("x"), "y", e("CAST(100 + lid % 5 * 10 AS DOUBLE)").alias("w"), F.lit(40.0).alias("h"), e("1 - CAST(lid % 3 AS DOUBLE) / 10").alias("opacity"), e("CAST(lid % 90 AS DOUBLE)").alias("rotation"),
        F.when(e("lid % 8 <> 3"), F.col("t_in")).alias("t_in"), F.col("t_out"), F.when(e("lid % 4 <> 1"), keys).alias("keys"))
    second = F.col("scene") == 2
    scenes = t.select("vid").distinct().withColumn("scene", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "vid", "scene", F.when(second, 2.0).otherwise(0.0).alias("start"), F.when(second, 8.0).otherwise(2.0).alias("end"), F.when(second & (F.col("vid") % 2 == 0), 0.6).otherwise(0.0).alias("fade"), F.lit(8.0).alias("duration"), F.concat(F.lit("Video "), F.col("vid").cast("string")).alias("name"), F.lit(640.0).alias("w"), F.lit(360.0).alias("h"))
    return document(scenes, layers, "vid")


@query("snk_17_animation_layer", "fx_layers", sql=f"""SELECT id, z + 1 AS ind, {whole('x + w / 2')} AS px, {whole('y + h / 2')} AS py, {whole('w / 2')} AS ax, {whole('opacity * 100')} AS o, rotation AS r FROM fx_layers""")
def snk17(layers):
    from ..operators.animation import image_layer

    return layers.select(image_layer().alias("l")).select(F.col("l.nm").alias("id"), "l.ind", "l.px", "l.py", "l.ax", "l.o", "l.r")


@query("snk_18_frame_clock", "fx_timing", sql=f"SELECT vid, {whole('max(t_out) * 30')} AS frames, {r('(' + whole('max(t_out) * 30') + ' - 1) / 30.0')} AS last FROM fx_timing GROUP BY vid")
def snk18(t):
    from ..operators.animation import frame_times

    d = t.groupBy("vid").agg(F.max("t_out").alias("d")).withColumn("times", frame_times(F.col("d"), 30))
    return d.select("vid", F.size("times").cast("bigint").alias("frames"), round_to(F.element_at("times", -1), 6).alias("last"))


@query("snk_01_save_redacted", "fx_projects", sql=f"SELECT id, name, '[inline:' || CAST({whole('(22 + 1000 * (id % 5)) / 1024.0')} AS STRING) || 'KB]' AS thumb, n_orders AS assets FROM fx_projects")
def snk01(p):
    url = F.concat(F.lit("data:image/png;base64,"), F.repeat(F.lit("A"), (1000 * (F.col("id") % 5)).cast("int")))
    return library.redact(p.withColumn("thumb", url), "thumb").select("id", "name", "thumb", F.col("n_orders").alias("assets"))


@query("snk_02_pack_scenes", "fx_boxes", sql="SELECT pid, ord, CASE WHEN ord = (pid % 3) + 1 THEN NULL ELSE label END AS stored, label AS restored FROM fx_boxes")
def snk02(b):
    active = F.col("ord") == F.col("pid") % 3 + 1
    packed = library.pack(b, active, "label")
    whole_ = library.unpack(packed, b.where(active).select("pid", "ord", F.col("label").alias("active")), ["pid", "ord"], "label", "active")
    return whole_.select("pid", "ord", F.col("packed").alias("stored"), F.col("label").alias("restored"))


@query("snk_03_delete", "fx_projects", sql="SELECT id, name FROM fx_projects WHERE NOT starred")
def snk03(p):
    return library.delete(p, p.where("starred"), "id").select("id", "name")


@query("snk_04_sync", "fx_projects", "fx_boxes", sql="SELECT id, CASE WHEN id % 10 = 0 THEN dna + 1 ELSE dna END AS dna, CAST(CASE WHEN n_orders = 0 THEN 1 ELSE n_orders + 1 END AS BIGINT) AS version, (SELECT count(*) FROM fx_boxes b WHERE b.pid = id AND CASE WHEN kind IN ('person', 'face') THEN 'PERSON' ELSE upper(kind) END = 'PERSON') AS persons FROM fx_projects")
def snk04(p, b):
    merged = library.upsert(p, p.where("id % 10 = 0").withColumn("dna", F.col("dna") + 1), "id")
    versions = library.next_version(p.select("id", F.col("n_orders").alias("version")), "id", "version")
    assets = library.asset_rows(b).where("asset_kind = 'PERSON'").groupBy(F.col("pid").alias("id")).agg(F.count(F.lit(1)).alias("persons"))
    return merged.join(versions, "id").join(assets, "id", "left").select("id", "dna", "version", F.coalesce("persons", F.lit(0)).alias("persons"))


@query("snk_05_backup", "fx_projects", sql="SELECT CAST(count(*) AS BIGINT) AS projects, CAST(sum(dna) AS BIGINT) AS dna, 1 AS version FROM fx_projects")
def snk05(p):
    lines = library.backup(p, "2026-01-01T00:00:00Z")
    back, skipped = library.restore(lines.unionAll(lines.limit(1).select(F.lit("{broken").alias("line"))))
    return back.agg(F.count(F.lit(1)).alias("projects"), F.sum(F.get_json_object("project", "$.dna").cast("bigint")).alias("dna"), F.max("version").alias("version"))


@query("src_11_restore", "fx_projects", sql="SELECT CASE WHEN id % 4 = 3 THEN 'skipped' ELSE 'restored' END AS outcome, count(*) AS n FROM fx_projects GROUP BY 1")
def src11(p):
    lines = library.backup(p.where("id % 4 <> 3"), "2026-01-01T00:00:00Z").unionAll(library.backup(p.where("id % 4 = 3"), "2026-01-01T00:00:00Z", version=9))
    good, bad = library.restore(lines)
    return good.select(F.lit("restored").alias("outcome")).unionAll(bad.select(F.lit("skipped").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("snk_19_export_log", "fx_requests", sql="SELECT event_id FROM fx_requests ORDER BY ts DESC, event_id DESC LIMIT 200")
def snk19(q):
    return library.newest(q, 200, "ts", "event_id").select("event_id")


@query("snk_20_eval_report", "fx_projects", sql=f"SELECT design_type AS metric, {r('avg(dna) / 100', 3)} AS value, {r('avg(dna) FILTER (owner < 12) / 100', 3)} AS before FROM fx_projects GROUP BY 1")
def snk20(p):
    return p.groupBy(F.col("design_type").alias("metric")).agg(round_to(F.avg("dna") / 100, 3).alias("value"), round_to(F.avg(F.when(F.col("owner") < 12, F.col("dna"))) / 100, 3).alias("before"))


MIMES = ["image/png", "image/jpeg", "image/webp", "image/gif", "text/plain", "video/mp4", "image/svg+xml"]


@query("src_01_upload_gate", "fx_requests", sql=f"""SELECT event_id, CASE WHEN mime = 'text/plain' THEN 'unsupported type' WHEN size > CASE WHEN starts_with(mime, 'video/') THEN 200 ELSE 25 END * 1048576 THEN 'too large' ELSE 'accepted' END AS outcome
  FROM (SELECT event_id, ({MIMES})[CAST(event_id % 7 AS INT) + 1] AS mime, (event_id * 7919) % 300000000 AS size FROM fx_requests)""")
def src01(q):
    from ..sources.uploads import gate

    mime = F.element_at(F.array(*map(F.lit, MIMES)), (F.col("event_id") % 7 + 1).cast("int"))
    return q.select("event_id", gate(mime, (F.col("event_id") * 7919) % 300000000).alias("outcome"))


@query("src_09_library_scan", "fx_projects", sql="SELECT id, name, dna FROM fx_projects")
def src09(p):
    return p.select("id", "name", "dna")


@query("src_10_owner_list", "fx_projects", sql="SELECT id, name, design_type, dna, starred FROM fx_projects WHERE owner = 7")
def src10(p):
    return p.where("owner = 7").select("id", "name", "design_type", "dna", "starred")


@query("src_12_provider_reply", "events", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'ok' AS status FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL, 'error' FROM events WHERE event_id % 5 = 0")
def src12(e):
    from ..sources.providers import parse_reply

    said = F.when(F.col("event_id") % 5 == 0, F.lit("no json here")).otherwise(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```")))
    p = parse_reply(said, "k bigint")
    return e.withColumn("p", p).select("event_id", F.col("p.k").alias("k"), F.when(F.col("p.k").isNull(), "error").otherwise("ok").alias("status"))


@query("src_14_detector_rows", "fx_boxes", sql=f"SELECT pid, ord, CASE label WHEN 'Player' THEN 'person' WHEN 'Vehicle' THEN 'vehicle' ELSE 'object' END AS kind, {r('x / 600', 4)} AS nx, {r('w / 600', 4)} AS nw, {r('conf', 3)} AS conf FROM fx_boxes")
def src14(b):
    from ..sources.providers import detector_rows

    return detector_rows(b, 600.0, {"Player": "person", "Vehicle": "vehicle"}).select("pid", "ord", "kind", "nx", "nw", "conf")


@query("src_17_samples", sql="SELECT * FROM (VALUES ('sports', 'Match day', 'Sports Poster'), ('sale', 'Summer sale', 'Marketing Banner'), ('event', 'Night concert', 'Event Flyer')) t(id, name, category)")
def src17():
    from pyspark.sql import SparkSession

    from ..sources.uploads import samples

    return samples(SparkSession.active())


@query("src_19_region_words", "fx_boxes", sql=f"SELECT pid, min(x) AS x, max(x + w) AS x1, {r('avg(conf)', 4)} AS conf, string_agg(label, ' ' ORDER BY x, ord) AS text FROM fx_boxes WHERE conf > 0.6 AND length(regexp_replace(label, '[^A-Za-z0-9]', '', 'g')) >= 2 GROUP BY pid")
def src19(b):
    from ..sources.providers import region_text

    return region_text(b.withColumn("text", F.col("label")), 0.6).select("pid", "x", "x1", round_to(F.col("conf"), 4).alias("conf"), "text")


@query("src_20_answer_keys", "fx_boxes", sql="SELECT pid, count(*) AS elements, count(*) FILTER (kind IN ('person', 'product', 'logo', 'icon')) AS objects FROM fx_boxes GROUP BY pid")
def src20(b):
    return b.groupBy("pid").agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("kind").isin("person", "product", "logo", "icon")).alias("objects"))


@query("src_05_raster_scale", "fx_boxes", sql=f"SELECT pid, ord, {r('greatest(1, greatest(w, h) / 100)', 4)} AS scale, {whole('w / greatest(1, greatest(w, h) / 100)')} AS rw, {whole('h / greatest(1, greatest(w, h) / 100)')} AS rh FROM fx_boxes")
def src05(b):
    from ..sources.uploads import raster_size

    return b.select("pid", "ord", raster_size(F.col("w"), F.col("h"), 100).alias("s")).select("pid", "ord", round_to(F.col("s.scale"), 4).alias("scale"), F.col("s.width").alias("rw"), F.col("s.height").alias("rh"))


@query("src_06_sample_colors", "fx_samples", sql="SELECT vec_id, i, r, g, b FROM fx_samples WHERE i % 2 = 0 AND r + g + b >= 128")
def src06(s):
    return s.where((F.col("i") % 2 == 0) & (F.col("r") + F.col("g") + F.col("b") >= 128)).select("vec_id", "i", "r", "g", "b")


def PICK():  # noqa: N802
    return F.col("z") == F.col("pid") % 4

_ORD = "CAST(row_number() OVER (PARTITION BY pid ORDER BY o, z) - 1 AS INT) AS z"


@query("edt_01_update_layer", "fx_layers", sql="SELECT id, CASE WHEN z = pid % 4 THEN 'Renamed' ELSE name END AS name, CASE WHEN z = pid % 4 THEN 0.5 ELSE opacity END AS opacity FROM fx_layers")
def edt01(layers):
    return scene.patch(layers, PICK(), name=F.lit("Renamed"), opacity=F.lit(0.5)).select("id", "name", "opacity")


def _reorder_sql(target: str) -> str:
    return f"""SELECT id, {_ORD} FROM (SELECT *, CASE WHEN z = pid % 4 AND type <> 'background' THEN {target} ELSE z END AS o FROM (SELECT *, coalesce(max(CASE WHEN type = 'background' THEN z END) OVER (PARTITION BY pid), -1) AS fl FROM fx_layers))"""


@query("edt_02_reorder_down", "fx_layers", sql=_reorder_sql("greatest(z - 1.5, fl + 0.5)"))
def edt02(layers):
    return scene.reorder(layers, PICK(), "down").select("id", "z")


@query("edt_02_reorder_top", "fx_layers", sql=_reorder_sql("1e9"))
def edt02b(layers):
    return scene.reorder(layers, PICK(), "top").select("id", "z")


@query("edt_03_remove", "fx_layers", sql=f"SELECT id, {_ORD} FROM (SELECT *, z AS o FROM fx_layers WHERE z <> pid % 4)")
def edt03(layers):
    return scene.remove(layers, PICK()).select("id", "z")


_DUP = "SELECT pid, id, name, x, locked, z, CAST(z AS DOUBLE) AS o FROM fx_layers UNION ALL SELECT pid, id || '-copy', name || ' copy', x + 16, FALSE, z, z + 0.5 FROM fx_layers WHERE z = pid % 4"


@query("edt_04_duplicate", "fx_layers", sql=f"SELECT id, name, x, locked, {_ORD} FROM ({_DUP})")
def edt04(layers):
    return scene.duplicate(layers, PICK()).select("id", "name", "x", "locked", "z")


@query("edt_05_add_layer", "fx_layers", sql="SELECT id, z FROM fx_layers UNION ALL SELECT 'N' || CAST(pid AS STRING), CAST(count(*) AS INT) FROM fx_layers GROUP BY pid")
def edt05(layers):
    new = layers.select("pid").distinct().select("pid", F.concat(F.lit("N"), F.col("pid").cast("string")).alias("id"), F.lit("text").alias("type"), F.lit(0).alias("z"))
    return scene.add(layers, new).select("id", "z")


@query("edt_06_switch_scene", "fx_boxes", sql="SELECT pid, ord, ord = 2 AS active FROM fx_boxes")
def edt06(b):
    return scene.switch(b, F.col("ord") == 2).select("pid", "ord", "active")


@query("edt_07_build_scene", "fx_texts", "fx_boxes", sql="""SELECT pid, 0 AS z, 'background' AS type, 0 AS ord FROM (SELECT DISTINCT pid FROM fx_boxes) UNION ALL SELECT pid, CAST(row_number() OVER (PARTITION BY pid ORDER BY src, k, ord) AS INT), CASE WHEN src = 1 THEN 'image' ELSE 'text' END, ord FROM
  (SELECT pid, 1 AS src, ord, -w * h AS k FROM fx_boxes WHERE source = 'external' AND kind <> 'face' UNION ALL SELECT pid, 2, ord, size FROM fx_texts WHERE source = 'local')""")
def edt07(t, b):
    return scene.build(t.where("source = 'local'"), b.where("source = 'external'"), b.select("pid").distinct()).select("pid", "z", "type", "ord")


@query("edt_08_crossfade", "fx_timing", sql=f""", s AS (SELECT vid, ord, t_in * 10 AS b FROM fx_timing) SELECT vid, ord, t, {r("CASE WHEN t < b - 0.3 THEN 0 WHEN t > b + 0.3 THEN 1 ELSE (t - (b - 0.3)) / 0.6 END")} AS alpha FROM (SELECT *, b + ((ord - 1) % 5 - 2) * 0.15 AS t FROM s)""")
def edt08(t):
    from ..operators.animation import crossfade

    s = t.select("vid", "ord", (F.col("t_in") * 10).alias("b")).withColumn("t", F.col("b") + ((F.col("ord") - 1) % 5 - 2) * 0.15)
    return s.select("vid", "ord", "t", round_to(crossfade(F.col("t"), F.col("b"), F.lit(0.6)), 6).alias("alpha"))


@query("edt_09_star_toggle", "fx_projects", sql="SELECT id, CASE WHEN id % 10 = 0 THEN NOT starred ELSE starred END AS starred FROM fx_projects")
def edt09(p):
    return scene.patch(p, F.col("id") % 10 == 0, starred=~F.col("starred")).select("id", "starred")


@query("edt_10_resize_corner", "fx_layers", sql=f"""SELECT id, CASE WHEN p THEN {whole('x + w - nw')} ELSE x END AS x, CASE WHEN p THEN {whole('nw')} ELSE w END AS w, CASE WHEN p THEN {whole('nh')} ELSE h END AS h, CASE WHEN p AND type = 'text' THEN greatest(4, {whole('size * nh / h')}) ELSE size END AS size
  FROM (SELECT *, z = pid % 4 AND NOT locked AS p, greatest(8, w + 70.4) AS nw, greatest(8, h - 90.3) AS nh FROM fx_layers)""")
def edt10(layers):
    return scene.resize(layers, PICK(), "sw", -70.4, -90.3).select("id", "x", "w", "h", "size")


@query("edt_10_rotate_snap", "fx_layers", sql=f"SELECT id, CASE WHEN z = pid % 4 AND NOT locked THEN ({whole('(rotation * 5 - 40) / 15')} * 15 % 360 + 360) % 360 ELSE rotation END AS rotation FROM fx_layers")
def edt10b(layers):
    return scene.rotate(layers, PICK(), F.col("rotation") * 5 - 40, snap=True).select("id", "rotation")


@query("edt_11_nudge", "fx_layers", sql=f"SELECT id, CASE WHEN z = pid % 4 AND NOT locked THEN {whole('x + 10')} ELSE x END AS x, CASE WHEN z = pid % 4 AND NOT locked THEN {whole('y - 1')} ELSE y END AS y FROM fx_layers")
def edt11(layers):
    return scene.move(layers, PICK(), 10.0, -1.0).select("id", "x", "y")


@query("edt_12_new_text", "fx_texts", "fx_palette", sql=f"SELECT t.pid, {whole('600 * 0.3')} AS x, {whole('600 * 0.06')} AS size, arg_min(family, ord) AS family FROM fx_texts t GROUP BY t.pid")
def edt12(t, p):
    first = t.groupBy("pid").agg(F.min_by("family", "ord").alias("family"))
    return scene.default_text(first, 600.0, 600.0).select("pid", "x", "size", "family")


@query("edt_13_inspector", "fx_layers", sql="SELECT id, CASE WHEN z = pid % 4 THEN NOT locked ELSE locked END AS locked, CASE WHEN z = pid % 4 THEN (rotation + 345) % 360 ELSE rotation END AS rotation FROM fx_layers")
def edt13(layers):
    return scene.patch(layers, PICK(), locked=~F.col("locked"), rotation=F.pmod(F.col("rotation") - 15, F.lit(360.0))).select("id", "locked", "rotation")


@query("win_09_motion_samples", "fx_timing", sql=f"SELECT vid, ord, {r('CASE WHEN t <= 0 THEN dx WHEN t >= 0.5 THEN 0 ELSE dx * (1 - t / 0.5) END')} AS dx, {r('CASE WHEN t <= 0 THEN scale WHEN t >= 0.5 THEN 1 ELSE scale + (1 - scale) * t / 0.5 END')} AS scale FROM (SELECT *, CAST(lid % 10 - 2 AS DOUBLE) / 10 AS t FROM fx_timing)")
def win09(t):
    zero, one = F.lit(0.0), F.lit(1.0)
    key = lambda t, *v: F.struct(t.alias("t"), *(x.alias(n) for x, n in zip(v, motion.FIELDS, strict=True)))
    keys = F.array(key(zero, F.col("dx"), F.col("dy"), F.col("scale"), F.col("o_first")), key(F.lit(0.5), zero, zero, one, one))
    s = motion.state_at(keys, (F.col("lid") % 10 - 2).cast("double") / 10)
    return t.withColumn("s", s).select("vid", "ord", round_to(F.col("s.dx"), 6).alias("dx"), round_to(F.col("s.scale"), 6).alias("scale"))


@query("win_13_css_track", "fx_timing", sql=f"SELECT vid, ord, {r('least(1, greatest(0, t_in / 5))', 4)} AS a, {r('least(1, greatest(0, (t_in + 0.5) / 5))', 4)} AS b, {r('least(1, greatest(0, t_out / 5))', 4)} AS c FROM fx_timing")
def win13(t):
    from ..operators.animation import offsets

    o = offsets(F.array("t_in", F.col("t_in") + 0.5, "t_out"), F.lit(0.0), F.lit(5.0))
    return t.select("vid", "ord", *(round_to(F.get(o, i), 4).alias(n) for i, n in enumerate("abc")))


@query("sc_26_presets", "fx_timing", sql=f"SELECT vid, ord, {r('t_in - 0.25', 3)} AS t0, {r('t_in + 0.25', 3)} AS t1, {r('t_out - 0.15', 3)} AS t2, {r('t_out + 0.15', 3)} AS t3 FROM fx_timing")
def sc26p(t):
    k = motion.apply_preset(F.col("t_in"), F.col("t_out"), "slide-up", 0.5, 24.0, fade_out=True)
    return t.withColumn("k", k).select("vid", "ord", *(round_to(F.get("k", i)["t"], 3).alias(f"t{i}") for i in range(4)))


@query("win_12_drag", "fx_timing", sql=f"SELECT vid, ord, {r('least(t_out - 0.1, greatest(0, floor((t_in + 0.33) / 0.05 + 0.5) * 0.05))', 4)} AS t_in FROM fx_timing")
def win12d(t):
    d = timeline.drag(F.col("t_in"), F.col("t_out"), "in", F.lit(0.33), F.lit(0.0), F.lit(6.0))
    return t.select("vid", "ord", round_to(d["t_in"], 4).alias("t_in"))
