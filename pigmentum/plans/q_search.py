"""Queries over smart search and library filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import palette, search
from ..sources import fixtures
from .q_design import HEX, TWINS
from .q_scalar import FAMILY_SQL, NAME_SQL, lum_sql
from .registry import QUERIES, SQL, query, r, whole

#: One phrase per rule of the query language, and its quirks.
PHRASES = [
    "", "  ", "blue colors", "Show the palette", "gold", "gray shades", "red text", "gradients", "background layers", "blur background", "textures", "headlines over 60px", "sub-headlines", "subtitles", "captions please", "statistics", "match results",
    "when is it", "team names", "body copy", "call to action", "fonts over 160", "text larger than 90", "all words", "all layers", "player images", "faces", "sponsor logos", "team crest", "brand marks", "icons", "products", "trucks", "stadiums", "every image", "live concert", "Logo 2", "Dark",
]


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PHRASES)), "qid int, query string")


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    v = lambda n: fixtures.view(spark, d, n)
    boxes, layers = v("fx_boxes"), v("fx_layers")
    pal = palette.build(v("fx_palette")).withColumn("ord", F.col("place"))
    back = boxes.where("ord = 1").select("pid", "ord", F.element_at(F.array(*map(F.lit, ("texture", "blur", "overlay", "lighting"))), (F.col("pk") % 4 + 1).cast("int")).alias("kind"), "label", "conf")
    grad = pal.where("place = 1").select("pid", "ord", F.concat(F.lit("linear-gradient(90deg, "), "hex", F.lit(" 0%)")).alias("css"), F.lit("Background").alias("region"))
    return {"texts": v("fx_texts"), "objects": boxes, "palette": pal, "backgrounds": back, "gradients": grad, "layers": layers}


def _w(p: str) -> str:
    return rf"regexp_matches(q, '\b(?:{p})\b')"


def _q(s: str) -> str:
    return s.replace("'", "''")


_FIRST = "CASE " + " ".join(f"WHEN {_w(c)} THEN '{c}'" for c in search.COLOR_WORDS) + " END"
_ROLES = " ".join(f"""WHEN {_w(p)}{" OR contains(q, 'call to action')" if n == "cta" else ""} THEN ['{label}', 'role', '{n}', '']""" for p, n, label in search.TEXT_ROLES)
_OBJECTS = " ".join(f"WHEN {_w(p)} THEN ['{label}', 'object', '{n}', '{sub}']" for p, n, sub, label in search.OBJECT_WORDS)
_SIZE = r"regexp_extract(q, '\b(fonts?|text)\b.*\b(over|above|larger than|>)\s*([0-9]+)', 3)"
_KIND = rf"regexp_extract(q, '\b({search.BACKGROUND_KINDS})\b', 1)"
INTENTS = f"""ph AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{_q(p)}')" for i, p in enumerate(PHRASES))}) t(qid, query)), pq AS (SELECT *, lower(trim(query)) AS q FROM ph), pc AS (SELECT *, {_FIRST} AS c FROM pq),
  pr AS (SELECT *, CASE WHEN q = '' THEN ['Type a query', 'none', '', ''] WHEN {_w(search.COLOR_NOUNS)} OR (c IS NOT NULL AND NOT {_w('text')}) THEN [coalesce(upper(c[1]) || c[2:] || ' colours', 'All colours'), 'color', CASE WHEN c = 'gray' THEN 'grey' ELSE coalesce(c, '') END, '']
    WHEN {_w('gradients?')} THEN ['Gradients', 'gradient', '', ''] WHEN {_w(search.BACKGROUND_WORDS)} THEN [CASE WHEN {_KIND} = '' THEN 'Background layers' ELSE upper(({_KIND})[1]) || ({_KIND})[2:] || ' layers' END, 'background', {_KIND}, '']
    {_ROLES} WHEN {_SIZE} <> '' THEN ['Text larger than ' || {_SIZE} || 'px', 'size', {_SIZE}, ''] WHEN {_w(search.TEXT_WORDS)} THEN ['All text layers', 'layer', 'text', ''] WHEN {_w('layers?')} THEN ['All layers', 'layer', '', '']
    {_OBJECTS} ELSE ['Matches for “' || trim(query) || '”', 'any', q, ''] END AS z FROM pc),
  it AS (SELECT qid, query, z[1] AS intent, z[2] AS target, z[3] AS arg, z[4] AS sub FROM pr)"""
PALETTE = f"{TWINS}, sw AS (SELECT pid, place AS ord, {HEX} AS hex, {FAMILY_SQL} AS family, {NAME_SQL} AS cname, role, weight FROM pl)"
_PCT = lambda x: f"CAST({whole(f'{x} * 100')} AS STRING) || '%'"
HITS = {
    "color": f"SELECT qid, pid, 'color' AS type, 0 AS branch, ord, cname || ' ' || hex AS title, role || ' · ' || {_PCT('weight')} AS subtitle FROM sw JOIN it ON target = 'color' AND (arg = '' OR arg = family OR (arg = 'gold' AND family IN ('yellow', 'brown')))",
    "gradient": "SELECT qid, pid, 'color', 0, ord, 'linear-gradient(90deg, ' || hex || ' 0%)', 'Background' FROM sw JOIN it ON target = 'gradient' WHERE ord = 1",
    "background": f"SELECT qid, pid, 'background', 0, ord, label, bk || ' · ' || {_PCT('conf')} FROM (SELECT *, CASE pk % 4 WHEN 0 THEN 'texture' WHEN 1 THEN 'blur' WHEN 2 THEN 'overlay' ELSE 'lighting' END AS bk FROM fx_boxes WHERE ord = 1) JOIN it ON target = 'background' AND (arg = '' OR arg = bk)",
    "role": "SELECT qid, pid, 'text', 0, ord, txt, family || ' ' || CAST(weight AS STRING) || ' · ' || CAST(CAST(size AS BIGINT) AS STRING) || 'px' FROM fx_texts JOIN it ON target = 'role' AND arg = role",
    "size": "SELECT qid, pid, 'text', 0, ord, txt, CAST(CAST(size AS BIGINT) AS STRING) || 'px ' || family FROM fx_texts JOIN it ON target = 'size' AND size > TRY_CAST(arg AS DOUBLE)",
    "layer": "SELECT qid, pid, 'layer', 0, CASE WHEN arg = '' THEN -z ELSE z END, name, type || ' layer' FROM fx_layers JOIN it ON target = 'layer' AND (arg = '' OR (arg = 'text' AND type = 'text'))",
    "object": f"SELECT qid, pid, 'object', 0, ord, label, kind || ' · ' || {_PCT('conf')} FROM fx_boxes JOIN it ON target = 'object' AND (arg = '*' OR arg = kind) AND (sub = '' OR regexp_matches(lower(label), sub))",
    "any": """SELECT qid, pid, 'text', 0, ord, txt, role FROM fx_texts JOIN it ON target = 'any' AND contains(lower(txt), arg) UNION ALL SELECT qid, pid, 'object', 1, ord, label, kind FROM fx_boxes JOIN it ON target = 'any' AND (contains(lower(label), arg) OR contains(kind, arg))
      UNION ALL SELECT qid, pid, 'color', 2, ord, cname || ' ' || hex, role FROM sw JOIN it ON target = 'any' AND (contains(lower(hex), arg) OR contains(lower(cname), arg))""",
}
BASE = f"{fixtures.duckdb_with('fx_boxes', 'fx_texts', 'fx_layers', 'fx_palette')}, {PALETTE}, {INTENTS}"


def _search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(search.compile_intents(phrases(spark)), **tables(spark, d))


#: Tables that answer a target.
ANSWERED = {
    "color": ("palette",), "gradient": ("gradients",), "background": ("backgrounds",), "role": ("texts",), "size": ("texts",), "layer": ("layers",), "object": ("objects",), "any": ("texts", "objects", "palette"),
}


def _branch(name: str, target: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t, given = search.compile_intents(phrases(spark)), tables(spark, d)
        # tables that don't answer this target have no hits; they aren't read
        return search.search(t.where(F.col("target") == target), **{k: v if k in ANSWERED[target] else v.where("false") for k, v in given.items()})

    QUERIES[name] = run
    SQL[name] = f"{BASE} {HITS[target]}".replace("'color', 0, ord, 'linear", "'color' AS type, 0 AS branch, ord, 'linear")


def _intents(spark: SparkSession, d: str) -> DataFrame:
    return search.compile_intents(phrases(spark))


QUERIES["qry_01_intents"] = _intents
SQL["qry_01_intents"] = f"WITH {INTENTS} SELECT qid, query, intent, target, arg, sub FROM it"
QUERIES["qry_01_smart_search"] = _search
SQL["qry_01_smart_search"] = f"{BASE} " + " UNION ALL ".join(HITS.values())
for _name, _target in (("qry_02_color_intent", "color"), ("qry_03_gradient_intent", "gradient"), ("qry_04_background_intent", "background"), ("qry_05_text_role_intent", "role"), ("qry_06_size_intent", "size"), ("qry_07_layer_intent", "layer"), ("qry_08_object_intent", "object"), ("qry_09_full_text", "any")):
    _branch(_name, _target)
    if _target not in ("color", "any"):
        SQL[_name] = f"{BASE}, h(qid, pid, type, branch, ord, title, subtitle) AS ({HITS[_target]}) SELECT * FROM h"
    elif _target == "any":
        SQL[_name] = f"{BASE}, h(qid, pid, type, branch, ord, title, subtitle) AS ({HITS['any']}) SELECT * FROM h"


@query("qry_10_hit_projection", "fx_palette", sql=f", {TWINS} SELECT pid, place, {NAME_SQL} || ' ' || {HEX} AS title, role || ' · ' || {_PCT('weight')} AS subtitle FROM pl")
def qry10(p):
    b = palette.build(p)
    return b.select("pid", "place", F.concat_ws(" ", color.name(F.col("h"), F.col("s"), F.col("l")), "hex").alias("title"), F.concat_ws(" · ", "role", search.percent(F.col("weight"))).alias("subtitle"))


@query("qry_11_library_filter", "fx_projects", sql="SELECT id, name, CAST(row_number() OVER (ORDER BY dna DESC, id) AS INT) AS place FROM fx_projects WHERE starred AND (contains(lower(name), '00') OR contains(lower(design_type), 'event'))")
def qry11(p):
    from ..operators.library import browse

    return browse(p, text="00", or_type="event", starred=True, sort="dna").select("id", "name", "place")


@query("qry_12_palette_project_search", "fx_projects", sql="SELECT id, name FROM fx_projects WHERE contains(lower(name), '1') ORDER BY updated_at DESC NULLS LAST, id LIMIT 6")
def qry12(p):
    return p.where(F.lower("name").contains("1")).orderBy(F.desc_nulls_last("updated_at"), "id").limit(6).select("id", "name")


@query("qry_13_hit_to_layer", "fx_boxes", "fx_layers", sql="SELECT b.pid, b.ord, arg_min(l.id, l.z) AS layer FROM fx_boxes b JOIN fx_layers l ON l.pid = b.pid AND l.source_id = 'S' || CAST(b.pid AS STRING) || '_' || CAST(b.ord AS STRING) WHERE b.kind = 'logo' GROUP BY b.pid, b.ord")
def qry13(b, layers):
    hits = b.where("kind = 'logo'").select("pid", "ord", F.concat(F.lit("S"), F.col("pid").cast("string"), F.lit("_"), F.col("ord").cast("string")).alias("source_id"))
    return hits.join(layers.select("pid", "source_id", "id", "z"), ["pid", "source_id"]).groupBy("pid", "ord").agg(F.min_by("id", "z").alias("layer"))


@query("qry_14_highlight_boxes", "fx_boxes", "fx_texts", sql="SELECT pid, ord, 'text' AS type, x, y, w, h FROM fx_texts WHERE ord % 3 = 0 UNION ALL SELECT pid, ord, 'object', x, y, w, h FROM fx_boxes WHERE ord % 3 = 0")
def qry14(b, t):
    chosen = b.where("ord % 3 = 0").select("pid", "ord")
    pick = lambda df, kind: df.join(chosen, ["pid", "ord"], "left_semi").select("pid", "ord", F.lit(kind).alias("type"), "x", "y", "w", "h")
    return pick(t, "text").unionByName(pick(b, "object"))


@query("qry_15_asset_library", "fx_boxes", sql="SELECT kind, count(*) AS n, count(DISTINCT label) AS labels FROM fx_boxes WHERE conf > 0.3 GROUP BY kind")
def qry15(b):
    return b.where("conf > 0.3").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"))


KIND_ORDER = ["person", "face", "logo", "product", "vehicle", "building", "icon", "object"]


@query("qry_16_elements_by_kind", "fx_boxes", sql=f"SELECT pid, kind, count(*) AS n, CAST(row_number() OVER (PARTITION BY pid ORDER BY list_position({KIND_ORDER}, kind)) AS INT) AS place FROM fx_boxes GROUP BY pid, kind")
def qry16(b):
    from pyspark.sql import Window

    order = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    g = b.groupBy("pid", "kind").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy(order)))


@query("qry_17_color_cards", "fx_palette", sql=f"SELECT pid, ord, {r(f'1.05 / ({lum_sql()} + 0.05)', 2)} AS on_white, {r(f'({lum_sql()} + 0.05) / 0.05', 2)} AS on_black, CASE WHEN 1.05 / ({lum_sql()} + 0.05) > ({lum_sql()} + 0.05) / 0.05 THEN '#FFFFFF' ELSE '#000000' END AS ink FROM fx_palette")
def qry17(p):
    from ..functions.numeric import round_to

    rgb = tuple(F.col(c) for c in "rgb")
    white, black = color.contrast(rgb, (F.lit(255),) * 3), color.contrast(rgb, (F.lit(0),) * 3)
    return p.select("pid", "ord", round_to(white, 2).alias("on_white"), round_to(black, 2).alias("on_black"), F.when(white > black, "#FFFFFF").otherwise("#000000").alias("ink"))


@query("qry_18_buckets", "fx_boxes", sql="SELECT CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.55 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN pk % 101 >= 80 THEN 'strong' WHEN pk % 101 >= 60 THEN 'fair' ELSE 'weak' END AS gauge, count(*) AS n FROM fx_boxes GROUP BY ALL")
def qry18(b):
    conf = F.when(F.col("conf") >= 0.75, "high").when(F.col("conf") >= 0.55, "medium").otherwise("low")
    score = F.col("pk") % 101
    return b.groupBy(conf.alias("confidence"), F.when(score >= 80, "strong").when(score >= 60, "fair").otherwise("weak").alias("gauge")).agg(F.count(F.lit(1)).alias("n"))


@query("qry_20_failures", "fx_boxes", sql="SELECT pid, ord, CASE WHEN conf < 0.2 THEN 'missed text' WHEN kind = 'face' THEN 'wrong kind' WHEN conf < 0.3 THEN 'wrong colour' ELSE 'false object' END AS failure FROM fx_boxes WHERE conf < 0.3 OR kind = 'face' OR (source = 'external' AND conf > 0.9)")
def qry20(b):
    from ..operators.evaluation import failures

    return failures(b).select("pid", "ord", "failure")
