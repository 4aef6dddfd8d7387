"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, easing, geometry, numeric, text
from ..functions.numeric import half_up, round_to
from .registry import query, r, whole

def RGB():  # noqa: N802
    return tuple(F.col(c) for c in "rgb")

HSL_SQL = """hsl AS (
  SELECT *, greatest(r, g, b) / 255.0 AS hi, least(r, g, b) / 255.0 AS lo FROM (SELECT *, CAST(r AS DOUBLE) AS rr, CAST(g AS DOUBLE) AS gg, CAST(b AS DOUBLE) AS bb FROM {src})),
hsl2 AS (SELECT *, CAST(floor(100 * (hi + lo) / 2 + 0.5) AS INT) AS l,
  CAST(floor(100 * CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END + 0.5) AS INT) AS s,
  CAST(floor(60 * CASE WHEN hi = lo THEN 0 WHEN rr / 255 = hi THEN (gg / 255 - bb / 255) / (hi - lo) + CASE WHEN gg < bb THEN 6 ELSE 0 END
    WHEN gg / 255 = hi THEN (bb / 255 - rr / 255) / (hi - lo) + 2 ELSE (rr / 255 - gg / 255) / (hi - lo) + 4 END + 0.5) AS INT) AS h FROM hsl)"""
NAME_SQL = """CASE WHEN l < 8 THEN 'Black' WHEN l > 94 THEN 'White' WHEN s < 12 THEN CASE WHEN l < 30 THEN 'Charcoal' WHEN l < 60 THEN 'Slate Grey' ELSE 'Silver' END
  WHEN h >= 15 AND h < 40 AND l < 40 THEN 'Brown' WHEN h >= 40 AND h < 65 AND s < 70 AND l < 60 THEN 'Gold'
  ELSE CASE WHEN l < 25 THEN 'Deep ' WHEN l < 42 THEN 'Dark ' WHEN l > 75 THEN 'Light ' WHEN s > 80 THEN 'Vivid ' ELSE '' END
    || CASE WHEN h < 15 THEN 'Red' WHEN h < 40 THEN 'Orange' WHEN h < 65 THEN 'Yellow' WHEN h < 80 THEN 'Lime' WHEN h < 160 THEN 'Green' WHEN h < 190 THEN 'Teal' WHEN h < 210 THEN 'Cyan'
      WHEN h < 250 THEN 'Blue' WHEN h < 280 THEN 'Indigo' WHEN h < 320 THEN 'Purple' WHEN h < 345 THEN 'Magenta' ELSE 'Red' END END"""
FAMILY_SQL = """CASE WHEN l < 10 THEN 'black' WHEN l > 92 THEN 'white' WHEN s < 12 THEN 'grey' WHEN h < 15 OR h >= 345 THEN 'red' WHEN h < 40 THEN CASE WHEN l < 40 THEN 'brown' ELSE 'orange' END
  WHEN h < 70 THEN 'yellow' WHEN h < 160 THEN 'green' WHEN h < 200 THEN 'teal' WHEN h < 255 THEN 'blue' WHEN h < 290 THEN 'purple' ELSE 'pink' END"""


def lum_sql(p: str = "") -> str:
    one = lambda c: f"CASE WHEN {p}{c} / 255.0 <= 0.03928 THEN {p}{c} / 255.0 / 12.92 ELSE pow(({p}{c} / 255.0 + 0.055) / 1.055, 2.4) END"
    return f"(0.2126 * {one('r')} + 0.7152 * {one('g')} + 0.0722 * {one('b')})"


def hex_sql(p: str = "") -> str:
    return "'#' || " + " || ".join(f"lpad(upper(to_hex({p}{c})), 2, '0')" for c in "rgb")


@query("sc_01_hex_roundtrip", "fx_palette", sql=f"SELECT pid, ord, {hex_sql()} AS hex, r AS r2, g AS g2, b AS b2, (r // 16) * 17 AS r3, (g // 16) * 17 AS g3, (b // 16) * 17 AS b3 FROM fx_palette")
def sc01(p):
    p = p.withColumn("hex", color.to_hex(*RGB())).withColumn("back", color.from_hex(F.col("hex")))
    short = color.from_hex(F.concat(F.lit("#"), *(F.lower(F.hex(F.floor(F.col(c) / 16))) for c in "rgb")))
    return p.withColumn("short", short).select("pid", "ord", "hex", F.col("back.r").alias("r2"), F.col("back.g").alias("g2"), F.col("back.b").alias("b2"), F.col("short.r").alias("r3"), F.col("short.g").alias("g3"), F.col("short.b").alias("b3"))


@query("sc_02_rgb_to_hsl", "fx_palette", sql=f", {HSL_SQL.format(src='fx_palette')} SELECT pid, ord, h, s, l FROM hsl2")
def sc02(p):
    return p.select("pid", "ord", color.hsl(*RGB()).alias("x")).select("pid", "ord", "x.h", "x.s", "x.l")


@query("sc_03_contrast", "fx_palette", sql=f"SELECT pid, ord, {r(lum_sql())} AS luminance, {r(f'(1.05) / ({lum_sql()} + 0.05)')} AS on_white, {r(f'({lum_sql()} + 0.05) / 0.05')} AS on_black FROM fx_palette")
def sc03(p):
    white, black = (F.lit(255),) * 3, (F.lit(0),) * 3
    return p.select("pid", "ord", round_to(color.luminance(*RGB()), 6).alias("luminance"), round_to(color.contrast(RGB(), white), 6).alias("on_white"), round_to(color.contrast(RGB(), black), 6).alias("on_black"))


REDMEAN_SQL = "sqrt((2 + ({a}r + {b}r) / 2.0 / 256) * ({a}r - {b}r) * ({a}r - {b}r) + 4 * ({a}g - {b}g) * ({a}g - {b}g) + (2 + (255 - ({a}r + {b}r) / 2.0) / 256) * ({a}b - {b}b) * ({a}b - {b}b))"


@query("sc_04_redmean", "fx_palette", sql=f"SELECT x.pid, x.ord AS a, y.ord AS b, {r(REDMEAN_SQL.format(a='x.', b='y.'), 4)} AS d FROM fx_palette x JOIN fx_palette y ON x.pid = y.pid AND x.ord < y.ord")
def sc04(p):
    x, y = p.alias("x"), p.alias("y")
    d = color.redmean(tuple(F.col(f"x.{c}") for c in "rgb"), tuple(F.col(f"y.{c}") for c in "rgb"))
    return x.join(y, (F.col("x.pid") == F.col("y.pid")) & (F.col("x.ord") < F.col("y.ord"))).select("x.pid", F.col("x.ord").alias("a"), F.col("y.ord").alias("b"), round_to(d, 4).alias("d"))


def with_hsl(p):
    return p.withColumn("hsl", color.hsl(*RGB())).select("*", "hsl.*")


@query("sc_05_color_name", "fx_palette", sql=f", {HSL_SQL.format(src='fx_palette')} SELECT pid, ord, {NAME_SQL} AS name FROM hsl2")
def sc05(p):
    return with_hsl(p).select("pid", "ord", color.name(F.col("h"), F.col("s"), F.col("l")).alias("name"))


@query("sc_06_hue_family", "fx_palette", sql=f", {HSL_SQL.format(src='fx_palette')} SELECT pid, ord, {FAMILY_SQL} AS family FROM hsl2")
def sc06(p):
    return with_hsl(p).select("pid", "ord", color.family(F.col("h"), F.col("s"), F.col("l")).alias("family"))


@query("sc_07_skin_test", "fx_samples", sql="""SELECT vec_id, i, r > 95 AND g > 40 AND b > 20 AND r > g AND r > b AND r - least(g, b) > 15 AND abs(r - g) > 15
  AND 128 - 0.168736 * r - 0.331264 * g + 0.5 * b BETWEEN 77 AND 127 AND 128 + 0.5 * r - 0.418688 * g - 0.081312 * b BETWEEN 133 AND 173 AS skin FROM fx_samples""")
def sc07(s):
    return s.select("vec_id", "i", color.is_skin(*RGB()).alias("skin"))


@query("sc_08_saturation_smoothstep", "fx_samples", sql=f"""SELECT vec_id, i, {r("CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE 100.0 * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END")} AS saturation,
  {r("least(1, greatest(0, (r - 40) / 120.0)) * least(1, greatest(0, (r - 40) / 120.0)) * (3 - 2 * least(1, greatest(0, (r - 40) / 120.0)))")} AS soft FROM fx_samples""")
def sc08(s):
    return s.select("vec_id", "i", round_to(color.saturation(*RGB()), 6).alias("saturation"), round_to(numeric.smoothstep(F.lit(40.0), F.lit(160.0), F.col("r").cast("double")), 6).alias("soft"))


@query("sc_09_clamp_round_gcd", "fx_boxes", sql=f"SELECT pid, ord, greatest(100, least(200, w)) AS clamped, {r('h / 7', 2)} AS rounded, CAST(gcd(CAST(w AS BIGINT), CAST(h AS BIGINT)) AS BIGINT) AS gcd FROM fx_boxes")
def sc09(b):
    return b.select("pid", "ord", numeric.clamp(F.col("w"), 100.0, 200.0).alias("clamped"), round_to(F.col("h") / 7, 2).alias("rounded"), numeric.gcd(F.col("w"), F.col("h")).alias("gcd"))


@query("sc_10_formats", "fx_projects", sql=f"""SELECT id,
  CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN CAST(n AS STRING) || ' B' ELSE
    CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS STRING) ELSE CAST(v AS STRING) END || CASE WHEN n < 1048576 THEN ' KB' ELSE ' MB' END END AS size,
  CASE WHEN n < 60 THEN 'just now' WHEN n < 3600 THEN CAST(n // 60 AS STRING) || 'm ago' WHEN n < 86400 THEN CAST(n // 3600 AS STRING) || 'h ago' WHEN n < 604800 THEN CAST(n // 86400 AS STRING) || 'd ago' END AS ago,
  substring(regexp_replace(regexp_replace(lower(name || ' / ' || segment), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 48) AS slug
  FROM (SELECT *, (id * 7919) % 3000000 AS n, {r("((id * 7919) % 3000000) / CASE WHEN (id * 7919) % 3000000 < 1048576 THEN 1024.0 ELSE 1048576.0 END", 1)} AS v FROM fx_projects)""")
def sc10(p):
    n = (F.col("id") * 7919) % 3000000
    return p.select("id", numeric.file_size(n).alias("size"), text.ago(n.cast("double")).alias("ago"), text.slug(F.concat_ws(" / ", "name", "segment")).alias("slug"))


@query("sc_11_clock", "fx_timing", sql=f"SELECT vid, ord, CAST(floor(s / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor((s - 60 * floor(s / 60)) * 10 + 0.5) AS BIGINT) // 10 AS STRING) || '.' || CAST(CAST(floor((s - 60 * floor(s / 60)) * 10 + 0.5) AS BIGINT) % 10 AS STRING), 4, '0') AS clock FROM (SELECT *, t_in * 17 AS s FROM fx_timing)")
def sc11(t):
    return t.select("vid", "ord", text.clock(F.col("t_in") * 17).alias("clock"))


@query("sc_12_title_from_file", "fx_projects", sql="""SELECT id, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(lower(name) || '_' || lower(segment) || '-final.v2.PNG', '\\.[a-zA-Z0-9]+$', ''), '[-_]+', ' ', 'g'), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'),
  lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), '') AS title FROM fx_projects""")
def sc12(p):
    return p.select("id", text.title_from_file(F.concat(F.lower("name"), F.lit("_"), F.lower("segment"), F.lit("-final.v2.PNG")), "Untitled").alias("title"))


DATES_RE = text.DATE_WORDS
ROLE_SQL = rf"""CASE WHEN regexp_matches(t, '\b[0-9]{{1,3}}\s*[-–:|]\s*[0-9]{{1,3}}\b') AND length(t) <= 24 AND NOT regexp_matches(t, '[0-9]{{4}}') THEN 'score'
  WHEN regexp_matches(t, '(?i)\b({DATES_RE})\b') OR regexp_matches(t, '\b[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}\b') OR (regexp_matches(t, '\b(19|20)[0-9]{{2}}\b') AND length(t) < 24) THEN 'date'
  WHEN regexp_matches(t, '(?i)[0-9]+(\.[0-9]+)?\s*(%|pts|km|kg|x|k|m|\+)(\b|$)') OR (regexp_matches(t, '^[^0-9]{{0,10}}[0-9][0-9.,]*[^0-9]{{0,12}}$') AND length(t) < 16) THEN 'statistic'
  WHEN regexp_matches(t, '^[A-Z][\p{{Ll}}''’.-]+(\s+[A-Z][\p{{Ll}}''’.-]+){{1,2}}$') AND length(t) < 28 THEN 'name' END"""


@query("sc_13_text_role", "fx_texts", sql=f"SELECT pid, ord, t AS txt, {ROLE_SQL} AS role FROM (SELECT *, trim(txt) AS t FROM fx_texts)")
def sc13(t):
    return t.select("pid", "ord", F.trim("txt").alias("txt"), text.role(F.col("txt")).alias("role"))


@query("sc_14_typography_estimate", "fx_texts", sql=f""", m AS (SELECT *, h / CASE WHEN upper(txt) = txt AND regexp_matches(txt, '[A-Za-z]') THEN 0.74 WHEN regexp_matches(txt, '[gjpqy,]') THEN 1.0 ELSE 0.8 END AS px FROM fx_texts),
  e AS (SELECT *, {ROLE_SQL.replace('(t,', '(txt,').replace('length(t)', 'length(txt)')} AS own, row_number() OVER (PARTITION BY pid ORDER BY px DESC, ord) AS place, max(px) OVER (PARTITION BY pid) AS top,
    (w / greatest(1, length(txt))) / px AS ratio, conf AS ink FROM m)
  SELECT pid, ord, {whole('px')} AS size_px, {r('ratio', 4)} AS width_ratio,
    CASE WHEN ink < 0.16 THEN 300 WHEN ink < 0.24 THEN 400 WHEN ink < 0.31 THEN 600 WHEN ink < 0.4 THEN 700 ELSE 800 END AS weight,
    CASE WHEN abs(x + w / 2 - 300) < 30 THEN 'center' WHEN x + w / 2 < 300 THEN 'left' ELSE 'right' END AS align,
    CASE WHEN place = 1 AND coalesce(own, '') <> 'score' THEN 'headline' WHEN own IS NOT NULL THEN own WHEN px >= 0.55 * top THEN 'subheadline' WHEN px < 0.28 * top THEN 'caption' ELSE 'body' END AS role FROM e""")
def sc14(t):
    from ..operators.typography import estimate

    return estimate(t, 600.0).select("pid", "ord", "size_px", round_to(F.col("width_ratio"), 4).alias("width_ratio"), "weight", "align", "role")


@query("sc_15_line_plausibility", "fx_texts", sql="""SELECT pid, ord, length(txt) >= 2 AND length(regexp_replace(txt, '[^A-Za-z0-9]', '', 'g')) >= 0.55 * length(txt) AND conf * 100 >= 50 AND h >= 6 AND w >= 8 AND h <= 180
  AND w / length(txt) / h BETWEEN 0.18 AND 2.2 AS plausible FROM fx_texts""")
def sc15(t):
    return t.select("pid", "ord", text.plausible(F.col("txt"), F.col("conf") * 100, F.col("w"), F.col("h"), 600).alias("plausible"))


@query("sc_18_approx_ratio", "fx_boxes", sql=f""", k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}', {v})" for i, (n, v) in enumerate(text.RATIOS))}) k(i, n, v)),
  c AS (SELECT pid, ord, w / h AS ratio, arg_min(n, (abs(CAST(v AS DOUBLE) - w / h), i)) AS n, min(abs(CAST(v AS DOUBLE) - w / h)) AS d FROM fx_boxes CROSS JOIN k GROUP BY pid, ord, w, h)
  SELECT pid, ord, CASE WHEN d < 0.03 THEN n ELSE CAST({whole('ratio * 100')} // 100 AS STRING) || '.' || lpad(CAST({whole('ratio * 100')} % 100 AS STRING), 2, '0') || ':1' END AS shape FROM c""")
def sc18(b):
    return b.select("pid", "ord", text.approx_ratio(F.col("w") / F.col("h")).alias("shape"))


@query("sc_19_denormalise", "fx_boxes", sql=f"SELECT pid, ord, {whole('x / 640 * 1080')} AS px, {whole('y / 640 * 1350')} AS py, {whole('w / 640 * 1080')} AS pw, {whole('h / 640 * 1350')} AS ph FROM fx_boxes")
def sc19(b):
    d = geometry.denormalised(tuple(F.col(c) / 640 for c in "xywh"), 1080, 1350)
    return b.select("pid", "ord", *(v.alias(f"p{c}") for v, c in zip(d, "xywh", strict=True)))


@query("sc_20_xml_escape", "fx_texts", sql="""SELECT pid, ord, replace(replace(replace(replace('<' || txt || ' & "co">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM fx_texts""")
def sc20(t):
    return t.select("pid", "ord", text.xml(F.concat(F.lit("<"), "txt", F.lit(' & "co">'))).alias("escaped"))


@query("sc_21_rgb01", "fx_palette", sql=f"SELECT pid, ord, {r('r / 255.0', 4)} AS r, {r('g / 255.0', 4)} AS g, {r('b / 255.0', 4)} AS b FROM fx_palette")
def sc21(p):
    return p.select("pid", "ord", *(round_to(F.col(c) / 255, 4).alias(c) for c in "rgb"))


def _ease_sql(name: str, x: str) -> str:
    """The same inversion by a recursive query, one row per halving."""
    x1, y1, x2, y2 = easing.CURVES[name]
    bez = lambda t, a, b: f"(3 * {a} * {t} * (1 - {t}) * (1 - {t}) + 3 * {b} * {t} * {t} * (1 - {t}) + {t} * {t} * {t})"
    mid = "((lo + hi) / 2)"
    return f"""SELECT vid, ord, '{name}' AS curve, x, CASE WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 1 ELSE {bez(mid, y1, y2)} END AS y FROM (
      SELECT vid, ord, x, z.lo AS lo, z.hi AS hi FROM (SELECT vid, ord, x, list_reduce(list_prepend({{'lo': CAST(0 AS DOUBLE), 'hi': CAST(1 AS DOUBLE)}}, list_transform(range(30), lambda i: {{'lo': CAST(0 AS DOUBLE), 'hi': CAST(1 AS DOUBLE)}})),
        lambda s, i: CASE WHEN {bez('((s.lo + s.hi) / 2)', x1, x2)} < x THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END) AS z
      FROM (SELECT vid, ord, CAST((lid * 37) % 121 - 10 AS DOUBLE) / 100 AS x FROM fx_timing)))"""


@query("sc_22_easing", "fx_timing", sql=" UNION ALL ".join(f"SELECT vid, ord, curve, {r('y')} AS y FROM ({_ease_sql(n, 'x')})" for n in ("ease", "ease-in", "out-expo")))
def sc22(t):
    x = ((F.col("lid") * 37) % 121 - 10).cast("double") / 100
    curves = F.explode(F.array(*map(F.lit, ("ease", "ease-in", "out-expo")))).alias("curve")
    return t.select("vid", "ord", x.alias("x"), curves).select("vid", "ord", "curve", round_to(easing.ease_any(F.col("curve"), F.col("x")), 6).alias("y"))


def KEYS():  # noqa: N802
    return F.array(
        F.struct(F.col("t_in").alias("t"), F.col("dx").alias("dx"), F.col("dy").alias("dy"), F.col("scale").alias("scale"), F.col("o_first").alias("opacity")),
        F.struct((F.col("t_in") + 0.5).alias("t"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("scale"), F.lit(1.0).alias("opacity")),
        F.struct(F.col("t_out").alias("t"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("scale"), F.col("o_last").alias("opacity")),
    )

ENTRANCE_SQL = """CASE WHEN o_first >= 0.05 THEN NULL WHEN abs(scale - 1) >= 0.06 AND sqrt(dx * dx + dy * dy) <= 0.25 * 40 THEN 'scale'
  WHEN abs(dy) >= 12 AND abs(dy) >= abs(dx) THEN CASE WHEN dy > 0 THEN 'slide-up' ELSE 'slide-down' END WHEN abs(dx) >= 12 THEN CASE WHEN dx > 0 THEN 'slide-left' ELSE 'slide-right' END
  WHEN abs(scale - 1) >= 0.06 THEN 'scale' ELSE 'fade' END"""


@query("sc_23_layer_state", "fx_timing", sql=f"""SELECT vid, ord, t, CASE WHEN t < t_in OR t > t_out THEN 0 ELSE {r("o_first + (1 - o_first) * least(1, greatest(0, (t - t_in) / 0.5))")} END AS opacity,
  {r("dx * (1 - least(1, greatest(0, (t - t_in) / 0.5)))")} AS shift FROM (SELECT *, 2.5 AS t FROM fx_timing)""")
def sc23(t):
    from ..operators.motion import state_at

    s = state_at(F.slice(KEYS(), 1, 2), F.lit(2.5))
    shown = F.col("t").between(F.col("t_in"), F.col("t_out"))
    return t.withColumn("s", s).withColumn("t", F.lit(2.5)).select("vid", "ord", "t", F.when(shown, round_to(F.col("s.opacity"), 6)).otherwise(0.0).alias("opacity"), round_to(F.col("s.dx"), 6).alias("shift"))


@query("sc_24_entrance", "fx_timing", sql=f"SELECT vid, ord, {ENTRANCE_SQL} AS entrance FROM fx_timing")
def sc24(t):
    return t.select("vid", "ord", easing.entrance(KEYS(), F.lit(40.0)).alias("entrance"))


@query("sc_25_motion_words", "fx_timing", sql=f"""SELECT vid, ord, nullif(concat_ws(' · ', CASE {ENTRANCE_SQL} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in easing.ENTRANCE_WORDS.items())} END,
  CASE WHEN o_last < 0.05 THEN 'fades out' END), '') AS motion FROM fx_timing""")
def sc25(t):
    return t.select("vid", "ord", easing.describe(KEYS(), F.lit(40.0)).alias("motion"))


@query("sc_26_retime", "fx_timing", sql=f"""SELECT vid, ord, {r('t_in + 0.25', 3)} AS new_in, {r('t_out', 3)} AS new_out, {r('t_in + 0.25', 3)} AS k1, {r("t_in + 0.5 + CASE WHEN t_in + 0.5 < (t_in + t_out) / 2 THEN 0.25 ELSE 0 END", 3)} AS k2, {r('t_out', 3)} AS k3 FROM fx_timing""")
def sc26(t):
    from ..operators.motion import retime

    x = retime(F.col("t_in"), F.col("t_out"), KEYS(), "in", 0.25)
    return t.select("vid", "ord", x.alias("x")).select("vid", "ord", F.col("x.t_in").alias("new_in"), F.col("x.t_out").alias("new_out"), *(round_to(F.col("x.keys")[i]["t"], 3).alias(f"k{i + 1}") for i in range(3)))


@query("sc_27_caption_stamp", "fx_timing", sql=""", m AS (SELECT *, CAST(floor(t_out * 1000 * 731 + 0.5) AS BIGINT) AS ms FROM fx_timing)
  SELECT vid, ord, lpad(CAST(ms // 3600000 AS STRING), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS STRING), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS STRING), 2, '0') || ',' || lpad(CAST(ms % 1000 AS STRING), 3, '0') AS stamp FROM m""")
def sc27(t):
    return t.select("vid", "ord", text.stamp(F.col("t_out") * 731, ",").alias("stamp"))


@query("sc_28_char_accuracy", "fx_texts", sql=f""", n AS (SELECT pid, ord, trim(regexp_replace(lower(txt), '[^a-z0-9%]+', ' ', 'g')) AS a FROM fx_texts)
  SELECT x.pid, x.ord, y.ord AS other, {r("CASE WHEN length(x.a) = 0 THEN 1 ELSE greatest(0, 1 - levenshtein(x.a, y.a) / CAST(greatest(length(x.a), length(y.a)) AS DOUBLE)) END")} AS accuracy FROM n x JOIN n y ON x.pid = y.pid AND y.ord = x.ord + 1""")
def sc28(t):
    n = t.select("pid", "ord", text.normalised(F.col("txt")).alias("a"))
    x, y = n.alias("x"), n.alias("y")
    return x.join(y, (F.col("x.pid") == F.col("y.pid")) & (F.col("y.ord") == F.col("x.ord") + 1)).select("x.pid", "x.ord", F.col("y.ord").alias("other"), round_to(text.accuracy(F.col("x.a"), F.col("y.a")), 6).alias("accuracy"))


@query("sc_29_color_error", "fx_palette", sql=f"SELECT x.pid, x.ord, {r('sqrt((x.r - y.r) * (x.r - y.r) + (x.g - y.g) * (x.g - y.g) + (x.b - y.b) * (x.b - y.b))', 4)} AS error, sqrt((x.r - y.r) * (x.r - y.r) + (x.g - y.g) * (x.g - y.g) + (x.b - y.b) * (x.b - y.b)) < 60 AS near FROM fx_palette x JOIN fx_palette y ON x.pid = y.pid AND y.ord = x.ord + 1")
def sc29(p):
    x, y = p.alias("x"), p.alias("y")
    d = color.euclid(tuple(F.col(f"x.{c}") for c in "rgb"), tuple(F.col(f"y.{c}") for c in "rgb"))
    return x.join(y, (F.col("x.pid") == F.col("y.pid")) & (F.col("y.ord") == F.col("x.ord") + 1)).select("x.pid", "x.ord", round_to(d, 4).alias("error"), (d < 60).alias("near"))


@query("sc_31_data_url", "fx_texts", sql="SELECT pid, ord, 'image/png' AS mime, 'QUJD' || CAST(pk AS STRING) AS payload, '[inline:' || CAST(CAST(floor(length('data:image/png;base64,QUJD' || CAST(pk AS STRING)) * 100 / 1024.0 + 0.5) AS BIGINT) AS STRING) || 'KB]' AS redacted FROM fx_texts")
def sc31(t):
    url = F.concat(F.lit("data:image/png;base64,QUJD"), F.col("pk").cast("string"))
    redacted = F.when(url.startswith("data:"), F.concat(F.lit("[inline:"), half_up(F.length(url) * 100 / 1024).cast("string"), F.lit("KB]"))).otherwise(url)
    return t.select("pid", "ord", F.regexp_extract(url, "^data:([^;]+);base64,", 1).alias("mime"), F.regexp_extract(url, "^data:[^;]+;base64,(.*)$", 1).alias("payload"), redacted.alias("redacted"))


@query("sc_32_json", "events", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k_next FROM events")
def sc32(e):
    reply = F.concat(F.lit("Here you are: "), F.col("props"), F.lit(" - done"))
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)  # from the first { to the last }
    return e.withColumn("j", F.from_json(body, "k bigint")).select("event_id", F.col("j.k").alias("k"), F.from_json(F.to_json(F.struct((F.col("j.k") + 1).alias("k"))), "k bigint")["k"].alias("k_next"))


@query("sc_34_client_key", "fx_requests", sql="SELECT event_id, '10.0.' || CAST(client % 7 AS STRING) || '.' || CAST(client AS STRING) AS client_key FROM fx_requests")
def sc34(q):
    header = F.concat(F.lit(" 10.0."), (F.col("client") % 7).cast("string"), F.lit("."), F.col("client").cast("string"), F.lit(" , 172.16.0.1"))
    return q.select("event_id", F.trim(F.get(F.split(header, ","), 0)).alias("client_key"))


@query("sc_35_storage_errors", "fx_requests", sql="SELECT event_type, CASE event_type WHEN 'click' THEN 'full' WHEN 'purchase' THEN 'blocked' ELSE 'other' END AS class, count(*) AS n FROM fx_requests GROUP BY ALL")
def sc35(q):
    from ..operators.library import storage_error

    name = F.when(F.col("event_type") == "click", "QuotaExceededError").when(F.col("event_type") == "purchase", "SecurityError").otherwise(F.lit("TypeError"))
    return q.groupBy("event_type", storage_error(name).alias("class")).agg(F.count(F.lit(1)).alias("n"))
