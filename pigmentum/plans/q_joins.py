"""Queries over joins and matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..functions.color import redmean
from ..functions.geometry import box
from ..functions.numeric import half_up, round_to
from ..operators import merge, spatial
from ..sources import fixtures
from .q_scalar import REDMEAN_SQL
from .registry import query, r, whole


def inter_sql(a: str, b: str) -> str:
    return f"(greatest(0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x)) * greatest(0, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y)))"


def iou_sql(a: str, b: str) -> str:
    both = inter_sql(a, b)
    return f"({both} / ({a}w * {a}h + {b}w * {b}h - {both}))"


def line_sql(a: str, b: str) -> str:
    return f"(least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x) > 0.7 * least({a}w, {b}w) AND least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y) > 0.5 * least({a}h, {b}h))"


def A():  # noqa: N802
    return box("a.")


def B():  # noqa: N802
    return box("b.")

def LOCAL():  # noqa: N802
    return F.col("source") == "local"


def EXTERNAL():  # noqa: N802
    return F.col("source") == "external"

SIDES = ", loc AS (SELECT * FROM fx_boxes WHERE source = 'local'), ext AS (SELECT * FROM fx_boxes WHERE source = 'external')"


@query("join_01_iou", "fx_boxes", sql=f"SELECT a.pid, a.ord AS a, b.ord AS b, {r(iou_sql('a.', 'b.'))} AS iou FROM fx_boxes a JOIN fx_boxes b ON a.pid = b.pid AND a.ord < b.ord WHERE {inter_sql('a.', 'b.')} > 0")
def join01(b):
    p = spatial.pairs(b, b, ["pid"], cell=150.0).where(F.col("a.ord") < F.col("b.ord"))
    return p.where(geometry.overlap(A(), B()) > 0).select("a.pid", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), round_to(geometry.iou(A(), B()), 6).alias("iou"))


@query("join_02_coverage_pad_scale", "fx_boxes", sql=f"""SELECT a.pid, a.ord AS a, b.ord AS b, {r(inter_sql('a.', 'b.') + ' / (a.w * a.h)')} AS coverage, {whole('greatest(0, a.x - 12) * 1.37')} AS px,
  {whole('(least(600, a.x + a.w + 12) - greatest(0, a.x - 12)) * 1.37')} AS pw FROM fx_boxes a JOIN fx_boxes b ON a.pid = b.pid AND b.ord = a.ord + 1""")
def join02(b):
    p = geometry.rounded(geometry.scaled(geometry.padded(A(), 12, 600, 600), 1.37))
    j = spatial.pairs(b, b, ["pid"]).where(F.col("b.ord") == F.col("a.ord") + 1)
    return j.select("a.pid", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), round_to(geometry.coverage(A(), B()), 6).alias("coverage"), p[0].alias("px"), p[2].alias("pw"))


def _merge(b, least: float, fields: list[str], patch):
    both = b.groupBy("pid").agg(*(F.array_sort(F.collect_list(F.when(side, F.struct("ord", "x", "y", "w", "h", *fields)))).alias(n) for side, n in ((LOCAL(), "loc"), (EXTERNAL(), "ext"))))
    merged = merge.merge_first(F.col("loc"), F.col("ext"), lambda k, x: merge.overlaps(k, x) > least, patch)
    return both.select("pid", F.posexplode(merged).alias("place", "e")).select("pid", "place", "e.*")


def _merge_sql(least: float, fields: str, patch: str) -> str:
    """list_reduce over one-element lists; the first list holds all local boxes."""
    s = f"struct_pack(ord := ord, x := x, y := y, w := w, h := h, {fields})"
    at = f"list_position(list_transform(acc, lambda q: {iou_sql('q.', 'x[1].')} > {least}), true)"
    return f"""{SIDES}, l AS (SELECT pid, list({s} ORDER BY ord) AS l FROM loc GROUP BY pid), e AS (SELECT pid, list([{s}] ORDER BY ord) AS e FROM ext GROUP BY pid),
      ids AS (SELECT DISTINCT pid FROM fx_boxes), j AS (SELECT pid, list_reduce(CASE WHEN l IS NULL THEN e WHEN e IS NULL THEN [l] ELSE list_prepend(l, e) END,
        lambda acc, x: CASE WHEN {at} > 0 THEN list_transform(acc, lambda k, i: CASE WHEN i = {at} THEN {patch} ELSE k END) ELSE list_concat(acc, x) END) AS m
        FROM ids LEFT JOIN l USING (pid) LEFT JOIN e USING (pid)),
      u AS (SELECT pid, unnest(m) AS k, CAST(generate_subscripts(m, 1) - 1 AS INT) AS place FROM j)"""


@query("join_03_merge_texts", "fx_texts", sql=f"""{_merge_sql(0.25, 'txt := txt, weight := weight, conf := conf', "struct_pack(ord := k.ord, x := k.x, y := k.y, w := k.w, h := k.h, txt := CASE WHEN k.conf < 0.7 THEN x[1].txt ELSE k.txt END, weight := x[1].weight, conf := k.conf)").replace('fx_boxes', 'fx_texts')}
  SELECT pid, place, k.ord AS ord, k.x AS x, k.txt AS txt, k.weight AS weight, k.conf AS conf FROM u""")
def join03(t):
    patch = lambda k, x: k.withField("txt", F.when(k["conf"] < 0.7, x["txt"]).otherwise(k["txt"])).withField("weight", x["weight"])
    return _merge(t, 0.25, ["txt", "weight", "conf"], patch).select("pid", "place", "ord", "x", "txt", "weight", "conf")


@query("join_04_merge_objects", "fx_boxes", sql=f"""{_merge_sql(0.3, 'kind := kind, conf := conf', "struct_pack(ord := k.ord, x := k.x, y := k.y, w := k.w, h := k.h, kind := x[1].kind, conf := greatest(k.conf, x[1].conf))")}
  SELECT pid, place, k.ord AS ord, k.kind AS kind, k.conf AS conf FROM u""")
def join04(b):
    patch = lambda k, x: k.withField("kind", x["kind"]).withField("conf", F.greatest(k["conf"], x["conf"]))
    return _merge(b, 0.3, ["kind", "conf"], patch).select("pid", "place", "ord", "kind", "conf")


def _keep_sql(src: str, order: str, fields: str, step: str) -> str:
    return f""", g AS (SELECT pid, list_reduce(list([struct_pack({fields})] ORDER BY {order}), lambda acc, x: {step}) AS m FROM {src} GROUP BY pid), u AS (SELECT pid, unnest(m) AS k FROM g)"""


@query("join_05_provider_nms", "fx_providers", sql=_keep_sql("fx_providers", "priority, ord", "priority := priority, ord := ord, x := x, y := y, w := w, h := h, provider := provider", f"CASE WHEN len(list_filter(acc, lambda k: {iou_sql('k.', 'x[1].')} > 0.4)) > 0 THEN acc ELSE list_concat(acc, x) END") + " SELECT pid, k.ord AS ord, k.provider AS provider FROM u")
def join05(p):
    g = merge.gathered(p, "pid", ["priority", "ord"], ["x", "y", "w", "h", "provider"])
    kept = merge.greedy_keep(F.col("items"), lambda k, x: merge.overlaps(k, x) > 0.4)
    return g.select("pid", F.explode(kept).alias("k")).select("pid", "k.ord", "k.provider")


_CLASH = f"({iou_sql('k.', 'x[1].')} > 0.3 OR {line_sql('k.', 'x[1].')})"


@query("join_06_ocr_contest", "fx_texts", sql=_keep_sql("fx_texts", "ord", "ord := ord, x := x, y := y, w := w, h := h, n := length(txt), conf := conf", f"""CASE WHEN len(list_filter(acc, lambda k: {_CLASH} AND NOT (x[1].n > 1.2 * k.n OR (x[1].n >= 0.8 * k.n AND x[1].conf > k.conf)))) > 0 THEN acc
  ELSE list_concat(list_filter(acc, lambda k: NOT {_CLASH}), x) END""") + " SELECT pid, k.ord AS ord, CAST(k.n AS INT) AS n FROM u")
def join06(t):
    g = merge.gathered(t.withColumn("n", F.length("txt")), "pid", ["ord"], ["x", "y", "w", "h", "n", "conf"])
    beats = lambda x, k: (x["n"] > 1.2 * k["n"]) | ((x["n"] >= 0.8 * k["n"]) & (x["conf"] > k["conf"]))
    return g.select("pid", F.explode(merge.contest(F.col("items"), merge.line_clash, beats)).alias("k")).select("pid", "k.ord", "k.n")


@query("join_07_same_line", "fx_boxes", sql=f"SELECT a.pid, a.ord AS a, b.ord AS b FROM fx_boxes a JOIN fx_boxes b ON a.pid = b.pid AND a.ord < b.ord AND {line_sql('a.', 'b.')}")
def join07(b):
    return spatial.pairs(b, b, ["pid"]).where((F.col("a.ord") < F.col("b.ord")) & geometry.same_line(A(), B())).select("a.pid", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))


@query("join_08_text_antijoin", "fx_boxes", "fx_texts", sql=f"SELECT a.pid, a.ord, a.kind FROM fx_boxes a WHERE a.kind IN ('logo', 'object') AND NOT EXISTS (SELECT 1 FROM fx_texts b WHERE b.pid = a.pid AND b.source = 'external' AND {iou_sql('a.', 'b.')} > 0.1)")
def join08(b, t):
    return spatial.without(b.where(F.col("kind").isin("logo", "object")), t.where(EXTERNAL()), ["pid"], geometry.iou(A(), B()) > 0.1).select("a.pid", "a.ord", "a.kind")


@query("join_09_add_second_keyframe", "fx_texts", sql=f""", k1 AS (SELECT * FROM fx_texts WHERE source = 'local'), k2 AS (SELECT pid, ord, x * 1.1 AS x, y * 1.1 AS y, w * 1.1 AS w, h * 1.1 AS h, txt FROM fx_texts WHERE source = 'external')
  SELECT pid, ord, {r('x', 3)} AS x, txt, 1 AS keyframe FROM k1 UNION ALL SELECT pid, ord, {r('x', 3)} AS x, txt, 2 AS keyframe FROM k2 a WHERE NOT EXISTS (SELECT 1 FROM k1 b WHERE b.pid = a.pid AND b.txt = a.txt AND {iou_sql('a.', 'b.')} > 0.5)""")
def join09(t):
    k1 = t.where(LOCAL())
    k2 = t.where(EXTERNAL()).withColumns({c: F.col(c) * 1.1 for c in "xywh"})
    new = spatial.without(k2, k1, ["pid", "txt"], geometry.iou(A(), B()) > 0.5)
    show = lambda df, n: df.select("pid", "ord", round_to(F.col("x"), 3).alias("x"), "txt", F.lit(n).alias("keyframe"))
    return show(k1, 1).unionByName(show(new, 2))


@query("join_10_layer_timing", "fx_layers", "fx_timing", sql="SELECT l.id, coalesce(t.t_in, 0) AS t_in, coalesce(t.t_out, 4) AS t_out FROM fx_layers l LEFT JOIN (SELECT *, 'S' || CAST(vid AS STRING) || '_' || CAST(ord AS STRING) AS source_id FROM fx_timing) t USING (source_id)")
def join10(layers, t):
    t = t.select(F.concat(F.lit("S"), F.col("vid").cast("string"), F.lit("_"), F.col("ord").cast("string")).alias("source_id"), "t_in", "t_out")
    return layers.join(t, "source_id", "left").select("id", F.coalesce("t_in", F.lit(0.0)).alias("t_in"), F.coalesce("t_out", F.lit(4.0)).alias("t_out"))


@query("join_11_nearest_frame", "fx_timing", "fx_frames", sql=""", f AS (SELECT DISTINCT f, t FROM fx_frames), q AS (SELECT lid, t_in * 0.37 AS t FROM fx_timing)
  SELECT lid, arg_min(f, (abs(f.t - q.t), f)) AS frame FROM q CROSS JOIN f GROUP BY lid""")
def join11(t, frames):
    f = frames.select("f", "t").distinct().withColumn("video", F.lit(0))
    q = t.select("lid", (F.col("t_in") * 0.37).alias("t"), F.lit(0).alias("video"))
    return spatial.nearest_in_time(q, f, ["video"], "t", "f", "frame").select("lid", "frame")


@query("join_12_sponsor_strip", "fx_boxes", sql="SELECT a.pid, a.ord, count(*) AS n FROM fx_boxes a JOIN fx_boxes b ON a.pid = b.pid AND abs(a.y + a.h / 2 - b.y - b.h / 2) < 24 AND abs(a.h - b.h) < 0.35 * a.h GROUP BY a.pid, a.ord HAVING count(*) >= 3")
def join12(b):
    near = (F.abs(A()[1] + A()[3] / 2 - B()[1] - B()[3] / 2) < 0.04 * 600) & (F.abs(A()[3] - B()[3]) < 0.35 * A()[3])
    return spatial.pairs(b, b, ["pid"]).where(near).groupBy("a.pid", "a.ord").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("join_13_panels", "fx_boxes", sql="SELECT a.pid, a.ord, count(*) AS n_inside FROM fx_boxes a JOIN fx_boxes b ON a.pid = b.pid AND b.x > a.x AND b.y > a.y AND b.x + b.w * 0.4 < a.x + a.w AND b.y + b.h * 0.4 < a.y + a.h GROUP BY a.pid, a.ord HAVING count(*) >= 2")
def join13(b):
    inner = (B()[0], B()[1], B()[2] * 0.4, B()[3] * 0.4)
    return spatial.pairs(b, b, ["pid"]).where(geometry.contains(A(), inner)).groupBy("a.pid", "a.ord").agg(F.count(F.lit(1)).alias("n_inside")).where("n_inside >= 2")


@query("join_14_text_share", "fx_boxes", "fx_texts", sql=f""", o AS (SELECT * FROM fx_boxes WHERE source = 'local'), n AS (SELECT i FROM range(16) t(i)),
  g AS (SELECT pid, ord, x + (i.i + 0.5) * w / 16 AS gx, y + (j.i + 0.5) * h / 16 AS gy FROM o CROSS JOIN n i CROSS JOIN n j)
  SELECT pid, ord, {r('avg(CASE WHEN EXISTS (SELECT 1 FROM fx_texts t WHERE t.pid = g.pid AND t.source = ' + "'external'" + ' AND gx BETWEEN t.x AND t.x + t.w AND gy BETWEEN t.y - 0.6 * t.h AND t.y + 1.6 * t.h) THEN 1.0 ELSE 0.0 END)')} AS share FROM g GROUP BY pid, ord""")
def join14(b, t):
    """Of the points of a grid over each object, the share inside a text; an object's points are the bits of four numbers."""
    at = [i + 0.5 for i in range(16)]
    texts, o = t.where(EXTERNAL()).select("pid", *(F.col(c).alias(f"t{c}") for c in "xywh")), b.where(LOCAL()).select("pid", "ord", "x", "y", "w", "h")
    across = lambda i: (F.col("x") + i * F.col("w") / 16).between(F.col("tx"), F.col("tx") + F.col("tw"))
    down = lambda j: (F.col("y") + j * F.col("h") / 16).between(F.col("ty") - 0.6 * F.col("th"), F.col("ty") + 1.6 * F.col("th"))
    column = reduce(lambda a, c: a + c, (F.when(down(j), 1 << k).otherwise(0) for k, j in enumerate(at))).cast("bigint")
    met = o.join(texts, "pid", "left").withColumn("_column", column)
    four = [reduce(lambda a, c: a.bitwiseOR(c), (F.when(across(i), F.shiftleft("_column", 16 * k)).otherwise(F.lit(0).cast("bigint")) for k, i in enumerate(at[n : n + 4]))) for n in range(0, 16, 4)]
    seen = met.groupBy("pid", "ord").agg(*(F.bit_or(c).alias(f"_{n}") for n, c in enumerate(four)))
    hits = reduce(lambda a, c: a + c, (F.bit_count(f"_{n}") for n in range(4)))
    return seen.select("pid", "ord", round_to(hits / 256, 6).alias("share"))


@query("join_15_has_text", "fx_boxes", "fx_texts", sql=f"SELECT a.pid, a.ord FROM fx_boxes a WHERE a.source = 'local' AND EXISTS (SELECT 1 FROM fx_texts b WHERE b.pid = a.pid AND b.source = 'external' AND {inter_sql('a.', 'b.')} / (b.w * b.h) > 0.6)")
def join15(b, t):
    return spatial.having(b.where(LOCAL()), t.where(EXTERNAL()), ["pid"], geometry.coverage(B(), A()) > 0.6).select("a.pid", "a.ord")


@query("join_16_ink_halo", "fx_boxes", "fx_texts", sql="""SELECT b.pid, b.ord, count(*) AS n FROM fx_boxes b JOIN fx_texts t ON t.pid = b.pid AND t.ord <> b.ord AND b.x + b.w / 2 BETWEEN t.x - greatest(4, 0.25 * t.h) AND t.x + t.w + greatest(4, 0.25 * t.h)
  AND b.y + b.h / 2 BETWEEN t.y - greatest(4, 0.25 * t.h) AND t.y + t.h + greatest(4, 0.25 * t.h) GROUP BY b.pid, b.ord""")
def join16(b, t):
    halo = F.greatest(F.lit(4.0), 0.25 * B()[3])
    px, py = A()[0] + A()[2] / 2, A()[1] + A()[3] / 2
    near = px.between(B()[0] - halo, B()[0] + B()[2] + halo) & py.between(B()[1] - halo, B()[1] + B()[3] + halo) & (F.col("a.ord") != F.col("b.ord"))
    return spatial.pairs(b, t, ["pid"]).where(near).groupBy("a.pid", "a.ord").agg(F.count(F.lit(1)).alias("n"))


CENTRES = [(0, 20, 30, 40), (1, 200, 60, 50), (2, 90, 180, 90), (3, 60, 80, 210), (4, 230, 220, 190)]


@query("join_17_nearest_centre", "fx_samples", sql=f""", c AS (SELECT * FROM (VALUES {", ".join(map(str, CENTRES))}) c(k, r, g, b))
  SELECT vec_id, i, CAST(arg_min(k, ({REDMEAN_SQL.format(a='s.', b='c.')}, k)) AS INT) AS k FROM fx_samples s CROSS JOIN c GROUP BY vec_id, i""")
def join17(s):
    from ..operators.palette import nearest_centre

    return s.select("vec_id", "i", nearest_centre(tuple(F.col(c) for c in "rgb"), CENTRES).alias("k"))


@query("join_18_eval_text_match", "fx_texts", sql=f""", p AS (SELECT a.pid, a.ord, a.txt, string_agg(b.txt, ' ' ORDER BY b.x, b.ord) AS pred, count(b.ord) AS n FROM fx_texts a LEFT JOIN fx_texts b ON a.pid = b.pid AND b.source = 'external'
   AND ({inter_sql('a.', 'b.')} / (b.w * b.h) >= 0.5 OR {inter_sql('a.', 'b.')} / (a.w * a.h) >= 0.5) WHERE a.source = 'local' GROUP BY a.pid, a.ord, a.txt)
  SELECT pid, ord, coalesce(pred, '') AS pred, n FROM p""")
def join18(t):
    a, b = t.where(LOCAL()).alias("a"), t.where(EXTERNAL()).alias("b")
    hit = (geometry.coverage(B(), A()) >= 0.5) | (geometry.coverage(A(), B()) >= 0.5)
    j = a.join(b, (F.col("a.pid") == F.col("b.pid")) & hit, "left")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("b.ord").isNotNull(), F.struct("b.x", "b.ord", "b.txt")))), lambda s: s["txt"]), " ")
    return j.groupBy("a.pid", "a.ord").agg(said.alias("pred"), F.count("b.ord").alias("n"))


@query("join_19_eval_object_match", "fx_boxes", sql=f"""WITH RECURSIVE {fixtures.duckdb_with("fx_boxes")[5:]},
  g AS (SELECT pid, list({{'ord': ord, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY ord) FILTER (source = 'local') AS want, coalesce(list({{'ord': ord, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY ord) FILTER (source = 'external'), []) AS have FROM fx_boxes GROUP BY pid),
  m(pid, i, used, ord, hit) AS (SELECT pid, 0, CAST([] AS INT[]), CAST(NULL AS INT), CAST(NULL AS STRUCT(neg DOUBLE, o INT)) FROM g WHERE want IS NOT NULL UNION ALL
    SELECT pid, i + 1, CASE WHEN good THEN list_append(used, b.o) ELSE used END, n.ord, CASE WHEN good THEN b END FROM (SELECT *, coalesce(b.neg <= -0.5, FALSE) AS good FROM (
      SELECT pid, i, used, n, list_sort(list_transform(list_filter(have, lambda h: NOT list_contains(used, h.ord)), lambda h: {{'neg': CAST(-{iou_sql('n.', 'h.')} AS DOUBLE), 'o': h.ord}}))[1] AS b
      FROM (SELECT m.pid, m.i, m.used, g.have, g.want[m.i + 1] AS n FROM m JOIN g USING (pid) WHERE m.i < len(g.want)))))
  SELECT pid, ord, hit.o AS other, {r('coalesce(-hit.neg, 0)')} AS iou FROM m WHERE i > 0""")
def join19(b):
    g = b.groupBy("pid").agg(*(F.array_sort(F.collect_list(F.when(side, F.struct("ord", "x", "y", "w", "h")))).alias(n) for side, n in ((LOCAL(), "want"), (EXTERNAL(), "have"))))
    return g.select("pid", F.explode(merge.assign_best(F.col("want"), F.col("have"), merge.overlaps, 0.5)).alias("m")).select("pid", "m.ord", "m.other", round_to(F.col("m.score"), 6).alias("iou"))


@query("join_20_scene_overlap", "fx_timing", sql=f""", a AS (SELECT * FROM fx_timing WHERE ord % 2 = 0), b AS (SELECT * FROM fx_timing WHERE ord % 2 = 1)
  SELECT vid, lid, arg_max(other, (ov, -oord)) AS other, {r('max(ov)')} AS overlap FROM (SELECT a.vid, a.lid, b.lid AS other, b.ord AS oord, least(a.t_out, b.t_out) - greatest(a.t_in, b.t_in) AS ov FROM a JOIN b ON a.vid = b.vid) WHERE ov > 0 GROUP BY vid, lid""")
def join20(t):
    from ..operators.spatial import best_overlap

    a, b = t.where("ord % 2 = 0").select("vid", "lid", "t_in", "t_out"), t.where("ord % 2 = 1").select("vid", "t_in", "t_out", "ord", F.col("lid").alias("other"))
    return best_overlap(a, b, "vid", "t_in", "t_out", "ord", "other").select("vid", "lid", "other", round_to(F.col("overlap"), 6).alias("overlap"))


@query("join_21_cut_match", "fx_timing", sql=f"""WITH RECURSIVE {fixtures.duckdb_with("fx_timing")[5:]},
  w AS (SELECT vid, ord, t_in AS t, CASE WHEN lid % 3 = 0 THEN 0.3 ELSE {2 / 25 + 1e-3!r} END AS most, row_number() OVER (PARTITION BY vid ORDER BY ord) AS i FROM fx_timing WHERE ord % 2 = 0),
  h AS (SELECT vid, list({{'ord': ord, 't': t_in}}) AS have FROM fx_timing WHERE ord % 2 = 1 GROUP BY vid),
  m(vid, i, used, ord, other) AS (SELECT DISTINCT vid, CAST(0 AS BIGINT), CAST([] AS INT[]), CAST(NULL AS INT), CAST(NULL AS INT) FROM w UNION ALL
    SELECT vid, i, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.o) END, ord, b.o FROM (
      SELECT m.vid, w.i, m.used, w.ord, list_sort(list_transform(list_filter(h.have, lambda x: abs(x.t - w.t) <= w.most AND NOT list_contains(m.used, x.ord)), lambda x: {{'d': abs(x.t - w.t), 'o': x.ord}}))[1] AS b
      FROM m JOIN w ON w.vid = m.vid AND w.i = m.i + 1 JOIN h ON h.vid = m.vid))
  SELECT vid, ord, other FROM m WHERE i > 0""")
def join21(t):
    """Layers with an even place are the wanted cuts, a third of them fades; the others are those found, at 25 frames a second."""
    from ..operators.evaluation import match_cuts

    kind = F.when(F.col("lid") % 3 == 0, "fade").otherwise("cut")
    want = t.where("ord % 2 = 0").select("vid", "ord", F.col("t_in").alias("t"), kind.alias("kind"))
    return match_cuts(want, t.where("ord % 2 = 1").select("vid", "ord", F.col("t_in").alias("t")), "vid", 25.0)


@query("join_22_tree_closure", "supplier", sql="""WITH RECURSIVE t AS (SELECT s_suppkey AS root, s_suppkey AS id, 0 AS depth FROM supplier WHERE s_suppkey <= 3 UNION ALL SELECT t.root, CAST(s.s_suppkey AS BIGINT), t.depth + 1 FROM supplier s JOIN t ON CAST(floor(s.s_suppkey / 2) AS BIGINT) = t.id AND s.s_suppkey > 3)
  SELECT root, count(*) AS n, max(depth) AS depth FROM t GROUP BY root""")
def join22(s):
    return s.sparkSession.sql("""
        WITH RECURSIVE edges AS (SELECT s_suppkey AS id, CAST(floor(s_suppkey / 2) AS BIGINT) AS parent FROM {s}),
        t (root, id, depth) AS (SELECT id, id, 0 FROM edges WHERE id <= 3 UNION ALL SELECT t.root, e.id, t.depth + 1 FROM edges e JOIN t ON e.parent = t.id WHERE e.id > 3)
        SELECT root, count(*) AS n, max(depth) AS depth FROM t GROUP BY root""", s=s)


@query("join_23_regression", "fx_projects", sql=f""", c AS (SELECT design_type AS metric, avg(CAST(dna AS DOUBLE)) / 100 AS v FROM fx_projects GROUP BY 1), b AS (SELECT design_type AS metric, avg(CAST(dna AS DOUBLE)) / 100 AS v FROM fx_projects WHERE owner < 12 GROUP BY 1)
  SELECT c.metric, {r('c.v - b.v')} AS delta, CASE WHEN c.v - b.v > 0.0005 THEN 'better' WHEN c.v - b.v < -0.0005 THEN 'worse' ELSE 'same' END AS verdict FROM c JOIN b USING (metric)""")
def join23(p):
    from ..operators.evaluation import compare

    mean = lambda df: df.groupBy(F.col("design_type").alias("metric")).agg((F.avg(F.col("dna").cast("double")) / 100).alias("v"))
    return compare(mean(p), mean(p.where("owner < 12"))).select("metric", round_to(F.col("delta"), 6).alias("delta"), "verdict")
