"""Queries over frames, timing and ordered analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, round_to
from ..operators import video
from ..sources import fixtures
from .registry import query, r, whole

PX = """, px AS (SELECT f, t, scene, px, py, v FROM fx_frames), nb AS (SELECT *, lag(v) OVER wx AS l, lead(v) OVER wx AS rr, lag(v) OVER wy AS u, lead(v) OVER wy AS d FROM px WINDOW wx AS (PARTITION BY f, py ORDER BY px), wy AS (PARTITION BY f, px ORDER BY py)),
  ed AS (SELECT f, t, px, py, v, CASE WHEN px BETWEEN 1 AND 14 AND py BETWEEN 1 AND 14 AND abs(rr - l) + abs(d - u) > 18 THEN 1 ELSE 0 END AS e FROM nb),
  nx AS (SELECT *, greatest(e, coalesce(lag(e) OVER wx, 0), coalesce(lead(e) OVER wx, 0), coalesce(lag(e) OVER wy, 0), coalesce(lead(e) OVER wy, 0)) AS near FROM ed WINDOW wx AS (PARTITION BY f, py ORDER BY px), wy AS (PARTITION BY f, px ORDER BY py)),
  fr AS (SELECT DISTINCT f, t, lag(f) OVER (ORDER BY f) AS prev, lag(t) OVER (ORDER BY f) AS t0 FROM (SELECT DISTINCT f, t FROM px)),
  st AS (SELECT fr.f, fr.t, fr.t0, coalesce(avg(abs(b.v - a.v)), 0) AS step, CASE WHEN fr.prev IS NULL THEN NULL WHEN sum(a.e) < 8 THEN 1 ELSE sum(CASE WHEN a.e = 1 THEN b.near ELSE 0 END) / CAST(sum(a.e) AS DOUBLE) END AS kept
    FROM fr JOIN nx b ON b.f = fr.f LEFT JOIN nx a ON a.f = fr.prev AND a.px = b.px AND a.py = b.py GROUP BY fr.f, fr.t, fr.t0, fr.prev)"""


def _frames(fx):
    return video.frames(fx, ["f", "t", "scene"], 16).withColumn("video", F.lit(0))


@query("win_02_frame_difference", "fx_frames", sql=f"{PX} SELECT f, {r('step + 1e-9', 4)} AS step FROM st")
def win02(fx):
    return video.steps(_frames(fx), 16, 16).select("f", round_to(F.col("step") + 1e-9, 4).alias("step"))


@query("win_03_hard_cuts", "fx_frames", sql=f"""{PX}, ar AS (SELECT *, greatest(coalesce(lag(step, 2) OVER w, 0), coalesce(lag(step) OVER w, 0), coalesce(lead(step) OVER w, 0), coalesce(lead(step, 2) OVER w, 0)) AS around FROM st WINDOW w AS (ORDER BY f))
  SELECT f, {r('(t0 + t) / 2', 4)} AS time FROM ar WHERE step >= 2.5 AND step >= 3 * around AND kept < 0.45""")
def win03(fx):
    return video.hard_cuts(video.steps(_frames(fx), 16, 16)).select("f", round_to(F.col("time"), 4).alias("time"))


REFINED = f"""WITH RECURSIVE {fixtures.duckdb_with("fx_frames")[5:]}{PX}, sm AS (SELECT k.k AS video, f, t FROM fr JOIN (VALUES (4), (5)) k(k) ON f % k.k = 0), sq AS (SELECT *, lag(f) OVER w AS prev, lag(t) OVER w AS t0 FROM sm WINDOW w AS (PARTITION BY video ORDER BY f)),
  ss AS (SELECT q.video, q.f, q.prev, q.t, q.t0, coalesce(avg(abs(b.v - a.v)), 0) AS step, CASE WHEN q.prev IS NULL THEN NULL WHEN sum(a.e) < 8 THEN 1 ELSE sum(CASE WHEN a.e = 1 THEN b.near ELSE 0 END) / CAST(sum(a.e) AS DOUBLE) END AS kept
    FROM sq q JOIN nx b ON b.f = q.f LEFT JOIN nx a ON a.f = q.prev AND a.px = b.px AND a.py = b.py GROUP BY q.video, q.f, q.prev, q.t, q.t0),
  sr AS (SELECT *, greatest(coalesce(lag(step, 2) OVER w, 0), coalesce(lag(step) OVER w, 0), coalesce(lead(step) OVER w, 0), coalesce(lead(step, 2) OVER w, 0)) AS around FROM ss WINDOW w AS (PARTITION BY video ORDER BY f)),
  ct AS (SELECT video, f, prev, t0 AS lo, t AS hi FROM sr WHERE step >= 2.5 AND step >= 3 * around AND kept < 0.45),
  lk AS (SELECT c.video, c.f, p.t, avg(abs(p.v - a.v)) <= avg(abs(p.v - b.v)) AS early FROM ct c JOIN px p ON p.t BETWEEN c.lo AND c.hi JOIN px a ON a.f = c.prev AND a.px = p.px AND a.py = p.py JOIN px b ON b.f = c.f AND b.px = p.px AND b.py = p.py GROUP BY ALL),
  gl AS (SELECT video AS gv, f AS gf, list({{'t': t, 'early': early}} ORDER BY t) AS g FROM lk GROUP BY video, f),
  bs(video, f, lo, hi) AS (SELECT video, f, lo, hi FROM ct UNION ALL
    SELECT b.video, b.f, CASE WHEN e THEN m ELSE lo END, CASE WHEN e THEN hi ELSE m END FROM (SELECT b.*, (lo + hi) / 2 AS m, list_filter(g, lambda x: x.t <= (lo + hi) / 2)[-1].early AS e FROM bs b JOIN gl ON gv = video AND gf = f WHERE hi - lo > 1.0 / 60) b)
  SELECT video, {r('(lo + hi) / 2', 5)} AS time FROM bs WHERE hi - lo <= 1.0 / 60"""


@query("iter_04_refine_cuts", "fx_frames", sql=REFINED)
def iter04(fx):
    """Cuts found on every fourth and on every fifth frame, refined on all of them."""
    whole = _frames(fx).select("f", "t", "v").withColumn("video", F.explode(F.array(F.lit(4), F.lit(5))))
    sampled = whole.where(F.col("f") % F.col("video") == 0).withColumn("f", F.floor(F.col("f") / F.col("video")))
    return video.refine_cuts(video.hard_cuts(video.steps(sampled, 16, 16)), whole).select("video", round_to(F.col("time"), 5).alias("time"))


@query("ras_17_edges", "fx_frames", sql=f"{PX} SELECT f, CAST(sum(e) AS INT) AS n, CAST(sum(e * (px + 16 * py)) AS BIGINT) AS moment FROM ed GROUP BY f")
def ras17(fx):
    e = _frames(fx).withColumn("e", video.edges(F.col("v"), 16, 16))
    moment = F.aggregate(F.transform("e", lambda x, i: x.cast("bigint") * i), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return e.select("f", video.ones(F.col("e")).alias("n"), moment.alias("moment"))


@query("ras_18_persistence", "fx_frames", sql=f"{PX} SELECT f, {r('kept', 4)} AS kept FROM st WHERE kept IS NOT NULL")
def ras18(fx):
    return video.steps(_frames(fx), 16, 16).where("kept is not null").select("f", round_to(F.col("kept"), 4).alias("kept"))


@query("ras_16_block_mean", "fx_frames", sql=f"SELECT f, CAST(px // 4 AS INT) AS bx, CAST(py // 4 AS INT) AS by, {r('avg(v) + 1e-9', 4)} AS v FROM fx_frames GROUP BY ALL")
def ras16(fx):
    return fx.groupBy("f", F.floor(F.col("px") / 4).cast("int").alias("bx"), F.floor(F.col("py") / 4).cast("int").alias("by")).agg(round_to(F.avg("v") + 1e-9, 4).alias("v"))


@query("win_07_visibility", "fx_frames", sql=f""", k AS (SELECT f.f, f.t, floor(f.f / 60) AS lid, avg(abs(f.v - k.v)) AS d FROM fx_frames f JOIN fx_frames k ON k.f = CAST(floor(f.f / 60) * 60 + 30 AS BIGINT) AND k.px = f.px AND k.py = f.py GROUP BY ALL),
  h AS (SELECT *, max(d) OVER (PARTITION BY lid) / 2 AS half, lag(t) OVER w AS pt, lag(d) OVER w AS pd, lead(t) OVER w AS nt, lead(d) OVER w AS nd FROM k WINDOW w AS (PARTITION BY lid ORDER BY t)),
  c AS (SELECT lid, max(d) AS most, arg_min(CASE WHEN pt IS NULL THEN lid * 2.4 ELSE pt + (t - pt) * (pd - half) / greatest(1e-6, pd - d) END, t) FILTER (d < half) AS a, arg_max(CASE WHEN nt IS NULL THEN lid * 2.4 + 2.4 ELSE nt + (t - nt) * (nd - half) / greatest(1e-6, nd - d) END, t) FILTER (d < half) AS b FROM h GROUP BY lid)
  SELECT CAST(lid AS BIGINT) AS lid, {r('CASE WHEN most < 6 THEN lid * 2.4 ELSE coalesce(a, lid * 2.4 + 1.2) END', 4)} AS t_in, {r('CASE WHEN most < 6 THEN lid * 2.4 + 2.4 ELSE coalesce(b, lid * 2.4 + 1.2) END', 4)} AS t_out FROM c""")
def win07(fx):
    x = _frames(fx).withColumn("lid", F.floor(F.col("f") / 60).cast("bigint"))
    key = x.where(F.col("f") == F.col("lid") * 60 + 30).select("lid", F.col("v").alias("kv"))
    start = F.col("lid").cast("double") * 2.4
    d = x.join(key, "lid").select("lid", "t", video.mean_diff(F.col("v"), F.col("kv")).alias("d"), start.alias("start"), (start + 2.4).alias("end"), (start + 1.2).alias("key_t"))
    return video.visibility(d, ["lid"]).select("lid", round_to(F.col("t_in"), 4).alias("t_in"), round_to(F.col("t_out"), 4).alias("t_out"))


@query("win_08_keyframe", "fx_frames", sql=f"""{PX}, n AS (SELECT f, floor(f / 20) AS scene, sum(e) AS n FROM ed GROUP BY f) SELECT CAST(scene AS BIGINT) AS scene, arg_max(f, (n, -f)) AS keyframe, CAST(max(n) AS INT) AS n, max(n) < 256 * 0.002 AS empty FROM n GROUP BY scene""")
def win08(fx):
    x = _frames(fx).withColumn("n", video.ones(video.edges(F.col("v"), 16, 16)))
    return x.groupBy("scene").agg(F.max_by("f", F.struct("n", -F.col("f"))).alias("keyframe"), F.max("n").alias("n"), (F.max("n") < 256 * 0.002).alias("empty"))


FADES = "(SELECT vid, t_in * 3 AS time, CASE WHEN lid % 2 = 0 THEN 0.6 ELSE 0.9 END AS length, CAST(lid % 97 AS DOUBLE) / 97 AS share, ord FROM fx_timing)"


@query("win_05_fade_suppression", "fx_timing", sql=f""", c AS {FADES}, g AS (SELECT vid, list_reduce(list([struct_pack(time := time, length := length)] ORDER BY share DESC, ord), lambda acc, x:
   CASE WHEN len(list_filter(acc, lambda k: abs(k.time - x[1].time) < greatest(0.5, (k.length + x[1].length) / 2))) > 0 THEN acc ELSE list_concat(acc, x) END) AS m FROM c GROUP BY vid),
  s AS (SELECT vid, unnest(m) AS k FROM g), o AS (SELECT vid, k.time AS time, k.time - lag(k.time) OVER (PARTITION BY vid ORDER BY k.time, k.length) AS gap FROM s) SELECT vid, {r('time', 3)} AS time FROM o WHERE gap IS NULL OR gap > 0.3""")
def win05(t):
    found = t.select("vid", "ord", (F.col("t_in") * 3).alias("time"), F.when(F.col("lid") % 2 == 0, 0.6).otherwise(0.9).alias("length"), (-(F.col("lid") % 97).cast("double") / 97).alias("neg"))
    # of equal fades only the best can stay
    best = found.groupBy("vid", "time", "length").agg(F.min(F.struct("neg", "ord")).alias("o"))
    g = best.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("o", "time", "length"))).alias("items"))
    fades = F.transform("items", lambda s: F.struct(s["time"].alias("time"), s["length"].alias("length")))
    kept = video.suppress(fades, F.array().cast("array<struct<time:double,length:double>>"))
    times = F.transform(kept, lambda s: s["time"])
    return g.withColumn("times", times).select("vid", F.explode(video.spaced(F.col("times"))).alias("time")).select("vid", round_to(F.col("time"), 3).alias("time"))


@query("win_06_fold_short_scenes", "fx_timing", sql=f""", c AS (SELECT vid, list_sort(list(DISTINCT t_in * 4)) AS ts FROM fx_timing GROUP BY vid),
  g AS (SELECT vid, list_reduce(list_prepend([CAST(21.0 AS DOUBLE)], list_transform(list_reverse(ts), lambda x: [x])), lambda acc, x: CASE WHEN x[1] - coalesce(list_max(list_filter(ts, lambda q: q < x[1])), 0) < 0.7 OR acc[len(acc)] - x[1] < 0.7 THEN acc ELSE list_concat(acc, x) END) AS m FROM c),
  u AS (SELECT vid, unnest(m[2:]) AS time FROM g) SELECT vid, {r('time', 3)} AS time FROM u""")
def win06(t):
    g = t.groupBy("vid").agg(F.array_sort(F.collect_set(F.col("t_in") * 4)).alias("ts"))
    return g.select("vid", F.explode(video.fold_short(F.col("ts"), F.lit(21.0))).alias("time")).select("vid", round_to(F.col("time"), 3).alias("time"))


@query("win_10_spacing_rhythm", "fx_texts", sql=f"SELECT pid, count(*) AS n, {r('avg(gap)', 4)} AS mean FROM (SELECT pid, y - lag(y) OVER (PARTITION BY pid ORDER BY y, ord) AS gap FROM fx_texts) WHERE gap > 2 GROUP BY pid")
def win10(t):
    gap = F.col("y") - F.lag("y").over(Window.partitionBy("pid").orderBy("y", "ord"))
    return t.select("pid", gap.alias("gap")).where("gap > 2").groupBy("pid").agg(F.count(F.lit(1)).alias("n"), round_to(F.avg("gap"), 4).alias("mean"))


@query("win_11_split_lines", "fx_boxes", sql=f""", w AS (SELECT pid, ord AS word, CASE WHEN ord % 5 = 0 THEN '*' WHEN ord % 3 = 0 THEN 'Off' || CAST(ord AS STRING) ELSE 'word' || CAST(pk % 10 AS STRING) END AS text, conf, x AS x0, x + w / 3 AS x1, 20 + h / 40 AS y0, 60 + h / 10 AS y1 FROM fx_boxes),
  m AS (SELECT *, (y0 + y1) / 2 AS mid, y1 - y0 AS hh, count(*) OVER (PARTITION BY pid) AS n FROM w),
  q AS (SELECT *, list_sort(list(mid) OVER (PARTITION BY pid))[n // 2 + 1] AS cy, list_sort(list(hh) OVER (PARTITION BY pid))[n // 2 + 1] AS wh FROM m),
  k AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY pid ORDER BY x0, word) > 1.2 * wh THEN 1 ELSE 0 END AS brk FROM q WHERE abs(mid - cy) < 0.5 * wh AND hh < 1.8 * wh),
  p AS (SELECT *, sum(brk) OVER (PARTITION BY pid ORDER BY x0, word ROWS UNBOUNDED PRECEDING) AS part, row_number() OVER (PARTITION BY pid ORDER BY x0, word) AS i FROM k),
  e AS (SELECT *, min(CASE WHEN text <> '*' THEN i END) OVER (PARTITION BY pid, part) AS a, max(CASE WHEN text <> '*' THEN i END) OVER (PARTITION BY pid, part) AS b FROM p)
  SELECT pid, CAST(part AS BIGINT) AS part, string_agg(text, ' ' ORDER BY i) AS text, {r('avg(conf)', 4)} AS conf, min(x0) AS x0, {r('max(x1)', 4)} AS x1 FROM e WHERE i BETWEEN a AND b GROUP BY pid, part""")
def win11(b):
    w = b.select("pid", F.col("ord").alias("word"), F.when(F.col("ord") % 5 == 0, "*").when(F.col("ord") % 3 == 0, F.concat(F.lit("Off"), F.col("ord").cast("string"))).otherwise(F.concat(F.lit("word"), (F.col("pk") % 10).cast("string"))).alias("text"), "conf", F.col("x").alias("x0"), (F.col("x") + F.col("w") / 3).alias("x1"), (20 + F.col("h") / 40).alias("y0"), (60 + F.col("h") / 10).alias("y1"))
    return video.split_words(w, ["pid"]).select("pid", "part", "text", round_to(F.col("conf"), 4).alias("conf"), "x0", round_to(F.col("x1"), 4).alias("x1"))


@query("win_12_timeline_ticks", "fx_timing", sql=f"SELECT vid, unnest(range(CAST(floor(max(t_out) / CASE WHEN max(t_out) < 5 THEN 0.5 WHEN max(t_out) < 7 THEN 1 ELSE 2 END) AS BIGINT) + 1)) AS tick, CASE WHEN max(t_out) < 5 THEN 0.5 WHEN max(t_out) < 7 THEN 1 ELSE 2 END AS step, {r('max(t_out) / 0.05', 0)} * 0.05 AS snapped FROM fx_timing GROUP BY vid")
def win12(t):
    from ..operators.timeline import tick_step, ticks

    d = t.groupBy("vid").agg(F.max("t_out").alias("d"))
    step = tick_step(F.col("d"), 5.0, 7.0)
    return d.select("vid", F.explode(ticks(F.col("d"), step)).alias("tick"), step.alias("step"), (round_to(F.col("d") / 0.05, 0) * 0.05).alias("snapped"))


CUES = """, it AS (SELECT vid, ord, greatest(0, t_in) AS s, least(5, t_out) AS e, y, upper(txt) AS txt FROM fx_timing WHERE least(5, t_out) - greatest(0, t_in) >= 0.1),
  cu AS (SELECT vid, list_reduce(list([struct_pack(s := CAST(s AS DOUBLE), e := CAST(e AS DOUBLE), lines := [struct_pack(y := y, n := 0, txt := txt)])] ORDER BY ord), lambda acc, x:
    CASE WHEN list_position(list_transform(acc, lambda q: abs(q.s - x[1].s) < 0.15 AND abs(q.e - x[1].e) < 0.15), true) > 0 THEN list_transform(acc, lambda k, i: CASE WHEN i = list_position(list_transform(acc, lambda q: abs(q.s - x[1].s) < 0.15 AND abs(q.e - x[1].e) < 0.15), true)
      THEN struct_pack(s := k.s, e := k.e, lines := list_concat(k.lines, [struct_pack(y := x[1].lines[1].y, n := len(k.lines), txt := x[1].lines[1].txt)])) ELSE k END) ELSE list_concat(acc, x) END) AS m FROM it GROUP BY vid),
  cc AS (SELECT vid, unnest(m) AS k FROM cu), cs AS (SELECT vid, k.s AS s, k.e AS e, array_to_string(list_transform(list_sort(k.lines), lambda l: l.txt), '/') AS lines, row_number() OVER (PARTITION BY vid ORDER BY k.s, k.e, list_sort(k.lines)) AS n FROM cc)"""


def _cues(t):
    it = t.select("vid", "ord", F.greatest(F.lit(0.0), "t_in").alias("start"), F.least(F.lit(5.0), "t_out").alias("end"), "y", F.upper("txt").alias("text")).where("end - start >= 0.1")
    return video.cues(it, "vid", "ord")


@query("agg_34_caption_cues", "fx_timing", sql=f"{CUES} SELECT vid, CAST(n - 1 AS INT) AS n, s, e, lines FROM cs")
def agg34(t):
    c = _cues(t).withColumn("n", (F.row_number().over(Window.partitionBy("vid").orderBy("start", "end", "lines")) - 1))
    return c.select("vid", "n", F.col("start").alias("s"), F.col("end").alias("e"), F.array_join(F.transform("lines", lambda x: x["text"]), "/").alias("lines"))


def _stamp(x: str, sep: str) -> str:
    ms = whole(f"{x} * 1000")
    return f"lpad(CAST({ms} // 3600000 AS STRING), 2, '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS STRING), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS STRING), 2, '0') || '{sep}' || lpad(CAST({ms} % 1000 AS STRING), 3, '0')"


@query("snk_15_captions", "fx_timing", sql=rf"""{CUES} SELECT vid, string_agg(CAST(n AS STRING) || chr(10) || {_stamp('s', ',')} || ' --> ' || {_stamp('e', ',')} || chr(10) || replace(lines, '/', chr(10)) || chr(10), chr(10) ORDER BY n) AS srt,
  'WEBVTT' || chr(10) || chr(10) || string_agg({_stamp('s', '.')} || ' --> ' || {_stamp('e', '.')} || chr(10) || replace(lines, '/', chr(10)) || chr(10), chr(10) ORDER BY n) AS vtt FROM cs GROUP BY vid""")
def snk15(t):
    from ..operators.export import srt, vtt

    files = _cues(t).groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "lines"))).alias("cues"))
    return files.select("vid", srt(F.col("cues")).alias("srt"), vtt(F.col("cues")).alias("vtt"))


@query("agg_35_frame_quality", "fx_frames", sql=f"SELECT a.f, {r('avg(abs(a.v - b.v)) + 1e-9', 4)} AS mad, {r('10 * log10(255.0 * 255 / avg((a.v - b.v) * (a.v - b.v)))', 4)} AS psnr FROM fx_frames a JOIN fx_frames b ON b.f = a.f + 1 AND a.px = b.px AND a.py = b.py GROUP BY a.f")
def agg35(fx):
    d = fx.alias("a").join(fx.alias("b"), (F.col("b.f") == F.col("a.f") + 1) & (F.col("a.px") == F.col("b.px")) & (F.col("a.py") == F.col("b.py"))).select("a.f", (F.col("a.v") - F.col("b.v")).alias("d"))
    return d.groupBy("f").agg(round_to(F.avg(F.abs("d")) + 1e-9, 4).alias("mad"), round_to(10 * F.log10(F.lit(65025.0) / F.avg(F.col("d") * F.col("d"))), 4).alias("psnr"))


@query("src_07_luma", "fx_samples", sql="SELECT vec_id, i, CAST((77 * r + 150 * g + 29 * b) >> 8 AS INT) AS luma FROM fx_samples")
def src07(s):
    from ..functions.color import luma

    return s.select("vec_id", "i", luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


@query("str_03_rate_limit", "fx_requests", sql="""WITH RECURSIVE q AS (SELECT user_id AS client, event_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events),
  w AS (SELECT client, event_id, s, ord, s AS opened, 1 AS n FROM q WHERE ord = 1 UNION ALL SELECT q.client, q.event_id, q.s, q.ord, CASE WHEN q.s >= w.opened + 43200 THEN q.s ELSE w.opened END, CASE WHEN q.s >= w.opened + 43200 THEN 1 ELSE w.n + 1 END FROM q JOIN w ON q.client = w.client AND q.ord = w.ord + 1)
  SELECT client, event_id, n <= 3 AS allowed, CASE WHEN n <= 3 THEN 0 ELSE CAST(ceil(opened + 43200 - s) AS BIGINT) END AS retry_after FROM w""")
def str03(q):
    from ..streaming.rate_limit import decide

    return decide(q, "client", "ts", "event_id", 3, 43200.0).select("client", "event_id", "allowed", "retry_after")


@query("str_04_step_states", "fx_requests", sql="SELECT client, event_type AS step, arg_max(event_id % 3, (ts, event_id)) AS status, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS seconds, count(*) AS n FROM fx_requests GROUP BY client, event_type")
def str04(q):
    return q.groupBy("client", F.col("event_type").alias("step")).agg(F.max_by(F.col("event_id") % 3, F.struct("ts", "event_id")).alias("status"), F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000000).cast("bigint").alias("seconds"), F.count(F.lit(1)).alias("n"))


@query("str_07_autosave", "fx_requests", sql=""", g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY client ORDER BY ts, event_id) < 7200 THEN 0 ELSE 1 END AS brk FROM fx_requests),
  s AS (SELECT *, sum(brk) OVER (PARTITION BY client ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM g) SELECT client, arg_max(event_id, (ts, event_id)) AS saved, count(*) AS edits FROM s GROUP BY client, sess""")
def str07(q):
    w = F.session_window("ts", "2 hours")
    return q.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("client", w).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("saved"), F.count(F.lit(1)).alias("edits")).select("client", "saved", "edits")


@query("agg_32_step_timings", "fx_requests", sql="SELECT event_type AS step, CAST(sum(event_id % 1000) AS BIGINT) AS ms, count(*) AS n FROM fx_requests GROUP BY event_type")
def agg32(q):
    return q.groupBy(F.col("event_type").alias("step")).agg(F.sum(F.col("event_id") % 1000).cast("bigint").alias("ms"), F.count(F.lit(1)).alias("n"))


@query("agg_33_upload_progress", "fx_requests", sql=f"SELECT client, {r('least(1, (count(*) FILTER (event_id % 3 = 0) + min(least(0.95, (event_id % 100) / 100.0)) FILTER (event_id % 3 = 1)) / count(*))')} AS progress FROM fx_requests GROUP BY client")
def agg33(q):
    active = F.min(F.when(F.col("event_id") % 3 == 1, F.least(F.lit(0.95), (F.col("event_id") % 100) / 100)))
    return q.groupBy("client").agg(round_to(F.least(F.lit(1.0), (F.count_if(F.col("event_id") % 3 == 0) + active) / F.count(F.lit(1))), 6).alias("progress"))


EDITS = ("edit", "undo", "edit", "edit", "drag", "commit", "edit", "redo", "edit", "undo", "redo", "edit", "save", "edit", "edit", "edit")
_ACTION = "CASE WHEN event_id % 97 = 5 THEN 'open' WHEN event_id % 101 = 7 THEN 'switch' ELSE CASE event_id % 16 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(EDITS)) + " END END"
_STACK = lambda past, shown, future, dirty: f"{{'past': {past}, 'shown': {shown}, 'future': {future}, 'dirty': {dirty}}}"
_PUSH = "list_append(s.past, s.shown)[-60:]"
_NONE = "CAST([] AS BIGINT[])"


@query("str_06_undo_redo", "fx_requests", sql=f"""WITH RECURSIVE {fixtures.duckdb_with("fx_requests")[5:]}, e AS (SELECT client // 4 AS editor, ts, event_id, {_ACTION} AS action, row_number() OVER (PARTITION BY client // 4 ORDER BY ts, event_id) AS n FROM fx_requests),
  f AS (SELECT *, max(CASE WHEN action IN ('open', 'switch', 'edit', 'drag') THEN 1 ELSE 0 END) OVER (PARTITION BY editor ORDER BY n) = 1 AS opened FROM e),
  g AS (SELECT *, row_number() OVER (PARTITION BY editor ORDER BY n) AS m FROM f WHERE opened),
  k AS (SELECT editor, event_id, m, {_STACK(_NONE, 'event_id', _NONE, "action = 'switch'")} AS s FROM g WHERE m = 1
    UNION ALL SELECT g.editor, g.event_id, g.m, CASE WHEN action IN ('open', 'switch') THEN {_STACK(_NONE, 'g.event_id', _NONE, "action = 'switch'")} WHEN action = 'edit' THEN {_STACK(_PUSH, 'g.event_id', _NONE, 'true')}
      WHEN action = 'drag' THEN {_STACK('s.past', 'g.event_id', 's.future', 'true')} WHEN action = 'commit' THEN {_STACK(_PUSH, 's.shown', _NONE, 's.dirty')}
      WHEN action = 'undo' AND len(s.past) > 0 THEN {_STACK('s.past[:-2]', 's.past[-1]', 'list_prepend(s.shown, s.future)', 'true')} WHEN action = 'redo' AND len(s.future) > 0 THEN {_STACK('list_append(s.past, s.shown)', 's.future[1]', 's.future[2:]', 'true')}
      WHEN action = 'save' THEN {_STACK('s.past', 's.shown', 's.future', 'false')} ELSE s END FROM k JOIN g ON g.editor = k.editor AND g.m = k.m + 1)
  SELECT f.editor, f.event_id, k.s.shown AS version, coalesce(len(k.s.past), 0) AS undos, coalesce(len(k.s.future), 0) AS redos, coalesce(k.s.dirty, false) AS dirty FROM f LEFT JOIN k USING (editor, event_id)""")
def str06(q):
    """Four users share an editor; every event is a step of its log."""
    from ..operators.history import replay

    log = q.select(F.floor(F.col("client") / 4).cast("bigint").alias("editor"), "ts", "event_id", F.expr(_ACTION).alias("action"), F.col("event_id").alias("version"))
    return replay(log, "editor", "ts", "event_id").drop("ts")
