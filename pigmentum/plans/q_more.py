"""Queries over the seeded generator, letter blobs, provider states and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import random, register
from ..functions.numeric import round_to
from ..operators import objects
from ..sources import providers
from .q_joins import iou_sql
from .q_scalar import REDMEAN_SQL
from .registry import query, r

_M = "4294967296"
_T1 = f"((xor(a, a >> 15)::HUGEINT * (a | 1)::HUGEINT) % {_M})::BIGINT"
_T2 = f"((t1 + ((xor(t1, t1 >> 7)::HUGEINT * (t1 | 61)::HUGEINT) % {_M})::BIGINT) % {_M})"


@query("sc_30_seeded_random", "fx_projects", sql=f"SELECT id, {r(f'xor(t2, t2 >> 14) / {_M}.0', 6)} AS u FROM (SELECT id, xor(t1, {_T2}) AS t2 FROM (SELECT id, {_T1} AS t1 FROM (SELECT id, ((id + 1831565813) % {_M})::BIGINT AS a FROM fx_projects)))")
def sc30(p):
    return p.select("id", round_to(random.uniform(F.col("id")), 6).alias("u"))


@query("ras_11_letter_blobs", "fx_boxes", sql=""", s AS (SELECT pid, ord, x, y, w / 3 AS w, h / 3 AS h, w * h / 9 * conf AS area FROM fx_boxes), k AS (SELECT * FROM s WHERE NOT (h > 90 OR (w > 540 AND h > 162) OR (area < 0.12 * w * h AND least(w, h) > 30))),
  p AS (SELECT a.pid, a.ord FROM k a JOIN k b ON a.pid = b.pid AND b.x > a.x AND b.y > a.y AND b.x + b.w < a.x + a.w AND b.y + b.h < a.y + a.h WHERE least(a.w, a.h) > 9 GROUP BY a.pid, a.ord HAVING count(*) >= 3)
  SELECT pid, ord FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pid = k.pid AND p.ord = k.ord)""")
def ras11(b):
    s = b.select("pid", "ord", "x", "y", (F.col("w") / 3).alias("w"), (F.col("h") / 3).alias("h"), (F.col("w") * F.col("h") / 9 * F.col("conf")).alias("area"))
    return objects.letter_blobs(s, 600.0, 180.0).select("pid", "ord")


@query("src_13_provider_states", "fx_requests", sql="SELECT client, CASE WHEN event_id % 4 = 0 THEN 'skipped' WHEN event_id % 7 = 0 OR (event_id * 31) % 90000 > 60000 THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM fx_requests GROUP BY ALL")
def src13(q):
    rows = q.select("client", (F.col("event_id") % 4 != 0).alias("enabled"), ((F.col("event_id") * 31) % 90000).alias("duration_ms"), F.when(F.col("event_id") % 7 == 0, "HTTP 500").alias("error"))
    return providers.statuses(rows).groupBy("client", "status").agg(F.count(F.lit(1)).alias("n"))


@query("src_16_health", "fx_requests", sql="SELECT count(*) FILTER (event_id % 4 <> 0) AS enabled, count(*) FILTER (event_id % 4 <> 0 AND event_id % 7 <> 0) AS ok, TRUE AS local_engine FROM fx_requests")
def src16(q):
    return providers.health(q.select((F.col("event_id") % 4 != 0).alias("enabled"), F.lit(10).alias("duration_ms"), F.when(F.col("event_id") % 7 == 0, "HTTP 500").alias("error")))


@query("udf_01_sql_functions", "fx_palette", "fx_boxes", sql=f"SELECT u.pid, u.ord, {r(iou_sql('u.', 'v.'))} AS iou, (SELECT {r('avg(' + REDMEAN_SQL.format(a='p.', b='q.') + ')', 3)} FROM fx_palette p JOIN fx_palette q ON p.pid = q.pid AND q.ord = p.ord + 1 WHERE p.pid = u.pid) AS apart FROM fx_boxes u JOIN fx_boxes v ON u.pid = v.pid AND v.ord = u.ord + 1")
def udf01(p, b):
    spark = p.sparkSession
    register.register(spark, "pg_")
    apart = spark.sql("SELECT p.pid, avg(pg_color_distance(p.r, p.g, p.b, q.r, q.g, q.b)) AS d FROM {p} p JOIN {p} q ON p.pid = q.pid AND q.ord = p.ord + 1 GROUP BY p.pid", p=p)
    iou = spark.sql("SELECT b.pid, b.ord, pg_box_iou(b.x, b.y, b.w, b.h, c.x, c.y, c.w, c.h) AS iou FROM {b} b JOIN {b} c ON b.pid = c.pid AND c.ord = b.ord + 1", b=b)
    return iou.join(apart, "pid", "left").select("pid", "ord", round_to(F.col("iou"), 6).alias("iou"), round_to(F.col("d"), 3).alias("apart"))
