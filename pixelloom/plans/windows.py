"""Queries of the neighbourhood windows, scans, top-k and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as O
from .base import NX, NY, peaks, pixels, register, rounded, samples, sql, table


@register(
    "local_maxima",
    sql("""SELECT p.image_id, p.y, p.x, p.v FROM pixels p JOIN (SELECT image_id, max(v) AS top FROM pixels GROUP BY image_id) m ON p.image_id = m.image_id
      WHERE p.x BETWEEN 3 AND 60 AND p.y BETWEEN 3 AND 44 AND p.v > 0.2 * m.top
        AND NOT EXISTS (SELECT 1 FROM pixels q WHERE q.image_id = p.image_id AND abs(q.x - p.x) <= 3 AND abs(q.y - p.y) <= 3 AND q.v > p.v)""", "pixels"),
)
def local_maxima(spark, d):
    return O.local_maxima(pixels(spark, d), 3, 0.2, 3, NX, NY)


@register(
    "refine_local_max",
    sql(""", near AS (SELECT k.image_id, k.peak_id, p.x, p.y, p.v, row_number() OVER (PARTITION BY k.image_id, k.peak_id ORDER BY p.v DESC, p.y, p.x) AS n
        FROM peaks k JOIN pixels p ON k.image_id = p.image_id AND abs(p.x - round(k.x)) <= 2 AND abs(p.y - round(k.y)) <= 2)
      SELECT DISTINCT image_id, x, y, v FROM near WHERE n = 1""", "pixels", "peaks"),
)
def refine_local_max(spark, d):
    return O.refine_local_max(pixels(spark, d), peaks(spark, d), 2)


@register(
    "anchored_clusters",
    """WITH RECURSIVE s AS (SELECT user_id, value AS d, CAST(event_id AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events),
      walk AS (SELECT user_id, n, d, v, d AS anchor, CAST(0 AS BIGINT) AS cluster FROM s WHERE n = 1
        UNION ALL SELECT s.user_id, s.n, s.d, s.v, CASE WHEN s.d - w.anchor > 5 THEN s.d ELSE w.anchor END, CASE WHEN s.d - w.anchor > 5 THEN w.cluster + 1 ELSE w.cluster END
        FROM walk w JOIN s ON s.user_id = w.user_id AND s.n = w.n + 1)
      SELECT user_id, cluster, round(avg(d), 9) AS d, round(avg(v), 9) AS v, round(stddev_pop(v), 4) AS std, round(CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(v) / sqrt(count(*)) ELSE 0 END, 4) AS half_width, count(*) AS n
      FROM walk GROUP BY user_id, cluster""",
)
def anchored_clusters(spark, d):
    series = table(spark, d, "events").select("user_id", F.col("value").alias("d"), F.col("event_id").cast("double").alias("v"))
    out = O.cluster_stats(O.anchored_clusters(series, 5.0))
    places = {"d": 9, "v": 9, "std": 4, "half_width": 4}  # averages of two decimals would tie at four
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


@register(
    "greedy_dedup",
    "WITH RECURSIVE" + sql(
        """, o AS (SELECT image_id, peak_id, x, y, row_number() OVER (PARTITION BY image_id ORDER BY peak_id) AS n FROM peaks),
        walk AS (SELECT image_id, n, [{'id': peak_id, 'x': x, 'y': y}] AS kept FROM o WHERE n = 1
          UNION ALL SELECT o.image_id, o.n, CASE WHEN len(list_filter(w.kept, lambda k: abs(k.x - o.x) < 4 AND abs(k.y - o.y) < 4)) = 0 THEN list_append(w.kept, {'id': o.peak_id, 'x': o.x, 'y': o.y}) ELSE w.kept END
          FROM walk w JOIN o ON o.image_id = w.image_id AND o.n = w.n + 1),
        last AS (SELECT image_id, arg_max(kept, n) AS kept FROM walk GROUP BY image_id)
      SELECT image_id, k.id AS peak_id FROM (SELECT image_id, unnest(kept) AS k FROM last) t""", "peaks").removeprefix("WITH"),
)
def greedy_dedup(spark, d):
    return O.greedy_dedup(peaks(spark, d), 4.0).select("image_id", "peak_id")


@register("random_batches")
def random_batches(spark, d):
    return O.random_batches(samples(spark, d), 16).select("id", "batch")


@register("duplicate_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY l_orderkey * 10 + l_linenumber) AS k, min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_suppkey, l_quantity) AS f FROM lineitem) t WHERE l_orderkey * 10 + l_linenumber > f")
def duplicate_rows(spark, d):
    rows = table(spark, d, "lineitem").withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return O.duplicate_rows(rows, ["l_suppkey", "l_quantity"], "idx").select("l_orderkey", "l_linenumber", "l_partkey")


@register(
    "hot_pixels",
    sql(""", b AS (SELECT p.image_id, p.y, p.x, p.v, (SELECT avg(q.v) FROM pixels q WHERE q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1) AS blur FROM pixels p),
      l AS (SELECT image_id, avg(abs(v - blur)) + 2 * stddev_pop(abs(v - blur)) AS lim FROM b GROUP BY image_id)
      SELECT b.image_id, y, x, abs(v - blur) > lim AS hot, round(CASE WHEN abs(v - blur) > lim THEN blur ELSE v END, 6) AS v FROM b JOIN l ON b.image_id = l.image_id""", "pixels"),
)
def hot_pixels(spark, d):
    return rounded(O.hot_pixels(O.mean_filter(pixels(spark, d)), 2.0).select("image_id", "y", "x", "hot", "v"))


@register(
    "line_defect",
    sql(""", z AS (SELECT image_id, y, x, CASE WHEN v < 12 THEN 0.0 ELSE v END AS v FROM pixels),
      c AS (SELECT image_id, x, sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS m FROM z GROUP BY image_id, x),
      b AS (SELECT image_id, x AS b FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY m DESC, x) AS k FROM c) t WHERE k = 1)
      SELECT z.image_id, z.y, z.x, CASE WHEN abs(z.x - b) <= 1 AND l.v IS NOT NULL AND r.v IS NOT NULL THEN (l.v + r.v) / 2 ELSE z.v END AS v
      FROM z JOIN b ON z.image_id = b.image_id LEFT JOIN z l ON z.image_id = l.image_id AND z.y = l.y AND l.x = b - 2 LEFT JOIN z r ON z.image_id = r.image_id AND z.y = r.y AND r.x = b + 2""", "pixels"),
)
def line_defect(spark, d):
    p = pixels(spark, d).withColumn("v", F.when(F.col("v") < 12, F.lit(0.0)).otherwise(F.col("v")))
    return O.line_defect(p).select("image_id", "y", "x", "v")


@register("adaptive_origins")
def adaptive_origins(spark, d):
    return rounded(O.adaptive_origins(peaks(spark, d), (30.0, 24.0), (6.0, 1.0), (-1.0, 6.0), 8))
