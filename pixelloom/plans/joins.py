"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as O
from .base import NX, NY, peaks, peaks_ref, pixels, register, rounded, sql, table

_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


def _nearest_sql(left: str, right: str, ids: str, where: str = "true") -> str:
    """Ranked pairs of two tables of one image: the first of each left row."""
    return f"""SELECT * FROM (SELECT a.image_id, {ids}, b.peak_id AS peak_id_r, b.x AS bx, b.y AS byy, b.atom_type AS bt, {_D2} AS d2,
      row_number() OVER (PARTITION BY a.image_id, {ids} ORDER BY {_D2}, b.peak_id) AS k
      FROM {left} a JOIN {right} b ON a.image_id = b.image_id WHERE {where}) t WHERE k = 1"""


@register("join_nearest_bruteforce", sql(f"SELECT image_id, y, x, peak_id_r, round(d2, 6) AS d2 FROM ({_nearest_sql('pixels', 'peaks', 'a.y, a.x')}) n", "pixels", "peaks"))
def join_nearest_bruteforce(spark, d):
    return rounded(O.nearest_any(pixels(spark, d), peaks(spark, d), ("y", "x"), reach=3.0))


@register(
    "join_nearest_bounded",
    sql(f"SELECT p.image_id, p.y, p.x, n.peak_id_r AS peak_id FROM pixels p LEFT JOIN ({_nearest_sql('pixels', 'peaks', 'a.y, a.x', _D2 + ' < 6.25')}) n ON p.image_id = n.image_id AND p.x = n.x AND p.y = n.y", "pixels", "peaks"),
)
def join_nearest_bounded(spark, d):
    return O.label_pixels(pixels(spark, d), peaks(spark, d), 2.5).select("image_id", "y", "x", "peak_id")


@register("join_nearest_match", sql(f"SELECT image_id, peak_id, peak_id_r, bx AS x_r, bt AS atom_type_r FROM ({_nearest_sql('peaks', 'peaks_ref', 'a.peak_id')}) n", "peaks", "peaks_ref"))
def join_nearest_match(spark, d):
    return O.nearest_match(peaks(spark, d), peaks_ref(spark, d), ["x", "atom_type"], reach=1.0).select("image_id", "peak_id", "peak_id_r", "x_r", "atom_type_r")


@register(
    "join_nearest_threshold",
    sql(f"SELECT a.image_id, a.peak_id, CASE WHEN d2 < 0.09 THEN peak_id_r END AS peak_id_r, CASE WHEN d2 < 0.09 THEN round(d2, 6) END AS d2 FROM ({_nearest_sql('peaks', 'peaks_ref', 'a.peak_id')}) a", "peaks", "peaks_ref"),
)
def join_nearest_threshold(spark, d):
    return rounded(O.nearest_below(peaks(spark, d), peaks_ref(spark, d), 0.3))


@register(
    "nn_distance",
    sql(f"SELECT p.image_id, p.peak_id, round(n.m, 6) AS distance FROM peaks p LEFT JOIN (SELECT a.image_id, a.peak_id, sqrt(min({_D2})) AS m FROM peaks a JOIN peaks b ON a.image_id = b.image_id AND a.peak_id <> b.peak_id AND {_D2} < 16 GROUP BY 1, 2) n ON p.image_id = n.image_id AND p.peak_id = n.peak_id", "peaks"),
)
def nn_distance(spark, d):
    return rounded(O.nn_distance(peaks(spark, d), 4.0))


def _moved(spark, d):
    both = peaks(spark, d).alias("p").join(peaks_ref(spark, d).alias("r"), ["image_id", "peak_id"])
    return both.select("image_id", "peak_id", "p.x", "p.y", (F.col("p.x") - F.col("r.x")).alias("ux"), (F.col("p.y") - F.col("r.y")).alias("uy"))


@register(
    "neighbor_mean",
    sql(f""", moved AS (SELECT p.image_id, p.peak_id, p.x, p.y, p.x - r.x AS ux, p.y - r.y AS uy FROM peaks p JOIN peaks_ref r ON p.image_id = r.image_id AND p.peak_id = r.peak_id),
      m AS (SELECT a.image_id, a.peak_id, avg(b.ux) AS mx, avg(b.uy) AS my FROM moved a JOIN moved b ON a.image_id = b.image_id AND a.peak_id <> b.peak_id AND {_D2} < 20.25 GROUP BY 1, 2)
      SELECT moved.image_id, moved.peak_id, round(ux - coalesce(mx, 0), 6) AS ux, round(uy - coalesce(my, 0), 6) AS uy FROM moved LEFT JOIN m ON moved.image_id = m.image_id AND moved.peak_id = m.peak_id""", "peaks", "peaks_ref"),
)
def neighbor_mean(spark, d):
    return rounded(O.neighbor_mean(_moved(spark, d), 4.5))


@register(
    "polarization",
    sql(f""", m AS (SELECT a.image_id, a.peak_id, avg(b.x) AS mx, avg(b.y) AS my FROM peaks a JOIN peaks b ON a.image_id = b.image_id AND a.atom_type = 1 AND b.atom_type = 0 AND {_D2} < 49 GROUP BY 1, 2 HAVING count(*) >= 4)
      SELECT p.image_id, p.peak_id, round(p.x - mx, 6) AS px, round(p.y - my, 6) AS py, round(sqrt((p.x - mx) * (p.x - mx) + (p.y - my) * (p.y - my)), 6) AS magnitude
      FROM peaks p LEFT JOIN m ON p.image_id = m.image_id AND p.peak_id = m.peak_id WHERE p.atom_type = 1""", "peaks"),
)
def polarization(spark, d):
    return rounded(O.polarization(peaks(spark, d), 0, 1, 7.0, 4))


@register(
    "knn_tilt",
    sql(f""", pair AS (SELECT a.image_id, a.peak_id, b.atom_type AS t, b.x - a.x AS dx, b.y - a.y AS dy,
        row_number() OVER (PARTITION BY a.image_id, a.peak_id, b.atom_type ORDER BY {_D2}, b.peak_id) AS k
        FROM peaks a JOIN peaks b ON a.image_id = b.image_id AND a.atom_type = 2 AND b.atom_type IN (0, 2) AND a.peak_id <> b.peak_id AND {_D2} < 64),
      v AS (SELECT p.image_id, p.peak_id, q.dx - p.dx AS ax, q.dy - p.dy AS ay, o.dx AS ox, o.dy AS oy
        FROM pair p JOIN pair q ON p.image_id = q.image_id AND p.peak_id = q.peak_id AND p.t = 0 AND q.t = 0 AND p.k = 1 AND q.k = 2
        JOIN pair o ON p.image_id = o.image_id AND p.peak_id = o.peak_id AND o.t = 2 AND o.k = 1)
      SELECT p.image_id, p.peak_id, round(degrees(acos(least(1.0, abs(ax * ox + ay * oy) / (sqrt(ax * ax + ay * ay) * sqrt(ox * ox + oy * oy))))), 4) AS tilt
      FROM peaks p LEFT JOIN v ON p.image_id = v.image_id AND p.peak_id = v.peak_id WHERE p.atom_type = 2""", "peaks"),
)
def knn_tilt(spark, d):
    return rounded(O.knn_tilt(peaks(spark, d), 0, 2, 8.0), 4)


@register(
    "join_directional_nn",
    sql(f""", pair AS (SELECT a.image_id, a.peak_id, b.peak_id AS peak_id_r, ((b.x - a.x) * 6 + (b.y - a.y) * 1) / sqrt(37.0) AS pa, ((b.x - a.x) * -1 + (b.y - a.y) * 6) / sqrt(37.0) AS pb, sqrt({_D2}) AS distance
        FROM peaks a JOIN peaks b ON a.image_id = b.image_id),
      best AS (SELECT *, row_number() OVER (PARTITION BY image_id, peak_id ORDER BY pa, peak_id_r) AS k FROM pair WHERE pa > 1 AND abs(pb) < sqrt(37.0) / 2 AND abs(pa) < 1.5 * sqrt(37.0))
      SELECT image_id, peak_id, peak_id_r, round(pa, 6) AS along, round(distance, 6) AS distance FROM best WHERE k = 1""", "peaks"),
)
def join_directional_nn(spark, d):
    return rounded(O.directional_nn(peaks(spark, d), (6.0, 1.0), (-1.0, 6.0), 1.0))


@register(
    "join_angular_range",
    sql(f"SELECT a.image_id, a.peak_id, b.peak_id AS peak_id_r, round(sqrt({_D2}), 6) AS distance FROM peaks a JOIN peaks b ON a.image_id = b.image_id WHERE {_D2} > 4 AND {_D2} < 60.84 AND abs((b.x - a.x) * 6 + (b.y - a.y)) / (sqrt({_D2}) * sqrt(37.0) + 1e-12) > 0.95", "peaks"),
)
def join_angular_range(spark, d):
    return rounded(O.angular_range(peaks(spark, d), (6.0, 1.0), 2.0, 7.8))


def _rows(spark, d):
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k1"), F.col("l_linenumber").cast("long").alias("k2"))
    right = table(spark, d, "part").select((F.col("p_partkey") % 90).alias("k1"), (F.col("p_size") % 7).cast("long").alias("k2"), F.col("p_partkey").alias("idx"))
    return left, right


_ROWS = "SELECT l_orderkey, l_linenumber, {} AS found FROM lineitem l {} JOIN (SELECT p_partkey % 90 AS k1, p_size % 7 AS k2, {}(p_partkey) AS idx FROM part GROUP BY 1, 2) r ON l.l_suppkey = r.k1 AND l.l_linenumber = r.k2"


@register("lookup_rows", _ROWS.format("coalesce(idx, -1)", "LEFT", "max"))
def lookup_rows(spark, d):
    left, right = _rows(spark, d)
    return O.lookup_rows(left, right, ["k1", "k2"]).select("l_orderkey", "l_linenumber", F.col("found").cast("long").alias("found"))


@register("lookup_elements", _ROWS.format("idx", "INNER", "min"))
def lookup_elements(spark, d):
    left, right = _rows(spark, d)
    return O.lookup_elements(left, right, ["k1", "k2"]).select("l_orderkey", "l_linenumber", "found")


@register("join_periodic_images", sql("SELECT image_id, peak_id, round(x + 64 * i, 6) AS x, round(y + 48 * j, 6) AS y FROM peaks, (VALUES (-1), (0), (1)) s(i), (VALUES (-1), (0), (1)) t(j)", "peaks"))
def join_periodic_images(spark, d):
    return rounded(O.periodic_images(peaks(spark, d), NX, NY).select("image_id", "peak_id", "x", "y"))


@register(
    "lookup_region",
    sql("SELECT p.image_id, p.peak_id, CASE WHEN q.image_id IS NULL THEN NULL ELSE CAST(floor(trunc(p.x) / 16) + 4 * floor(trunc(p.y) / 16) AS BIGINT) END AS region_id FROM peaks p LEFT JOIN pixels q ON p.image_id = q.image_id AND q.x = CAST(trunc(p.x) AS INTEGER) AND q.y = CAST(trunc(p.y) AS INTEGER)", "pixels", "peaks"),
)
def lookup_region(spark, d):
    regions = pixels(spark, d).withColumn("region_id", F.floor(F.col("x") / 16) + 4 * F.floor(F.col("y") / 16))
    return O.lookup_region(peaks(spark, d), regions).select("image_id", "peak_id", "region_id")


@register(
    "min_distances",
    sql(f""", image AS (SELECT image_id, x + 64 * i AS x, y + 48 * j AS y FROM peaks, (VALUES (-1), (0), (1)) s(i), (VALUES (-1), (0), (1)) t(j))
      SELECT b.image_id, b.atom_type, round(sqrt(min({_D2})) / 2, 6) AS radius FROM image a JOIN peaks b ON a.image_id = b.image_id WHERE {_D2} > 0 AND {_D2} < 100 GROUP BY b.image_id, b.atom_type""", "peaks"),
)
def min_distances(spark, d):
    return rounded(O.min_distances(peaks(spark, d), NX, NY, 10.0))


@register("lookup_type_params", sql("SELECT image_id, peak_id, CAST(CASE atom_type WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 ELSE 2.5 END AS DOUBLE) AS sigma FROM peaks", "peaks"))
def lookup_type_params(spark, d):
    types = spark.createDataFrame([(0, 1.5), (1, 2.0), (2, 2.5)], "atom_type int, sigma double")
    return O.with_type_params(peaks(spark, d), types).select("image_id", "peak_id", "sigma")


@register(
    "click_nearest",
    sql(f""", click AS (SELECT CAST(1 + s_suppkey % 7 AS INTEGER) AS image_id, 1000000 + s_suppkey AS peak_id, CAST((s_suppkey * 11) % 64 AS DOUBLE) AS x, CAST((s_suppkey * 5) % 48 AS DOUBLE) AS y, 9 AS atom_type FROM supplier),
      hit AS ({_nearest_sql('click', 'peaks', 'a.peak_id', _D2 + ' < 0.25')})
      SELECT image_id, peak_id, atom_type FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.image_id = p.image_id AND hit.peak_id_r = p.peak_id)
      UNION ALL SELECT image_id, peak_id, atom_type FROM click c WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.image_id = c.image_id AND hit.peak_id = c.peak_id)""", "peaks"),
)
def click_nearest(spark, d):
    key = F.col("s_suppkey")
    clicks = table(spark, d, "supplier").select(
        (key % 7 + 1).cast("int").alias("image_id"), (key + 1_000_000).alias("click_id"), ((key * 11) % NX).cast("double").alias("x"), ((key * 5) % NY).cast("double").alias("y"), F.lit(9).alias("atom_type")
    )
    return O.apply_clicks(peaks(spark, d), clicks, 0.5).select("image_id", "peak_id", "atom_type")
