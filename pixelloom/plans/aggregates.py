"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as O
from ..operators.filters import filter_trim
from ..operators.joins import label_pixels
from .base import NX, NY, peaks, peaks_ref, pixels, register, rounded, samples, sql, table

_LABELS = """, pair AS (SELECT p.image_id, p.y, p.x, p.v, k.peak_id, row_number() OVER (PARTITION BY p.image_id, p.y, p.x ORDER BY (p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y), k.peak_id) AS n
    FROM pixels p JOIN peaks k ON p.image_id = k.image_id AND (p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y) < 9),
  label AS (SELECT image_id, y, x, v, peak_id FROM pair WHERE n = 1),
  cell AS (SELECT image_id, peak_id, sum(v) AS total FROM label GROUP BY image_id, peak_id)"""


@register("voronoi_integrate", sql(_LABELS + " SELECT k.image_id, k.peak_id, coalesce(c.total, 0) AS total FROM peaks k LEFT JOIN cell c ON k.image_id = c.image_id AND k.peak_id = c.peak_id", "pixels", "peaks"))
def voronoi_integrate(spark, d):
    return O.voronoi_integrate(pixels(spark, d), peaks(spark, d), 3.0)


@register("voronoi_paint", sql(_LABELS + " SELECT p.image_id, p.y, p.x, c.total FROM pixels p LEFT JOIN label l ON p.image_id = l.image_id AND p.x = l.x AND p.y = l.y LEFT JOIN cell c ON l.image_id = c.image_id AND l.peak_id = c.peak_id", "pixels", "peaks"))
def voronoi_paint(spark, d):
    p, k = pixels(spark, d), peaks(spark, d)
    return O.voronoi_paint(label_pixels(p, k, 3.0), O.voronoi_integrate(p, k, 3.0)).select("image_id", "y", "x", "total")


@register(
    "voronoi_edge_cells",
    sql(_LABELS + """, edge AS (SELECT DISTINCT image_id, peak_id FROM label WHERE x < 2 OR x >= 62 OR y < 2 OR y >= 46)
      SELECT k.image_id, k.peak_id, CASE WHEN e.peak_id IS NULL THEN coalesce(c.total, 0) END AS total FROM peaks k LEFT JOIN cell c ON k.image_id = c.image_id AND k.peak_id = c.peak_id LEFT JOIN edge e ON k.image_id = e.image_id AND k.peak_id = e.peak_id""", "pixels", "peaks"),
)
def voronoi_edge_cells(spark, d):
    p, k = pixels(spark, d), peaks(spark, d)
    return O.without_edge_cells(O.voronoi_integrate(p, k, 3.0), O.edge_cells(label_pixels(p, k, 3.0), NX, NY, 2))


@register("center_of_mass", sql("SELECT image_id, round(sum(y * v) / sum(v), 6) AS cy, round(sum(x * v) / sum(v), 6) AS cx FROM pixels GROUP BY image_id", "pixels"))
def center_of_mass(spark, d):
    return rounded(O.center_of_mass(pixels(spark, d), "image_id"))


@register("radial_average", sql(", c AS (SELECT image_id, floor(avg(x)) AS cx, floor(avg(y)) AS cy FROM pixels WHERE v > 20 GROUP BY image_id) SELECT p.image_id, CAST(floor(sqrt(power(x - cx, 2) + power(y - cy, 2))) AS BIGINT) AS r, round(avg(v), 6) AS mean FROM pixels p JOIN c ON p.image_id = c.image_id GROUP BY 1, 2", "pixels"))
def radial_average(spark, d):
    p = pixels(spark, d)
    return rounded(O.radial_average(p, O.moments_center(p.filter("v > 20"))))


@register("column_profile", sql(", c AS (SELECT image_id, x, sum(v) AS m FROM pixels GROUP BY image_id, x) SELECT image_id, x, m FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY m DESC, x) AS k FROM c) t WHERE k = 1", "pixels"))
def column_profile(spark, d):
    return O.column_extreme(pixels(spark, d), F.col("v"))


@register(
    "detector_normalize",
    sql(", l AS (SELECT image_id, avg(v) FILTER (WHERE power(x - 31.5, 2) + power(y - 23.5, 2) < 100) AS det, quantile_cont(v, 0.2) AS bg FROM pixels GROUP BY image_id) SELECT p.image_id, y, x, round(greatest(0, (v - bg) / (det - bg)), 6) AS v FROM pixels p JOIN l ON p.image_id = l.image_id", "pixels"),
)
def detector_normalize(spark, d):
    from ..operators.filters import in_circle

    p = pixels(spark, d)
    return rounded(O.detector_normalize(p, O.detector_levels(p, in_circle(NX, NY, 10))).select("image_id", "y", "x", "v"))


@register("moments_center", sql("SELECT image_id, CAST(floor(avg(x)) AS BIGINT) AS cx, CAST(floor(avg(y)) AS BIGINT) AS cy FROM pixels WHERE v > 40 GROUP BY image_id", "pixels"))
def moments_center(spark, d):
    return O.moments_center(pixels(spark, d).filter("v > 40"))


@register("type_mean", "SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_partkey % 3), 4) AS sigma FROM part")
def type_mean(spark, d):
    part = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("atom_type"), F.col("p_retailprice").alias("sigma"))
    return rounded(O.type_mean(part, ["sigma"]).select("p_partkey", "sigma"), 4)


@register("counts", sql("SELECT image_id, count(*) AS n_peaks, count(DISTINCT atom_type) AS n_types FROM peaks GROUP BY image_id", "peaks"))
def counts(spark, d):
    return O.counts(peaks(spark, d))


@register("fit_loss", sql("SELECT image_id, round(sqrt(avg(power(v - (x + y) / 2, 2))) + avg(abs(v - (x + y) / 2)), 6) AS loss FROM pixels GROUP BY image_id", "pixels"))
def fit_loss(spark, d):
    return rounded(O.fit_loss(pixels(spark, d).withColumn("model", (F.col("x") + F.col("y")) / 2)))


@register("convergence", sql(""", m AS (SELECT p.image_id, max(greatest(abs(p.x - r.x), abs(p.y - r.y))) AS move, avg(abs((p.x + p.y - r.x - r.y) / (p.x + p.y + 1e-10))) AS change FROM peaks p JOIN peaks_ref r ON p.image_id = r.image_id AND p.peak_id = r.peak_id GROUP BY p.image_id)
  SELECT image_id, round(move, 6) AS move, round(change, 6) AS change, move <= 1 AND change <= 0.01 AS converged FROM m""", "peaks", "peaks_ref"))  # fmt: skip
def convergence(spark, d):
    new, old = (p(spark, d).withColumn("height", F.col("x") + F.col("y")) for p in (peaks, peaks_ref))
    return rounded(O.convergence(new, old, 0.01))


@register(
    "scs_error_stats",
    """WITH e AS (SELECT (o_totalprice * 1.01 + o_custkey % 7 - o_totalprice) / o_totalprice AS v FROM orders),
      q AS (SELECT quantile_cont(v, 0.001) AS a, quantile_cont(v, 0.999) AS b FROM e)
      SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM e, q WHERE v > a AND v < b""",
)
def scs_error_stats(spark, d):
    price = F.col("o_totalprice")
    errors = table(spark, d, "orders").select(((price * 1.01 + F.col("o_custkey") % 7 - price) / price).alias("v"))
    return rounded(O.error_stats(filter_trim(errors)))


@register("histogram", sql(""", e AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY image_id)
  SELECT p.image_id, CAST(least(floor((v - lo) / ((hi - lo) / 32)), 31) AS INTEGER) AS bin, count(*) AS n FROM pixels p JOIN e ON p.image_id = e.image_id GROUP BY 1, 2""", "pixels"))  # fmt: skip
def histogram(spark, d):
    return O.histogram(pixels(spark, d), 32, "image_id")


@register("histogram_2d", """WITH e AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)
  SELECT CAST(least(floor((p_size - a) / ((b - a) / 16.0)), 15) AS INTEGER) AS bin_size, CAST(least(floor((p_retailprice - c) / ((d - c) / 16)), 15) AS INTEGER) AS bin_price, count(*) AS n FROM part, e GROUP BY 1, 2""")
def histogram_2d(spark, d):
    part = table(spark, d, "part").select(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return O.histogram2d(part, 16, "size", "price")


@register("percentile_stats", sql("SELECT user_id, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.95), 6) AS p95 FROM samples GROUP BY user_id", "samples"))
def percentile_stats(spark, d):
    return rounded(O.percentiles(samples(spark, d), [5, 95], "user_id"))


@register("loglikelihood", sql("SELECT round(sum(ln(0.6 * exp(-v / 20) / 20 + 0.4 * exp(-v / 80) / 80)), 3) AS llh FROM samples", "samples"))
def loglikelihood(spark, d):
    v = F.col("v")
    parts = F.explode(F.array(0.6 * F.exp(-v / 20) / 20, 0.4 * F.exp(-v / 80) / 80))
    return rounded(O.log_likelihood(samples(spark, d).select("id", parts.alias("p"))), 3)

