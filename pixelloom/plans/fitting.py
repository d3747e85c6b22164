"""Queries of the fits and of what is computed by callbacks elsewhere.

All run with their operators' own rounds and stop rules. Iterative results have no SQL; tests hold them
against known truth, and single rounds are compared with SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fitting as O
from ..operators import refinement as R
from .base import peaks, pixels, register, rounded, sql, table


@register(
    "init_params",
    sql(
        """, b AS (SELECT image_id, min(v) AS base FROM pixels GROUP BY image_id)
        SELECT k.image_id, k.peak_id, coalesce(p.v, b.base) - b.base AS height, 2.0::DOUBLE AS sigma, round(2.0 / sqrt(2 * ln(2)), 6) AS gamma, 0.9::DOUBLE AS ratio, b.base AS background
        FROM peaks k JOIN b ON k.image_id = b.image_id LEFT JOIN pixels p ON k.image_id = p.image_id AND p.x = CAST(trunc(k.x) AS INTEGER) AND p.y = CAST(trunc(k.y) AS INTEGER)""",
        "pixels", "peaks",
    ),
)
def init_params(spark, d):
    return rounded(O.init_params(pixels(spark, d), peaks(spark, d), 2.0).select("image_id", "peak_id", "height", "sigma", "gamma", "ratio", "background"))


def _params(spark, d):
    return peaks(spark, d).select("image_id", "peak_id", "x", "y", "atom_type", (F.col("x") + 5).alias("height"), F.lit(1.5).alias("sigma"), F.lit(1.3).alias("gamma"), F.lit(0.9).alias("ratio"), F.lit(2.0).alias("background"))


@register(
    "guess_radius",
    sql(
        """, d AS (SELECT p.image_id, p.y, p.x, min(greatest(abs(p.x - round(k.x)), abs(p.y - round(k.y)))) AS d FROM pixels p JOIN peaks k ON p.image_id = k.image_id GROUP BY 1, 2, 3),
        a AS (SELECT n, count(*) AS area FROM (SELECT unnest(range(1, 130)) AS n) t JOIN d ON d.d <= n GROUP BY n),
        g AS (SELECT n, area, lag(area, 1, 0) OVER (ORDER BY n) AS before FROM a), w AS (SELECT *, area - before AS gain, max(area - before) OVER (ORDER BY n) AS best FROM g)
        SELECT round(sqrt((SELECT before FROM w WHERE gain < best / 2.0 ORDER BY n LIMIT 1) * 1.0 / (SELECT count(*) FROM peaks)) / pi(), 6) AS radius""",
        "pixels", "peaks",
    ),
)
def guess_radius(spark, d):
    return rounded(spark.createDataFrame([(O.guess_radius(pixels(spark, d), peaks(spark, d)),)], "radius double"))


_G = """, g AS (SELECT p.image_id, p.y, p.x, p.v, k.peak_id AS i, k.x AS kx, k.y AS ky, k.x + 5 AS h, exp(-(power(p.x - k.x, 2) + power(p.y - k.y, 2)) / 4.5) AS g
    FROM pixels p JOIN peaks k ON p.image_id = k.image_id AND greatest(abs(p.x - k.x), abs(p.y - k.y)) < 4)"""


@register("linear_estimator", sql(_G + " SELECT a.image_id, a.i, b.i AS j, round(sum(a.g * b.g), 6) AS a FROM g a JOIN g b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y GROUP BY 1, 2, 3", "pixels", "peaks"))
def linear_estimator(spark, d):
    return rounded(O.normal_equations(pixels(spark, d), _params(spark, d), 4.0)[0])


@register("linear_heights")
def linear_heights(spark, d):
    return rounded(O.linear_heights(pixels(spark, d), _params(spark, d), 4.0), 3)


@register(
    "linear_heights_round",
    sql(_G + """, a AS (SELECT a.image_id, a.i, b.i AS j, sum(a.g * b.g) AS a FROM g a JOIN g b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y GROUP BY 1, 2, 3),
      w AS (SELECT image_id, i, sum(abs(a)) AS w FROM a GROUP BY 1, 2), b AS (SELECT image_id, i, sum(g * v) AS b FROM g GROUP BY 1, 2)
      SELECT b.image_id, b.i AS peak_id, round(greatest(0, b / w), 6) + 0.0 AS height FROM b JOIN w ON b.image_id = w.image_id AND b.i = w.i""", "pixels", "peaks"),
)
def linear_heights_round(spark, d):
    """The first of the rounds."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", O.NotConverged)
        return rounded(O.linear_heights(pixels(spark, d), _params(spark, d), 4.0, rounds=1))


@register(
    "optimizers",
    sql(
        _G + """, r AS (SELECT image_id, y, x, sum(h * g) + 2 - max(v) AS r FROM g GROUP BY 1, 2, 3)
        SELECT g.image_id, g.i AS peak_id, round(sum(r * h * g * (g.x - kx) / 2.25), 4) + 0.0 AS gx, round(sum(r * h * g * (g.y - ky) / 2.25), 4) + 0.0 AS gy, round(sum(r * g), 4) + 0.0 AS gh
        FROM g JOIN r ON g.image_id = r.image_id AND g.x = r.x AND g.y = r.y GROUP BY 1, 2""",
        "pixels", "peaks",
    ),
)
def optimizers(spark, d):
    return rounded(O.gradient(pixels(spark, d), _params(spark, d), 4.0).select("image_id", "peak_id", "gx", "gy", "gh"), 4)


_FIRST = (
    _G + """, r AS (SELECT image_id, y, x, sum(h * g) + 2 - max(v) AS r FROM g GROUP BY 1, 2, 3),
    d AS (SELECT g.image_id, g.i, sum(r * h * g * (g.x - kx) / 2.25) AS gx, sum(r * h * g * (g.y - ky) / 2.25) AS gy, sum(r * g) AS gh, sum(r * h * g * (power(g.x - kx, 2) + power(g.y - ky, 2)) / 3.375) AS gs
      FROM g JOIN r ON g.image_id = r.image_id AND g.x = r.x AND g.y = r.y GROUP BY 1, 2)"""
)
_MOVE = "round({c} - {rate} * coalesce(d.{g} / (abs(d.{g}) + 1e-8), 0), 4)"


@register(
    "fit_global_round",
    sql(
        _FIRST + " SELECT k.image_id, k.peak_id, " + ", ".join(f"{_MOVE.format(c=c, rate=rate, g=g)} AS {n}" for n, c, rate, g in (("x", "k.x", 0.05, "gx"), ("y", "k.y", 0.05, "gy"), ("height", "k.x + 5", 0.05, "gh"), ("sigma", "1.5", 0.02, "gs")))
        + " FROM peaks k LEFT JOIN d ON k.image_id = d.image_id AND k.peak_id = d.i",
        "pixels", "peaks",
    ),
)
def fit_global_round(spark, d):
    """The first round of Adam: each parameter moves by its step size against its derivative."""
    return rounded(O.adam_round(pixels(spark, d), O.adam_start(_params(spark, d)), 4.0, 1).select("image_id", "peak_id", "x", "y", "height", "sigma"), 4)


@register("fit_global")
def fit_global(spark, d):
    return rounded(R.fit_all(pixels(spark, d), _params(spark, d), 4.0).select("image_id", "peak_id", "x", "y", "height", "sigma"), 2)


@register("fit_random_batch")
def fit_random_batch(spark, d):
    return rounded(R.fit_blocks(pixels(spark, d), _params(spark, d), 4.0).select("image_id", "peak_id", "x", "y", "height", "sigma", "converged"), 2)


@register("fit_region_patch")
def fit_region_patch(spark, d):
    return rounded(O.fit_patches(pixels(spark, d), _params(spark, d), 8, 2), 3)


@register("fit_voronoi")
def fit_voronoi(spark, d):
    return rounded(O.fit_cells(pixels(spark, d), _params(spark, d), 3.0), 3)


@register("benchmark_refine")
def benchmark_refine(spark, d):
    """Start values, fit, cross-sections and Voronoi sums in one; a test recovers known peaks."""
    return rounded(O.refine_benchmark(pixels(spark, d), peaks(spark, d), 1.5), 2)


@register(
    "refine_com",
    sql(
        """, pair AS (SELECT p.image_id, p.y, p.x, p.v, k.peak_id, row_number() OVER (PARTITION BY p.image_id, p.y, p.x ORDER BY power(p.x - k.x, 2) + power(p.y - k.y, 2), k.peak_id) AS n
          FROM pixels p JOIN peaks k ON p.image_id = k.image_id AND power(p.x - k.x, 2) + power(p.y - k.y, 2) < 9),
        e AS (SELECT image_id, peak_id, min(v) AS lo, max(v) AS hi FROM pair WHERE n = 1 GROUP BY 1, 2),
        c AS (SELECT pair.image_id, pair.peak_id, sum(x * (v - lo) / (hi - lo)) / sum((v - lo) / (hi - lo)) AS cx, sum(y * (v - lo) / (hi - lo)) / sum((v - lo) / (hi - lo)) AS cy
          FROM pair JOIN e ON pair.image_id = e.image_id AND pair.peak_id = e.peak_id WHERE n = 1 AND hi > lo GROUP BY 1, 2)
        SELECT k.image_id, k.peak_id, round(coalesce(cx, k.x), 8) AS x, round(coalesce(cy, k.y), 8) AS y FROM peaks k LEFT JOIN c ON k.image_id = c.image_id AND k.peak_id = c.peak_id""",
        "pixels", "peaks",
    ),
)
def refine_com(spark, d):
    return rounded(O.refine_com_step(pixels(spark, d), peaks(spark, d), 3.0).select("image_id", "peak_id", "x", "y"), 8)


@register("fit_gaussian")
def fit_gaussian(spark, d):
    return rounded(R.fit_rotated(pixels(spark, d), {"x0": 32.0, "y0": 24.0, "sx": 10.0, "sy": 8.0, "theta": 0.1}), 2)


@register("calibrate", "SELECT p_partkey, round((3.9 / sqrt(power(p_size + 1, 2) + 4) + 5.5 / sqrt(9 + power(p_size + 2, 2))) / 2, 6) AS dx FROM part")
def calibrate(spark, d):
    s = F.col("p_size").cast("double")
    v = table(spark, d, "part").select("p_partkey", (s + 1).alias("ax"), F.lit(2.0).alias("ay"), F.lit(3.0).alias("bx"), (s + 2).alias("by"))
    return rounded(O.calibrate(v, 3.9, 5.5).select("p_partkey", "dx"))


_INFO = (
    _G + """, f AS (SELECT image_id, y, x, sum(h * g) + 2 AS f FROM g GROUP BY 1, 2, 3),
    d AS (SELECT g.image_id, i, h * g * (g.x - kx) / 2.25 AS d0, h * g * (g.y - ky) / 2.25 AS d1, g AS d2, f FROM g JOIN f ON g.image_id = f.image_id AND g.x = f.x AND g.y = f.y)"""
)


@register("udf_model", sql(_INFO + " SELECT image_id, i AS peak_id, p, q, round(sum(CASE p WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END * CASE q WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END / f), 4) + 0.0 AS info FROM d, (VALUES (0), (1), (2)) a(p), (VALUES (0), (1), (2)) b(q) GROUP BY 1, 2, 3, 4", "pixels", "peaks"))
def udf_model(spark, d):
    return rounded(O.fisher_information(pixels(spark, d), _params(spark, d), 4.0), 4)


@register("joint_probability", sql("SELECT image_id, round(sum(v * ln(1 + x + y) - (1 + x + y)), 4) AS llh FROM pixels GROUP BY image_id", "pixels"))
def joint_probability(spark, d):
    return rounded(O.poisson_llh(pixels(spark, d).withColumn("model", (1 + F.col("x") + F.col("y")).cast("double"))), 4)


@register(
    "crb",
    sql(
        _INFO + """, m AS (SELECT image_id, i, sum(d0 * d0 / f) AS a, sum(d0 * d1 / f) AS b, sum(d0 * d2 / f) AS c, sum(d1 * d1 / f) AS d, sum(d1 * d2 / f) AS e, sum(d2 * d2 / f) AS g FROM d GROUP BY 1, 2),
        n AS (SELECT *, a * (d * g - e * e) - b * (b * g - c * e) + c * (b * e - c * d) AS det FROM m)
        SELECT image_id, i AS peak_id, det > 1e-9 * a * d * g AS determined, CASE WHEN det > 1e-9 * a * d * g THEN round(sqrt((d * g - e * e) / det), 4) END AS sx,
          CASE WHEN det > 1e-9 * a * d * g THEN round(sqrt((a * g - c * c) / det), 4) END AS sy, CASE WHEN det > 1e-9 * a * d * g THEN round(sqrt((a * d - b * b) / det), 4) END AS sh FROM n""",
        "pixels", "peaks",
    ),
)
def crb(spark, d):
    """Errors of the peaks that the image determines."""
    bounds = O.cramer_rao(O.fisher_information(pixels(spark, d), _params(spark, d), 4.0))
    return rounded(bounds.withColumns({c: F.when(F.col("determined"), F.col(c)) for c in ("sx", "sy", "sh")}), 4)


@register("udf_cc", "SELECT p_partkey, round((cos(p_size * -8.0) + cos(p_size * -2.0) + cos(p_size * 2.0) + cos(p_size * 8.0)) / 4, 6) + 0.0 AS mean FROM part")
def udf_cc(spark, d):
    points = spark.createDataFrame([(-8.0,), (-2.0,), (2.0,), (8.0,)], "df double")
    return rounded(O.average_over(table(spark, d, "part").select("p_partkey", "p_size"), points, F.cos(F.col("p_size") * F.col("df")), "p_partkey"))


@register("poisson_noise")
def poisson_noise(spark, d):
    return O.poisson_noise(pixels(spark, d))

