"""Queries of the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as O
from .base import NX, NY, peaks, pixels, register, rounded, samples, sql, table

HEXAGON = [(10.0, 5.0), (50.0, 2.0), (62.0, 24.5), (40.0, 46.0), (12.0, 40.0), (2.0, 20.0)]


def _polygon_sql(points: list[tuple[float, float]], columns: str, invert: str = "") -> str:
    edges = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(points, points[1:] + points[:1], strict=True))
    return sql(
        f""", edge(x1, y1, x2, y2) AS (VALUES {edges}), hit AS (
        SELECT image_id, peak_id FROM peaks, edge
        WHERE y > least(y1, y2) AND y <= greatest(y1, y2) AND x <= greatest(x1, x2)
          AND (x1 = x2 OR x <= (y - y1) * (x2 - x1) / (y2 - y1) + x1)
        GROUP BY image_id, peak_id HAVING count(*) % 2 = 1)
        SELECT {columns} FROM peaks WHERE {invert} EXISTS (SELECT 1 FROM hit WHERE hit.image_id = peaks.image_id AND hit.peak_id = peaks.peak_id)""",
        "peaks",
    )


@register("filter_polygon", _polygon_sql(HEXAGON, "image_id, peak_id, round(x, 6) AS x, round(y, 6) AS y"))
def filter_polygon(spark, d):
    return rounded(O.filter_polygon(peaks(spark, d), O.polygon(HEXAGON)).select("image_id", "peak_id", "x", "y"))


@register("filter_selected", _polygon_sql([(5.5, 5.5), (35.5, 11.5), (25.5, 33.5), (-4.5, 27.5)], "image_id, peak_id, atom_type", "NOT"))
def filter_selected(spark, d):
    region = O.parallelogram((5.5, 5.5), (30.0, 6.0), (-10.0, 22.0))
    return O.filter_polygon(peaks(spark, d), region, invert=True).select("image_id", "peak_id", "atom_type")


@register("filter_bounds", sql("SELECT image_id, peak_id, atom_type FROM peaks WHERE x - 5 BETWEEN 0 AND 49.999999999 AND y - 5 BETWEEN 0 AND 29.999999999", "peaks"))
def filter_bounds(spark, d):
    moved = peaks(spark, d).withColumns({"x": F.col("x") - 5, "y": F.col("y") - 5})
    return O.filter_bounds(moved, 50, 30).select("image_id", "peak_id", "atom_type")


@register(
    "threshold_per_slice",
    sql(
        "SELECT p.image_id, p.x, p.y, CASE WHEN p.v < (0.2 + p.image_id / 20.0) * m.top THEN 0.0 ELSE 2 * p.v END AS v FROM pixels p JOIN (SELECT image_id, max(v) AS top FROM pixels GROUP BY image_id) m ON p.image_id = m.image_id",
        "pixels",
    ),
)
def threshold_per_slice(spark, d):
    p = pixels(spark, d).withColumns({"ref": F.col("v"), "v": 2 * F.col("v")})
    return O.threshold_per_slice(p, F.lit(0.2) + F.col("image_id") / 20.0).select("image_id", "x", "y", "v")


@register("mask_circle", sql("SELECT image_id, x, y, v FROM pixels WHERE power(x - 31.5, 2) + power(y - 23.5, 2) < 225", "pixels"))
def mask_circle(spark, d):
    return pixels(spark, d).filter(O.in_circle(NX, NY, 15)).select("image_id", "x", "y", "v")


@register(
    "mask_boxes_union",
    sql(
        "SELECT image_id, x, y, v FROM pixels WHERE EXISTS (SELECT 1 FROM peaks k WHERE k.image_id = pixels.image_id AND pixels.x >= trunc(k.x - 1.5) AND pixels.x < trunc(k.x + 1.5) AND pixels.y >= trunc(k.y - 1.5) AND pixels.y < trunc(k.y + 1.5))",
        "pixels", "peaks",
    ),
)
def mask_boxes_union(spark, d):
    return O.mask_boxes(pixels(spark, d), peaks(spark, d), 1.5).select("image_id", "x", "y", "v")


@register("filter_element", "SELECT p_partkey, p_brand FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def filter_element(spark, d):
    formula = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))  # such as SmallRing
    return table(spark, d, "part").filter(F.array_contains(O.formula_elements(formula), "Ring")).select("p_partkey", "p_brand")


_PARAMS = """, params AS (SELECT 'pos_x' AS key, peak_id, x AS v FROM peaks UNION ALL SELECT 'height', peak_id, x + y FROM peaks
  UNION ALL SELECT 'sigma', CAST(NULL AS BIGINT), 2.5 UNION ALL SELECT 'background', CAST(NULL AS BIGINT), 1.0)"""


def params(spark, d):
    """Long parameters: two for each peak, a shared width and the background."""
    p = peaks(spark, d)
    one = spark.range(1)
    none = F.lit(None).cast("long").alias("peak_id")
    return (
        p.select(F.lit("pos_x").alias("key"), "peak_id", F.col("x").alias("v"))
        .union(p.select(F.lit("height"), "peak_id", F.col("x") + F.col("y")))
        .union(one.select(F.lit("sigma"), none, F.lit(2.5)))
        .union(one.select(F.lit("background"), none, F.lit(1.0)))
    )


@register("select_params", sql(_PARAMS + " SELECT key, peak_id, round(v, 6) AS v FROM params WHERE key = 'sigma' OR (key NOT IN ('sigma', 'background') AND peak_id IN (SELECT peak_id FROM peaks WHERE atom_type = 1))", "peaks"))
def select_params(spark, d):
    return rounded(O.select_params(params(spark, d), peaks(spark, d).filter("atom_type = 1"), ("sigma",), background=False))


@register("mask_columns", sql(_PARAMS + " SELECT key, peak_id, CASE WHEN key IN ('height', 'sigma') THEN 0.0 ELSE round(v, 6) END AS v FROM params", "peaks"))
def mask_columns(spark, d):
    return rounded(O.mask_keys(params(spark, d), ["height", "sigma"]))


@register("filter_percentile", sql("SELECT p.image_id, x, y, v FROM pixels p JOIN (SELECT image_id, quantile_cont(v, 0.25) AS q FROM pixels GROUP BY image_id) c ON p.image_id = c.image_id WHERE v > q", "pixels"))
def filter_percentile(spark, d):
    return O.above_percentile(pixels(spark, d)).select("image_id", "x", "y", "v")


@register(
    "clip_params",
    sql(
        """, s AS (SELECT image_id, sum(v) AS total, max(v) AS top FROM pixels GROUP BY image_id)
        SELECT k.image_id, peak_id, round(greatest(0, least(63, 1.2 * x - 5)), 6) AS pos_x, round(greatest(0, least(47, 1.2 * y - 5)), 6) AS pos_y,
          round(greatest(0, least(total, (x - 20) * 100)), 6) AS height, round(greatest(1, least(24, x / 2)), 6) AS sigma,
          round(greatest(0, least(1, y / 30)), 6) AS ratio, round(greatest(0, least(top, y * 10 - 50)), 6) AS background
        FROM peaks k JOIN s ON k.image_id = s.image_id""",
        "pixels", "peaks",
    ),
)
def clip_params(spark, d):
    x, y = F.col("x"), F.col("y")
    wide = peaks(spark, d).select(
        "image_id", "peak_id", (1.2 * x - 5).alias("pos_x"), (1.2 * y - 5).alias("pos_y"), ((x - 20) * 100).alias("height"), (x / 2).alias("sigma"), (y / 30).alias("ratio"), (y * 10 - 50).alias("background")
    )
    return rounded(O.clip_params(wide, pixels(spark, d), NX, NY))


@register("filter_nan_valid", sql("SELECT image_id, peak_id FROM peaks WHERE atom_type <> 0 AND NOT (x < 8 OR x > 56 OR y < 8 OR y > 40)", "peaks"))
def filter_nan_valid(spark, d):
    p = peaks(spark, d).withColumn("value", F.when(F.col("atom_type") == 0, F.lit(float("nan"))).otherwise(F.col("x")))
    return O.valid_within_border(p, "value", NX, NY, 8).select("image_id", "peak_id")


@register("filter_half", sql("SELECT 'top' AS half, image_id, peak_id FROM peaks WHERE y < 24 UNION ALL SELECT 'right', image_id, peak_id FROM peaks WHERE x > 32", "peaks"))
def filter_half(spark, d):
    p = peaks(spark, d)
    top, right = (O.filter_half(p, h, NX, NY).select(F.lit(h).alias("half"), "image_id", "peak_id") for h in ("top", "right"))
    return top.union(right)


@register("filter_outliers_high", sql("SELECT id, v FROM samples, (SELECT quantile_cont(v, 0.99) AS q, avg(v) AS m FROM samples) c WHERE NOT (v > q AND v > m) AND v > 0", "samples"))
def filter_outliers_high(spark, d):
    return O.filter_outliers_high(samples(spark, d)).select("id", "v")


@register("filter_trim", sql("SELECT id, v FROM samples, (SELECT quantile_cont(v, 0.001) AS a, quantile_cont(v, 0.999) AS b FROM samples) c WHERE v > a AND v < b", "samples"))
def filter_trim(spark, d):
    return O.filter_trim(samples(spark, d)).select("id", "v")
