"""Filters: masks over pixels, peaks and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spatial import near_pairs


def inside(vertices: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon (array of struct x, y), by ray casting.

    An edge counts where the point's y is above the lower end and not above the upper one, and the point is not right of it.
    """
    following = F.concat(F.slice(vertices, 2, F.size(vertices) - 1), F.slice(vertices, 1, 1))

    def crosses(p: Column, q: Column) -> Column:
        meets = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]
        return (y > F.least(p["y"], q["y"])) & (y <= F.greatest(p["y"], q["y"])) & (x <= F.greatest(p["x"], q["x"])) & ((p["x"] == q["x"]) | (x <= meets))

    return F.aggregate(F.zip_with(vertices, following, crosses), F.lit(False), lambda acc, c: acc != F.coalesce(c, F.lit(False)))


def polygon(points: list[tuple[float, float]]) -> Column:
    if len(points) < 3:
        raise ValueError("a polygon has at least three vertices")
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def parallelogram(origin: tuple[float, float], a: tuple[float, float], b: tuple[float, float]) -> Column:
    (ox, oy), (ax, ay), (bx, by) = origin, a, b
    return polygon([(ox, oy), (ox + ax, oy + ay), (ox + ax + bx, oy + ay + by), (ox + bx, oy + by)])


def filter_polygon(points: DataFrame, vertices: Column, invert: bool = False) -> DataFrame:
    hit = inside(vertices, F.col("x"), F.col("y"))
    return points.filter(~hit if invert else hit)


def filter_bounds(points: DataFrame, nx: int, ny: int) -> DataFrame:
    """Half-open bounds; all columns stay aligned."""
    return points.filter((F.col("x") >= 0) & (F.col("x") < nx) & (F.col("y") >= 0) & (F.col("y") < ny))


def threshold_per_slice(slices: DataFrame, threshold: Column, key: str = "image_id", value: str = "v", ref: str = "ref") -> DataFrame:
    """0 where the reference is below its share of the slice's maximum."""
    top = slices.groupBy(key).agg(F.max(ref).alias("__top"))
    out = slices.join(F.broadcast(top), key)  # one row for each slice
    return out.withColumn(value, F.when(F.col(ref) < threshold * F.col("__top"), F.lit(0.0)).otherwise(F.col(value))).drop("__top")


def in_circle(nx: int, ny: int, radius: float) -> Column:
    dx, dy = F.col("x") - (nx - 1) / 2, F.col("y") - (ny - 1) / 2
    return dx * dx + dy * dy < radius * radius


def mask_boxes(pixels: DataFrame, peaks: DataFrame, reach: float) -> DataFrame:
    """Pixels inside any box round a peak: from the truncated lower to below the truncated upper border."""
    cut = lambda c: F.col(c).cast("int")
    whole = int(reach) + 1
    pairs = near_pairs(pixels, peaks, whole + 1.0, box=True)
    low = lambda c: (F.col(c) - reach).cast("int")
    high = lambda c: (F.col(c) + reach).cast("int")
    hit = (cut("x") >= low("x_r")) & (cut("x") < high("x_r")) & (cut("y") >= low("y_r")) & (cut("y") < high("y_r"))
    return pairs.filter(hit).select(*pixels.columns).distinct()


def formula_elements(formula: Column) -> Column:
    return F.regexp_extract_all(formula, F.lit("[A-Z][a-z]*"), F.lit(0))


def select_params(params: DataFrame, chosen: DataFrame, shared: tuple[str, ...] = (), background: bool = True) -> DataFrame:
    """Long parameters (key, peak_id, v): shared keys pass, ``background`` only if fitted, others follow the chosen peaks."""
    whole = F.col("key").isin(*shared, *(["background"] if background else []))
    own = params.filter(~F.col("key").isin(*shared, "background")).join(chosen.select("peak_id"), "peak_id", "left_semi")
    return params.filter(whole).unionByName(own)


def mask_keys(params: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    return params.withColumn(value, F.when(F.col("key").isin(keys), F.lit(0.0)).otherwise(F.col(value)))


def above_percentile(pixels: DataFrame, percent: float = 25.0, key: str = "image_id") -> DataFrame:
    """Strictly above the interpolated percentile of the image."""
    cut = pixels.groupBy(key).agg(F.percentile("v", percent / 100).alias("__cut"))
    return pixels.join(F.broadcast(cut), key).filter(F.col("v") > F.col("__cut")).drop("__cut")


def clip_params(params: DataFrame, image: DataFrame, nx: int, ny: int) -> DataFrame:
    """Wide parameters kept in their ranges; heights and background by the image's sum and maximum."""
    stats = image.groupBy("image_id").agg(F.sum("v").alias("__sum"), F.max("v").alias("__max"))
    out = params.join(F.broadcast(stats), "image_id")
    bounds = {"pos_x": (0, F.lit(nx - 1.0)), "pos_y": (0, F.lit(ny - 1.0)), "height": (0, F.col("__sum")), "ratio": (0, F.lit(1.0)), "background": (0, F.col("__max"))}
    bounds |= {k: (1, F.lit(min(nx, ny) / 2)) for k in ("sigma", "gamma")}
    clip = {k: F.greatest(F.lit(float(low)), F.least(high, F.col(k))) for k, (low, high) in bounds.items() if k in params.columns}
    return out.withColumns(clip).drop("__sum", "__max")


def valid_within_border(points: DataFrame, value: str, nx: int, ny: int, border: float) -> DataFrame:
    """Rows whose value is a number and that keep ``border`` from the image's edges."""
    x, y = F.col("x"), F.col("y")
    return points.filter(F.col(value).isNotNull() & ~F.isnan(value) & ~((x < border) | (x > nx - border) | (y < border) | (y > ny - border)))


def filter_half(points: DataFrame, half: str, nx: int, ny: int) -> DataFrame:
    """top, bottom, left or right; the midline is in neither."""
    return points.filter({"top": F.col("y") < ny / 2, "bottom": F.col("y") > ny / 2, "left": F.col("x") < nx / 2, "right": F.col("x") > nx / 2}[half])


def filter_outliers_high(values: DataFrame, value: str = "v", share: float = 0.01) -> DataFrame:
    """Positive values without the highest ``share``: a percentile rule in place of a randomised forest."""
    cut = values.agg(F.percentile(value, 1 - share).alias("__cut"), F.avg(value).alias("__mean"))
    out = values.crossJoin(F.broadcast(cut))  # one row
    return out.filter(~((F.col(value) > F.col("__cut")) & (F.col(value) > F.col("__mean"))) & (F.col(value) > 0)).drop("__cut", "__mean")


def filter_trim(values: DataFrame, value: str = "v", low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Strictly between two percentiles of all values."""
    cut = values.agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("__cut"))
    return values.crossJoin(F.broadcast(cut)).filter((F.col(value) > F.col("__cut")[0]) & (F.col(value) < F.col("__cut")[1])).drop("__cut")


