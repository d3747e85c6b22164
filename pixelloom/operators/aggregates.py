"""Aggregations over pixels, cells, peaks and samples. All combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import label_pixels


def voronoi_integrate(pixels: DataFrame, peaks: DataFrame, radius: float) -> DataFrame:
    """Sum of the pixels nearest to each peak and closer than ``radius``; 0 for an empty cell."""
    cells = label_pixels(pixels, peaks, radius).filter("peak_id IS NOT NULL").groupBy("image_id", "peak_id").agg(F.sum("v").alias("total"))
    return peaks.select("image_id", "peak_id").join(cells, ["image_id", "peak_id"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def voronoi_paint(labelled: DataFrame, cells: DataFrame) -> DataFrame:
    """Each pixel with its cell's sum, null for the background."""
    return labelled.join(cells, ["image_id", "peak_id"], "left")


def edge_cells(labelled: DataFrame, nx: int, ny: int, band: int) -> DataFrame:
    """(image_id, peak_id) of cells that touch the border band; the background isn't a cell."""
    x, y = F.col("x"), F.col("y")
    at_edge = (x < band) | (x >= nx - band) | (y < band) | (y >= ny - band)
    return labelled.filter(at_edge & F.col("peak_id").isNotNull()).select("image_id", "peak_id").distinct()


def without_edge_cells(cells: DataFrame, edge: DataFrame) -> DataFrame:
    """Sums of edge cells become null."""
    marked = edge.withColumn("__edge", F.lit(True))
    return cells.join(marked, ["image_id", "peak_id"], "left").withColumn("total", F.when(F.col("__edge").isNull(), F.col("total"))).drop("__edge")


def center_of_mass(pixels: DataFrame, *keys: str) -> DataFrame:
    total = F.sum("v")
    return pixels.groupBy(*keys).agg((F.sum(F.col("y") * F.col("v")) / total).alias("cy"), (F.sum(F.col("x") * F.col("v")) / total).alias("cx"))


def radial_average(pixels: DataFrame, centers: DataFrame) -> DataFrame:
    """Mean by whole distance from each image's centre (cx, cy)."""
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    ring = F.floor(F.sqrt(dx * dx + dy * dy))
    return pixels.join(F.broadcast(centers), "image_id").groupBy("image_id", ring.alias("r")).agg(F.avg("v").alias("mean"))


def column_extreme(pixels: DataFrame, measure: Column) -> DataFrame:
    """Per image the column with the largest sum of ``measure``; the first of equals."""
    columns = pixels.groupBy("image_id", "x").agg(F.sum(measure).alias("m"))
    return columns.groupBy("image_id").agg(F.max(F.struct("m", (-F.col("x")).alias("k"))).alias("b")).select("image_id", (-F.col("b.k")).alias("x"), F.col("b.m").alias("m"))


def detector_levels(pixels: DataFrame, mask: Column, percent: float = 20.0) -> DataFrame:
    """Mean inside the mask and a percentile of all, for each image."""
    return pixels.groupBy("image_id").agg(F.avg(F.when(mask, F.col("v"))).alias("detector"), F.percentile("v", percent / 100).alias("background"))


def detector_normalize(pixels: DataFrame, levels: DataFrame) -> DataFrame:
    """Values between background 0 and detector 1, not below 0."""
    scaled = (F.col("v") - F.col("background")) / (F.col("detector") - F.col("background"))
    return pixels.join(F.broadcast(levels), "image_id").withColumn("v", F.greatest(F.lit(0.0), scaled)).drop("detector", "background")


def moments_center(masked: DataFrame) -> DataFrame:
    return masked.groupBy("image_id").agg(F.floor(F.avg("x")).alias("cx"), F.floor(F.avg("y")).alias("cy"))


def type_mean(params: DataFrame, columns: list[str]) -> DataFrame:
    """Each column replaced by its mean over the atom type."""
    mean = params.groupBy("atom_type").agg(*(F.avg(c).alias(c) for c in columns))
    return params.drop(*columns).join(F.broadcast(mean), "atom_type")


def counts(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("image_id").agg(F.count("*").alias("n_peaks"), F.count_distinct("atom_type").alias("n_types"))


def fit_loss(residuals: DataFrame, weight: Column | None = None) -> DataFrame:
    """Root mean square plus mean absolute of image - model, weighted by a window if there is one."""
    diff = F.col("v") - F.col("model")
    if weight is not None:
        diff = diff * weight
    return residuals.groupBy("image_id").agg((F.sqrt(F.avg(diff * diff)) + F.avg(F.abs(diff))).alias("loss"))


def convergence(new: DataFrame, old: DataFrame, tol: float) -> DataFrame:
    """Per image the largest move, the mean relative change of heights, and whether both are small."""
    o = old.select("image_id", "peak_id", *(F.col(c).alias(f"{c}_old") for c in ("x", "y", "height")))
    j = new.join(o, ["image_id", "peak_id"])
    move = F.max(F.greatest(F.abs(F.col("x") - F.col("x_old")), F.abs(F.col("y") - F.col("y_old"))))
    change = F.avg(F.abs((F.col("height") - F.col("height_old")) / (F.col("height") + 1e-10)))
    out = j.groupBy("image_id").agg(move.alias("move"), change.alias("change"))
    return out.withColumn("converged", (F.col("move") <= 1) & (F.col("change") <= tol))


def error_stats(errors: DataFrame, value: str = "v") -> DataFrame:
    return errors.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def histogram(values: DataFrame, bins: int, *keys: str) -> DataFrame:
    """Counts of equal bins between least and largest value of each key; the last bin is closed."""
    ends = values.groupBy(*keys).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    joined = values.join(F.broadcast(ends), list(keys)) if keys else values.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("__lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return joined.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def histogram2d(values: DataFrame, bins: int, a: str, b: str) -> DataFrame:
    """Counts of equal bins between the ends of both columns; the last bins are closed."""
    ends = values.agg(*(f(c).alias(f"__{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))))
    joined = values.crossJoin(F.broadcast(ends))  # one row

    def at(c: str) -> Column:
        width = (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")) / bins
        return F.when(width > 0, F.least(F.floor((F.col(c) - F.col(f"__lo_{c}")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")

    return joined.groupBy(at(a).alias(f"bin_{a}"), at(b).alias(f"bin_{b}")).agg(F.count("*").alias("n"))


def percentiles(values: DataFrame, percents: list[float], *keys: str) -> DataFrame:
    return values.groupBy(*keys).agg(*(F.percentile("v", p / 100).alias(f"p{p:g}".replace(".", "_")) for p in percents))


def log_likelihood(densities: DataFrame) -> DataFrame:
    """Sum over data of the log of the sum over components (columns id, p)."""
    return densities.groupBy("id").agg(F.sum("p").alias("p")).agg(F.sum(F.log("p")).alias("llh"))


