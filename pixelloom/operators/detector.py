"""Detector and dose calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import gaussian_filter
from .flooding import watershed


def smooth(pixels: DataFrame, nx: int, ny: int, sigma: float = 2.0, reach: int = 2) -> DataFrame:
    """5 x 5 Gaussian blur whose image is continued by reflection about the border pixels."""
    x, y = F.col("x"), F.col("y")

    def images(c, n):
        return F.array(c, *[F.when(c == k, F.lit(-k)) for k in range(1, reach + 1)], *[F.when(c == n - 1 - k, F.lit(n - 1 + k)) for k in range(1, reach + 1)])

    wide = pixels.select("image_id", "y", F.explode(images(x, nx)).alias("x"), "v").filter("x IS NOT NULL")
    wide = wide.select("image_id", F.explode(images(y, ny)).alias("y"), "x", "v").filter("y IS NOT NULL")
    inner = (x >= 0) & (x < nx) & (y >= 0) & (y < ny)
    return gaussian_filter(wide, sigma, reach).filter(inner).select("image_id", "y", "x", "v", "blur")


def otsu(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """(image_id, threshold) that maximises the variance between both classes, from one histogram of fixed size for each image."""
    ends = pixels.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    h = pixels.join(F.broadcast(ends), "image_id").filter("hi > lo").groupBy("image_id", at.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first(width).alias("w"))
    low = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("image_id")
    m = F.col("n") * F.col("bin")
    h = h.select("image_id", "bin", "lo", "w", F.sum("n").over(low).alias("n0"), F.sum("n").over(every).alias("n1"), F.sum(m).over(low).alias("m0"), F.sum(m).over(every).alias("m1"))
    rest = F.col("n1") - F.col("n0")
    gap = F.col("m0") / F.col("n0") - (F.col("m1") - F.col("m0")) / rest
    best = F.max(F.struct(F.when(rest > 0, F.round(F.col("n0") * rest * gap * gap, 3)).otherwise(0.0).alias("s"), (-F.col("bin")).alias("k"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("t")))
    return h.groupBy("image_id").agg(best.alias("b")).select("image_id", F.col("b.t").alias("threshold"))


def otsu_mask(pixels: DataFrame) -> DataFrame:
    return pixels.join(F.broadcast(otsu(pixels)), "image_id", "left").withColumn("mask", F.coalesce(F.col("v") >= F.col("threshold"), F.lit(False))).drop("threshold")


def edge_mask(masked: DataFrame) -> DataFrame:
    """Mask pixels of which all four neighbours are mask pixels too: the mask eroded by one."""
    on = masked.filter("mask").select("image_id", "y", "x")
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))).alias("s")
    votes = on.select("image_id", "y", "x", steps).select("image_id", (F.col("y") + F.col("s.j")).alias("y"), (F.col("x") + F.col("s.i")).alias("x")).groupBy("image_id", "y", "x").agg(F.count("*").alias("n"))
    full = votes.filter("n = 5").select("image_id", "y", "x", F.lit(True).alias("inner"))
    return masked.join(full, ["image_id", "y", "x"], "left").withColumn("mask", F.coalesce("inner", F.lit(False))).drop("inner")


def percentile_mask(pixels: DataFrame, percent: float = 80.0) -> DataFrame:
    """Pixels above a percentile of their image."""
    cut_at = pixels.groupBy("image_id").agg(F.percentile("v", percent / 100).alias("cut"))
    return pixels.join(F.broadcast(cut_at), "image_id").withColumn("mask", F.col("v") > F.col("cut")).drop("cut")


def watershed_mask(pixels: DataFrame, percent: float = 80.0) -> DataFrame:
    """The part flooded from above a percentile of each image, against that from below it."""
    cut_at = pixels.groupBy("image_id").agg(F.percentile("v", percent / 100).alias("cut"))
    sides = pixels.join(F.broadcast(cut_at), "image_id").filter("v <> cut")
    markers = sides.select("image_id", "y", "x", F.when(F.col("v") > F.col("cut"), 2).otherwise(1).alias("label"))
    return watershed(pixels, markers).withColumn("mask", F.coalesce(F.col("label") == 2, F.lit(False))).drop("label")


def watershed_cells(pixels: DataFrame, peaks: DataFrame) -> DataFrame:
    """Pixels with the id of the peak whose cell they lie in: each peak's rounded place floods down from it."""
    at = peaks.select("image_id", F.round("y").cast("int").alias("y"), F.round("x").cast("int").alias("x"), F.col("peak_id").alias("label"))
    flooded = watershed(pixels.withColumn("v", -F.col("v")), at)
    return flooded.select("image_id", "y", "x", (-F.col("v")).alias("v"), F.col("label").alias("peak_id"))


def dose_scale(experiment: DataFrame, detector: DataFrame, shutter: float) -> DataFrame:
    """Net level of the experiment over that of the detector scan, for each image."""
    e, d = (x.select("image_id", (F.col("detector") - F.col("background")).alias(n)) for x, n in ((experiment, "e"), (detector, "d")))
    return e.join(d, "image_id").select("image_id", (F.col("e") / F.col("d") / shutter).alias("scale"))


def detector_gain(levels: DataFrame, scale: DataFrame) -> DataFrame:
    gain = (F.col("detector") - F.col("background")) * F.col("scale")
    return levels.join(scale, "image_id").select("image_id", gain.alias("gain"), (gain + F.col("background")).alias("top"))
