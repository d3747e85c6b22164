"""Joins: nearest neighbours, ranges, lookups and edits. Ties go to the least id throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import cut
from ..plans.spatial import near_pairs, nearest


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def nearest_any(left: DataFrame, right: DataFrame, left_id: tuple[str, ...], right_id: str = "peak_id", key: str = "image_id", reach: float = 4.0) -> DataFrame:
    """For each left row the nearest right row of its image, however far; minima are combined before the shuffle.

    By rounds of grid buckets of a doubled radius, from ``reach`` on: each settles the rows that have a neighbour
    within it, and only the rest goes on. The last radius covers the images; rows of images without any right
    row give none.
    """
    right = cut(right.select(key, right_id, "x", "y"))
    left = left.join(F.broadcast(right.select(key).distinct()), key, "left_semi").select(key, *left_id, "x", "y")
    ends = right.select("x", "y").unionByName(left.select("x", "y")).agg(*(F.max(c) - F.min(c) for c in "xy")).first()
    far, out = math.hypot(ends[0] or 0.0, ends[1] or 0.0) * 1.01 + 1.0, None
    rest = left
    while True:
        reach = min(reach, far)
        close = cut(nearest(rest, right, reach, left_id, right_id, (key,)))
        out = close if out is None else out.unionByName(close)
        if reach >= far:
            return out
        rest = cut(rest.join(close, [key, *left_id], "left_anti"))
        if rest.isEmpty():
            return out
        reach *= 2


def label_pixels(pixels: DataFrame, peaks: DataFrame, radius: float) -> DataFrame:
    """Pixels with the id of the nearest peak closer than ``radius``, null where there is none.

    For periodic images give ``periodic_images(peaks, nx, ny)`` as peaks.
    """
    near = nearest(pixels, peaks, radius, ("y", "x"))
    return pixels.join(near.select("image_id", "y", "x", F.col("peak_id_r").alias("peak_id")), ["image_id", "y", "x"], "left")


def nearest_match(left: DataFrame, right: DataFrame, right_columns: list[str], key: str = "image_id", reach: float = 4.0) -> DataFrame:
    """Left rows with columns of their nearest right row (many to one)."""
    found = nearest_any(left, right, ("peak_id",), key=key, reach=reach).drop("d2")
    gathered = right.select(key, F.col("peak_id").alias("peak_id_r"), *(F.col(c).alias(c + "_r") for c in right_columns))
    return left.join(found, [key, "peak_id"], "left").join(gathered, [key, "peak_id_r"], "left")


def nearest_below(left: DataFrame, right: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Nearest right row strictly below the threshold, null otherwise."""
    return nearest(left, right, threshold, ("peak_id",), how="left")


def nn_distance(peaks: DataFrame, reach: float) -> DataFrame:
    """Distance to the nearest other peak within ``reach``, null beyond."""
    pairs = near_pairs(peaks, peaks, reach).filter("peak_id <> peak_id_r")
    found = pairs.groupBy("image_id", "peak_id").agg(F.sqrt(F.min("d2")).alias("distance"))
    return peaks.select("image_id", "peak_id").join(found, ["image_id", "peak_id"], "left")


def neighbor_mean(moved: DataFrame, cutoff: float) -> DataFrame:
    """(ux, uy) less the mean of the neighbours within ``cutoff``; a peak without any keeps its own."""
    pairs = near_pairs(moved, moved, cutoff).filter("peak_id <> peak_id_r")
    mean = pairs.groupBy("image_id", "peak_id").agg(F.avg("ux_r").alias("mx"), F.avg("uy_r").alias("my"))
    out = moved.join(mean, ["image_id", "peak_id"], "left")
    return out.select("image_id", "peak_id", (F.col("ux") - F.coalesce("mx", F.lit(0.0))).alias("ux"), (F.col("uy") - F.coalesce("my", F.lit(0.0))).alias("uy"))


def polarization(peaks: DataFrame, a_type: int, b_type: int, cutoff: float, least: int) -> DataFrame:
    """For each peak of type b its offset from the mean of all type a peaks within ``cutoff``; null with fewer than ``least``."""
    a, b = (peaks.filter(F.col("atom_type") == t) for t in (a_type, b_type))
    mean = near_pairs(b, a, cutoff).groupBy("image_id", "peak_id").agg(F.avg("x_r").alias("mx"), F.avg("y_r").alias("my"), F.count("*").alias("n"))
    out = b.join(mean.filter(F.col("n") >= least), ["image_id", "peak_id"], "left")
    px, py = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return out.select("image_id", "peak_id", px.alias("px"), py.alias("py"), hypot(px, py).alias("magnitude"))


def knn_tilt(peaks: DataFrame, a_type: int, o_type: int, cutoff: float) -> DataFrame:
    """Angle (0 to 90 degrees) between the line of each o's two nearest a and that to its nearest other o.

    Null unless there are two a and one other o within the cutoff.
    """
    a, o = (peaks.filter(F.col("atom_type") == t) for t in (a_type, o_type))
    order = Window.partitionBy("image_id", "peak_id").orderBy("d2", "peak_id_r")
    two = near_pairs(o, a, cutoff).withColumn("k", F.row_number().over(order)).filter("k <= 2")
    line = two.groupBy("image_id", "peak_id").agg(
        *(F.max(F.when(F.col("k") == k, F.col(c + "_r"))).alias(f"{c}{k}") for k in (1, 2) for c in "xy")
    )
    other = near_pairs(o, o, cutoff).filter("d2 > 1e-12").withColumn("k", F.row_number().over(order)).filter("k = 1")
    other = other.select("image_id", "peak_id", (F.col("x_r") - F.col("x")).alias("ox"), (F.col("y_r") - F.col("y")).alias("oy"))
    ax, ay = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cos = F.abs(ax * F.col("ox") + ay * F.col("oy")) / (hypot(ax, ay) * hypot(F.col("ox"), F.col("oy")))
    out = o.join(line, ["image_id", "peak_id"], "left").join(other, ["image_id", "peak_id"], "left")
    return out.select("image_id", "peak_id", F.degrees(F.acos(F.least(cos, F.lit(1.0)))).alias("tilt"))


def directional_nn(peaks: DataFrame, a: tuple[float, float], b: tuple[float, float], least: float) -> DataFrame:
    """Nearest neighbour along vector a, in a corridor of half of b: projection and distance."""
    (ax, ay), (bx, by) = a, b
    la, lb = (ax**2 + ay**2) ** 0.5, (bx**2 + by**2) ** 0.5
    pairs = near_pairs(peaks, peaks, ((1.5 * la) ** 2 + (lb / 2) ** 2) ** 0.5 * 1.5)
    dx, dy = F.col("x_r") - F.col("x"), F.col("y_r") - F.col("y")
    pa, pb = (dx * ax + dy * ay) / la, (dx * bx + dy * by) / lb
    hit = pairs.filter((pa > least) & (F.abs(pb) < lb / 2) & (F.abs(pa) < 1.5 * la))
    best = F.min(F.struct(pa.alias("along"), F.col("peak_id_r").alias("id"), F.sqrt("d2").alias("distance")))
    return hit.groupBy("image_id", "peak_id").agg(best.alias("m")).select("image_id", "peak_id", F.col("m.id").alias("peak_id_r"), F.col("m.along").alias("along"), F.col("m.distance").alias("distance"))


def angular_range(peaks: DataFrame, vector: tuple[float, float], low: float, high: float, cosine: float = 0.95) -> DataFrame:
    """All ordered pairs between two distances whose line runs along the vector, either way."""
    vx, vy = vector
    length = (vx**2 + vy**2) ** 0.5
    pairs = near_pairs(peaks, peaks, high).filter(F.col("d2") > low * low)
    dx, dy = F.col("x_r") - F.col("x"), F.col("y_r") - F.col("y")
    cos = F.abs(dx * vx + dy * vy) / (F.sqrt("d2") * length + 1e-12)
    return pairs.filter(cos > cosine).select("image_id", "peak_id", "peak_id_r", F.sqrt("d2").alias("distance"))


def lookup_rows(left: DataFrame, right: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Left rows with the last index of an equal right row, -1 where there is none."""
    last = right.groupBy(*keys).agg(F.max(idx).alias("found"))
    return left.join(last, keys, "left").withColumn("found", F.coalesce("found", F.lit(-1)))


def lookup_elements(left: DataFrame, right: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Left rows that have an equal right row, with its first index."""
    return left.join(right.groupBy(*keys).agg(F.min(idx).alias("found")), keys)


def periodic_images(peaks: DataFrame, nx: float, ny: float) -> DataFrame:
    """Every peak and its eight translations by the image's edges (shift_x, shift_y from -1 to 1)."""
    shifts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    out = peaks.withColumn("s", F.explode(shifts))
    return out.withColumns({"x": F.col("x") + F.col("s.i") * nx, "y": F.col("y") + F.col("s.j") * ny, "shift_x": F.col("s.i"), "shift_y": F.col("s.j")}).drop("s")


def lookup_region(peaks: DataFrame, region_map: DataFrame) -> DataFrame:
    """Region of the pixel that a peak's truncated place names."""
    at = peaks.withColumns({"py": F.col("y").cast("int"), "px": F.col("x").cast("int")})
    r = region_map.select(F.col("image_id"), F.col("y").alias("py"), F.col("x").alias("px"), "region_id")
    return at.join(r, ["image_id", "py", "px"], "left").drop("py", "px")


def min_distances(atoms: DataFrame, nx: float, ny: float, reach: float) -> DataFrame:
    """Half the least distance of each atom type to any other site, periodic images included."""
    pairs = near_pairs(periodic_images(atoms, nx, ny), atoms, reach).filter("d2 > 0")
    return pairs.groupBy("image_id", F.col("atom_type_r").alias("atom_type")).agg((F.sqrt(F.min("d2")) / 2).alias("radius"))


def with_type_params(peaks: DataFrame, type_params: DataFrame) -> DataFrame:
    """Shared parameters of each atom type; one row for each type, so that the table is broadcast."""
    return peaks.join(F.broadcast(type_params), "atom_type", "left")


def apply_clicks(peaks: DataFrame, clicks: DataFrame, tolerance: float) -> DataFrame:
    """Batch of edits: a click within ``tolerance`` of peaks deletes the nearest, any other inserts one with the click's id."""
    c = clicks.select("image_id", F.col("click_id").alias("peak_id"), "x", "y", "atom_type")
    hits = nearest(c, peaks, tolerance, ("peak_id",))
    gone = hits.select("image_id", F.col("peak_id_r").alias("peak_id"))
    new = c.join(hits, ["image_id", "peak_id"], "left_anti")
    return peaks.join(gone, ["image_id", "peak_id"], "left_anti").unionByName(new.select(*peaks.columns))
