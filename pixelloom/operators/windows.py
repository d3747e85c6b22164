"""Neighbourhood windows over pixels and order-dependent scans."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import cut, shared_dir
from ..plans.spatial import near_pairs
from .aggregates import column_extreme


def box_offsets(reach: int) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))


def local_maxima(pixels: DataFrame, reach: int, share: float, border: int, nx: int, ny: int) -> DataFrame:
    """Pixels that are the largest within ``reach`` along both axes, above a share of the image's maximum and away from its border.

    Maxima spread along x first, then along y, so that each pixel goes out 2 (2 reach + 1) times, not its square.
    """
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("step")
    along_x = pixels.select("image_id", "y", "x", "v", steps).withColumn("x", F.col("x") + F.col("step"))
    rows = along_x.groupBy("image_id", "y", "x").agg(F.max("v").alias("v"))
    along_y = rows.select("image_id", "y", "x", "v", steps).withColumn("y", F.col("y") + F.col("step"))
    boxes = along_y.groupBy("image_id", "y", "x").agg(F.max("v").alias("top"))
    best = pixels.groupBy("image_id").agg(F.max("v").alias("__max"))
    x, y = F.col("x"), F.col("y")
    inner = (x >= border) & (x < nx - border) & (y >= border) & (y < ny - border)
    out = pixels.filter(inner).join(boxes, ["image_id", "y", "x"]).join(F.broadcast(best), "image_id")
    return out.filter((F.col("v") == F.col("top")) & (F.col("v") > share * F.col("__max"))).select("image_id", "y", "x", "v")


def refine_local_max(pixels: DataFrame, peaks: DataFrame, reach: int) -> DataFrame:
    """The brightest pixel within ``reach`` of each peak's rounded place (the first of equals), then distinct."""
    at = peaks.select("image_id", "peak_id", F.explode(box_offsets(reach)).alias("o"), F.round("x").cast("int").alias("px"), F.round("y").cast("int").alias("py"))
    near = at.select("image_id", "peak_id", (F.col("px") + F.col("o.i")).alias("x"), (F.col("py") + F.col("o.j")).alias("y")).join(pixels, ["image_id", "y", "x"])
    best = near.groupBy("image_id", "peak_id").agg(F.max(F.struct("v", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("b"))
    return best.select("image_id", (-F.col("b.nx")).alias("x"), (-F.col("b.ny")).alias("y"), F.col("b.v").alias("v")).distinct()


def anchored_clusters(series: DataFrame, window: float, key: str = "user_id") -> DataFrame:
    """Adds the number of the cluster, from 0: one opens where the distance from the first member exceeds ``window``.

    Each series (columns d, v) is sorted within its partition and walked by a generator that
    carries only the open cluster, so a series of any length streams through.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema.fields), "cluster long"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = anchor = None
        n = 0
        for b in batches:
            out = np.empty(len(b), np.int64)
            for i, (k, d) in enumerate(zip(b[key], b["d"], strict=True)):
                if own is None or k != own:
                    own, anchor, n = k, d, 0
                elif d - anchor > window:
                    anchor, n = d, n + 1
                out[i] = n
            yield b.assign(cluster=out)

    return series.repartition(key).sortWithinPartitions(key, "d", "v").mapInPandas(walk, schema)


def cluster_stats(clustered: DataFrame, key: str = "user_id") -> DataFrame:
    n = F.count("*")
    half = F.when(n > 1, 1.96 * F.stddev_samp("v") / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))
    return clustered.groupBy(key, "cluster").agg(F.avg("d").alias("d"), F.avg("v").alias("v"), F.stddev_pop("v").alias("std"), half.alias("half_width"), n.alias("n"))


def greedy_dedup(peaks: DataFrame, threshold: float, rounds: int | None = None) -> DataFrame:
    """In order of id, each point that stays removes all later ones closer than ``threshold`` along both axes.

    By rounds over the pairs that are close: a point stays once all its earlier neighbours are gone,
    and is gone once one of them stays. Each round decides at least the least undecided point of
    every group, and cuts the lineage where there is a folder for it. They go on until all points are
    decided; with ``rounds`` given, it is an error if that many don't do.
    """
    pairs = near_pairs(peaks, peaks, threshold, box=True).filter("peak_id_r < peak_id").select("image_id", "peak_id", F.col("peak_id_r").alias("before")).persist()
    state = peaks.select("image_id", "peak_id").join(pairs.select("image_id", "peak_id").distinct().withColumn("s", F.lit(0)), ["image_id", "peak_id"], "left").select("image_id", "peak_id", F.coalesce("s", F.lit(1)).alias("s")).persist()
    for k in count():
        if state.filter("s = 0").isEmpty():
            break
        if k == rounds:
            raise RuntimeError(f"greedy_dedup did not decide all points in {rounds} rounds")
        earlier = state.select("image_id", F.col("peak_id").alias("before"), F.col("s").alias("sb"))
        seen = pairs.join(earlier, ["image_id", "before"]).groupBy("image_id", "peak_id").agg(F.max(F.col("sb") == 1).alias("lost"), F.min(F.col("sb") == -1).alias("free"))
        new = state.join(seen, ["image_id", "peak_id"], "left").select(
            "image_id", "peak_id", F.when(F.col("s") != 0, F.col("s")).when(F.col("lost"), -1).when(F.col("free"), 1).otherwise(0).alias("s")
        )
        state = cut(new)
    return peaks.join(state.filter("s = 1").select("image_id", "peak_id"), ["image_id", "peak_id"], "left_semi")


def random_batches(rows: DataFrame, n_batches: int, seed: int = 0) -> DataFrame:
    """Deals rows into batches at random by a seeded hash of their id: no global sort is needed."""
    return rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_batches)).cast("int"))


def duplicate_rows(rows: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Rows that aren't the first of their value: no window, so a frequent value is no burden on one task."""
    first = rows.groupBy(*keys).agg(F.min(idx).alias("__first"))
    return rows.join(first, keys).filter(F.col(idx) > F.col("__first")).drop("__first")


def mean_filter(pixels: DataFrame, reach: int = 1) -> DataFrame:
    """Adds ``blur``: the mean of the pixels present in the box round each."""
    spread = pixels.select("image_id", F.explode(box_offsets(reach)).alias("o"), "y", "x", "v")
    mean = spread.select("image_id", (F.col("y") + F.col("o.j")).alias("y"), (F.col("x") + F.col("o.i")).alias("x"), "v").groupBy("image_id", "y", "x").agg(F.avg("v").alias("blur"))
    return pixels.join(mean, ["image_id", "y", "x"])


def hot_pixels(blurred: DataFrame, sigma: float) -> DataFrame:
    """Pixels farther from their blur than mean + sigma * population std of all such distances take the blur."""
    diff = F.abs(F.col("v") - F.col("blur"))
    limit = blurred.groupBy("image_id").agg((F.avg(diff) + sigma * F.stddev_pop(diff)).alias("__limit"))
    hot = diff > F.col("__limit")
    return blurred.join(F.broadcast(limit), "image_id").withColumns({"hot": hot, "v": F.when(hot, F.col("blur")).otherwise(F.col("v"))}).drop("__limit", "blur")


def line_defect(pixels: DataFrame) -> DataFrame:
    """The column with the most zeros (or, where none has any, the first) and its neighbours become the mean of the columns two off."""
    at = column_extreme(pixels, F.when(F.col("v") == 0, 1).otherwise(0)).select("image_id", F.col("x").alias("b"))
    joined = pixels.join(F.broadcast(at), "image_id")
    side = joined.filter(F.abs(F.col("x") - F.col("b")) == 2).groupBy("image_id", "y").agg((F.sum("v") / 2).alias("mean"), F.count("*").alias("n"))
    out = joined.join(side.filter("n = 2"), ["image_id", "y"], "left")
    return out.withColumn("v", F.when((F.abs(F.col("x") - F.col("b")) <= 1) & F.col("mean").isNotNull(), F.col("mean")).otherwise(F.col("v"))).drop("b", "mean", "n")


def _rings(a: np.ndarray, b: np.ndarray, reach: int) -> list[tuple[int, int, int]]:
    """(i, j, ring) of the lattice cells up to ``reach``: a cell's ring comes after those of its neighbours that are nearer to the
    origin (or as near and of a lesser number)."""
    cells = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    ring: dict[tuple[int, int], int] = {}
    for i, j in sorted(cells, key=lambda c: (round(float(np.hypot(*(c[0] * a + c[1] * b))), 9), c)):
        ring[i, j] = 1 + max((ring[n] for n in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if n in ring), default=-1)
    return [(i, j, r) for (i, j), r in ring.items()]


def adaptive_origins(peaks: DataFrame, origin: tuple[float, float], a: tuple[float, float], b: tuple[float, float], reach: int) -> DataFrame:
    """Lattice origins of each image: perfect ones, and adaptive ones that follow the peaks.

    A cell's place is predicted by the mean of what its placed neighbours say, and snaps to the nearest peak (of equals that of
    the least id) within half the shorter vector. Cells are placed in rings outwards from the origin, those of all images at
    once: a ring is a join with what is placed and a distance join on buckets. Cells outside the peaks' box give no row.
    """
    spark, va, vb = peaks.sparkSession, np.array(a, float), np.array(b, float)
    half = float(min(np.hypot(*va), np.hypot(*vb)) / 2)
    kind = peaks.schema["image_id"].dataType.simpleString()
    rings = _rings(va, vb, reach)
    peaks = cut(peaks.select("image_id", "peak_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    box = peaks.groupBy("image_id").agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))))
    numbers = F.sequence(F.lit(-reach), F.lit(reach))
    cells = box.withColumn("a", F.explode(numbers)).withColumn("b", F.explode(numbers))
    perfect = {f"perfect_{c}": F.lit(float(o)) + F.col("a") * float(p) + F.col("b") * float(q) for c, o, p, q in zip("xy", origin, va, vb, strict=True)}
    inside = F.lit(True)
    for c in "xy":
        inside = inside & (F.col(f"perfect_{c}") >= F.col(f"low_{c}") - half) & (F.col(f"perfect_{c}") <= F.col(f"high_{c}") + half)
    ring = spark.createDataFrame(rings, "a int, b int, ring int")
    cells = cut(cells.withColumns(perfect).filter(inside).join(ring, ["a", "b"]).select("image_id", "a", "b", "perfect_x", "perfect_y", "ring"))
    path = f"{shared_dir(spark)}/origins-{uuid.uuid4().hex}"
    schema = f"image_id {kind}, a int, b int, perfect_x double, perfect_y double, x double, y double"
    cells.limit(0).withColumns({c: F.lit(0.0) for c in "xy"}).drop("ring").write.parquet(path)
    for k in range(max(r for *_, r in rings) + 1):
        placed = spark.read.schema(schema).parquet(path)
        says = placed.withColumn("s", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))))))
        says = says.select("image_id", (F.col("a") + F.col("s.i")).alias("a"), (F.col("b") + F.col("s.j")).alias("b"), *((F.col(c) + F.col("s.i") * float(p) + F.col("s.j") * float(q)).alias(c) for c, p, q in zip("xy", va, vb, strict=True)))
        mean = says.groupBy("image_id", "a", "b").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        told = cells.filter(F.col("ring") == k).drop("ring").join(mean, ["image_id", "a", "b"], "left").withColumns({c: F.coalesce(c, f"perfect_{c}") for c in "xy"})
        best = F.min(F.when(F.col("d2").isNotNull(), F.struct("d2", "peak_id_r", "x_r", "y_r"))).alias("m")
        kept = ["image_id", "a", "b", "perfect_x", "perfect_y", "x", "y"]
        near = near_pairs(told, peaks, half, how="left").groupBy(*kept).agg(best)
        near.select(*kept[:5], F.coalesce("m.x_r", "x").alias("x"), F.coalesce("m.y_r", "y").alias("y")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ranked(rows: DataFrame, by: list[Column], *keys: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
