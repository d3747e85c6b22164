"""Sorts, top-k, set operations and keyed changes of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import inside


def argmin(rows: DataFrame, score: str, idx: str, *keys: str) -> DataFrame:
    """The row with the least score of each key; the least index of equals."""
    best = F.min(F.struct(F.col(score).alias("score"), F.col(idx).alias("idx"))).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, F.col("b.idx").alias(idx), F.col("b.score").alias(score))


def sort_components(components: DataFrame) -> DataFrame:
    """Components of each model renumbered by mean, with their weights and variances."""
    order = Window.partitionBy("model").orderBy("mean", "k")
    return components.withColumn("k", F.row_number().over(order).cast("long") - 1)


def topk(rows: DataFrame, k: int, value: str, idx: list[str]) -> DataFrame:
    """The k largest of all rows; ties by index."""
    return rows.orderBy(F.desc(value), *idx).limit(k)


def distinct_columns(atoms: DataFrame) -> DataFrame:
    """One row for each projected place; the first atom gives the element and height."""
    return atoms.groupBy("x", "y").agg(F.min(F.struct("idx", "z", "symbol")).alias("a")).select("x", "y", "a.idx", "a.z", "a.symbol")


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str], deleted: str | None = None) -> DataFrame:
    """Insert or replace by key; changes marked ``deleted`` only take the old row away."""
    kept = rows.join(changes.select(*keys), keys, "left_anti")
    new = changes.filter(~F.col(deleted)) if deleted else changes
    return kept.unionByName(new.select(*rows.columns))


def region_map(pixels: DataFrame, regions: DataFrame, edge: float = 16.0) -> DataFrame:
    """Pixels with the last region (by ``ord``) whose polygon holds them, 0 for none.

    A region goes to all grid buckets that its bounding box touches, and pixels meet it by bucket, so any number
    of regions will do.
    """
    ends = lambda c: (f(F.transform("vertices", lambda p: p[c])) for f in (F.array_min, F.array_max))
    bucket = lambda c: F.floor(c / edge)
    (x0, x1), (y0, y1) = ends("x"), ends("y")
    boxes = regions.select("region_id", "ord", "vertices", F.explode(F.sequence(bucket(x0), bucket(x1))).alias("bx"), y0.alias("y0"), y1.alias("y1"))
    boxes = boxes.select("region_id", "ord", "vertices", "bx", F.explode(F.sequence(bucket(F.col("y0")), bucket(F.col("y1")))).alias("by"))
    x, y = F.col("x"), F.col("y")
    hit = pixels.withColumns({"bx": bucket(x), "by": bucket(y)}).join(boxes, ["bx", "by"]).filter(inside(F.col("vertices"), x, y))
    last = hit.groupBy("image_id", "y", "x").agg(F.max(F.struct("ord", "region_id")).alias("r"))
    return pixels.join(last, ["image_id", "y", "x"], "left").withColumn("region_id", F.coalesce("r.region_id", F.lit(0))).drop("r")


def union_lattices(lattices: list[DataFrame]) -> DataFrame:
    out = lattices[0]
    for other in lattices[1:]:
        out = out.unionByName(other)
    return out


def replace_region(peaks: DataFrame, new: DataFrame, in_region: Column) -> DataFrame:
    """The region's peaks give way to new ones."""
    return peaks.filter(~in_region).unionByName(new)


def merge_params(params: DataFrame, local: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Heights that a local fit has found take the place of the old ones."""
    found = local.select("image_id", "peak_id", F.col("height").alias("__new"))
    return params.join(found, ["image_id", "peak_id"], "left").withColumn("height", F.coalesce("__new", "height")).drop("__new")


def blend_shared(value: Column, new: Column, share: Column) -> Column:
    """Shared parameters move by the share of peaks that were fitted."""
    return value + (new - value) * share


def append_version(history: DataFrame, current: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """History with the current places under the next version, unless all are those of the last one."""
    last = history.groupBy("image_id").agg(F.max("version").alias("version"))
    old = history.join(last, ["image_id", "version"]).select("image_id", "peak_id", F.col("x").alias("__x"), F.col("y").alias("__y"))
    both = current.join(old, ["image_id", "peak_id"], "full")
    far = F.coalesce(F.greatest(F.abs(F.col("x") - F.col("__x")), F.abs(F.col("y") - F.col("__y"))), F.lit(float("inf"))) > tolerance
    moved = both.groupBy("image_id").agg(F.max(far).alias("moved")).filter("moved")
    new = current.join(moved.select("image_id"), "image_id", "left_semi").join(last, "image_id", "left")
    return history.unionByName(new.withColumn("version", F.coalesce(F.col("version") + 1, F.lit(0))).select(*history.columns))
