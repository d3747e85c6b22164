"""Distance joins as equi-joins on grid buckets.

A plain distance predicate would be a nested-loop join. Here each row of the right side goes to the
3 x 3 buckets round its own (their edge is the radius), the sides meet on keys and bucket, and the
exact predicate filters what is left. The right side should be the one with fewer rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX = "_r"


def _bucket(c: str, edge: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(edge)))


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = ("image_id",), how: str = "inner", box: bool = False, closed: bool = False) -> DataFrame:
    """Rows of both sides closer than ``radius`` (``closed``: at most), with d2.

    Columns of the right side get the suffix ``_r``. ``box``: the larger of both distances along the
    axes counts in place of the Euclidean one. ``how``: inner, left, left_semi or left_anti.
    """
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    r = right.select(*(F.col(c).alias(c + SUFFIX) for c in right.columns), _bucket("x", radius).alias("bx"), _bucket("y", radius).alias("by"), F.explode(around).alias("o"))
    r = r.withColumns({"bx": F.col("bx") + F.col("o.i"), "by": F.col("by") + F.col("o.j")}).drop("o")
    l = left.withColumns({"lx": _bucket("x", radius), "ly": _bucket("y", radius)})  # noqa: E741
    dx, dy = F.col("x") - F.col("x_r"), F.col("y") - F.col("y_r")
    d2 = F.greatest(dx * dx, dy * dy) if box else dx * dx + dy * dy
    on = (F.col("lx") == F.col("bx")) & (F.col("ly") == F.col("by")) & ((d2 <= radius * radius) if closed else (d2 < radius * radius))
    for k in keys:
        on = on & (F.col(k) == F.col(k + SUFFIX))
    out = l.join(r, on, how)
    if how in ("left_semi", "left_anti"):
        return out.drop("lx", "ly")
    return out.withColumn("d2", dx * dx + dy * dy).drop("lx", "ly", "bx", "by")


def nearest(left: DataFrame, right: DataFrame, radius: float, left_id: tuple[str, ...], right_id: str = "peak_id", keys: tuple[str, ...] = ("image_id",), how: str = "inner") -> DataFrame:
    """For each left row the nearest right one closer than ``radius``; of equals the least id.

    Returns keys, left_id, right_id + "_r" and d2. Combined before the shuffle, so a dense bucket sends one row.
    """
    pairs = near_pairs(left, right, radius, keys, how)
    best = F.min(F.when(F.col("d2").isNotNull(), F.struct("d2", F.col(right_id + SUFFIX).alias("id"))))
    return pairs.groupBy(*keys, *left_id).agg(best.alias("b")).select(*keys, *left_id, F.col("b.id").alias(right_id + SUFFIX), F.col("b.d2").alias("d2"))
