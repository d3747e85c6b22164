"""Queries of sorts, top-k, set operations and keyed changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets as O
from ..operators.filters import in_circle
from .base import NX, NY, peaks, peaks_ref, pixels, register, rounded, sql, table


@register("argmin_argmax", "SELECT l_suppkey, idx, score FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS idx, l_quantity AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey * 10 + l_linenumber) AS k FROM lineitem) t WHERE k = 1")
def argmin_argmax(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.col("l_quantity").alias("score"))
    return O.argmin(rows, "score", "idx", "l_suppkey")


@register("sort_components", "SELECT s_nationkey AS model, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS k, s_acctbal AS mean, s_acctbal / 10 AS var FROM supplier")
def sort_components(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("model"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("mean"), (F.col("s_acctbal") / 10).alias("var"))
    return O.sort_components(s)


@register("topk_peaks", sql("SELECT image_id, y, x, v FROM pixels ORDER BY v DESC, image_id, y, x LIMIT 30", "pixels"))
def topk_peaks(spark, d):
    return O.topk(pixels(spark, d), 30, "v", ["image_id", "y", "x"]).select("image_id", "y", "x", "v")


@register("best_n_components", "SELECT event_type, user_id AS n, round(score, 6) AS score FROM (SELECT event_type, user_id, score, row_number() OVER (PARTITION BY event_type ORDER BY score, user_id) AS k FROM (SELECT event_type, user_id, sum(round(value * 100)) AS score FROM events GROUP BY 1, 2) s) t WHERE k = 1")
def best_n_components(spark, d):
    s = table(spark, d, "events").groupBy("event_type", F.col("user_id").alias("n")).agg(F.sum(F.round(F.col("value") * 100)).alias("score"))
    return rounded(O.argmin(s, "score", "n", "event_type"))


@register("distinct_columns", "SELECT l_suppkey AS x, l_linenumber AS y, idx, z, symbol FROM (SELECT l_suppkey, l_linenumber, l_orderkey * 10 + l_linenumber AS idx, l_partkey AS z, l_returnflag AS symbol, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey * 10 + l_linenumber, l_partkey, l_returnflag) AS k FROM lineitem) t WHERE k = 1")
def distinct_columns(spark, d):
    atoms = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("x"), F.col("l_linenumber").alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.col("l_partkey").alias("z"), F.col("l_returnflag").alias("symbol")
    )
    return O.distinct_columns(atoms)


@register(
    "region_upsert",
    """WITH change AS (SELECT p_partkey * 3 AS c_custkey, p_brand AS name, p_size < 10 AS gone FROM part)
      SELECT c_custkey, c_mktsegment AS name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM change)
      UNION ALL SELECT c_custkey, name FROM change WHERE NOT gone""",
)
def region_upsert(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"))
    changes = table(spark, d, "part").select((F.col("p_partkey") * 3).alias("c_custkey"), F.col("p_brand").alias("name"), (F.col("p_size") < 10).alias("gone"))
    return O.upsert(rows, changes, ["c_custkey"], "gone")


_REGIONS = [(1, 1, [(3.5, 3.5), (40.5, 3.5), (40.5, 30.5), (3.5, 30.5)]), (2, 2, [(20.5, 10.5), (60.5, 10.5), (60.5, 45.5), (20.5, 45.5)])]


@register(
    "region_map",
    sql("SELECT image_id, y, x, CASE WHEN x > 20.5 AND x <= 60.5 AND y > 10.5 AND y <= 45.5 THEN 2 WHEN x > 3.5 AND x <= 40.5 AND y > 3.5 AND y <= 30.5 THEN 1 ELSE 0 END AS region_id FROM pixels", "pixels"),
)
def region_map(spark, d):
    regions = spark.createDataFrame(_REGIONS, "region_id int, ord int, vertices array<struct<x:double,y:double>>")
    return O.region_map(pixels(spark, d), regions).select("image_id", "y", "x", "region_id")


@register("union_lattices", sql("SELECT image_id, peak_id, atom_type FROM peaks UNION ALL SELECT image_id, peak_id, 5 FROM peaks_ref", "peaks", "peaks_ref"))
def union_lattices(spark, d):
    cols = ("image_id", "peak_id", "atom_type")
    return O.union_lattices([peaks(spark, d).select(*cols), peaks_ref(spark, d).withColumn("atom_type", F.lit(5)).select(*cols)])


@register("replace_region_peaks", sql("SELECT image_id, peak_id, atom_type FROM peaks WHERE NOT power(x - 31.5, 2) + power(y - 23.5, 2) < 100 UNION ALL SELECT image_id, peak_id, 7 FROM peaks_ref WHERE power(x - 31.5, 2) + power(y - 23.5, 2) < 100", "peaks", "peaks_ref"))
def replace_region_peaks(spark, d):
    hit, cols = in_circle(NX, NY, 10), ("image_id", "peak_id", "atom_type")
    new = peaks_ref(spark, d).filter(hit).withColumn("atom_type", F.lit(7))
    return O.replace_region(peaks(spark, d), new, hit).select(*cols)


@register("merge_local_params", sql("SELECT p.image_id, p.peak_id, round(CASE WHEN p.atom_type = 1 THEN r.x + 1 ELSE p.x END, 6) AS height, round(2 + (3 - 2) * (SELECT avg(CASE WHEN atom_type = 1 THEN 1.0 ELSE 0.0 END) FROM peaks q WHERE q.image_id = p.image_id), 6) AS sigma FROM peaks p JOIN peaks_ref r ON p.image_id = r.image_id AND p.peak_id = r.peak_id", "peaks", "peaks_ref"))
def merge_local_params(spark, d):
    params = peaks(spark, d).withColumn("height", F.col("x"))
    local = peaks_ref(spark, d).filter("atom_type = 1").withColumn("height", F.col("x") + 1)
    share = params.groupBy("image_id").agg(F.avg((F.col("atom_type") == 1).cast("double")).alias("share"))
    out = O.merge_params(params, local).join(F.broadcast(share), "image_id")
    return rounded(out.select("image_id", "peak_id", "height", O.blend_shared(F.lit(2.0), F.lit(3.0), F.col("share")).alias("sigma")))


@register("coordinate_history", sql("SELECT 0 AS version, image_id, peak_id, x, y FROM peaks_ref UNION ALL SELECT 1, image_id, peak_id, round(x, 6), round(y, 6) FROM peaks", "peaks", "peaks_ref"))
def coordinate_history(spark, d):
    cols = ("version", "image_id", "peak_id", "x", "y")
    first = peaks_ref(spark, d).withColumn("version", F.lit(0)).select(*cols)
    twice = O.append_version(O.append_version(first, peaks(spark, d)), peaks(spark, d))  # the second time nothing has moved
    return rounded(twice)
