"""Queries of atom counting and of outliers by a forest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import counting as C
from ..operators import forest, selection
from .base import peaks, pixels, register, rounded, samples, sql, table

_LIBRARY = "l AS (SELECT scs, min(t) AS t FROM (SELECT p_size AS t, sum(p_retailprice) / count(*) AS scs FROM part GROUP BY p_size) u GROUP BY scs)"


@register(
    "library_counts",
    f"""WITH {_LIBRARY}, n AS (SELECT scs, t, lead(scs) OVER (ORDER BY scs) AS scs2, lead(t) OVER (ORDER BY scs) AS t2 FROM l),
      v AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS v FROM lineitem), f AS (SELECT * FROM n ORDER BY scs LIMIT 1),
      a AS (SELECT v.*, n.scs, n.t, n.scs2, n.t2 FROM v ASOF LEFT JOIN n ON v.v >= n.scs)
      SELECT l_orderkey, l_linenumber, CAST(CASE WHEN a.scs IS NULL THEN f.t WHEN a.scs2 IS NULL THEN a.t WHEN v - a.scs <= a.scs2 - v THEN a.t ELSE a.t2 END AS DOUBLE) AS count,
        round(CASE WHEN a.scs IS NULL THEN f.t WHEN a.scs2 IS NULL THEN a.t ELSE a.t + (v - a.scs) / (a.scs2 - a.scs) * (a.t2 - a.t) END, 5) + 0.0 AS thickness FROM a, f""",
)
def library_counts(spark, d):
    """Unit prices held against the mean price of each size."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    library = table(spark, d, "part").groupBy(F.col("p_size").alias("thickness")).agg((F.sum("p_retailprice") / F.count("*")).alias("scs"))
    return rounded(C.match_library(line, library).select("l_orderkey", "l_linenumber", "count", "thickness"), 5)


def _columns(spark, d):
    return peaks(spark, d).withColumn("count", (F.col("peak_id") % 6).cast("int"))


_ATOMS = ", a AS (SELECT image_id, peak_id, x, y, atom_type, k, (k - (n - 1) / 2.0) * 2.5 + atom_type * 0.5 AS z FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, peak_id % 6 AS n FROM peaks) t) u)"


@register("model_3d", sql(_ATOMS + " SELECT image_id, peak_id, CAST(k AS INTEGER) AS k, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) + 0.0 AS z FROM a", "peaks"))
def model_3d(spark, d):
    """Columns of up to five atoms, the types at three heights."""
    return rounded(C.stacked(_columns(spark, d), 2.5, F.col("atom_type") * 0.5).select("image_id", "peak_id", "k", "x", "y", "z"))


@register(
    "coordination_numbers",
    sql(_ATOMS + """ SELECT a.image_id, a.peak_id, CAST(a.k AS INTEGER) AS k, count(b.peak_id) AS neighbours FROM a LEFT JOIN a b
      ON a.image_id = b.image_id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 20.25 AND NOT (a.peak_id = b.peak_id AND a.k = b.k) GROUP BY 1, 2, 3""", "peaks"),
)
def coordination_numbers(spark, d):
    atoms = C.stacked(_columns(spark, d), 2.5, F.col("atom_type") * 0.5)
    return C.coordination(atoms, 4.5).select("image_id", "peak_id", "k", "neighbours")


@register("hmm_counts")
def hmm_counts(spark, d):
    """Counts of each user over time; a test holds the chunks against a plain Viterbi over whole series."""
    events = table(spark, d, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("t"), "value")
    return C.viterbi(events, [20.0 * k for k in range(8)], 15.0, 0.2, 7 * 86400.0, id_="event_id", value="value").select("user_id", "event_id", "state")


@register("filter_outliers_forest")
def filter_outliers_forest(spark, d):
    """By an isolation forest; a test holds path lengths against plain recursion. ``filter_outliers_high`` goes by a percentile."""
    return forest.without_high_outliers(samples(spark, d)).select("id", "v")


@register("model_selection")
def model_selection(spark, d):
    """Whether one, two or three peaks, from its brightest pixels on, explain a square of an image best; a test has known truth."""
    tile = {"tx": F.floor(F.col("x") / 16).cast("int"), "ty": F.floor(F.col("y") / 16).cast("int")}
    keys = ("image_id", "tx", "ty")
    squares = pixels(spark, d).withColumns(tile)
    bright = squares.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v"), "y", "x"))).filter("nth <= 3")
    floor = squares.groupBy(*keys).agg(F.min("v").alias("background"))
    starts = bright.join(floor, list(keys)).withColumn("model", F.explode(F.sequence(F.col("nth"), F.lit(3))))
    starts = starts.select(*keys, "model", "x", "y", (F.col("v") - F.col("background")).alias("height"), F.lit(1.5).alias("sigma"), "background")
    found = selection.most_probable(selection.model_evidence(squares, starts, keys), keys)
    return rounded(found.select(*keys, "model", "n_peaks", "log_evidence", "posterior", "chosen"), 2)
