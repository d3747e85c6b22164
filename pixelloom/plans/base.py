"""Registry of queries and the input views that they share.

The views read whole tables: ``pixels`` are seven images (one for each line number) of summed
quantities, ``peaks`` are the parts dealt over these images, ``samples`` are event values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NX, NY = 64, 48

_VIEWS = {
    "pixels": "SELECT l_linenumber AS image_id, CAST(l_suppkey % 48 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3",
    "peaks": """SELECT CAST(1 + p_partkey % 7 AS INTEGER) AS image_id, min(p_partkey) AS peak_id,
      CAST((p_partkey * 13) % 64 AS DOUBLE) + CAST(sum(p_size) AS DOUBLE) / (100.0 * count(*)) AS x,
      CAST((p_partkey * 7) % 48 AS DOUBLE) + CAST(sum(p_size) AS DOUBLE) / (200.0 * count(*)) AS y,
      CAST(min(p_partkey) % 3 AS INTEGER) AS atom_type
      FROM part GROUP BY CAST(1 + p_partkey % 7 AS INTEGER), (p_partkey * 13) % 64, (p_partkey * 7) % 48""",
    "peaks_ref": """SELECT CAST(1 + p_partkey % 7 AS INTEGER) AS image_id, min(p_partkey) AS peak_id,
      CAST((p_partkey * 13) % 64 AS DOUBLE) AS x, CAST((p_partkey * 7) % 48 AS DOUBLE) AS y, CAST(min(p_partkey) % 3 AS INTEGER) AS atom_type
      FROM part GROUP BY CAST(1 + p_partkey % 7 AS INTEGER), (p_partkey * 13) % 64, (p_partkey * 7) % 48""",
    "samples": "SELECT event_id AS id, user_id, value AS v FROM events",
}


def sql(body: str, *views: str) -> str:
    """``body`` over the named views; it may go on with further common tables after a comma."""
    named = ", ".join(f"{v} AS ({_VIEWS[v]})" for v in views)
    body = body.strip()
    if not named:
        return body
    return f"WITH {named}{body}" if body.startswith(",") else f"WITH {named} {body}"


def register(name: str, oracle: str | None = None):
    """Adds a query, and its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(
        F.col("l_linenumber").alias("image_id"), (F.col("l_suppkey") % NY).cast("int").alias("y"), (F.col("l_partkey") % NX).cast("int").alias("x")
    ).agg(F.sum("l_quantity").alias("v"))


def _peaks(spark: SparkSession, sf_dir: str, by_size: bool) -> DataFrame:
    key = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").groupBy(
        (key % 7 + 1).cast("int").alias("image_id"), ((key * 13) % NX).cast("double").alias("cx"), ((key * 7) % NY).cast("double").alias("cy")
    ).agg(F.min(key).alias("peak_id"), F.sum("p_size").cast("double").alias("size"), F.count("*").alias("n"))
    x, y = F.col("cx"), F.col("cy")
    if by_size:
        x, y = x + F.col("size") / (F.lit(100.0) * F.col("n")), y + F.col("size") / (F.lit(200.0) * F.col("n"))
    return cells.select("image_id", "peak_id", x.alias("x"), y.alias("y"), (F.col("peak_id") % 3).cast("int").alias("atom_type"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peaks(spark, sf_dir, True)


def peaks_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peaks(spark, sf_dir, False)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("value").alias("v"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, and negative zeros made positive, so that results compare across engines."""
    return df.select(*((F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
