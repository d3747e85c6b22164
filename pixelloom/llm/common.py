"""Small helpers that the text operators share."""

from __future__ import annotations

import atexit
import shutil
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
#: Most rows of a table of ids and hashes that is broadcast: some 25 MB in memory.
BROADCAST_ROWS = 250_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are; pure ASCII takes the quick built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it, such that no column has it."""
    while name in df.columns:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="pixelloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: cuts the lineage,
    is computed once, and outlives executors. A filter on the column ``by`` reads its own files only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few numbers a row, marked for a broadcast if it has no more rows than ``most``
    (its count comes from the files' footers); a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.count() <= most else df
