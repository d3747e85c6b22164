"""Loops on the driver around Spark jobs."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


class NotConverged(UserWarning):
    """A loop has ended by its number of rounds; its result isn't settled yet."""


def timed(f: Callable) -> Callable:
    """Logs the wall time of each call on the driver."""

    @wraps(f)
    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            logging.getLogger(__name__).info("%s took %.3f s", f.__name__, time.perf_counter() - began)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors see; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="pixelloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` to go on with in a loop: written as a Parquet table in the shared folder and read back.

    That cuts the lineage, is computed once and outlives executors. A checkpoint would hand on the estimated
    size of the plan that it comes from, which grows from round to round; here it comes from the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
