"""Line dedup by levelled sorted runs of line hashes.

Documents come in batches, by ascending id. The store keeps the hashes of all lines seen as sorted
runs: a batch's own new lines (those that a merge anti-join finds in no run) become a run of level 0,
and as soon as a level holds ``fanout`` runs they are compacted into one of the next. Runs are
bucketed and sorted by hash, one file a bucket, and read in that order, so that a join with them
shuffles and sorts only the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, free_name, shared_dir, stored

LEAST = 10
BATCHES = 4
#: Lets joins rely on the order of bucketed files.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> tuple[Column, Column]:
    """128 bits: two hashes with independent seeds."""
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Within it, scans of runs give their rows in order, as each bucket is one sorted file."""
    before = spark.conf.get(ORDERED, "false")
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


class LineRuns:
    """Sorted runs of (h1, h2), by level: bucketed tables whose files lie in the shared folder.

    Use it in a ``with`` statement: at the end, however it comes, no table is left in the catalog.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *how) -> None:
        self.close()

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Name of the new run, and its files as a plain table."""
        name = f"line_run_{uuid.uuid4().hex}"
        try:
            rows.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", self._path(name)).saveAsTable(name)
        except BaseException:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            raise
        return name, self.spark.read.schema(rows.schema).parquet(self._path(name))

    def _path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{name}"

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The rows whose line is in no run, by one merge anti-join for each run."""
        for name in (n for level in self.levels for n in level):
            hashes = hashes.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return hashes

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds a run (of lines not yet held), compacts full levels, and gives the run's rows."""
        name, own = self._write(rows)
        self.levels[0].append(name)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            # as plain files: a union of bucketed tables would be written as it lies, in several files a bucket
            merged = self.spark.read.schema("h1 long, h2 long").parquet(*map(self._path, full))
            self.levels[level + 1].append(self._write(merged)[0])
            self.levels[level] = []
            for other in full:
                self.spark.sql(f"DROP TABLE {other}")
            level += 1
        return own

    def close(self) -> None:
        for name in (n for level in self.levels for n in level):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = [[]]


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(id, text_hash, at, h1, h2) of each line with a key of ``least`` code points or more."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    keyed = each.select("id", "text_hash", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least)
    return keyed.select("id", "text_hash", "at", *_hashes(F.col("key")))


def dropped_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = 2) -> DataFrame:
    """(id, text_hash, at): the lines that a document of a smaller id holds as well; rows without an id are the last."""
    spark = docs.sparkSession
    cuts = [i / batches for i in range(1, batches)]
    found = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), cuts, 1000).alias("c")).first()["c"] if cuts else []
    bounds = sorted(set(found or []))
    after = sum((F.when(F.col("id") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    batch = F.when(F.col("id").isNull(), len(bounds)).otherwise(after).cast("int")
    lines = stored(_lines(docs, least).withColumn("batch", batch), "lines", "batch")
    owners = None
    with LineRuns(spark, fanout) as runs, ordered_scans(spark):
        for b in range(len(bounds) + 1):
            first = lines.filter(F.col("batch") == b).groupBy("h1", "h2").agg(F.min("id").alias("owner"))
            new = runs.unseen(first)
            own = runs.add(new) if b < len(bounds) else stored(new, "first-lines")
            owners = own if owners is None else owners.union(own)
    # every line has one owner now; plain tables on both sides, so that Spark can split a very frequent line
    return lines.join(owners, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("owner"))).select("id", "text_hash", "at")


def dedup_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = 2, counts: bool = True) -> DataFrame:
    """All documents with ``text`` cut to the lines that stay, and with ``counts`` n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at
    least ``least`` code points that two documents hold or more lose their lines except in the
    document of the smallest id, where all stay. Null counts as one empty line. Rows of one id are
    one document; rows without id are one too, the last. n_chars follows the text if it is there. Columns
    named n_lines and n_dropped are replaced by the counts.
    """
    lost = dropped_lines(docs, least, batches, fanout)
    own, whole, id_, hash_, gone = (free_name(docs, n) for n in ("own_id", "own_hash", "id_of", "hash_of", "gone"))
    lost = lost.groupBy(F.col("id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.collect_set("at").alias(gone))
    text = F.coalesce("text", F.lit(""))
    keyed = (docs.drop("n_lines", "n_dropped") if counts else docs).withColumns({own: F.col("doc_id").cast("long"), whole: F.xxhash64(text)})
    joined = keyed.join(lost, F.col(own).eqNullSafe(F.col(id_)) & (F.col(whole) == F.col(hash_)), "left")
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    new = {"text": kept}
    if counts:
        new |= {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    out = joined.withColumns(new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[c for c in docs.columns if c not in new or c == "text"], *[c for c in new if c != "text"])
