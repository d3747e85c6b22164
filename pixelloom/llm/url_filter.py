"""URL filter: allow and block rules, and for the rest a ratio of two character models.

The models are Markov models over a folded URL alphabet, blended from the orders 2, 1 and 0 by
Witten-Bell weights (a context that has been seen often and with few successors speaks for itself,
any other hands on to the shorter one). One model is fitted on URLs that the rules accept, one on
those they reject, always over every page. The score is the log-likelihood difference per
character; its threshold is calibrated on a quarter of the labelled URLs, by models of the others.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, stored

#: (host, path, verdict); a rule fits its host and all subdomains and paths that start with its own.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Symbol 0 is the edge, then these characters (digits folded to 0), then "other".
ALPHABET = "abcdefghijklmnopqrstuvwxyz0.-/_?=&#:%"
SIZE = len(ALPHABET) + 2


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both empty for a null URL or one without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.withColumns(
        {"host": ascii_lower(F.regexp_extract(u, pattern, 1)), "path": F.regexp_extract(u, pattern, 2)}
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _symbols(url: Column) -> Column:
    """Codes of what follows ``://`` (else of all), two edges before and one after."""
    u = F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), r"(?s)^.*?://", "")
    chars = F.array_remove(F.split(F.translate(u, "123456789", "000000000"), ""), "")
    code = F.transform(
        chars,
        lambda c: F.when(F.call_function("instr", F.lit(ALPHABET), c) > 0, F.call_function("instr", F.lit(ALPHABET), c)).otherwise(SIZE - 1),
    )
    return F.concat(F.array(F.lit(0), F.lit(0)), code, F.array(F.lit(0)))


def _cells(symbols: Column) -> Column:
    """Index of each three consecutive symbols in the dense model."""
    return F.transform(
        F.sequence(F.lit(0), F.size(symbols) - 3),
        lambda i: F.get(symbols, i) * (SIZE * SIZE) + F.get(symbols, i + 1) * SIZE + F.get(symbols, i + 2),
    )


def cell_counts(labelled: DataFrame, *by: str) -> DataFrame:
    """(accepted, by, cell, n): counts over all rows of ``labelled`` (url, accepted), combined before the shuffle, so
    that at most 2 * SIZE**3 rows for each value of ``by`` leave a task."""
    cells = labelled.select("accepted", *by, F.explode(_cells(_symbols(F.col("url")))).alias("cell"))
    return cells.groupBy("accepted", *by, "cell").agg(F.count("*").alias("n"))


def train(labelled: DataFrame) -> DataFrame:
    """One row: ``model``, the log ratio accepted / rejected of every cell, from all rows of ``labelled``."""
    return model_of(cell_counts(labelled))


def model_of(counts: DataFrame) -> DataFrame:
    """One row: ``model``. With no counts of a class its model is uniform."""
    grid = counts.sparkSession.range(2 * SIZE**3, numPartitions=4).select(
        (F.col("id") >= SIZE**3).alias("accepted"), (F.col("id") % SIZE**3).cast("int").alias("cell")
    )
    t = grid.join(counts, ["accepted", "cell"], "left").select(
        "accepted",
        "cell",
        F.floor(F.col("cell") / SIZE).alias("ab"),
        (F.floor(F.col("cell") / SIZE) % SIZE).alias("b"),
        (F.col("cell") % SIZE).alias("c"),
        F.coalesce("n", F.lit(0)).cast("double").alias("n"),
    )
    over = lambda *keys: Window.partitionBy("accepted", *keys)
    t = t.withColumns({"n_c": F.sum("n").over(over("c")), "n_bc": F.sum("n").over(over("b", "c"))})
    t = t.withColumns({"n_all": F.sum("n").over(over()), "n_b": F.sum("n").over(over("b")), "n_ab": F.sum("n").over(over("ab"))})
    #: Distinct successors: of ab directly; of b each (b, c) stands SIZE times, once for each a.
    t = t.withColumns(
        {
            "t_b": F.sum((F.col("n_bc") > 0).cast("double")).over(over("b")) / SIZE,
            "t_ab": F.sum((F.col("n") > 0).cast("double")).over(over("ab")),
        }
    )
    p0 = (F.col("n_c") + 1) / (F.col("n_all") + SIZE)
    p1 = F.when(F.col("n_b") > 0, (F.col("n_bc") + F.col("t_b") * p0) / (F.col("n_b") + F.col("t_b"))).otherwise(p0)
    p2 = F.when(F.col("n_ab") > 0, (F.col("n") + F.col("t_ab") * p1) / (F.col("n_ab") + F.col("t_ab"))).otherwise(p1)
    ratio = (
        t.select("cell", F.when(F.col("accepted"), F.log(p2)).otherwise(-F.log(p2)).alias("l"))
        .groupBy("cell")
        .agg(F.sum("l").alias("l"))
    )
    cells = F.array_sort(F.collect_list(F.struct("cell", F.round("l", 9).alias("l"))))
    return ratio.agg(F.transform(cells, lambda x: x["l"]).alias("model"))


def with_score(pages: DataFrame, model: DataFrame, url: str = "url", score: str = "score") -> DataFrame:
    """Adds the log-likelihood difference per character; positive: as accepted URLs are."""
    ratios, symbols = free_name(pages, "model"), free_name(pages, "symbols")
    cells = _cells(F.col(symbols))
    total = F.aggregate(cells, F.lit(0.0), lambda acc, i: acc + F.get(F.col(ratios), i))
    return pages.withColumn(ratios, model.scalar()).withColumn(symbols, _symbols(F.col(url))).withColumn(score, total / F.size(cells)).drop(ratios, symbols)


def calibrate(scored: DataFrame, bins: int = 2000, width: float = 0.005) -> DataFrame:
    """One row: ``threshold``, the score with the best mean of both classes' hit rates.

    Works on a histogram of a fixed number of bins, so nothing here grows with the input.
    Without labelled rows the threshold is 0.
    """
    half = bins // 2
    at = F.least(F.greatest(F.floor(F.col("score") / width), F.lit(-half)), F.lit(half - 1)).cast("int")
    h = scored.groupBy(at.alias("bin")).agg(
        F.sum(F.col("accepted").cast("double")).alias("good"), F.sum((~F.col("accepted")).cast("double")).alias("bad")
    )
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = h.select(
        "bin",
        (1 - F.coalesce(F.sum("good").over(below), F.lit(0.0)) / F.greatest(F.sum("good").over(every), F.lit(1.0))).alias("kept"),
        (F.coalesce(F.sum("bad").over(below), F.lit(0.0)) / F.greatest(F.sum("bad").over(every), F.lit(1.0))).alias("caught"),
    )
    best = F.max(F.struct((F.col("kept") + F.col("caught")).alias("hit"), (-F.col("bin")).alias("rank")))
    return h.agg(F.coalesce(-best["rank"] * F.lit(width), F.lit(0.0)).alias("threshold"))


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and score to every page.

    The longest fitting rule decides; without one the URL is allowed if its score reaches the
    calibrated threshold. Null and empty URLs score by the empty text; repeated rows each get
    their row; an empty table gives an empty result. Columns of these names in the input are replaced.
    """
    parts = with_parts(pages.drop("host", "path", "rule", "verdict", "score"), url)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = free_name(parts, "by_rule")
    ruled = parts.withColumns({"rule": rule, by_rule: verdict})
    held = (F.pmod(F.xxhash64(F.lit("held out"), F.col(url)), F.lit(4)) == 0).alias("held")
    labelled = ruled.filter(F.col(by_rule).isNotNull()).select(F.col(url).alias("url"), (F.col(by_rule) == "allow").alias("accepted"), held)
    counts = stored(cell_counts(labelled, "held"), "url-counts")
    model = stored(model_of(counts.groupBy("accepted", "cell").agg(F.sum("n").alias("n"))), "url-model")
    others = stored(model_of(counts.filter("NOT held").drop("held")), "url-model")
    threshold = stored(calibrate(with_score(labelled.filter("held"), others)), "url-threshold")
    by_score = F.when(F.col("score") >= threshold.scalar(), "allow").otherwise("block")
    return with_score(ruled, model, url).withColumn("verdict", F.coalesce(by_rule, by_score)).drop(by_rule)
