"""Benchmark decontamination: word windows of test items found in training documents.

The items' distinct windows are a broadcast hash table (its size is checked). Each document's windows
stream past it within one stage, are compared as text where the hash hits, and only hits and one row
for each document go on. Of a larger table a bit map of its hashes is sent instead, and only the few
windows whose bits are set meet it by a shuffle. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, small_side, stored

WINDOW = 10
#: Most windows that are broadcast: about 100 MB with their texts.
BROADCAST_WINDOWS = 500_000
#: Bits of the map for a larger table: 16 for each window, within these powers of two (at most 16 MB).
MAP_BITS = (16, 27)
#: All characters that are not part of a word, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(n, hash, gram, items): each distinct window of n words with the ids of the items that hold it.

    An item of fewer words is one window; one without words gives none. Items with a null id make
    windows that hit but are not listed.
    """
    n = F.least(F.size("w"), F.lit(window))
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).select("item_id", "w", n.alias("n"))
    each = w.select("item_id", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"), "w")
    cut = F.slice("w", F.col("i"), F.col("n"))
    return (
        each.select("item_id", "n", F.array_join(cut, " ").alias("gram"), F.xxhash64(cut).alias("hash"))
        .groupBy("n", "hash", "gram")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row of ``docs`` without its text, with row, n_words, spans (array of first word and length) and items.

    Null and empty texts have no words. Rows are told apart by their place in the input, so repeated
    ids and rows each keep their own result. An empty benchmark leaves everything clean.
    """
    grams = stored(item_windows(benchmark, window), "item-windows")
    sizes = {r["n"]: r["count"] for r in grams.groupBy("n").count().collect()}  # one row for each length up to ``window``
    kept = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*kept).alias("doc"), F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    # place 0 stands for the document itself, so that one without hits isn't lost
    places = rows.select("doc", "row", "w", F.explode(F.array(*map(F.lit, sorted(sizes) or [window]))).alias("n"))
    places = places.select("doc", "row", "w", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - F.col("n") + 1, F.lit(0)))).alias("i"))
    cut = F.slice("w", F.greatest(F.col("i"), F.lit(1)), F.col("n"))
    # place 0 has a hash that deals it out like any other, but meets nothing
    keyed = places.select("doc", "row", F.size("w").cast("long").alias("n_words"), "n", "i", cut.alias("cut")).withColumn(
        "hash", F.when(F.col("i") > 0, F.xxhash64("cut")).otherwise(F.xxhash64("row"))
    )
    g = grams.select(F.col("n").alias("g_n"), F.col("hash").alias("g_hash"), "gram", "items")

    if sum(sizes.values()) <= BROADCAST_WINDOWS:
        g = F.broadcast(g)
    else:
        bits = min(max((16 * sum(sizes.values())).bit_length(), MAP_BITS[0]), MAP_BITS[1])
        mapped = stored(_bit_map(grams, bits), "window-bits")
        keyed = keyed.withColumn("map", mapped.scalar())
        keyed = keyed.filter((F.col("i") == 0) | _is_set(F.col("map"), F.col("hash"), bits, 0) & _is_set(F.col("map"), F.col("hash"), bits, 32)).drop("map")
    same = (keyed["hash"] == g["g_hash"]) & (keyed["n"] == g["g_n"]) & (F.col("i") > 0) & (F.array_join("cut", " ") == g["gram"])
    found = keyed.join(g, same, "left").filter((F.col("i") == 0) | F.col("gram").isNotNull())
    span = F.when(F.col("i") > 0, F.struct((F.col("i") - 1).alias("at"), F.col("n").alias("len")))
    return found.groupBy("row").agg(
        F.first("doc").alias("doc"),
        F.first("n_words").alias("n_words"),
        F.collect_set(span).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _bit(hash_: Column, bits: int, shift: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hash_, shift), F.lit(1 << bits)).cast("int")


def _is_set(map_: Column, hash_: Column, bits: int, shift: int) -> Column:
    at = _bit(hash_, bits, shift)
    return F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", F.get(map_, F.floor(at / 64).cast("int")), at % 64)) == 1


def _bit_map(grams: DataFrame, bits: int) -> DataFrame:
    """One row: ``map``, an array of longs, with the two bits of each window's hash set."""
    at = grams.select(F.explode(F.array(_bit(F.col("hash"), bits, 0), _bit(F.col("hash"), bits, 32))).alias("at"))
    set_ = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.expr("1L"), F.col("at") % 64)).alias("b"))
    every = grams.sparkSession.range(max(1, (1 << bits) // 64)).select(F.col("id").cast("int").alias("k")).join(set_, "k", "left").select("k", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]).alias("map"))


def hit_words(spans: Column) -> Column:
    """Places (from 0) of the words inside any span, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every document.

    A word inside any occurrence of an item's window is hit; items lists the items with windows that
    occur, sorted as strings.
    """
    f = find_hits(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.size(hit_words(F.col("spans"))).cast("long")
    return f.select(F.col("doc.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "items", (n_hit > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, all columns as they were.

    Rows are held against hits by id and text, so that rows of one id with other texts stay.
    """
    f = find_hits(docs.select("doc_id", "text", F.xxhash64("text").alias("__text")), benchmark, window)
    bad = small_side(stored(f.filter(F.size("spans") > 0).select(F.col("doc.doc_id").alias("__id"), F.col("doc.__text").alias("__hash")).distinct(), "contaminated"))
    same = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__hash"])
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, each hit word cut from the text together with what follows it up to the next word.

    Texts without hits, null ones too, stay as they are; n_chars follows the text if it is there.
    """
    f = find_hits(docs.select("doc_id", "text", F.xxhash64("text").alias("__text")), benchmark, window)
    id_, hash_, hit = (free_name(docs, n) for n in ("id_of", "hash_of", "hit"))
    bad = f.filter(F.size("spans") > 0).select(
        F.col("doc.doc_id").alias(id_), F.col("doc.__text").alias(hash_), hit_words(F.col("spans")).alias(hit)
    ).dropDuplicates([id_, hash_])
    same = docs["doc_id"].eqNullSafe(bad[id_]) & (F.xxhash64(docs["text"]) == bad[hash_])
    joined = docs.join(bad, same, "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    parts = F.regexp_extract_all(F.col("text"), F.lit(f"(?s)({word})([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)"), F.lit(0))
    lead = F.regexp_extract("text", r"(?s)^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(hit))
    rest = F.concat(lead, F.array_join(F.transform(left, lambda i: F.get(parts, i)), ""))
    text = F.when(F.col(hit).isNull(), F.col("text")).otherwise(rest)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(hit).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
