"""Token counts by a two-tier lookup on the map side, without any shuffle of pre-tokens.

A piece of the vocabulary never runs across a blank or a line feed (checked when the table is
built), so the counts of a text's pre-tokens add up to the count of the text. Tier one is a broadcast
table with the lengths of the pre-tokens that are frequent in a sample of the texts, of bounded size.
Tier two is each Python worker's cache of what its texts hold besides, filled by the library and
emptied when full. Neither can change a count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The library writes blanks as this mark, and reads the mark as a blank.
MARK = "▁"
#: Most entries of a worker's cache, and the longest that it keeps.
CACHE, LONGEST = 400_000, 64
#: About as many documents are in the sample, and the broadcast table has the most frequent of their pre-tokens.
SAMPLE, FREQUENT = 4000, 100_000


@lru_cache(maxsize=2)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_vocabulary(path: str) -> None:
    lib = library(path)
    pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
        raise ValueError("pieces of this vocabulary run across words; pre-tokens can't be counted one by one")


def frequent_lengths(docs: DataFrame, path: str, sample: int = SAMPLE, most: int = FREQUENT) -> dict[str, int]:
    """Lengths of the ``most`` pre-tokens that are most frequent in about ``sample`` documents, picked by a hash of their text.

    Only the sample's pre-tokens are counted in Spark, so what is shuffled and sent here is bounded by it.
    """
    check_vocabulary(path)
    share = max(1, docs.count() // sample)
    picked = docs.select("text").filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(share)) == 0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = Counter(u for t in b.text for u in marked_words(t) if len(u) <= LONGEST)
            yield pd.DataFrame({"unit": list(found.keys()), "n": list(found.values())})

    counts = picked.mapInPandas(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).filter("n > 1")
    units = [r["unit"] for r in counts.orderBy(F.desc("n"), "unit").limit(most).collect()]
    return {u: _length(library(path), u) for u in units}


#: Pre-tokens of a text with a blank before it: a run of blanks with the word after it, or a line feed with the word after it.
_UNITS = re.compile(r" +[^ \n]*|\n[^ \n]*")


def marked_words(text: str) -> list[str]:
    """Pre-tokens: a word without the one blank before it (further blanks stay), or "\n" and the first word of a line."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if text[0] == " " or "  " in text:
        return [u[1:] if u[0] == " " else u for u in _UNITS.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def _length(library, unit: str) -> int:
    """The library puts a blank before what it is given, which stands for the one before the word."""
    n = len(library.encode(unit, num_threads=1)) if unit else 1  # nothing: the blank alone
    return n - 1 if unit[:1] == "\n" else n  # no blank stands before a line feed


class _Lengths(dict):
    """Pre-token -> number of tokens; asks the library for those it hasn't."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.library, self.base = library(path), frequent

    def __missing__(self, key: str) -> int:
        n = _length(self.library, key)
        if len(key) <= LONGEST:
            if len(self) >= CACHE + len(self.base):
                self.clear()
                self.update(self.base)
            self[key] = n
        return n


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    ``n_tokens`` is what the library gives, without begin and end. Null counts as empty: 0 tokens.
    Repeated rows each give a row; other columns aren't carried.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_path))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = _Lengths(model_path, frequent.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "n_bytes": b.n_bytes, "n_tokens": [sum(map(lengths.__getitem__, marked_words(t))) for t in b.text]})

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def lookups(docs: DataFrame, model_path: str) -> DataFrame:
    """One row: how many pre-tokens there are (units), and how many tier one, tier two and the library answer."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_path))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = _Lengths(model_path, frequent.value)
        for b in batches:
            n = Counter()
            for u in (u for t in b.text for u in marked_words(t or "")):
                n["first" if u in lengths.base else "second" if u in lengths else "library"] += 1
                lengths[u]
            yield pd.DataFrame({"units": [sum(n.values())], **{k: [n[k]] for k in ("first", "second", "library")}})

    sums = (F.sum(c).alias(c) for c in ("units", "first", "second", "library"))
    return docs.select("text").mapInPandas(count, "units long, first long, second long, library long").agg(*sums)
