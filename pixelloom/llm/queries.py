"""The registered queries of this subpackage: thin digests over its operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, lexical_search, line_dedup, media, packing, periodic_runs, quality, secrets, sentence_pieces, simhash, token_count, url_filter
from .common import BLANKS, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(quality.is_held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [F.size(secrets.of_kind(F.col("base"), k)).cast("long").alias(f"n_{b[0]}") for k, b in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.span_list(F.col("base")), 256).alias("base_sha256"), secrets.span_list(F.col("secrets")).alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.text_media(table(spark, sf_dir, "documents")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return packing.pack(table(spark, sf_dir, "documents"), *vocabulary)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where each tenth document, by a hash of its id, goes on from some word with a period of some words."""
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n = F.size(words)
    g = F.floor(F.crc32(F.col("doc_id").cast("string")) / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice(words, 1, a), F.slice(again, F.lit(1), n - a)), " ")
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 10 == 0) & (trimmed != "")
    return docs.select("doc_id", F.when(chosen, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = periodic_runs.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentence_pieces.decode(sentence_pieces.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_decontaminate": op5_decontaminate,
    "op6_media": op6_media,
    "op7_html_text": op7_html_text,
    "op8_packing": op8_packing,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_lexical_search": op13_lexical_search,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d
), keyed AS (
  SELECT *, {_LOWER.replace("coalesce(text, '')", r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM each
), owner AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT keyed.*, owner.first_doc IS NOT NULL AND owner.first_doc <> keyed.doc_id AS gone FROM keyed LEFT JOIN owner ON keyed.key = owner.key
), kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY pos) AS kept FROM judged WHERE NOT gone GROUP BY r
), counted AS (
  SELECT r, max(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped FROM judged GROUP BY r
)
SELECT counted.doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM counted LEFT JOIN kept ON counted.r = kept.r
""",
    "op5_decontaminate": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0
), gram AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item) t
), place AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM gram) s) t
), hit AS (
  SELECT place.r, place.n, place.i, gram.item FROM place JOIN gram ON place.g = gram.g AND place.n = gram.n
), word AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) t GROUP BY r
), held AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) t GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(word.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(held.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(held.items, '')) AS items_sha256,
  word.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN word ON d.r = word.r LEFT JOIN held ON d.r = held.r
""",
    "op13_lexical_search": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), c AS (
  SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d
), held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) t GROUP BY r, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * c.docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, c GROUP BY term, c.docs
), scored AS (
  SELECT q.item_id, held.r, d.doc_id, CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * c.docs) // c.terms)))) AS BIGINT) AS score
  FROM q JOIN held ON q.term = held.term JOIN weight ON q.term = weight.term JOIN d ON held.r = d.r, c GROUP BY q.item_id, held.r, d.doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) t WHERE rank <= 50
""",
}
