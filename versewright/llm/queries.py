"""The queries opN_<name> over whole tables: thin digests of the operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, embeddings, html_text, jaccard, packing, quality, suffixes, token_counts, warc

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, offsets=False)
    both = bpe.decode(ids, RANKS)
    line = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(line, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, 2048).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY).withColumn("over_limit", F.col("n_tokens") > 512)


def op10_packed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.matrices(table(spark, sf_dir, "documents"), VOCABULARY, 2048)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", (~F.col("base_failed") & F.col("kept")).alias("kept"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), common.new_path(spark, "warc"))
    found = warc.records(warc.read(spark, archives))
    return found.select(F.col("record_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove(table(spark, sf_dir, "documents"), 400, with_text=True)
    spans = F.size("removed").cast("long").alias("n_spans")
    return left.select("doc_id", "n_bytes", "n_removed", spans, F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"), F.col("kept_text").alias("text"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


WORD = r"[^\x20\x09-\x0D]+"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 8) AS s(k) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 100 * n_symbols > 50 * n_words AND NOT 2 * word_chars < 3 * n_words AND NOT (n_dup_lines > 2 AND 100 * n_dup_lines > 50 * n_lines) AS kept FROM b"""


def jaccard_sql(n: int, num: int, den: int, tail: str) -> str:
    """Components of the documents by whole inverted lists; ``tail`` selects from s (sizes) and comp (doc_id, component_id)."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {n - 1}, least(len(ws), 1)) + 1)) AS i FROM w)),
s AS (SELECT w.doc_id, count(g.g) AS n_shingles FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY w.doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE {den} * k >= {num} * (x.n_shingles + y.n_shingles - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e2.b FROM reach JOIN e2 ON e2.a = reach.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
{tail}"""


#: SHA-1 in base32: of each five hexadecimal digits, twenty bits, four characters.
BASE32_SQL = "array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || {0}[k // 4 * 5 + 1:k // 4 * 5 + 5])::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1]), '')"
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS c, row_number() OVER () AS r FROM pages), t AS (SELECT *, first_value(r) OVER w AS top, first_value(page_id) OVER w AS top_id FROM p WINDOW w AS (PARTITION BY c ORDER BY page_id DESC NULLS LAST, r))
SELECT page_id, strlen(c) AS payload_bytes, {BASE32_SQL.format("sha1(c)")} AS payload_digest, CASE WHEN r = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> top THEN top_id END AS refers_to FROM t"""
OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), u AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, e.b FROM reach JOIN e ON e.a = reach.other),
comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_best_fit_packing, op3_html_text, op4_token_counts, op5_quality_rules, op6_warc, op7_suffix_dedup, op8_embedding_dedup, op9_ngram_jaccard, op10_packed_output)}
ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op8_embedding_dedup": OP8_SQL,
    "op9_ngram_jaccard": jaccard_sql(4, 85, 100, "SELECT doc_id, n_shingles, component_id FROM s JOIN comp USING (doc_id)"),
}
