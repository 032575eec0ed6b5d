"""A corpus pipeline over ``documents``: quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; all but the last
return the columns of documents. The driver writes each result and rereads it as the next stage's docs; ``run`` does so too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewright.llm import common, jaccard, packing, passages, quality, suffixes

CAPACITY = 2048
#: Repeated strings of so many bytes go, and so do repeated runs of so many words.
LENGTH, WORDS = 400, 51


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; a null text has no words and goes.

    Each row is judged by itself, so repeated rows stay or go together. An empty table gives an empty one.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingles at a similarity of 0.8 or more the one with the smallest id stays.

    Of rows that share that id one with the smallest content key stays. A document without words is alone.
    """
    named = jaccard.near_duplicates(docs, n=5, num=80, den=100).select(F.col("doc_id").alias("id"), "_k1", "_k2", "n_shingles", "component_id")
    alone = named.where("n_shingles = 0 or component_id is null").select("_k1", "_k2")
    grouped = named.where("n_shingles > 0 and component_id is not null").groupBy("component_id").agg(F.min(F.when(F.col("id") == F.col("component_id"), F.struct("_k1", "_k2"))).alias("k")).select("k._k1", "k._k2")
    keyed = docs.select(F.struct("*").alias("d"), *common.content_key("doc_id", "text"))
    one = keyed.join(common.materialize(grouped, "kept"), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("d.*")
    return one.unionByName(keyed.join(common.materialize(alone.distinct(), "alone"), ["_k1", "_k2"], "left_semi").select("d.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 400 bytes that also start elsewhere go; characters that a cut splits go whole; texts may end up empty.

    n_chars is that of the new text; the other columns stay.
    """
    return _without(spark, docs, None)


def all_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same, and runs of 51 words that also start elsewhere go too, however few bytes they have.

    Most runs of 51 words have fewer than 400 bytes; of long words, or writing without blanks, 400 bytes are fewer than 51
    words. Both are judged on the texts as they come.
    """
    return _without(spark, docs, WORDS)


def _without(spark: SparkSession, docs: DataFrame, words: int | None) -> DataFrame:
    common.bounded_batches(spark)
    keyed = docs.select(F.struct("*").alias("d"), F.coalesce("text", F.lit("")).alias("text"), *common.content_key("doc_id", "text"))
    texts, size = keyed.select("_k1", "_k2", "text"), F.octet_length("text")
    found = suffixes.repeated(texts.where(size >= LENGTH), LENGTH)
    if words:
        runs = passages.repeated(texts.where(size >= 2 * words - 1), words)
        # as cut_out() takes a span: the string of LENGTH bytes at hi ends where the passage does
        runs = runs.select("_k1", "_k2", F.transform("spans", lambda s: F.struct(s["a"].alias("lo"), (s["b"] - LENGTH).alias("hi"))).alias("spans"))
        found = found.unionByName(runs).groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    joined = keyed.join(found, ["_k1", "_k2"], "left").select(F.struct(*(F.col(f"d.{c}").alias(c) for c in rest)).alias("id"), "text", "spans")
    left = suffixes.cut_out(joined, LENGTH, as_text=True).select("id", "kept")
    new = {"text": F.col("kept").alias("text"), "n_chars": F.length("kept").cast("long").alias("n_chars")}
    return left.select(*(new.get(c, F.col(f"id.{c}").alias(c)) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all texts in as few sequences as linear grouping finds.

    A null or empty text is its end id alone, longer texts are cut losslessly, repeated rows and null ids are packed one
    by one, and an empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", all_repeated_passages), ("best_fit_packing", best_fit_packing)]

#: Packing and byte-exact removal are beyond SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
