"""Token counts without ids: pieces are counted once for each distinct pre-token and joined to per-document frequencies.

Pass one gathers the distinct pre-tokens of the corpus with their frequencies and counts the pieces of each by the
tokenizers library. Pass two takes each document's pre-token frequencies. The join has two halves that together cover
every pre-token: the most frequent ones (at most ``head``, a fixed bound) are broadcast and joined where the frequencies
arise, which takes the hot keys and most of the rows off the network; all others are shuffled and joined by the
pre-token. Results don't depend on ``head``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

#: Pre-tokens in the broadcast half of the join: some 3 MB.
HEAD = 1 << 17


def distinct_pretokens(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word binary, n, pieces): each distinct pre-token of all texts, how often it occurs and how many tokens it makes."""

    def words(batches):
        own = bpe.codec(path)
        for batch in batches:
            data, at = common.buffers(batch.column(0))
            for found, codes, _ in own.pieces(data, at):
                yield pa.RecordBatch.from_arrays([found, pa.array(np.bincount(codes, minlength=len(found)))], names=["word", "n"])

    def count(batches):
        own = bpe.codec(path)
        for batch in batches:
            _, sizes = own.ids_of(batch.column(0).to_numpy(zero_copy_only=False).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32))], names=["word", "n", "pieces"])

    found = df.select(df[text_col].alias("text")).mapInArrow(words, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(count, "word binary, n long, pieces int")


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of df.

    A null text counts as empty: no bytes, no tokens. Every row gives one, also where ids or whole rows repeat or are
    null; other columns are not looked at.
    """
    spark = df.sparkSession
    common.bounded_batches(spark)
    docs = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text")).select("id", "text", *common.content_key("id", "text"))
    words = common.materialize(distinct_pretokens(docs, path), "pretokens")
    top = common.most_frequent(words, head).select("word", "pieces").toArrow()  # at most ``head`` rows
    known = spark.sparkContext.broadcast({w: n for w, n in zip(top["word"].to_pylist(), top["pieces"].to_pylist(), strict=True)})
    kind = df.schema[id_col].dataType.simpleString()

    def frequencies(batches):
        own, have = bpe.codec(path), known.value
        for batch in batches:
            data, at = common.buffers(batch.column(1))
            rows = len(at) - 1
            near = np.zeros(rows, np.int64)
            tails: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
            for found, codes, row in own.pieces(data, at):
                pieces = np.fromiter((have.get(w, -1) for w in found.to_pylist()), np.int64, len(found))
                size = pieces[codes]
                near += np.bincount(row, np.maximum(size, 0), rows).astype(np.int64)
                rare = np.flatnonzero(size < 0)
                pair, n = np.unique(row[rare] * len(found) + codes[rare], return_counts=True)
                tails.append((pair // len(found), found.take(pa.array(pair % len(found))), n))
            # a row for the document itself, with what is counted already, and one for each rare pre-token
            where = np.concatenate([np.arange(rows), *(t[0] for t in tails)])
            word = pa.concat_arrays([pa.nulls(rows, pa.binary()), *(t[1] for t in tails)])
            n = pa.array(np.concatenate([near, *(t[2] for t in tails)]))
            nbytes = pc.if_else(pc.is_null(word), pa.array(np.diff(at)).take(pa.array(where)), pa.scalar(None, pa.int64()))
            keys = [c.take(pa.array(where)) for c in (batch.column(0), batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([*keys, word, n, nbytes], names=["id", "_k1", "_k2", "word", "n", "n_bytes"])

    found = common.materialize(docs.mapInArrow(frequencies, f"id {kind}, _k1 long, _k2 long, word binary, n long, n_bytes long"), "frequencies")
    base = found.where("word is null")
    # rows with the same id and text share a key: their rare pre-tokens are summed over as many copies as base has
    copies = base.groupBy("_k1", "_k2").agg(F.count("*").alias("copies"), F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.first("n").alias("near"))
    rare = found.where("word is not null").join(words.select("word", "pieces"), "word").groupBy("_k1", "_k2").agg(F.sum(F.col("n") * F.col("pieces")).alias("far"))
    total = F.col("near") + F.coalesce(F.expr("far div copies"), F.lit(0))
    out = copies.join(rare, ["_k1", "_k2"], "left").select("id", "n_bytes", total.alias("n_tokens"), "copies")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("_")
