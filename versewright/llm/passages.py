"""Passages of words that repeat, however they are spaced and however short their words are.

A run of ``n`` words that also starts anywhere else, in the same document or another, is repeated. The method is that of
``suffixes`` with words in place of bytes: of every window of n words the leftmost k-gram of words of least hash is its
anchor, an anchor stands for the windows that chose it, and the contexts go through the distributed order. Those that
equal a neighbour are settled whole; of those that only share their k-gram each window goes through it by itself.
Digests are 128 bits of blake2b over 64-bit hashes of the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffixes import anchors, digests, in_order
from .words import RollingHash, Words

#: Words of the k-grams that anchors are chosen by.
GRAM = 12


class WordHash(RollingHash):
    """64-bit hashes of any runs of words of a block, the same for equal words wherever they stand."""

    def __init__(self, words: Words, seed: int = 1):
        super().__init__(words.data[:0], seed, len(words.starts))
        values = words.hashes
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up(len(values)), out=self.sums[1:])


def _blocks(batch: pa.RecordBatch, n: int):
    """(first row, words, offsets of rows in words, the words' hashes as bytes) of the texts in column 2, whole rows together."""
    data, at = common.buffers(batch.column(2))
    for i, j in common.row_groups(at):
        lo, hi = int(at[i]), int(at[j])
        words = Words(data[lo:hi], at[i : j + 1] - lo)
        if len(words.starts) >= n:
            yield i, words, words.first, words.hashes.tobytes()


def contexts(docs: DataFrame, n: int) -> DataFrame:
    """(_k1, _k2, lo, hi, a, b, gram, c1, c2): runs of windows lo..hi (words) with one anchor, and the bytes a..b they cover."""

    def run(batches):
        for batch in batches:
            for i, words, first, raw in _blocks(batch, n):
                hashes = WordHash(words)
                row, lo, hi, anchor = anchors(words.starts, first, n, hashes, GRAM)
                if not len(row):
                    continue
                gram = hashes.of(anchor, anchor + GRAM).view(np.int64)
                c1, c2 = digests(raw, 8 * lo, 8 * (hi + n))
                begin, where = words.offsets[:-1][row], pa.array(i + row)
                numbers = (lo - first[:-1][row], hi - first[:-1][row], words.starts[lo] - begin, words.ends[hi + n - 1] - begin, gram, c1, c2)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *map(pa.array, numbers)], names=["_k1", "_k2", "lo", "hi", "a", "b", "gram", "c1", "c2"])

    return docs.select("_k1", "_k2", "text").mapInArrow(run, "_k1 long, _k2 long, lo long, hi long, a long, b long, gram long, c1 long, c2 long")


def _windows(docs: DataFrame, n: int) -> DataFrame:
    """(_k1, _k2, a, b, x, y) for each window of the runs l (array<struct<lo, hi>>) of docs: its bytes and digest."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            where = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(where[0], where[-1] - where[0])
            los, his = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            where = where - where[0]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(where))
            for i, words, first, raw in _blocks(batch, n):
                s = slice(int(where[i]), int(where[i + words.rows]))
                if s.start == s.stop:
                    continue
                size = his[s] - los[s] + 1
                row = np.repeat(owner[s] - i, size)
                at = common.ragged(los[s] + first[:-1][owner[s] - i], size)
                begin, take = words.offsets[:-1][row], pa.array(i + row)
                numbers = (words.starts[at] - begin, words.ends[at + n - 1] - begin, *digests(raw, 8 * at, 8 * (at + n)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, numbers)], names=["_k1", "_k2", "a", "b", "x", "y"])

    return docs.select("_k1", "_k2", "text", "l").mapInArrow(run, "_k1 long, _k2 long, a long, b long, x long, y long")


def repeated(docs: DataFrame, n: int = 51) -> DataFrame:
    """(_k1, _k2, spans array<struct<a, b>>): of each text that holds repeated runs of n words the bytes a..b (b excluded) they cover.

    docs: (_k1, _k2, text), text not null; equal keys mean equal texts, and each row counts as a place of its own.
    """
    spark = docs.sparkSession
    runs = common.materialize(contexts(docs, n), "runs")
    seen, tables = in_order(runs, ["gram", "c1", "c2"], ["_k1", "_k2", "lo", "hi", "a", "b"], group=1)
    common.discard(runs)
    open_ = seen.where("not copy").groupBy("_k1", "_k2").agg(F.collect_list(F.struct("lo", "hi")).alias("l"))  # of one text
    each = common.materialize(_windows(docs.join(open_, ["_k1", "_k2"]), n), "word-windows")
    windows, more = in_order(each, ["x", "y"], ["_k1", "_k2", "a", "b"])
    found = seen.where("copy").select("_k1", "_k2", "a", "b").unionByName(windows.select("_k1", "_k2", "a", "b"))
    spans = common.materialize(found.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "passages")
    common.discard(each, *tables, *more)
    common.free_shuffles(spark)
    return spans
