"""Packing of token sequences: lossless pieces, two planners over the histogram of lengths, and binary output.

Lengths are whole numbers up to the capacity, so however many documents there are, a histogram of at most ``capacity``
counts describes them. The planners work on it on the driver, on runs of equal bins instead of single ones, and return
a table of runs whose size depends on the capacity only: documents of one length and consecutive ranks go to consecutive
bins at one offset. The rows themselves never leave the executors: each learns its rank among the rows of its length
(a counter per task, plus what earlier tasks counted) and looks its place up in that table.

* ``plan_best_fit``: best-fit decreasing. A segment tree over residual capacities finds the fullest bin that still fits.
* ``plan_linear_grouping``: lengths over a fraction of the capacity are cut into groups of equal cardinality and rounded
  up to the largest of their group; the few sizes make a covering program over bin configurations, solved by column
  generation; actual documents replace the rounded ones, and what is left over, then the small ones, go best-fit into
  what room remains. Of a few fractions and group counts the plan with the fewest bins is kept.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import bpe, common

#: Rows of the table of rank bases (tasks x lengths) that are broadcast at most: 24 bytes each. Beyond it, a shuffle join.
BROADCAST_ROWS = 500_000


class FirstAtLeast:
    """Segment tree over 0..size: the smallest marked number that is n or more."""

    def __init__(self, size: int):
        self.width = 1 << (size + 1).bit_length()
        self.tree = [False] * (2 * self.width)

    def mark(self, at: int, on: bool) -> None:
        at += self.width
        self.tree[at] = on
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def find(self, n: int) -> int | None:
        at = n + self.width
        if self.tree[at]:
            return n
        while at > 1:  # up to the first marked right sibling, then down to its leftmost mark
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


class Bins:
    """Open bins by residual capacity, as runs of consecutive sequence numbers, and the placements made so far.

    runs: (length, first rank, documents, first sequence, offset, documents a bin): within a run, every ``documents a
    bin`` consecutive ranks share a bin.
    """

    def __init__(self, capacity: int):
        self.capacity, self.made, self.runs = capacity, 0, []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.tree = FirstAtLeast(capacity)

    def put_back(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.open[room].append((first, n))
            self.tree.mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        out = self.open[room].pop()
        if not self.open[room]:
            self.tree.mark(room, False)
        return out

    def new(self, n: int) -> int:
        self.made += n
        return self.made - n

    def place(self, length: int, rank: int, n: int) -> None:
        """n documents of a length from a rank on, each to the fullest bin that it fits, one after another."""
        while n:
            room = self.tree.find(length)
            if room is None:
                room = self.capacity
                first, have = self.new(m := -(-n // (room // length))), m
            else:
                first, have = self.take(room)
            each = room // length  # after the first, the same bin is the fullest that fits
            whole = min(have, n // each)
            if whole:
                self.runs.append((length, rank, whole * each, first, self.capacity - room, each))
                self.put_back(room - each * length, first, whole)
                rank, n = rank + whole * each, n - whole * each
            if whole < have and n and n < each:
                self.runs.append((length, rank, n, first + whole, self.capacity - room, n))
                self.put_back(room - n * length, first + whole, 1)
                whole, n = whole + 1, 0
            self.put_back(room, first + whole, have - whole)


def plan_best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing over a histogram of lengths: what it does document by document, done run by run."""
    bins = Bins(capacity)
    for length in sorted(counts, reverse=True):
        bins.place(length, 0, counts[length])
    return bins


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Bin configurations over few sizes and how often to use each, so that all demand is covered by the fewest bins.

    The covering program's relaxation by column generation: the basis prices the sizes, a knapsack over the capacity
    finds the configuration worth most, and the simplex step exchanges it for another until none is worth over one bin.
    """
    k, s, d = len(sizes), np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))  # columns: as many of one size as fit
    x = d / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        gain = np.maximum(price, 0)
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(s.min()), capacity + 1):
            fit = s <= c
            worth = np.where(fit, best[c - np.where(fit, s, c)] + gain, 0)
            at = int(worth.argmax())
            if worth[at] > best[c - 1] + 1e-12:
                best[c], last[c] = worth[at], at
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
                continue
            column[last[c]] += 1
            c -= int(s[last[c]])
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, j].astype(int), x[j]) for j in range(k)]


def plan_grouped(counts: dict[int, int], capacity: int, least: int, groups: int) -> Bins:
    """Linear grouping with ``groups`` groups of the lengths over ``least``; the rest best-fit."""
    bins = Bins(capacity)
    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if least < n < capacity]
    left = {n: (0, c) for n, c in counts.items()}  # per length: next rank, documents left
    if capacity in counts:
        bins.place(capacity, 0, counts[capacity])
        left.pop(capacity)
    total = sum(c for _, c in large)
    pools: list[list[list[int]]] = []  # per group: runs of [length, first rank, documents], largest first
    if total:
        share, room, used = -(-total // groups), 0, defaultdict(int)
        for length, n in large:
            while n:
                if not room:
                    pools.append([])
                    room = share
                t = min(n, room)
                pools[-1].append([length, used[length], t])
                used[length], n, room = used[length] + t, n - t, room - t
        pools = [p for p in pools if p]
        merged: list[list[list[int]]] = []  # groups whose largest lengths agree are one size
        for p in pools:
            if merged and merged[-1][0][0] == p[0][0]:
                merged[-1] += p
            else:
                merged.append(p)
        pools = merged
        demand = [sum(r[2] for r in p) for p in pools]
        for config, times in configurations([p[0][0] for p in pools], demand, capacity):
            m = min([int(times + 1e-9), *(demand[g] // int(config[g]) for g in np.flatnonzero(config))])
            if m <= 0:
                continue
            parts = [(bins.new(m), m, capacity)]
            for g in np.flatnonzero(config):
                demand[g] -= m * int(config[g])
                for _ in range(int(config[g])):
                    after = []
                    for first, n, room in parts:
                        while n:
                            length, rank, have = run = pools[g][0]
                            t = min(n, have)
                            bins.runs.append((length, rank, t, first, capacity - room, 1))
                            after.append((first, t, room - length))
                            run[1], run[2] = rank + t, have - t
                            if not run[2]:
                                pools[g].pop(0)
                            first, n = first + t, n - t
                    parts = after
            for first, n, room in parts:
                bins.put_back(room, first, n)
    rest = [tuple(r) for p in pools for r in p] + [(n, *left[n]) for n in left if n <= least]
    for length, rank, n in sorted(rest, key=lambda r: (-r[0], r[1])):
        bins.place(length, rank, n)
    return bins


def plan_linear_grouping(counts: dict[int, int], capacity: int, fractions=(1 / 8, 1 / 4, 1 / 2), groups=(16, 40)) -> Bins:
    """The plan with the fewest bins over several fractions of the capacity that part large from small, and group counts."""
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = None
    for f in fractions:
        for g in groups:
            found = plan_grouped(counts, capacity, int(capacity * f), g)
            if best is None or found.made < best.made:
                best = found
            if best.made <= least:
                return best
    return best or Bins(capacity)


def cut(df: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32 or ids, task, nth): each text's ids and an end id, cut where over the capacity.

    Full pieces but for the first, which takes the remainder, so nothing is lost. ids_crc32: of little-endian 32-bit ids.
    With with_ids the ids themselves instead: little-endian 16-bit numbers, or 32-bit ones where the vocabulary is
    larger. task and nth: the running number among the task's pieces of a length.
    """
    common.bounded_batches(df.sparkSession)
    wide = "<u2" if with_ids and bpe.codec(path).size <= 1 << 16 else "<u4"
    fields = [T.StructField("id", df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length"))]
    fields += [T.StructField("ids", T.BinaryType()) if with_ids else T.StructField("ids_crc32", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType())]

    def run(batches):
        own, task = bpe.codec(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, at = common.buffers(batch.column(1))
            ids, where = own.encode(data, at)
            sizes = np.diff(where) + 1
            n = -(-sizes // capacity)
            first = sizes - (n - 1) * capacity
            doc = np.repeat(np.arange(len(n)), n)
            piece = common.ragged(np.zeros(len(n), np.int64), n)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            raw = np.full(len(ids) + len(n), end_id, wide)
            own_ids = np.ones(len(raw), bool)
            own_ids[where[1:] + np.arange(len(n))] = False
            raw[own_ids] = ids
            lo = (where[:-1] + np.arange(len(n)))[doc] + start
            order = np.argsort(length, kind="stable")
            grouped = length[order]
            edge = np.flatnonzero(np.append(True, grouped[1:] != grouped[:-1]))[: len(grouped)]
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(edge, np.diff(np.append(edge, len(order)))) + seen[grouped]
            seen += np.bincount(length, minlength=capacity + 1)
            cols = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length)]
            if with_ids:
                cols.append(common.strings(raw.view(np.uint8), np.append(lo, len(raw)) * raw.itemsize))
            else:
                cols.append(pa.array([zlib.crc32(raw[a : a + b]) for a, b in zip(lo.tolist(), length.tolist(), strict=True)], pa.int64()))
            cols += [pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, T.StructType(fields))


def place(pieces: DataFrame, capacity: int, plan) -> DataFrame:
    """A materialised table of cut() with sequence_id and offset, by a planner over the histogram of lengths."""
    spark = pieces.sparkSession
    tasks = common.materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = plan(counts, capacity).runs
    schema = "length long, lo long, n long, sequence long, at long, each long"
    table = F.broadcast(spark.createDataFrame([tuple(map(int, r)) for r in runs], schema))  # as many rows for any input
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if tasks.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    rank = F.col("base") + F.col("nth")
    placed = pieces.join(base, ["task", "length"]).withColumn("rank", rank).join(table, "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n")))
    k = F.col("rank") - F.col("lo")
    return placed.select(*[c for c in pieces.columns if c not in ("task", "nth")], (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + k % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack(df: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, plan=plan_linear_grouping, with_ids: bool = False) -> DataFrame:
    """Every piece of every text with its sequence and offset there; see cut() for the columns.

    A null or empty text is the end id alone. Rows are packed one by one, whatever their ids: repeated and null ones too.
    An empty table gives no rows. Other columns of df are not looked at.
    """
    return place(common.materialize(cut(df, path, capacity, id_col, text_col, end_id, with_ids), "pieces"), capacity, plan)


def whole_sequences(batches):
    """Tables of whole sequences from batches that are sorted by their first column, which names the sequence."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        last = batch.column(0).to_numpy()
        if len(last) and last[0] != last[-1]:  # the batch's last sequence may go on
            table = pa.Table.from_batches(held)
            done = table.num_rows - int((last == last[-1]).sum())
            held = table.slice(done).combine_chunks().to_batches()
            yield table.slice(0, done).combine_chunks()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table.combine_chunks()


def matrices(df: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """Packed rows for training: a row for each sequence, by best-fit decreasing.

    sequence_id, n_tokens, n_segments, doc_ids, pieces, cu_seqlens (segment ends from 0 on, as variable-length attention
    takes them), input_ids (binary: ``capacity`` little-endian ids of the width that cut() gives, padded by pad_id) and
    position_ids (binary: as many 16-bit positions, starting anew with each segment, 0 in the padding).

    A null or empty text is a segment of the end id alone; a text longer than the capacity is cut losslessly into pieces,
    each a segment. Rows are packed one by one, whatever their ids, so repeated rows and null ids are segments of their
    own; an empty table gives no sequence. Other columns of df are not looked at, so their names may be any.
    """
    if capacity > 1 << 16:
        raise ValueError("positions are 16-bit numbers")
    kind = "<u2" if bpe.codec(path).size <= 1 << 16 else "<u4"
    placed = pack(df, path, capacity, id_col, text_col, end_id, plan_best_fit, with_ids=True).select("sequence_id", "offset", "id", "piece", "length", "ids")
    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_segments", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(df.schema[id_col].dataType))]
    fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("pieces", "cu_seqlens")] + [T.StructField(n, T.BinaryType()) for n in ("input_ids", "position_ids")]

    def run(batches):
        for table in whole_sequences(batches):
            sequence, offset, length = (table.column(k).to_numpy() for k in (0, 1, 4))
            edge = np.append(np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1])), len(sequence))
            first, count = edge[:-1], np.diff(edge)
            rows, tokens = len(first), np.add.reduceat(length, first)
            ends = np.insert(offset, edge[1:], tokens).astype(np.int32)  # where segments start, and where the last ends
            data, at = common.buffers(table.column(5))
            ids = data[at[0] : at[-1]].view(kind)
            used = np.arange(capacity) < tokens[:, None]  # sequences have no gaps
            matrix, places = np.full((rows, capacity), pad_id, kind), np.zeros((rows, capacity), "<u2")
            matrix[used] = ids
            places[used] = common.ragged(np.zeros(len(length), np.int64), length)
            lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), table.column(k).combine_chunks()) for k in (2, 3)]
            packed = [common.strings(m.reshape(-1).view(np.uint8), np.arange(rows + 1) * capacity * m.itemsize) for m in (matrix, places)]
            cols = [pa.array(sequence[first]), pa.array(tokens), pa.array(count.astype(np.int32)), *lists, common.lists(ends, edge + np.arange(rows + 1)), *packed]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    n = common.parts(df.sparkSession)
    dealt = placed.repartition(n, "sequence_id").sortWithinPartitions("sequence_id", "offset")
    return dealt.mapInArrow(run, T.StructType(fields))


def write(df: DataFrame, out: str, **options) -> None:
    """matrices(df, ...) as Parquet files of binary rows, which any reader maps to fixed-width arrays."""
    matrices(df, **options).write.mode("overwrite").parquet(out)
