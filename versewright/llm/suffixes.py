"""Exact removal of repeated byte strings by a distributed suffix order.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the same document or another.
Shipping every suffix would ship each byte hundreds of times, so suffixes are sampled by content: of every window of
``length`` bytes the leftmost k-gram of least hash is its anchor. Equal windows have their anchors at the same place, so
only windows around equal k-grams need comparing, and an anchor with the bytes around it stands for all the windows
(some 170) that chose it: its context.

``in_order`` is the distributed order: sampled splitters range-partition suffixes by their leading characters, each
bucket sorts its own by multikey quicksort and compares neighbours, and the edges of the buckets are compared across
their boundaries. The last character that splitters see is a salt, so that even one string that a third of all rows
repeat is dealt to many buckets.

1. Contexts are ordered by leading bytes and k-gram, then by the digest of all their bytes. Those that equal a neighbour
   are copies: all their windows are repeated. Those that stand among different ones of their k-gram are open.
2. The bytes of open contexts go to buckets by k-gram. There the suffixes of all windows are sorted by multikey
   quicksort, characters being 8-byte words first and a hash of the whole string where those agree; neighbours that tie
   are compared byte by byte, and if the hash told a lie, the sort goes on over all words.
3. Where one k-gram has more open contexts than a bucket should hold, each of their windows goes
   through ``in_order`` by itself, as leading word and digest.

Digests are 128 bits of blake2b. Rolling hashes choose anchors and shorten sorts, and decide nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .words import RollingHash

#: Bytes of the k-grams that anchors are chosen by.
K = 64
#: Contexts of one k-gram up to which a bucket compares them; beyond it their windows are dealt one by one.
CROWD = 2000
#: Suffixes in a bucket of the order, about.
BUCKET = 300_000
#: Bytes of a text whose windows are looked at together, and of a comparison byte by byte.
STRETCH, COMPARED = 1 << 19, 1 << 22
_POSITION = (1 << 24) - 1


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of byte ranges, as two columns of 64-bit numbers."""
    out = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    pairs = np.frombuffer(out, np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, hashes: RollingHash, k: int = K) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor): runs of windows of a row that have one anchor, as places in data."""
    n, width = len(data), length - k + 1
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(n)
    whole = place + length <= row_end
    if n < length or not whole.any():
        return (np.zeros(0, np.int64),) * 4
    grams = n - k + 1
    key = np.full(-(-grams // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    key[:grams] = (hashes.of(place[:grams], place[:grams] + k) & ~np.uint64(_POSITION)) | place[:grams].astype(np.uint64)
    tiles = key.reshape(-1, width)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(whole)
    chosen = (np.minimum(behind[starts], ahead[starts + width - 1]) & np.uint64(_POSITION)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[starts]
    edge = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)))
    last = np.append(edge[1:], len(starts)) - 1
    return row[edge], starts[edge], starts[last], chosen[edge]


def stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first row, bytes, offsets, place in the row): whole rows together; long rows in parts that overlap by length - 1."""
    for i, j in common.row_groups(offsets, STRETCH):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j > i + 1 or hi - lo <= 2 * STRETCH:
            yield i, data[lo:hi], offsets[i : j + 1] - lo, 0
            continue
        for a in range(lo, hi, STRETCH):
            b = min(hi, a + STRETCH + length - 1)
            if b - a >= length:
                yield i, data[a:b], np.array([0, b - a]), a - lo


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """(_k1, _k2, lo, hi, at, lead, gram, c1, c2) for each run of windows lo..hi with the anchor at."""

    def run(batches):
        for batch in batches:
            data, at = common.buffers(batch.column(2))
            for i, part, offs, shift in stretches(data, at, length):
                hashes = RollingHash(part)
                row, lo, hi, anchor = anchors(part, offs, length, hashes)
                if not len(row):
                    continue
                gram = hashes.of(anchor, anchor + K).view(np.int64)
                c1, c2 = digests(part.tobytes(), lo, hi + length)
                base = offs[:-1][row] - shift
                where = pa.array(i + row)
                numbers = (lo - base, hi - base, anchor - base, signed(word_at(part, anchor)), gram, c1, c2)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *map(pa.array, numbers)], names=["_k1", "_k2", "lo", "hi", "at", "lead", "gram", "c1", "c2"])

    return docs.select("_k1", "_k2", "text").mapInArrow(run, "_k1 long, _k2 long, lo long, hi long, at long, lead long, gram long, c1 long, c2 long")


def multikey_order(first: np.ndarray, more) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their characters, and which equal their predecessor in all of them.

    Multikey quicksort: sort by one character, and go on to the next only within the ranges that are equal so far.
    first: the first character of each; more: functions that give the further ones of some suffixes.
    """
    order = np.argsort(first, kind="stable")
    tied = np.append(False, first[order][1:] == first[order][:-1])[: len(order)]
    for character in more:
        at = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(at):
            break
        group, sub = np.cumsum(~tied[at]), order[at]
        key = character(sub)
        turn = np.lexsort((key, group))
        order[at], key = sub[turn], key[turn]
        tied[at] &= np.append(False, key[1:] == key[:-1])
    return order, tied


def signed(words: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones of the same order."""
    return (words ^ np.uint64(1 << 63)).view(np.int64)


def word_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number that sorts like them."""
    out = np.zeros(len(places), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[places + k]
    return out


def in_order(rows: DataFrame, chars: list[str], carry: list[str], group: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """The carried columns of the suffixes that equal a neighbour in their order, with ``copy`` true; and the tables it reads.

    rows: written ones, with long columns ``chars``. With group > 0, suffixes that share their first ``group`` characters
    are a group; of each group with different suffixes one of each kind is returned too, with ``copy`` false.
    """
    spark, total = rows.sparkSession, rows.count()
    schema = T.StructType([*(rows.schema[c] for c in carry), *T.StructType.fromDDL("copy boolean, open boolean, head boolean, tail boolean, opening boolean, closing boolean, bucket int, edge int").fields, *(T.StructField(f"e{k}", T.LongType()) for k in range(len(chars)))])

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        n, bucket = table.num_rows, TaskContext.get().partitionId()
        keys = [table.column(c).to_numpy() for c in chars]
        order, tied = multikey_order(keys[0], [lambda at, k=k: k[at] for k in keys[1:]])
        new = ~tied  # starts a run of equal suffixes
        copy = tied | np.append(tied[1:], False)
        run_of = np.cumsum(new) - 1
        head, tail = run_of == 0, run_of == run_of[-1]
        opened = np.zeros(n, bool)
        opening = closing = np.zeros(n, bool)
        if group:
            fresh = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys[:group]], axis=0))
            group_of = np.cumsum(fresh) - 1
            kinds = np.bincount(group_of[new])
            lone = np.bincount(group_of[~copy], minlength=len(kinds)) > 0
            opening, closing = new & (group_of == 0), new & (group_of == group_of[-1])
            opened = new & ((kinds > 1) & lone)[group_of]
        keep = np.flatnonzero(copy | head | tail | opened | opening | closing)
        flags = [copy[keep], opened[keep], head[keep], tail[keep], opening[keep], closing[keep], np.full(len(keep), bucket, np.int32), np.zeros(len(keep), np.int32)]
        where = pa.array(order[keep])
        none = pa.nulls(len(keep), pa.int64())
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(where) for c in carry), *map(pa.array, flags), *[none] * len(chars)], names=schema.names)
        ends = [order[0], order[-1]]
        blank = [pa.nulls(2, table.schema.field(c).type) for c in carry] + [pa.nulls(2, pa.bool_())] * 6
        yield pa.RecordBatch.from_arrays([*blank, pa.array([bucket] * 2, pa.int32()), pa.array([1, 2], pa.int32()), *(pa.array(k[ends]) for k in keys)], names=schema.names)

    buckets = max(common.parts(spark), -(-total // BUCKET))
    dealt = rows.select(*carry, *(c for c in chars if c not in carry), F.xxhash64(*carry).alias("_salt")).repartitionByRange(buckets, *chars, "_salt").drop("_salt")
    found = common.materialize(dealt.mapInArrow(run, schema), "ordered")
    edges = [f"e{k}" for k in range(len(chars))]
    by_bucket = Window.orderBy("bucket")  # two rows a bucket
    first = found.where("edge = 1").select("bucket", F.struct(edges).alias("first"))
    both = first.join(found.where("edge = 2").select("bucket", F.struct(edges).alias("last")), "bucket")
    both = both.select("bucket", "first", "last", F.lag("last").over(by_bucket).alias("before"), F.lead("first").over(by_bucket).alias("after"))
    same = lambda x, y, n: F.coalesce(F.expr(" and ".join(f"{x}.e{k} = {y}.e{k}" for k in range(n)) or "false"), F.lit(False))
    met = common.materialize(both.select("bucket", same("first", "before", len(chars)).alias("same_before"), same("last", "after", len(chars)).alias("same_after"), same("first", "before", group).alias("group_before"), same("last", "after", group).alias("group_after")), "boundaries")
    joined = found.where("edge = 0").join(F.broadcast(met), "bucket")  # a row a bucket
    cut = (F.col("opening") & F.col("group_before")) | (F.col("closing") & F.col("group_after"))
    copied = F.col("copy") | (F.col("head") & F.col("same_before")) | (F.col("tail") & F.col("same_after"))
    out = joined.where(copied).select(*carry, F.lit(True).alias("copy"))
    if group:
        out = out.unionByName(joined.where(F.col("open") | cut).select(*carry, F.lit(False).alias("copy")))
    common.free_shuffles(spark)
    return out, [found, met]


def equal_strings(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> bool:
    """Whether the strings at places x equal those at y, byte by byte; pairs that move on together are compared once."""
    if not len(x):
        return True
    turn = np.lexsort((y, x - y))
    x, y = x[turn], y[turn]
    start = np.flatnonzero(np.append(True, (y[1:] != y[:-1] + 1) | (x[1:] != x[:-1] + 1)))
    size = np.diff(np.append(start, len(x))) - 1 + length
    x, y, done = x[start], y[start], np.cumsum(size)
    i = 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(done, done[i] - size[i] + COMPARED, "right")))
        if (data[common.ragged(x[i:j], size[i:j])] != data[common.ragged(y[i:j], size[i:j])]).any():
            return False
        i = j
    return True


def repeated_windows(data: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of ``length`` bytes at these places equal another, by a sort of the suffixes there."""
    hashes = RollingHash(data)
    order, tied = multikey_order(word_at(data, place), [lambda at: word_at(data, place[at] + 8), lambda at: hashes.of(place[at], place[at] + length)])
    again = np.flatnonzero(tied)
    if not equal_strings(data, place[order[again - 1]], place[order[again]], length):
        words = [min(8 * k, length - 8) for k in range(1, -(-length // 8))]
        order, tied = multikey_order(word_at(data, place), [lambda at, k=k: word_at(data, place[at] + k) for k in words])
    found = np.zeros(len(order), bool)
    found[order] = tied | np.append(tied[1:], False)
    return found


def spans_of(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of runs of consecutive places, given in order."""
    if not len(owner):
        return owner, place, place
    edge = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)))
    return owner[edge], place[edge], place[np.append(edge[1:], len(owner)) - 1]


SPAN = "_k1 long, _k2 long, lo long, hi long"


def in_buckets(rows: DataFrame, length: int, n: int) -> DataFrame:
    """Runs of repeated windows of contexts (_k1, _k2, lo, hi, gram, lead, bytes), by range buckets of their k-grams."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        # rows come in the order of their k-grams, so a batch may end inside a group: the last group waits for the next
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            gram = table["gram"].to_numpy()
            cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if (gram != gram[-1]).any() else 0
            held = table.slice(cut).to_batches()
            if cut:
                yield from groups(table.slice(0, cut))
        if held:
            yield from groups(pa.Table.from_batches(held))

    def groups(table: pa.Table):
        gram = table["gram"].to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram))
        i = 0
        while i < len(edge) - 1:  # some thousand contexts at once, whole groups
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + CROWD, "right")) - 1)
            part = table.slice(int(edge[i]), int(edge[j] - edge[i])).combine_chunks()
            i = j
            data, at = common.buffers(part["bytes"])
            data, at = data[at[0] : at[-1]], at - at[0]
            lo, hi = part["lo"].to_numpy(), part["hi"].to_numpy()
            size = hi - lo + 1
            owner, place = np.repeat(np.arange(len(lo)), size), common.ragged(at[:-1], size)
            found = repeated_windows(data, place, length)
            owner, first, last = spans_of(owner[found], place[found])
            where = pa.array(owner)
            base = lo[owner] - at[:-1][owner]
            yield pa.RecordBatch.from_arrays([part["_k1"].combine_chunks().take(where), part["_k2"].combine_chunks().take(where), pa.array(first + base), pa.array(last + base)], names=["_k1", "_k2", "lo", "hi"])

    dealt = rows.repartitionByRange(n, "lead", "gram").sortWithinPartitions("lead", "gram")
    return dealt.select("_k1", "_k2", "lo", "hi", "gram", "bytes").mapInArrow(run, SPAN)


def one_by_one(rows: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """The same for contexts of crowded k-grams, window by window; and the tables it reads."""

    def run(batches):
        for batch in batches:
            for b in range(0, batch.num_rows, 200):
                part = batch.slice(b, 200)
                data, at = common.buffers(part.column(4))
                data, at = data[at[0] : at[-1]], at - at[0]
                lo, hi = part.column(2).to_numpy(), part.column(3).to_numpy()
                size = hi - lo + 1
                owner, place = np.repeat(np.arange(len(lo)), size), common.ragged(at[:-1], size)
                where = pa.array(owner)
                numbers = (place - at[:-1][owner] + lo[owner], signed(word_at(data, place)), *digests(data.tobytes(), place, place + length))
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), *map(pa.array, numbers)], names=["_k1", "_k2", "lo", "lead", "x", "y"])

    each = common.materialize(rows.select("_k1", "_k2", "lo", "hi", "bytes").mapInArrow(run, "_k1 long, _k2 long, lo long, lead long, x long, y long"), "windows")
    found, tables = in_order(each, ["lead", "x", "y"], ["_k1", "_k2", "lo"])
    return found.select("_k1", "_k2", "lo", F.col("lo").alias("hi")), [each, *tables]


def bytes_of(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(_k1, _k2, lo, hi, gram, lead, bytes) of open contexts (_k1, _k2, lo, hi, gram, lead)."""
    lists = open_.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("lo", "hi", "gram", "lead")).alias("l"))  # of one text

    def run(batches):
        for batch in batches:
            data, at = common.buffers(batch.column(2))
            where = batch.column(3).offsets.to_numpy().astype(np.int64)
            flat = batch.column(3).values.slice(where[0], where[-1] - where[0])
            row = np.repeat(np.arange(batch.num_rows), np.diff(where))
            lo, hi = (flat.field(k).to_numpy() for k in (0, 1))
            size = hi + length - lo
            for a in range(0, len(row), 4096):
                s = slice(a, a + 4096)
                got = common.strings(data[common.ragged(at[row[s]] + lo[s], size[s])], np.append(0, np.cumsum(size[s])))
                take, fields = pa.array(row[s]), [flat.field(k).slice(a, 4096) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *fields, got], names=["_k1", "_k2", "lo", "hi", "gram", "lead", "bytes"])

    return docs.join(lists, ["_k1", "_k2"]).select("_k1", "_k2", "text", "l").mapInArrow(run, "_k1 long, _k2 long, lo long, hi long, gram long, lead long, bytes binary")


def repeated(docs: DataFrame, length: int = 400) -> DataFrame:
    """(_k1, _k2, spans array<struct<lo, hi>>): of each text with repeated strings the windows lo..hi that are repeated.

    docs: (_k1, _k2, text), text not null; equal keys mean equal texts, and each row counts as a place of its own.
    length: at least K.
    """
    spark = docs.sparkSession
    runs = common.materialize(contexts(docs, length), "contexts")
    seen, tables = in_order(runs, ["lead", "gram", "c1", "c2"], ["_k1", "_k2", "lo", "hi", "gram", "lead"], group=2)
    common.discard(runs)
    rows = common.materialize(bytes_of(docs, seen.where("not copy").drop("copy"), length), "bytes")
    tables.append(rows)
    found = seen.where("copy").select("_k1", "_k2", "lo", "hi")
    crowded = common.materialize(rows.groupBy("gram").agg(F.count("*").alias("crowd")).where(f"crowd > {CROWD}").select("gram"), "crowded")
    tables.append(crowded)
    if crowded.isEmpty():
        found = found.unionByName(in_buckets(rows, length, common.parts(spark)))
    else:
        crowded = common.small(crowded)
        windows, more = one_by_one(rows.join(crowded, "gram", "left_semi"), length)
        tables += more
        found = found.unionByName(windows).unionByName(in_buckets(rows.join(crowded, "gram", "left_anti"), length, common.parts(spark)))
    spans = common.materialize(found.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    common.discard(*tables)
    common.free_shuffles(spark)
    return spans


def remove(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, removed array<struct<start, end>>, kept binary) of every row: bytes that lie in repeated strings go.

    A null text is empty and loses nothing; shorter texts than ``length`` lose nothing, and an empty table gives no rows. Strings are judged on the input,
    each row a place of its own, so all copies of a text lose it, repeated rows too, whatever their ids. removed: the
    maximal runs. Bytes are cut without regard to characters; with_text adds kept as a string, as cut_out() does.
    """
    common.bounded_batches(df.sparkSession)
    docs = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text")).select("id", "text", *common.content_key("id", "text"))
    found = repeated(docs.select("_k1", "_k2", "text").where(F.octet_length("text") >= length), length)
    return cut_out(docs.join(found, ["_k1", "_k2"], "left"), length, with_text=with_text).withColumnRenamed("id", id_col)


def cut_out(joined: DataFrame, length: int, as_text: bool = False, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, removed, kept) for rows of (id, text, spans), spans as repeated() gives them or null.

    kept: bytes, or with as_text a string, without the parts of characters that a cut left behind. with_text: that string
    follows as kept_text, beside the bytes.
    """
    fields = [T.StructField("id", joined.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType())]
    fields += [T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    fields += [T.StructField("kept_text", T.StringType())] * with_text
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, at = common.buffers(batch.column(1))
            size, removed, kept, gone = [], [], [], []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                own = data[at[k] : at[k + 1]]
                edge = np.zeros(len(own) + 1, np.int64)
                if spans:
                    np.add.at(edge, [s["lo"] for s in spans], 1)
                    np.add.at(edge, [s["hi"] + length for s in spans], -1)
                out = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                turns = np.flatnonzero(out[1:] != out[:-1]).reshape(-1, 2)
                size.append(len(own))
                gone.append(int((turns[:, 1] - turns[:, 0]).sum()))
                removed.append([{"start": int(a), "end": int(b)} for a, b in turns])
                left = own[~out[1:-1]].tobytes()
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.string() if as_text else pa.binary())]
            if with_text:
                columns.append(pa.array([k if as_text else k.decode("utf-8", "ignore") for k in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return joined.select("id", "text", "spans").mapInArrow(run, T.StructType(fields))
