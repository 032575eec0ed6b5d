"""Similarity join of documents on word shingles, and the classes of documents that its links connect.

The join is a blocked sparse product of the document by n-gram incidence with its transpose: of pairs of documents that
meet in a column, overlaps are accumulated. What of the product has to be formed is bounded by set sizes. Two sets of n
and m n-grams reach the similarity t only if they share t/(1+t) (n+m) of them, so under any common order of the n-grams
both must hold a common one among their first n - ceil(tn) + 1; and one at places i and j leaves room for min(n-i, m-j)
common ones. The order used is by rising frequency, so that very common n-grams fall outside almost every document's
first ones, and a document with too many n-grams of its own is done at once.

1. Documents with equal sets become one class, and each class lists its first n-grams. N-grams of
   frequent words come late, those last that a sample of documents has often (the order decides the cost, not the result).
2. In the columns of few classes the product is formed over the first n-grams: a row for each pair and column, summed
   for each pair. The sum, and what the sizes leave room for beyond the first n-grams, bound the whole overlap; pairs
   below the bound are discarded. Passages in common don't pass this, near copies do.
3. Classes in crowded columns, or with so many frequent n-grams that one is among their first, go through step 2 again
   among themselves, where a sample shows what is frequent with them, as long as that thins them out.
4. Those that stay together have columns over their whole sets, ordered by their true counts. In each crowded column all are compared with
   one pivot, the member with the fewest n-grams of its own. Whoever links to it is connected with the others who do, so
   after that only pairs that are not yet connected are formed and compared.

Overlaps that decide are products over whole sets, in blocks: the sets of up to so many partners against that of the one
they share (see ``compared``). Words are hashed as wholes to 64 bits, n-grams of them to 58, sets to 128.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph
from .words import Words, lower

#: Documents in the sample that shows which n-grams are frequent, how often they occur there at least, and how many are
#: remembered (8 bytes each).
SAMPLE, OFTEN, FREQUENT = 8000, 4, 1 << 17
#: Classes in a block of which all pairs are tried at once; larger blocks go by pivots.
CROWD = 16
#: Sets in a block of the product over whole sets, and rows of a column that one task joins with its pivot, about.
BLOCK, SPREAD = 256, 1000
#: Rounds of thinning out crowded classes at most; what is left then is counted exactly, however much it is.
LEVELS = 4


def shingle_sets(batch_text: pa.Array, n: int, common_words: tuple[np.ndarray, np.ndarray]):
    """For blocks of rows: (first row, last row + 1, n-grams row by row in ascending order, offsets)."""
    data, at = common.buffers(batch_text)
    known, level = common_words

    def levels(hashes: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[place] == hashes, level[place], 0)

    for i, j in common.row_groups(at):
        yield i, j, *Words(lower(data[at[i] : at[j]]), at[i : j + 1] - at[i]).shingles(n, levels)


def sample_of(docs: DataFrame) -> DataFrame:
    total = docs.count()
    return docs.select("text") if total <= SAMPLE else docs.select("text").sample(SAMPLE / total, seed=11)


def often_seen(found: DataFrame) -> pa.Table:
    """(s, n) of what is seen OFTEN or more often in all, at most the FREQUENT most frequent."""
    counts = common.materialize(found.groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN), "often")
    top = common.most_frequent(counts, FREQUENT).toArrow()
    common.discard(counts)
    return top


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that a sample of documents has most, ascending, and the bits of their counts."""

    def count(batches):
        for batch in batches:
            data, at = common.buffers(batch.column(0))
            for i, j in common.row_groups(at):
                found, n = np.unique(Words(lower(data[at[i] : at[j]]), at[i : j + 1] - at[i]).hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["s", "n"])

    top = often_seen(sample_of(docs).mapInArrow(count, "s long, n long"))
    word, n = top["s"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(word)
    return word[order], np.log2(n[order]).astype(np.int64)


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many first n-grams of a set of n any set of similarity num/den or more must touch."""
    return np.where(n > 0, n - -(-num * n // den) + 1, 0)


def frequent(docs: DataFrame, n: int, words) -> np.ndarray:
    """The n-grams that a sample of documents has often, ascending; at most FREQUENT."""

    def grams(batches):
        for batch in batches:
            for _, _, value, _ in shingle_sets(batch.column(0), n, words.value):
                found, count = np.unique(value, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], names=["s", "n"])

    return np.sort(often_seen(sample_of(docs).mapInArrow(grams, "s long, n long"))["s"].to_numpy().view(np.uint64))


def firsts(value: np.ndarray, at: np.ndarray, often: np.ndarray, num: int, den: int) -> tuple[pa.Array, pa.Array]:
    """(hot, first) of rows of hashes: those of a row's first n-grams that aren't in ``often``, in order; hot: some are."""
    size = np.diff(at)
    rows = len(size)
    row = np.repeat(np.arange(rows), size)
    late = often[np.minimum(np.searchsorted(often, value), len(often) - 1)] == value if len(often) else np.zeros(len(value), bool)
    order = np.lexsort((value, late, row))
    among = np.arange(len(value)) - at[row] < prefix_length(size, num, den)[row]
    hot = np.bincount(row[among], late[order][among], rows) > 0
    take = order[among & ~late[order]]
    return pa.array(hot), common.lists(value[take].view(np.int64), np.append(0, np.cumsum(np.bincount(row[take], minlength=rows))))


LIST = [T.StructField("hot", T.BooleanType()), T.StructField("first", T.ArrayType(T.LongType()))]


def classes(df: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, np.ndarray, object]:
    """The documents (id, text, _k1, _k2), the table (id, _k1, _k2, n_shingles, c, hot, first), frequent n-grams and words. c: the class key."""
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text")).select("id", "text", *common.content_key("id", "text"))
    words = df.sparkSession.sparkContext.broadcast(frequent_words(docs))
    found = frequent(docs, n, words)
    often = df.sparkSession.sparkContext.broadcast(found)
    kind = df.schema[id_col].dataType

    def sets(batches):
        for batch in batches:
            for i, j, value, at in shingle_sets(batch.column(1), n, words.value):
                raw = value.tobytes()
                ends = (8 * at).tolist()
                key = [hashlib.blake2b(raw[a:b], digest_size=16).digest() if b > a else None for a, b in zip(ends, ends[1:], strict=False)]
                keys = [batch.column(k).slice(i, j - i) for k in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.diff(at)), pa.array(key, pa.binary()), *firsts(value, at, often.value, num, den)], names=["id", "_k1", "_k2", "n_shingles", "c", "hot", "first"])

    schema = T.StructType([T.StructField("id", kind), *(T.StructField(k, T.LongType()) for k in ("_k1", "_k2", "n_shingles")), T.StructField("c", T.BinaryType()), *LIST])
    return docs, common.materialize(docs.mapInArrow(sets, schema), "shingles"), found, words


def again(docs: DataFrame, nodes: DataFrame, crowded: DataFrame, found: np.ndarray, words, n: int, num: int, den: int) -> tuple[DataFrame, np.ndarray]:
    """(node, n, hot, first) of the crowded nodes, with what is frequent among them last, and all that is frequent."""
    places = common.small(common.materialize(nodes.select("_k1", "_k2", "node").join(crowded, "node", "left_semi"), "wanted"))
    texts = docs.join(places, ["_k1", "_k2"]).select("node", "text")
    found = np.union1d(found, frequent(texts, n, words))
    often = docs.sparkSession.sparkContext.broadcast(found)

    def sets(batches):
        for batch in batches:
            for i, j, value, at in shingle_sets(batch.column(1), n, words.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), *firsts(value, at, often.value, num, den)], names=["node", "n", "hot", "first"])

    return common.materialize(texts.mapInArrow(sets, T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), *LIST])), "lists"), found


def number(known: DataFrame) -> DataFrame:
    """A row for each class, with a node number: (c, _k1, _k2, node, n, hot, first); _k1 and _k2 are one document's."""
    one = known.where("c is not null").groupBy("c").agg(F.min(F.struct("_k1", "_k2")).alias("k"), F.first("n_shingles").alias("n"), F.first("hot").alias("hot"), F.first("first").alias("first"))
    return common.materialize(one.select("c", "k._k1", "k._k2", F.monotonically_increasing_id().alias("node"), "n", "hot", "first"), "nodes")


def shared_rows(nodes: DataFrame) -> DataFrame:
    """(s, node, n, i, p, w, crowded): the n-grams among the first ones of more than one class, and their places; p, w: of how many, and the last.

    Almost all n-grams are of one class, so a sort passes them by in bounded memory where sums would hold each of them.
    Frequent ones aren't in the lists, so columns are short of the sampled share that makes one frequent.
    """
    # a list with frequent n-grams after it holds all the others there are
    last, most = F.when(F.col("hot"), F.lit((1 << 63) - 1)).otherwise(F.element_at("first", -1)), CROWD
    rows = nodes.where(F.size("first") > 0).select("node", F.col("n").cast("int").alias("n"), F.size("first").alias("p"), last.alias("w"), F.posexplode("first").alias("i", "s")).select("s", "node", "n", "i", "p", "w")

    def run(batches):
        held, open_ = None, None  # the last column so far, while it isn't crowded; the n-gram of one that is
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            s = table.column(0).to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s))
            size = np.diff(edge)
            late = size > most
            late[0] |= s[0] == open_
            done = len(size) - (not late[-1])  # a crowded one needn't be seen whole
            keep = np.repeat((late | (size > 1))[:done], size[:done])
            if keep.any():
                part = table.slice(0, int(edge[done])).append_column("crowded", pa.array(np.repeat(late[:done], size[:done])))
                yield from part.filter(pa.array(keep)).combine_chunks().to_batches()
            held, open_ = table.slice(int(edge[done])) if done < len(size) else None, s[-1] if late[-1] else None
        if held is not None and held.num_rows > 1:
            yield from held.append_column("crowded", pa.array(np.zeros(held.num_rows, bool))).combine_chunks().to_batches()

    dealt = rows.repartition(common.parts(nodes.sparkSession), "s").sortWithinPartitions("s")
    return common.materialize(dealt.mapInArrow(run, "s long, node long, n int, i int, p int, w long, crowded boolean"), "shared")


def product(rows: DataFrame, crowded: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose overlap, accumulated over uncrowded columns, leaves room for enough of it.

    Pairs of crowded classes are left to the next round, so a pair meets in no column that isn't looked at here.
    """
    few = rows.where("not crowded").join(common.small(crowded).withColumn("late", F.lit(True)), "node", "left").select("s", "node", "n", "i", "p", "w", F.coalesce("late", F.lit(False)).alias("late"))
    other = few.select("s", *(F.col(c).alias("pnode" if c == "node" else f"p{c}") for c in ("node", "n", "i", "p", "w", "late")))
    met = few.join(other, "s").where((F.col("node") < F.col("pnode")) & ~(F.col("late") & F.col("plate")) & like_sizes(num, den))
    sums = met.groupBy(F.col("node").alias("a"), F.col("pnode").alias("b")).agg(F.count("*").alias("o"), F.max("i").alias("i"), F.max("pi").alias("j"), *(F.first(c).alias(c) for c in ("n", "pn", "p", "pp", "w", "pw")))
    # of the list that ends first all that the other set shares is known; beyond the last common place of the other nothing is
    ends = F.col("w") <= F.col("pw")
    rest = F.least(F.col("n") - F.when(ends, F.col("p")).otherwise(F.col("i") + 1), F.col("pn") - F.when(ends, F.col("j") + 1).otherwise(F.col("pp")))
    return common.materialize(sums.where((num + den) * (F.col("o") + rest) >= num * (F.col("n") + F.col("pn"))).select("a", "b"), "pairs")


def whole_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words, n: int) -> DataFrame:
    """(node, set) of the wanted nodes; one document's text stands for each."""

    def sets(batches):
        for batch in batches:
            for i, j, value, at in shingle_sets(batch.column(1), n, words.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), common.lists(value.view(np.int64), at)], names=["node", "set"])

    places = common.materialize(nodes.select("_k1", "_k2", "node").join(wanted, "node", "left_semi"), "wanted")
    return common.materialize(docs.join(common.small(places), ["_k1", "_k2"]).select("node", "text").mapInArrow(sets, "node long, set array<long>"), "sets")


def blocks(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(s, f, node, n, i, own): each class's first n-grams by rising frequency f that others have too, their places, and own n-grams."""
    grams = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("s"))
    often = grams.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    per = grams.join(often, "s").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("l"))
    own = F.col("n") - F.size("l")
    length = F.expr(f"n - (({num} * n + {den - 1}) div {den}) + 1").cast("int")
    cut = per.select("node", "n", own.alias("own"), F.slice("l", 1, F.greatest(length - own, F.lit(0))).alias("l"))
    placed = cut.select("node", "n", "own", F.posexplode("l").alias("i", "g"))
    return placed.select(F.col("g.s").alias("s"), F.col("g.f").alias("f"), "node", "n", (F.col("i") + F.col("own")).alias("i"), "own")


def like_sizes(num: int, den: int):
    """The bound on a pair of rows by the sizes of the sets, the second one's columns with a p before."""
    return den * F.least("n", "pn") >= num * F.greatest("n", "pn")


def possible(num: int, den: int):
    """The bounds on a pair by its sizes and the places of the first n-gram that both have."""
    n, m, i, j = F.col("n"), F.col("pn"), F.col("i"), F.col("pi")
    return like_sizes(num, den) & ((num + den) * F.least(n - i, m - j) >= num * (n + m))


def compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough, by products of blocks: b's set with those of up to some BLOCK partners a."""
    hubs = pairs.groupBy("b").agg(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}").alias("parts"))
    members = pairs.join(hubs, "b").select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), F.lit(1).alias("k"), F.col("a").alias("node"))
    heads = hubs.select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("k"), F.col("b").alias("node"))
    rows = members.unionByName(heads).join(sets, "node").select("hub", "part", "k", "node", "set")

    def run(batches):
        head = None  # the last hub's set; its members follow it
        for batch in batches:
            hub, k, node = (batch.column(c).to_numpy() for c in (0, 2, 3))
            lists = batch.column(4)
            at = lists.offsets.to_numpy().astype(np.int64)
            value, at = lists.values.to_numpy()[at[0] : at[-1]], at - at[0]
            edge = np.flatnonzero(k == 0)
            edge = np.unique(np.concatenate([[0], edge, [len(k)]]))
            a_, b_ = [], []
            for x, y in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                if k[x] == 0:
                    head, x = value[at[x] : at[x + 1]], x + 1
                if x == y:
                    continue
                found = head[np.minimum(np.searchsorted(head, value[at[x] : at[y]]), len(head) - 1)] == value[at[x] : at[y]]
                both = np.diff(np.append(0, np.cumsum(found))[at[x : y + 1] - at[x]])
                enough = den * both >= num * (len(head) + np.diff(at[x : y + 1]) - both)
                a_.append(node[x:y][enough])
                b_.append(hub[x:y][enough])
            if a_:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_)), pa.array(np.concatenate(b_))], names=["a", "b"])

    n = common.parts(sets.sparkSession)
    return rows.repartition(n, "hub", "part").sortWithinPartitions("hub", "part", "k").mapInArrow(run, "a long, b long")


def spread(rows: DataFrame, ones: DataFrame) -> DataFrame:
    """rows joined by s with a table of one row an s: columns of many rows are dealt to many tasks, with a copy of that one row each."""
    tasks = F.expr(f"f div {SPREAD} + 1")
    many = ones.select("*", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("task")).drop("f")
    return rows.withColumn("task", F.pmod(F.xxhash64("node"), tasks)).join(many, ["s", "task"]).drop("task")


def crowded_links(sets: DataFrame, sure: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between the sets: no pair that could link stays uncompared unless links found or sure connect it already."""
    rows = common.materialize(blocks(sets, num, den), "blocks")
    pivot = rows.groupBy("s", "f").agg(F.min(F.struct("own", "node", "n", "i")).alias("p")).select("s", "f", F.col("p.node").alias("pnode"), F.col("p.own").alias("pown"), F.col("p.n").alias("pn"), F.col("p.i").alias("pi"))
    stars = spread(rows, pivot).where((F.col("node") != F.col("pnode")) & possible(num, den))
    nearest = common.materialize(stars.groupBy("node").agg(F.min(F.struct("pown", "pnode")).alias("p")).select(F.col("node").alias("a"), F.col("p.pnode").alias("b")), "stars")
    found = common.materialize(compared(nearest, sets, num, den), "links")
    connected = graph.components(found.unionByName(sure))
    named = common.materialize(rows.join(connected, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component", "own"), "named")
    common.discard(rows)
    major = named.groupBy("s", "f", "g").agg(F.count("*").alias("k")).groupBy("s", "f").agg(F.max(F.struct("k", "g")).alias("m"), F.count("*").alias("groups")).where("groups > 1").select("s", "f", F.col("m.g").alias("major"))
    open_rows = spread(named, major)
    minor = open_rows.where("g <> major").select("s", *(F.col(c).alias(f"p{c}") for c in ("node", "n", "i", "g")))
    pairs = open_rows.join(minor, "s").where((F.col("g") != F.col("pg")) & possible(num, den)).select(F.least("node", "pnode").alias("a"), F.greatest("node", "pnode").alias("b")).distinct()
    pairs = common.materialize(pairs.join(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    more = common.materialize(compared(pairs, sets, num, den), "links")
    common.discard(named, nearest, pairs)
    return found.unionByName(more)


def connect(docs: DataFrame, nodes: DataFrame, found: np.ndarray, words, n: int, num: int, den: int) -> DataFrame:
    """(node, component) of the classes with links."""
    spark, lists, pairs, left, done = docs.sparkSession, nodes, [], None, []
    for _ in range(LEVELS):
        rows = shared_rows(lists)
        crowded = common.materialize(rows.where("crowded").select("node").unionByName(lists.where("hot").select("node")).distinct(), "crowded")
        pairs.append(product(rows, crowded, num, den))
        common.discard(rows, *([] if lists is nodes else [lists]))
        common.free_shuffles(spark)
        done += [pairs[-1], crowded]
        before, left = left, crowded.count()
        if left <= SAMPLE or (before is not None and 2 * left > before):
            break
        lists, found = again(docs, nodes, crowded, found, words, n, num, den)
    else:
        common.discard(lists)
    every = functools.reduce(DataFrame.unionByName, pairs).distinct()
    sets = whole_sets(docs, nodes, crowded.unionByName(every.select(F.col("a").alias("node"))).unionByName(every.select(F.col("b").alias("node"))).distinct(), words, n)
    sure = common.materialize(compared(every, sets, num, den), "links")
    common.free_shuffles(spark)
    links = crowded_links(sets.join(common.small(crowded), "node", "left_semi"), sure, num, den)
    connected = graph.components(sure.unionByName(links))
    common.discard(sets, *done)
    common.free_shuffles(spark)
    return connected


def near_duplicates(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, _k1, _k2, n_shingles, component_id) of every row: the smallest id that it is connected with, its own included.

    Documents link when den * |intersection| >= num * |union| of their sets of n-word shingles (A-Z in lower case); with
    fewer words the whole sequence is the one shingle. Without words or text (null or empty) the set is empty and links
    with nothing. Rows with equal sets are one class whatever their ids; a row with a null id is part of its class, whose
    number is the smallest id that isn't null (null if none is). _k1 and _k2 name the row's content. An empty table gives
    no rows; other columns of df are not looked at.
    """
    common.bounded_batches(df.sparkSession)
    docs, known, found, words = classes(df, n, num, den, id_col, text_col)
    nodes = number(known)
    rows = common.materialize(known.drop("hot", "first"), "rows")
    common.discard(known)
    connected = connect(docs, nodes, found, words, n, num, den)
    least = rows.where("c is not null").groupBy("c").agg(F.min("id").alias("least"), F.count("*").alias("k"))
    joined = common.materialize(nodes.select("c", "node").join(connected, "node").join(least, "c").select("c", "component", "least"), "joined")
    label = joined.groupBy("component").agg(F.min("least").alias("label"))
    # classes of one document without links aren't named: theirs is its id
    named = least.join(joined.join(label, "component").select("c", "label"), "c", "left").where("k > 1 or label is not null").select("c", F.coalesce("label", "least").alias("label"))
    named = common.materialize(named, "labels")
    common.discard(nodes, joined)
    common.free_shuffles(df.sparkSession)
    out = rows.join(common.small(named).withColumn("named", F.lit(True)), "c", "left")
    return out.select(F.col("id").alias(id_col), "_k1", "_k2", "n_shingles", F.when(F.col("named"), F.col("label")).otherwise(F.col("id")).alias("component_id"))
