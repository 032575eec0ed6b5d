"""Near duplicates among vectors: learned binary codes, multi-index Hamming tables, reranking by the vectors themselves.

1. Iterative quantisation on a bounded sample learns rotations of the principal axes for which the signs of the rotated
   components lose least; several starts give several rotations. All vectors get codes. Vectors aren't centred: that
   would widen the angles between them, most of all in a hot cluster, and the tables are laid out for angles as they are.
2. The codes' substrings are the keys of the tables. Vectors that agree in a substring and whose codes are close become
   neighbours; a cell of a table yields a spanning forest of its neighbours, not their pairs. Cells over a bound are
   dealt out in shares, and every two shares meet in a block of bounded size.
3. What the forests connect is a candidate group. Within groups of up to GROUP vectors all pairs are compared by cosine in
   double precision, in blocks of bounded size. A larger group, which chains of neighbours may have made of vectors far
   apart, goes back to its cells: there the vectors of a cell are compared, and a pair counts in the first table that it
   meets in. Blocks give counts and again a forest of true links. No list of pairs is ever made.

Equal vectors are one class with a weight, so copies cost nothing. Each link is a cosine that was computed, so none is
wrong; the recall to expect is that of the tables, see ``layout``. The tables serve inputs of every size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

#: Vectors that rotations are learned on at most, and rounds of it.
SAMPLE, ROUNDS = 10_000, 20
#: Bits of the two code words by which a cell's vectors are told apart, and the recall that tables are laid out for.
CODE, RECALL = 128, 0.97
#: Vectors of a cell whose codes are compared at once; more are dealt out. Vectors of a block of exact comparison, and of
#: a candidate group that is compared as a whole.
CELL, BLOCK, GROUP = 2048, 512, 2048


def learn(x: np.ndarray, count: int, seed: int = 5) -> tuple[np.ndarray, list[np.ndarray]]:
    """The origin of codes, and as many projections (dimensions x bits) by iterative quantisation from different starts.

    Where the rows hold fewer dimensions than a code has bits, a projection has as many bits as dimensions.
    """
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(x.T @ x)
    low = x @ axes
    out = []
    for _ in range(count):
        turn, _ = np.linalg.qr(rng.standard_normal((x.shape[1],) * 2))
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.sign(low @ turn).T @ low)
            turn = (left @ right).T
        out.append(axes @ turn)
    return np.zeros(x.shape[1]), out


def layout(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits of a substring): cells of about half a vector, and as many tables as two vectors of just that cosine need.

    Their bits differ with the angle's share of a half turn; they meet where one substring agrees.
    """
    bits = min(24, max(8, math.ceil(math.log2(max(n, 2))) + 1))
    meet = (1 - math.acos(min(cosine, 1.0)) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1, bits


def unit(rows: list, dims: int) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(close: np.ndarray) -> np.ndarray:
    """For each node of a symmetric neighbour matrix the smallest node that it is connected with."""
    label = np.arange(len(close))
    near = close | np.eye(len(close), dtype=bool)
    while True:
        least = np.where(near, label[None, :], len(label)).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def by_groups(batches, keys: int):
    """(table, group offsets): whole groups from batches that are sorted by their first columns."""
    held: list[pa.RecordBatch] = []

    def split(table):
        cols = [table.column(k).to_numpy() for k in range(keys)]
        return np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        new = split(table)
        if len(new):
            held = table.slice(int(new[-1])).to_batches()
            yield table.slice(0, int(new[-1])).combine_chunks(), np.append(0, new)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.concatenate([[0], split(table), [table.num_rows]])


def by_key(batches, keys: int):
    """The groups one by one."""
    for table, edge in by_groups(batches, keys):
        yield from (table.slice(a, b - a) for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False))


def classes(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(k1, k2, node, vec, weight, least): the distinct usable vectors; the rows as (id, k1, k2), null if unusable; the dimensions.

    Usable vectors have the most common number of components, all finite, and aren't zero. k1 and k2 name a vector.
    """
    vec = F.col("vec")
    rows = df.select(df[id_col].alias("id"), df[vec_col].cast("array<double>").alias("vec"))
    sizes = rows.where(vec.isNotNull()).groupBy(F.size("vec").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(1).collect()
    dims = sizes[0]["k"] if sizes else 0
    fine = (F.size("vec") == dims) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.select("id", F.when(F.coalesce(fine, F.lit(False)), vec).alias("vec"))
    rows = rows.select("id", "vec", *(F.when(vec.isNotNull(), k).alias(f"k{i}") for i, k in ((1, F.xxhash64("vec")), (2, F.xxhash64(F.lit("second"), "vec")))))
    one = rows.where("vec is not null").groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("id").alias("least"))
    return common.materialize(one.select("k1", "k2", F.monotonically_increasing_id().alias("node"), "vec", "weight", "least"), "vectors"), rows.drop("vec"), dims


class Tables:
    """The rotations that were learned, and where each table's substring stands in the signs of a vector."""

    def __init__(self, vectors: DataFrame, dims: int, total: int, tables: int, bits: int):
        some = vectors.select("vec") if total <= SAMPLE else vectors.select("vec").sample(SAMPLE / total, seed=3)
        x = unit([v.as_py() for v in some.toArrow()["vec"]], dims)  # some SAMPLE rows
        self.dims, self.tables, self.width = dims, tables, min(bits, dims)
        self.each = max(1, dims // self.width)
        mean, turns = learn(x, max(-(-tables // self.each), -(-CODE // dims)))
        self.bits = min(CODE, dims * len(turns))
        self.known = vectors.sparkSession.sparkContext.broadcast((mean, np.concatenate(turns, axis=1)))

    def of(self, vec: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit vectors, the two words of their codes, their key in each table) of a column of vectors."""
        mean, turn = self.known.value
        x = vectors_of(vec, self.dims)
        signs = (x - mean) @ turn > 0
        words = np.packbits(signs[:, :CODE], axis=1)
        words = np.pad(words, ((0, 0), (0, 16 - words.shape[1]))).view(np.int64)
        at = [t // self.each * self.dims + t % self.each * self.width for t in range(self.tables)]
        return x, words, np.stack([signs[:, a : a + self.width] @ (1 << np.arange(self.width, dtype=np.int64)) for a in at], axis=1)


def vectors_of(vec: pa.Array, dims: int) -> np.ndarray:
    return unit(vec.values.to_numpy()[vec.offsets[0].as_py() : vec.offsets[-1].as_py()], dims)


def codes(vectors: DataFrame, tables: Tables) -> DataFrame:
    """(key, node, c1, c2): a row for each vector and table; key names the table and the substring."""

    def run(batches):
        for batch in batches:
            _, words, keys = tables.of(batch.column(1))
            for t in range(tables.tables):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t] + (t << 48)), batch.column(0), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], names=["key", "node", "c1", "c2"])

    return vectors.select("node", "vec").mapInArrow(run, "key long, node long, c1 long, c2 long")


def dealt_in_shares(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """rows (key, node, ...) with (shares, own, i, j): cells of more than ``most`` rows in shares that all meet; and the table of such cells."""
    crowded = common.materialize(rows.groupBy("key").agg(F.count("*").alias("k")).where(f"k > {most}").select("key", F.expr(f"(k + {most - 1}) div {most}").alias("shares")), "crowded")
    dealt = rows.join(common.small(crowded), "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("shares")))
    # of two shares or more each pair meets, and a share with itself in each of its pairs
    others = F.when(F.col("shares") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1), lambda o: o != F.col("own")))
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other"), crowded


def neighbours(cells: DataFrame, most: int) -> DataFrame:
    """(node, root) for cells dealt by (key, i, j): links that connect what is close in a cell, or in two of its shares."""

    def apart(x, y):
        return np.bitwise_count(x[0] ^ y[0]) + np.bitwise_count(x[1] ^ y[1])

    def run(batches):
        for table, edge in by_groups(batches, 3):
            size = np.diff(edge)
            node = table.column(3).to_numpy()
            w = [table.column(k).to_numpy().view(np.uint64) for k in (4, 5)]
            row = np.repeat(np.arange(len(size)), size)
            few = (size <= 8)[row]
            of, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(1, 8):  # of small cells all pairs at once
                if len(node) <= k:
                    break
                at = np.flatnonzero(few[k:] & (row[k:] == row[:-k]))
                at = at[apart([x[at + k] for x in w], [x[at] for x in w]) <= most]
                of.append(at + k)
                to.append(at)
            for g in np.flatnonzero(~few[edge[:-1]]).tolist():
                a = int(edge[g])
                s = slice(a, int(edge[g + 1]))  # two shares hold about 2 * CELL rows
                root = forest(apart([x[s, None] for x in w], [x[None, s] for x in w]) <= most)
                keep = np.flatnonzero(root != np.arange(len(root)))
                of.append(a + keep)
                to.append(a + root[keep])
            yield pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(of)]), pa.array(node[np.concatenate(to)])], names=["node", "root"])

    n = common.parts(cells.sparkSession)
    dealt = cells.select("key", "i", "j", "node", "c1", "c2").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return dealt.mapInArrow(run, "node long, root long")


def candidates(vectors: DataFrame, cosine: float, tables: Tables) -> DataFrame:
    """(node, component): the groups that forests of all cells connect."""
    rows = common.materialize(codes(vectors, tables), "codes")
    expected = math.acos(cosine) / math.pi
    most = math.ceil(tables.bits * expected + 4 * math.sqrt(tables.bits * expected * (1 - expected)))
    dealt, crowded = dealt_in_shares(rows, CELL)
    found = graph.components(neighbours(dealt, most).distinct(), "node", "root")
    common.discard(rows, crowded)
    return found


def compare(vectors: DataFrame, groups: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(node, n, root): by blocks of candidate groups, weights of the vectors each node links to, and its tree's first node."""
    size = groups.groupBy("component").agg(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    placed = groups.join(size, "component").select("node", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"))
    rows = placed.join(vectors.select("node", "vec", "weight"), "node")
    cells = rows.select("component", "node", "vec", "weight", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "vec", "weight")

    def run(batches):
        for cell in by_key(batches, 3):
            node, own, weight = (cell.column(k).to_numpy() for k in (4, 3, 6))
            vec = cell.column(5).combine_chunks()
            x = unit(vec.values.to_numpy()[vec.offsets[0].as_py() : vec.offsets[-1].as_py()], dims)
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            if cell.column(1)[0].as_py() != cell.column(2)[0].as_py():  # a block with itself is another cell
                linked &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(linked @ weight), pa.array(node[forest(linked)])], names=["node", "n", "root"])

    n = common.parts(vectors.sparkSession)
    dealt = cells.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(run, "node long, n long, root long")


def compare_cells(vectors: DataFrame, tables: Tables, cosine: float) -> DataFrame:
    """The same for the vectors of large groups, by their cells in all tables; a pair counts in the first that it meets in."""

    def keyed(batches):
        for batch in batches:
            _, _, keys = tables.of(batch.column(1))
            whole = common.strings(keys.astype("<u4").reshape(-1).view(np.uint8), np.arange(len(keys) + 1) * 4 * tables.tables)
            for t in range(tables.tables):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t] + (t << 48)), *(batch.column(c) for c in range(3)), whole], names=["key", "node", "vec", "weight", "keys"])

    def run(batches):
        for cell in by_key(batches, 3):
            i, j, shares, key = (cell.column(c)[0].as_py() for c in (1, 2, 3, 0))
            if cell.num_rows < 2:
                continue
            own, node, weight = (cell.column(c).to_numpy() for c in (4, 5, 7))
            x = vectors_of(cell.column(6).combine_chunks(), tables.dims)
            data, at = common.buffers(cell.column(8))
            keys = data[at[0] : at[-1]].view("<u4").reshape(len(node), -1)
            linked = x @ x.T >= cosine
            for t in range(key >> 48):
                linked &= keys[:, t][:, None] != keys[:, t][None, :]
            np.fill_diagonal(linked, False)
            if i != j:  # pairs within a share count in one of its blocks
                for share, here in ((i, j == i + 1), (j, i == 0 and j == shares - 1)):
                    if not here:
                        linked &= ~((own == share)[:, None] & (own == share)[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(linked @ weight), pa.array(node[forest(linked)])], names=["node", "n", "root"])

    n = common.parts(vectors.sparkSession)
    rows = vectors.select("node", "vec", "weight").mapInArrow(keyed, "key long, node long, vec array<double>, weight long, keys binary")
    dealt, _ = dealt_in_shares(rows, BLOCK)
    dealt = dealt.select("key", "i", "j", "shares", "own", "node", "vec", "weight", "keys").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "node long, n long, root long")


def near_duplicates(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: the other rows linked to it, the smallest id it is connected with.

    Rows link at a cosine of ``cosine`` or more, those at just that too. Vectors that are null, zero, hold null or
    non-finite components, or have another number of components than most, link with nothing. Equal vectors link with
    each other, whatever their ids; a null id is in its component, whose number is the smallest id that isn't null.
    kept: the row's id is that number. An empty table gives no rows; other columns of df are not looked at.
    """
    common.bounded_batches(df.sparkSession)
    vectors, rows, dims = classes(df, id_col, vec_col)
    n = vectors.count()
    if not n:
        own = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return own.withColumn("kept", F.col(id_col).isNotNull())
    tables = Tables(vectors, dims, n, *layout(n, cosine, recall))
    groups = common.materialize(candidates(vectors, cosine, tables), "groups")
    large = common.materialize(groups.groupBy("component").agg(F.count("*").alias("k")).where(f"k > {GROUP}").select("component"), "large")
    found = compare(vectors, groups.join(common.small(large), "component", "left_anti"), dims, cosine)
    if not large.isEmpty():
        found = found.unionByName(compare_cells(vectors.join(groups.join(common.small(large), "component", "left_semi").select("node"), "node"), tables, cosine))
    compared = common.materialize(found, "compared")
    common.discard(groups, large)
    common.free_shuffles(df.sparkSession)
    counts = compared.groupBy("node").agg(F.sum("n").alias("n"))
    named = vectors.select("node", "least").join(graph.components(compared.where("node <> root"), "node", "root"), "node")
    label = named.select("node", "component").join(named.groupBy("component").agg(F.min("least").alias("label")), "component").select("node", "label")
    table = vectors.select("k1", "k2", "node", "weight", "least").join(counts, "node", "left").join(label, "node", "left").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "least").alias("component_id"))
    out = rows.where("k1 is not null").join(common.materialize(table, "labels"), ["k1", "k2"], "left").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("k1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
