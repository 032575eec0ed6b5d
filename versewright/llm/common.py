"""Ground shared by the operators of this subpackage: batches of text as numpy buffers, and tables in the shared folder.

Texts arrive in Arrow batches. ``buffers`` shows a column of them as one byte array with row offsets (null: empty), and
``spans`` walks it in blocks of bounded size, so that numpy's work arrays stay small however long a batch or a text is.

``materialize`` writes an intermediate result as Parquet below ``spark.checkpoint.dir`` and reads it back: that cuts the
lineage, survives lost executors, and makes the driver's numbers about a table (histograms, counts) and the rows that
later stages read come from the same run.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow's own allocators keep what they once had; the system's gives it back when asked, see give_back.
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of text that numpy works on at once.
BLOCK = 1 << 19
#: Bytes and rows of an Arrow batch sent to Python at most (one row may be longer).
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where it is unset one of our own will do if there is but this machine (a local master); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.versewright.sharedDir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="versewright-")
        spark.conf.set("spark.versewright.sharedDir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's queries by bytes and rows, as rows may hold very long texts.

    Results are lazy, so the bounds have to outlast the call. They are lowered where they are higher, never raised.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_written: list[tuple[SparkSession, str]] = []


def _forget() -> None:
    for spark, path in _written:
        try:
            drop(spark, path)
        except Exception:  # the session may have ended first
            return


atexit.register(_forget)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that materialize wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/versewright/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return it reread."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once what was made of them is itself written."""
    for t in tables:
        path = t._written_to
        drop(t.sparkSession, path)
        _written.remove((t.sparkSession, path))


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver forget plans that nothing refers to any more, so that Spark deletes their shuffle files.

    Spark does so when the driver's heap is collected, by itself every half an hour; after a shuffle of the size of the
    input that is late.
    """
    gc.collect()
    spark._jvm.System.gc()


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def give_back() -> None:
    """Give memory that arrays of earlier batches held back to the system: workers live on, and share the machine."""
    if libc := _libc():
        libc.malloc_trim(0)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the offsets of its rows (one more than rows; the first may not be 0)."""
    give_back()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.string()
    col = col.cast(kind)
    if col.null_count:
        col = pc.fill_null(col, b"" if kind == pa.binary() else "")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Inverse of buffers: a binary array over data, without a copy of it."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def lists(values: np.ndarray | pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def row_groups(offsets: np.ndarray, most: int = BLOCK):
    """Ranges (i, j) of whole rows with at most so many bytes, or one row that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start..start+len of each entry, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def small(df: DataFrame, rows: int = 300_000) -> DataFrame:
    """A narrow materialised table, marked for broadcasting if it has at most so many rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of a written table from a frequency n on that at most ``most`` have, found by a histogram of some hundred steps.

    A sort for the first so many would gather that many rows of each task in one.
    """
    step = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    left, least = most, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():
        left -= row["k"]
        if left < 0:
            break
        least = row["step"]
    return counts.where(step >= least) if least is not None else counts.limit(0)


def content_key(id_col: str, text_col: str) -> list:
    """Two 64-bit columns that name a row by its id and text: stable over recomputation, unlike running numbers."""
    c = [F.col(id_col).cast("string"), F.col(text_col)]
    return [F.xxhash64(*c).alias("_k1"), F.xxhash64(F.lit("second"), *c).alias("_k2")]


def parts(spark: SparkSession) -> int:
    """Partitions for work that is dealt by key, at least as many as the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
