"""WARC archives by way of a chunked record table.

A payload becomes rows (record, chunk number, bytes) of bounded size with the digest and length of all bytes so far, the
last one carrying those of the whole; beyond the row it arrives in, nothing handles it as one piece. Writers and readers
stream such rows: a writer task meets a record's head row and then its chunks, and appends each to a gzip member; a
reader task inflates and emits chunks.

Records with equal payloads are one response and revisits that refer to it. A task's archive is written under a name of
the attempt and then renamed, so a lost executor leaves no half archive behind under a name that anyone reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of a chunk at most, and of payload in an archive, about.
CHUNK, ARCHIVE = 1 << 20, 1 << 30
# Fixed values of the format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_FIELDS = "chunk long, chunk_bytes binary, so_far long, digest string, last boolean"


def digest_text(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def pieces_of(payload, size: int):
    """(chunk, bytes, length so far, digest so far, last) of a buffer: digests are carried on, and bytes are views of it."""
    sha, view = hashlib.sha1(), memoryview(payload)
    count = max(1, -(-len(view) // size))
    for k in range(count):
        part = view[k * size : (k + 1) * size]
        sha.update(part)
        yield k, part, min((k + 1) * size, len(view)), digest_text(sha), k == count - 1


def chunks(df: DataFrame, id_col: str, payload_col: str, *carry: str, size: int = CHUNK) -> DataFrame:
    """(id, carried columns, record, chunk, chunk_bytes, so_far, digest, last): every payload as chunk rows.

    record numbers the rows of df, repeated ones too, anew with each evaluation. A null or empty payload is one empty chunk.
    """
    common.bounded_batches(df.sparkSession)
    picked = df.select(df[id_col].alias("id"), *(df[c].alias(f"c{k}") for k, c in enumerate(carry)), df[payload_col].cast("binary").alias("payload"))
    fields = [*picked.schema.fields[:-1], T.StructField("record", T.LongType()), *T.StructType.fromDDL(CHUNK_FIELDS).fields]
    names = [f.name for f in fields]

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            rows, out, held = [], [[] for _ in range(5)], 0

            def flush():
                take = pa.array(rows, pa.int64())
                types = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
                numbers = pa.array([base + i for i in rows], pa.int64())
                return pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:-1]), numbers, *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=names)

            for i in range(batch.num_rows):
                value = column[i].as_buffer() if column[i].is_valid else None
                for piece in pieces_of(value if value is not None else b"", size):
                    rows.append(i)
                    for x, v in zip(out, piece, strict=True):
                        x.append(bytes(v) if isinstance(v, memoryview) else v)
                    held += len(piece[1])
                    if held > 4 * size:
                        yield flush()
                        rows, out, held = [], [[] for _ in range(5)], 0
            if rows:
                yield flush()
            base += batch.num_rows

    out = picked.mapInArrow(run, T.StructType(fields))
    return out.select(F.col("id").alias(id_col), *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)), *(f.name for f in fields[1 + len(carry) :]))


def header(fields: list[tuple[str, str]]) -> bytes:
    clean = lambda v: "".join(c if c not in "\r\n" else " " for c in v)
    return VERSION + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields).encode() + b"\r\n"


def record_urn(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'record:' + key)}>"


def open_shared(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI in the shared folder."""
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return arrow_fs.LocalFileSystem(), path


#: What a record's head says, and where its payload stands: in rows of its own (chunk numbers), or beside the head (WHOLE).
HEAD = "key string, url string, sha string, n long, revisit boolean, target string"
ALONE, WHOLE = -1, -2


def record_head(key: str | None, url: str | None, sha: str, n: int, revisit: bool, target: str | None, date: str) -> bytes:
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_urn(str(key))), ("WARC-Date", date), ("WARC-Target-URI", url or "")]
    fields += [("WARC-Payload-Digest", "sha1:" + sha), ("X-Payload-Length", str(n))]
    if key is not None:
        fields.append(("X-Record-Key", key))
    if revisit:
        fields += [("WARC-Refers-To", record_urn(str(target))), ("WARC-Profile", REVISIT_PROFILE)]
        if target is not None:
            fields.append(("X-Refers-To-Key", target))
    return header([*fields, ("Content-Type", "text/html"), ("Content-Length", str(0 if revisit else n))])


def archive(rows: DataFrame, folder: str, prefix: str, date: str) -> DataFrame:
    """(path, records, bytes): an archive for each partition of rows (chunk, the head's columns, chunk_bytes), heads before their chunks."""

    def run(batches):
        task = TaskContext.get()
        shared, root = open_shared(folder)
        name = f"{root}/{prefix}-{task.partitionId():06d}.warc.gz"
        temporary = f"{name}.{task.taskAttemptId()}.tmp"
        out, records, member, skip = None, 0, None, False
        for batch in batches:
            if out is None and batch.num_rows:
                shared.create_dir(root, recursive=True)
                out = shared.open_output_stream(temporary, compression=None)
            payload = batch.column(7)
            heads = zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True)
            for i, (chunk, head) in enumerate(zip(batch.column(0).to_pylist(), heads, strict=True)):
                if chunk < 0:
                    if member:
                        out.write(member.compress(END) + member.flush())
                    member, skip = zlib.compressobj(6, zlib.DEFLATED, 31), head[4]  # a gzip member for each record
                    out.write(member.compress(record_head(*head, date)))
                    records += 1
                if chunk != ALONE and not skip:
                    out.write(member.compress(payload[i].as_buffer()))
        if out is None:
            return
        out.write(member.compress(END) + member.flush())
        total = out.tell()
        out.close()
        if shared.get_file_info(name).type != arrow_fs.FileType.NotFound:
            shared.delete_file(name)
        shared.move(temporary, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [total]})

    columns = ["chunk", *(f.name for f in T.StructType.fromDDL(HEAD).fields), "chunk_bytes"]
    return rows.select(columns).mapInArrow(run, "path string, records long, bytes long")


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z", size: int = CHUNK) -> DataFrame:
    """Write a record per row into gzip archives in a shared folder; returns (path, records, bytes), one row an archive.

    Of the rows with equal payloads of at least ``least`` bytes one with the largest id is the response and all others
    revisit it, those that repeat its id too. A null id comes before all others and is written as no key (a revisit of
    one refers to no key), a null url as an empty one, a null payload as an empty one. An empty table gives no archive.

    Records of one chunk, almost all there are, go to archives where they stand. Those of more meet their heads, which
    state the digest of the whole, by a shuffle.
    """
    spark = df.sparkSession
    table = common.materialize(chunks(df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[payload_col].alias("payload")), "id", "payload", "url", size=size), "chunks")
    ends = table.where("last").select("record", "id", "url", F.col("digest").alias("sha"), F.col("so_far").alias("n"), "chunk", "chunk_bytes")
    groups = common.materialize(ends.where(F.col("n") >= least).groupBy("sha", "n").agg(F.max(F.struct("id", "record")).alias("top"), F.count("*").alias("k")).where("k > 1").select("sha", "n", "top"), "equal")
    revisit = F.coalesce(F.col("record") != F.col("top.record"), F.lit(False))
    heads = ends.join(common.small(groups), ["sha", "n"], "left").withColumns({"key": F.col("id").cast("string"), "revisit": revisit, "target": F.when(revisit, F.col("top.id").cast("string"))})
    one = heads.where("chunk = 0").withColumn("chunk", F.lit(WHOLE).cast("long"))
    long = heads.where("chunk > 0").withColumns({"chunk": F.lit(ALONE).cast("long"), "chunk_bytes": F.lit(None).cast("binary")}).drop("id", "top")
    parts = table.where("chunk > 0 or not last").select("record", "chunk", "chunk_bytes").unionByName(long, allowMissingColumns=True)
    total = table.where("chunk > 0 or not last").agg(F.coalesce(F.sum(F.octet_length("chunk_bytes")), F.lit(0))).first()[0]
    dealt = parts.repartition(max(common.parts(spark), -(-total // ARCHIVE)), "record").sortWithinPartitions("record", "chunk")
    made = archive(one, folder, "part", date)
    archives = common.materialize(made.unionByName(archive(dealt, folder, "long", date)) if total else made, "archives")
    common.discard(table, groups)
    common.free_shuffles(spark)
    return archives


class Stream:
    """Bytes of a gzip file with any number of members, inflated as they are asked for."""

    def __init__(self, source, step: int = 1 << 18):
        self.source, self.step, self.ready, self.z, self.rest = source, step, bytearray(), None, b""

    def more(self) -> bool:
        if not self.rest:
            self.rest = self.source.read(self.step)
            if not self.rest:
                return False
        if self.z is None:
            self.z = zlib.decompressobj(31)
        self.ready += self.z.decompress(self.rest, 4 * self.step)
        if self.z.eof:
            self.rest, self.z = self.z.unused_data, None
        else:
            self.rest = self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before a mark, and past it; None at the end of the file."""
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                if self.ready.strip():
                    raise ValueError("a record is cut off")
                return None
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("a record is cut off")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def parse(source, size: int = CHUNK):
    """(fields, chunk, bytes, length so far, digest so far, last) of each record, in pieces of bounded size."""
    stream = Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode("utf-8", "replace").strip().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts with {first[:20]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        left, so_far, k, sha = int(fields["content-length"]), 0, 0, hashlib.sha1()
        while left or not k:
            part = stream.take(min(left, size))
            sha.update(part)
            left, so_far = left - len(part), so_far + len(part)
            yield fields, k, part, so_far, digest_text(sha), not left
            k += 1
        stream.take(len(END))


READ_FIELDS = "record_key string, url string, record_type string, refers_to string, stated_digest string, stated_bytes long, " + CHUNK_FIELDS


def read(spark: SparkSession, archives: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives in a column ``path``: a row for each record and chunk, digests carried on.

    record_key and refers_to are null where a record states none. An archive named twice is read twice; no archives, no
    rows. A record that is cut off or no record is an error, never left out.
    """
    schema = T.StructType.fromDDL(READ_FIELDS)
    arrow_types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in schema.fields]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                shared, name = open_shared(path)
                with shared.open_input_stream(name, compression=None) as source:
                    rows, held = [], 0
                    for f, k, part, so_far, digest, last in parse(source, size):
                        stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append((f.get("x-record-key"), f.get("warc-target-uri"), f.get("warc-type"), f.get("x-refers-to-key"), stated, int(f.get("x-payload-length", so_far)), k, part, so_far, digest, last))
                        held += len(part) + 200
                        if held > 4 * size:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow_types, strict=True)], names=schema.names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow_types, strict=True)], names=schema.names)

    n = max(1, min(archives.count(), 4 * common.parts(spark)))
    return archives.select("path").repartition(n, "path").mapInArrow(run, schema)


def records(table: DataFrame) -> DataFrame:
    """A row for each record of a chunked table, from its last chunk: what it states, checked against the bytes of a response.

    Records with the same key, or none, are rows of their own. A response whose bytes aren't those that it states is an error.
    """
    ends = table.where("last")
    sound = (F.col("record_type") != "response") | ((F.col("digest") == F.col("stated_digest")) & (F.col("so_far") == F.col("stated_bytes")))
    return ends.select("record_key", "url", "record_type", "refers_to", F.col("stated_bytes").alias("payload_bytes"), F.when(sound, F.col("stated_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce("record_key", F.lit("without a key"))))).alias("payload_digest"))
