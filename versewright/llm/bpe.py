"""Byte-level BPE over Arrow batches: vectorised pre-tokens, merges by the tokenizers library, byte table and offsets.

The pattern of the byte-level vocabularies splits a text into pre-tokens that merges never cross. ``pretokens`` finds
them for a whole block at once from the class of each code point (letter, number, white space, other); the classes are
asked of the tokenizers library itself, once for each code point met, so that they are those of its Unicode tables.
Each distinct pre-token of a block goes to the library once; its ids are copied to wherever it occurs.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

# The classes of code points that the pattern tells apart.
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Distinct pre-tokens whose ids a worker remembers (a cache: results don't depend on it).
REMEMBER = 350_000
#: White space that stands for no byte (see byte_chars), so it can part pre-tokens.
APART = "\u2003"


def byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabularies: itself where it prints, else one from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of two bytes or more is merged from: what is left of its bytes by all lower ranks."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        if len(token) > 1:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
                if ranks.get(parts[at] + parts[at + 1], rank) >= rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encoder and decoder of one vocabulary: a tokenizers .json of byte-level BPE, or a file of ranks.

    Special strings of a .json file are single tokens wherever a text holds them, as the library has it by default;
    files of ranks have none.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        chars = byte_chars()
        self.specials: dict[bytes, int] = {}
        if path.endswith(".json"):
            with open(path) as f:
                spec = json.load(f)
            kind = spec.get("pre_tokenizer") or {}
            if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
                raise ValueError(f"{path} isn't a plain byte-level vocabulary")
            self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
            tk = Tokenizer.from_file(path)
            vocab = tk.get_vocab(with_added_tokens=False)
        else:
            ranks = read_ranks(path)
            name = lambda b: "".join(chars[x] for x in b)
            vocab = {name(t): r for t, r in ranks.items()}
            tk = Tokenizer(models.BPE(vocab=vocab, merges=[(name(a), name(b)) for a, b in merges_of(ranks)], ignore_merges=True))
        self.tk = tk
        self.chars = dict(enumerate(chars))
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        byte_of = {c: b for b, c in enumerate(chars)}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        table = [b""] * self.size
        for t, i in vocab.items():
            table[i] = bytes(byte_of[c] for c in t)
        for t, i in self.specials.items():
            table[i] = t
        self.table = table
        self.token_len = np.array([len(t) for t in table], np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.classes = np.zeros(0x110000, np.uint8)
        self._forget()

    def _ask(self, points: np.ndarray) -> None:
        """The class of code points: of what lead do they continue the run?"""
        text = "".join(f"\nx{chr(c)}\n1{chr(c)}\n!{chr(c)}" for c in points.tolist())
        starts = np.zeros(len(text) + 1, bool)
        starts[[a for _, (a, _) in self.split.pre_tokenize_str(text)]] = True
        joins = ~starts[:-1].reshape(-1, 3, 3)[:, :, 2]
        self.classes[points] = np.select([joins[:, 0], joins[:, 1], joins[:, 2]], [LETTER, NUMBER, OTHER], SPACE)

    def pretokens(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Byte offsets where pre-tokens start, over whole texts that start at the byte offsets ``starts``."""
        if not len(data):
            return np.zeros(0, np.int64)
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        cls = self.classes[cp]
        if not cls.all():
            self._ask(np.unique(cp[cls == 0]))
            cls = self.classes[cp]
        n = len(cp)
        width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
        at = np.cumsum(width, dtype=np.int64) - width
        special, inside = [], None
        for s in self.specials:
            raw, i = data.tobytes(), -1
            while (i := raw.find(s, i + 1)) >= 0:
                special.append((i, i + len(s)))
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(at, starts[starts < len(data)])] = True
        if special:
            marks = np.searchsorted(at, np.array(special))
            # a special string that spans two texts is none
            marks = np.array([m for m in marks.tolist() if not first[m[0] + 1 : m[1]].any()], np.int64).reshape(-1, 2)
            inside = np.zeros(n + 1, bool)
            for a, b in marks.tolist():
                first[[a, b]] = True
                inside[a + 1 : b] = True
        first[n] = True
        run = first[:n].copy()
        run[1:] |= cls[1:] != cls[:-1]
        space = cls == SPACE
        # a single blank before a run of anything else belongs to it
        blank = np.zeros(n, bool)
        blank[1:] = (cp[:-1] == 0x20) & ~space[1:] & ~first[1:n]
        cut = run & ~blank
        # of white space before something else the last character stands apart
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
        cut |= last
        # contractions: an apostrophe that starts a pre-token, and the letters that go with it
        quote = np.flatnonzero((cp == 0x27) & cut)
        quote = quote[quote + 1 < n]
        if len(quote):
            ends = np.append(cp, [0, 0])
            limit = np.append(first, [True])
            a, b = ends[quote + 1], ends[quote + 2]
            free = ~limit[quote + 1]
            one = free & np.isin(a, [ord(c) for c in "stmd"])
            two = free & ~limit[quote + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            grown = np.append(cut, [True, True, True])
            for hit, size in ((one, 2), (two, 3)):
                q = quote[hit]
                grown[q + 1] = False
                grown[q + size] |= True
            cut = grown[:n]
        if inside is not None:
            cut &= ~inside[:n]
        return at[np.flatnonzero(cut)]

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}  # the number of a pre-token
        self.ends, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)  # ends[k], ends[k + 1]: where its ids stand in flat

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pre-tokens, one after another, and how many each has."""
        if len(self.slot) > REMEMBER:
            self._forget()
        slot = self.slot
        at = list(map(slot.get, pieces))
        if None in at:
            missing = [i for i, x in enumerate(at) if x is None]
            merge, lens, flat = self.tk.model.tokenize, [], []
            for i, text in zip(missing, APART.join([pieces[i].decode("latin-1") for i in missing]).translate(self.chars).split(APART), strict=True):
                p = pieces[i]
                found = [self.specials[p]] if p in self.specials else [t.id for t in merge(text)]
                at[i] = slot[p] = len(slot)
                lens.append(len(found))
                flat += found
            k, end = len(slot) - len(lens), int(self.ends[len(slot) - len(lens)])
            while len(self.ends) <= len(slot):
                self.ends = np.append(self.ends, np.zeros_like(self.ends))
            while len(self.flat) < end + len(flat):
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            self.ends[k + 1 : len(slot) + 1] = end + np.cumsum(lens)
            self.flat[end : end + len(flat)] = flat
        where = np.array(at, np.int64)
        size = self.ends[where + 1] - self.ends[where]
        return self.flat[common.ragged(self.ends[where], size)], size

    def blocks(self, data: np.ndarray, offsets: np.ndarray):
        """(row, whether it ends the row, part) tables of bounded size: (byte slice, starts of rows in it, first row, last row done).

        A long text is cut only before white space that follows something else, where a pre-token always ends.
        """
        for i, j in common.row_groups(offsets):
            lo, hi = int(offsets[i]), int(offsets[j])
            while j == i + 1 and hi - lo > 2 * common.BLOCK and not self.specials_near(data, lo, hi):
                part = data[lo + common.BLOCK : min(hi, lo + 2 * common.BLOCK)]
                gaps = np.flatnonzero((part[1:] == 0x20) & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
                if not len(gaps):
                    break
                cut = lo + common.BLOCK + int(gaps[0]) + 1
                yield data[lo:cut], np.zeros(1, np.int64), i, i + 1
                lo = cut
            starts = offsets[i:j] - offsets[i]
            yield data[lo:hi], (np.zeros(1, np.int64) if j == i + 1 else starts), i, j

    def specials_near(self, data: np.ndarray, lo: int, hi: int) -> bool:
        """Special strings hold no blank, so cuts before blanks never split one."""
        return any(b" " in s for s in self.specials)

    def pieces(self, data: np.ndarray, offsets: np.ndarray):
        """For each block: distinct pre-tokens, the code of each occurrence, the row of each occurrence."""
        for part, starts, i, j in self.blocks(data, offsets):
            cuts = self.pretokens(part, starts)
            if not len(cuts):
                continue
            coded = common.strings(part, np.append(cuts, len(part))).dictionary_encode()
            rows = i + np.searchsorted(starts, cuts, "right") - 1
            yield coded.dictionary, coded.indices.to_numpy(), rows

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the offsets of the rows among them."""
        out, counts = [], np.zeros(len(offsets) - 1, np.int64)
        for words, codes, rows in self.pieces(data, offsets):
            flat, lens = self.ids_of(words.to_numpy(zero_copy_only=False).tolist())
            each = common.strings(flat.view(np.uint8), 4 * np.append(0, np.cumsum(lens)))
            out.append(np.frombuffer(each.take(pa.array(codes)).buffers()[2], np.uint32))
            counts += np.bincount(rows, lens[codes], len(counts)).astype(np.int64)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.append(0, np.cumsum(counts))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and their offsets. Tokens may hold parts of characters, so only whole rows are text."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        size = self.token_len[ids]
        ends = np.append(0, np.cumsum(size))
        return self.token_bytes[common.ragged(self.token_start[ids], size)], ends[offsets]

    def spans(self, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one character of each token in the text: the characters that its bytes touch."""
        ends = np.cumsum(self.token_len[ids])
        begun = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # characters begun before each byte
        starts = ends - self.token_len[ids]
        lead = np.append((data & 0xC0) != 0x80, True)
        return np.where(lead[starts], begun[starts], begun[starts] - 1), begun[ends]


@functools.cache
def codec(path: str) -> Codec:
    """One for each worker process and vocabulary."""
    return Codec(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(id, ids array<int>[, starts array<int>, ends array<int>]): the ids of each whole text, and the characters each touches.

    A null or empty text has no ids. Rows with equal ids or texts are encoded one by one; null ids stay null. Other
    columns of df are not looked at.
    """
    spark = df.sparkSession
    common.bounded_batches(spark)
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        fields += [T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]

    def run(batches):
        own = codec(path)
        for batch in batches:
            data, at = common.buffers(batch.column(1))
            ids, where = own.encode(data, at)
            cols = [batch.column(0), common.lists(ids.view(np.int32), where)]
            if offsets:
                pairs = [own.spans(ids[where[i] : where[i + 1]], data[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
                for k in (0, 1):
                    flat = np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0)
                    cols.append(common.lists(flat.astype(np.int32), where))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that ids stand for (null or empty ids: empty). An unknown id is an error.

    Bytes, as a token may end inside a character: cut anywhere, decode the parts and join the bytes before reading text.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")

    def run(batches):
        own = codec(path)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids_col))
            col = pc.fill_null(col, pa.scalar([], col.type)) if col.null_count else col
            where = col.offsets.to_numpy().astype(np.int64)
            ids = col.values.to_numpy(zero_copy_only=False)[where[0] : where[-1]]
            data, at = own.decode(ids, where - where[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, common.strings(data, at)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))
