"""Words and shingles of many texts at once, as exact codes or 64-bit hashes, over numpy buffers.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return; UTF-8
never uses those bytes inside a character, so bytes will do.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash

from . import common

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close ones."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def invert(odd: int) -> int:
    """The inverse of an odd number modulo 2**64."""
    return pow(odd, -1, 1 << 64)


@functools.cache
def _values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(seed))


@functools.lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.append(np.uint64(1), np.cumprod(np.full(n, base, np.uint64)))


class RollingHash:
    """64-bit hashes of any byte ranges of one buffer, the same for equal bytes wherever they stand.

    Polynomials modulo 2**64: texts can be made that collide whatever the base, so these hashes choose and sort, but never
    decide that two texts are equal.
    """

    def __init__(self, data: np.ndarray, seed: int = 1, places: int = 0):
        self.base = int(mix(np.array([seed], np.uint64) * _ODD)[0]) | 5
        n = max(1 << 19, -(-max(len(data), places) >> 19) << 19)
        self.down = _powers(invert(self.base), n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_values(seed)[data] * _powers(self.base, n)[: len(data)], out=self.sums[1:])

    def up(self, n: int) -> np.ndarray:
        """The powers that the first n places are weighted by."""
        return _powers(self.base, len(self.down) - 1)[:n]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _ODD)


class Words:
    """The words of the rows of a block: data[starts[i]:ends[i]] in row ``row[i]``; first[r] is the first of row r."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        sep = np.ones(len(data) + 1, bool)
        sep[:-1] = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        begins = ~sep[:-1]
        begins[1:] &= sep[:-2]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        begins[edge] = ~sep[edge]
        self.starts = np.flatnonzero(begins)
        stops = np.zeros(len(data) + 1, bool)
        stops[1:] = ~sep[:-1] & sep[1:]
        inner = offsets[1:]
        inner = inner[inner > 0]
        stops[inner] = ~sep[inner - 1]
        self.ends = np.flatnonzero(stops)
        self.sep = sep[:-1]
        self.first = np.searchsorted(self.starts, offsets)
        self.n = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.n)

    @functools.cached_property
    def distinct(self) -> pa.DictionaryArray:
        kept = self.data[~self.sep]
        at = np.append(0, np.cumsum(self.ends - self.starts))
        return common.strings(kept, at).dictionary_encode()

    @functools.cached_property
    def codes(self) -> np.ndarray:
        """A number for each word, equal for equal words."""
        return self.distinct.indices.to_numpy().astype(np.int64)

    def runs(self, n: int) -> np.ndarray:
        """Which words start a run of n words of one row."""
        i = np.arange(len(self.starts))
        return i[i + n <= self.first[1:][self.row]]

    def run_codes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(words that start a run of n, a number for each run, equal for equal runs); n is a power of two."""
        code, size = self.codes, 1
        while size < n:
            if len(code) <= size:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            code = pa.array(code[:-size] * (int(code.max()) + 1) + code[size:]).dictionary_encode().indices.to_numpy().astype(np.int64)
            size *= 2
        at = self.runs(n)
        return at, code[at]

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in all blocks; each distinct word of the block is hashed once."""
        words = self.distinct.dictionary.to_numpy(zero_copy_only=False)
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[self.codes]

    def shingles(self, n: int, levels=None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct numbers below 2**63 for runs of n words, row by row in ascending order, and the offsets of the rows.

        A row with fewer words has one, of all its words; one without words has none. levels: small numbers for word
        hashes; runs of words with higher ones get higher numbers (32 steps). The rest of a number is a hash.
        """
        level = levels(self.hashes) if levels else np.zeros(len(self.starts), np.int64)
        at = self.runs(n)
        with np.errstate(over="ignore"):
            value, step = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
            for k in range(n):
                value = mix(value * _ODD + self.hashes[at + k])
                step += level[at + k]
            short = np.flatnonzero((self.n > 0) & (self.n < n))
            rest, rest_step = np.zeros(len(short), np.uint64), np.zeros(len(short), np.int64)
            for k in range(n - 1):
                on = self.n[short] > k
                rest[on] = mix(rest[on] * _ODD + self.hashes[self.first[:-1][short[on]] + k])
                rest_step[on] += level[self.first[:-1][short[on]] + k]
        row = np.concatenate([self.row[at], short])
        value = np.concatenate([value, rest]) >> np.uint64(6)
        value |= np.minimum(np.concatenate([step, rest_step]) * 2 // n, 31).astype(np.uint64) << np.uint64(58)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
        return value, np.searchsorted(row, np.arange(self.rows + 1))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
