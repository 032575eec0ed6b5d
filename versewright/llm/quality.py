"""Quality rules as a short-circuit cascade.

Each rule is a bound on features of a text. On a sample of the rows the executors time each rule by itself and count what
it rejects; rules then run in order of rejections per second, and each sees only what the ones before it let pass.
The order changes the cost, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .words import Words

#: Rows of the sample on which rules are timed at most.
SAMPLE = 2000
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


class Features:
    """Features of the rows of a block, each worked out when first asked for and for the rows asked about only."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.text, self.found, self.rows = lambda: (data, offsets), {}, len(offsets) - 1

    @functools.cached_property
    def data(self) -> np.ndarray:
        return self.text()[0]

    @functools.cached_property
    def offsets(self) -> np.ndarray:
        return self.text()[1]

    @functools.cached_property
    def words(self) -> Words:
        return Words(self.data, self.offsets)

    def sums(self, marks: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(marks))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def part(self, rows: np.ndarray) -> Features:
        """The same for some of the rows: what is known of them, and their text only if more is asked."""
        out = Features(self.data[:0], np.zeros(len(rows) + 1, np.int64))
        out.found = {k: v[rows] for k, v in self.found.items()}

        @functools.cache
        def text():
            size = np.diff(self.offsets)[rows]
            return self.data[common.ragged(self.offsets[:-1][rows], size)], np.append(0, np.cumsum(size))

        out.text = text
        return out

    def get(self, name: str) -> np.ndarray:
        if name not in self.found:
            self.found[name] = getattr(self, name)()
        return self.found[name]

    def n_words(self) -> np.ndarray:
        return self.words.n

    def word_chars(self) -> np.ndarray:
        return self.sums(~self.words.sep & ((self.data & 0xC0) != 0x80))

    def n_symbols(self) -> np.ndarray:
        is_symbol = np.zeros(256, bool)
        is_symbol[list(SYMBOLS)] = True
        return self.sums(is_symbol[self.data])

    @functools.cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each line with a word: its row, and whether it equals an earlier one of the row."""
        ends = self.data == 0x0A
        content = self.data[~ends]
        cut = np.flatnonzero(ends)
        # a line starts with each row and after each line feed
        starts = np.sort(np.concatenate([self.offsets[:-1], cut + 1]), kind="stable")
        before = np.append(0, np.cumsum(ends))
        at = np.append(starts - before[starts], len(content))
        row = np.concatenate([np.arange(len(self.offsets) - 1), np.searchsorted(self.offsets, cut, "right") - 1])
        row = np.sort(row, kind="stable")
        code = common.strings(content, at).dictionary_encode().indices.to_numpy().astype(np.int64)
        wordy = np.append(0, np.cumsum(~self.words.sep[~ends]))
        wordy = wordy[at[1:]] > wordy[at[:-1]]
        row, code = row[wordy], code[wordy]
        key = row * (int(code.max()) + 1 if len(code) else 1) + code
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        return row, ~first

    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=self.rows)

    def n_dup_lines(self) -> np.ndarray:
        row, again = self.lines
        return np.bincount(row[again], minlength=self.rows)

    def n_repeat_words(self) -> np.ndarray:
        w = self.words
        at, code = w.run_codes(8)
        if not len(at):
            return np.zeros(w.rows, np.int64)
        key = w.row[at] * (int(code.max()) + 1) + code
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[order][1:] == key[order][:-1]
        again = at[order[same[:-1] | same[1:]]]
        edge = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + 8, -1)
        covered = np.cumsum(edge)[:-1] > 0
        return np.bincount(w.row[covered], minlength=w.rows)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], np.ndarray]


# Whole-number bounds, so that any engine comes to the same verdict.
FEW_WORDS = Rule("few_words", lambda f: f.get("n_words") < 20)
REPEATED = Rule("repeated_words", lambda f: 100 * f.get("n_repeat_words") > 30 * f.get("n_words"))
SYMBOLIC = Rule("symbols", lambda f: 100 * f.get("n_symbols") > 50 * f.get("n_words"))
SHORT_WORDS = Rule("short_words", lambda f: 2 * f.get("word_chars") < 3 * f.get("n_words"))
DUP_LINES = Rule("duplicate_lines", lambda f: (f.get("n_dup_lines") > 2) & (100 * f.get("n_dup_lines") > 50 * f.get("n_lines")))
BASE = (FEW_WORDS, REPEATED)
RULES = (*BASE, SYMBOLIC, SHORT_WORDS, DUP_LINES)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(df: DataFrame, rules=RULES, text_col: str = "text", sample: int = SAMPLE) -> tuple[list[int], list[dict]]:
    """Rules by rejections per second on a sample of at most so many rows, most first, and what was measured."""
    spark = df.sparkSession
    total = df.count()
    texts = df.select(df[text_col].alias("text"))
    if total > sample:
        texts = texts.sample(min(1.0, 1.2 * sample / total), seed=7)
    rules = tuple(rules)

    def measure(batches):
        for batch in batches:
            data, at = common.buffers(batch.column(0))
            for i, j in common.row_groups(at):
                for k, rule in enumerate(rules):
                    f = Features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                    f.words  # noqa: B018  shared by all rules, so no cost of one
                    began = time.perf_counter()
                    rejected = int(rule.rejects(f).sum())
                    yield pa.RecordBatch.from_pydict({"rule": [k], "s": [time.perf_counter() - began], "rejected": [rejected], "n": [j - i]})

    rows = texts.mapInArrow(measure, "rule long, s double, rejected long, n long").groupBy("rule").agg({"s": "sum", "rejected": "sum", "n": "sum"}).collect()  # a row for each rule
    stats = [{"rule": rules[r["rule"]].name, "at": r["rule"], "seconds": r["sum(s)"], "rejected": r["sum(rejected)"], "rows": r["sum(n)"]} for r in rows]
    worth = {s["at"]: s["rejected"] / max(s["seconds"], 1e-9) for s in stats}
    return sorted(range(len(rules)), key=lambda k: (-worth.get(k, 0), k)), stats


def cascade(f: Features, rules, order) -> np.ndarray:
    """Which rows no rule rejects: each rule in turn over the rows still alive."""
    alive = np.arange(f.rows)
    for k in order:
        if not len(alive):
            break
        now = f if len(alive) == f.rows else f.part(alive)
        alive = alive[~rules[k].rejects(now)]
    kept = np.zeros(f.rows, bool)
    kept[alive] = True
    return kept


def judge(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """(id[, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], base_failed, kept) of every row.

    A null text has no words and fails; every row is judged by its own text alone, so repeated rows and ids, null ids
    and ties don't matter. An empty table gives no rows. Other columns are not looked at. With counts the counts of all
    rows are wanted, so features are worked out for all of them; without, the cascade stops at a row's first rejection.
    """
    common.bounded_batches(df.sparkSession)
    rules, (order, _) = tuple(rules), order_rules(df, rules, text_col)
    base = tuple(rules.index(r) for r in BASE if r in rules)
    fields = [T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS if counts), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    if not counts:
        fields.pop(-2)

    def run(batches):
        for batch in batches:
            data, at = common.buffers(batch.column(1))
            for i, j in common.row_groups(at):
                f = Features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                cols = [batch.column(0).slice(i, j - i)]
                if counts:
                    cols += [pa.array(f.get(c).astype(np.int64)) for c in COUNTS]
                    failed = np.zeros(j - i, bool)
                    for k in base:
                        failed |= rules[k].rejects(f)
                    cols.append(pa.array(failed))
                cols.append(pa.array(cascade(f, rules, order)))
                yield pa.RecordBatch.from_arrays(cols, names=[x.name for x in fields])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, T.StructType(fields))


def keep(df: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """df without the rows that a rule rejects, all columns as they were, whatever their names.

    A null text has no words and is rejected as one; rows are judged one by one, so repeated ones stay or go together.
    An empty table gives no rows.
    """
    common.bounded_batches(df.sparkSession)
    rules, (order, _) = tuple(rules), order_rules(df, rules, text_col)
    where = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, at = common.buffers(batch.column(where))
            for i, j in common.row_groups(at):
                f = Features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield batch.slice(i, j - i).filter(pa.array(cascade(f, rules, order)))

    return df.mapInArrow(run, df.schema)
