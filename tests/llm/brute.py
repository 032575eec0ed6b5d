"""Plain versions that the operators are held against."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return t.translate({c: c + 32 for c in range(65, 91)})


def quality(t: str) -> tuple[int, int, int, int, int]:
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(runs)
    covered = {k for i, r in enumerate(runs) if n[r] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def shingles(t: str | None, n: int) -> set:
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(nodes, links) -> dict:
    parent = {k: k for k in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in nodes}


def jaccard(texts: list[str | None], n: int, num: int, den: int) -> list[int]:
    """The smallest place connected with each place."""
    sets = [shingles(t, n) for t in texts]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    common = Counter(p for ks in where.values() for p in itertools.combinations(ks, 2))
    links = [(a, b) for (a, b), o in common.items() if den * o >= num * (len(sets[a]) + len(sets[b]) - o)]
    found = components(range(len(texts)), links)
    return [found[k] for k in range(len(texts))]


def without_repeats(texts: list[bytes], length: int) -> list[tuple[bytes, int, int]]:
    """(what is left, bytes removed, runs removed) of each text."""
    n = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if n[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((bytes(c for c, g in zip(t, gone, strict=True) if not g), sum(gone), len(re.findall(rb"\x01+", bytes(gone)))))
    return out


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Residual capacities of the bins."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)
