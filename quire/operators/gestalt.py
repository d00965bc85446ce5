"""The texts most like a given one by difflib's ratio, with few ratios computed: bounds for many texts
at once decide which are."""

from __future__ import annotations

import bisect
import difflib
from functools import cached_property

import numpy as np

#: difflib leaves out frequent characters of a second text this long.
LONG = 200
#: Ratios computed before closer bounds are worth their time.
FEW = 24


def _wide(t: str) -> bool:
    return any(c > "⹿" for c in t[:8])


def frequent(b: str) -> set[str]:
    """The characters that difflib leaves out of the second text."""
    if len(b) < LONG:
        return set()
    most = len(b) // 100 + 1
    return {c for c in set(b) if b.count(c) > most}


def places(b: str) -> dict[str, list[int]]:
    """Where each character stands that isn't frequent."""
    out: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        out.setdefault(c, []).append(j)
    for c in frequent(b):
        del out[c]
    return out


def long_ratio(a: str, b: str, at: dict[str, list[int]]) -> float:
    """difflib's ratio of a text and a long one, by the few characters of it that aren't frequent
    (``at``: their places): the same blocks in the same order."""
    rows = [(i, at[c]) for i, c in enumerate(a) if c in at]
    lines = [i for i, _ in rows]
    todo, total = [(0, len(a), 0, len(b))], 0
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        x, y, size, before, last = alo, blo, 0, {}, -2
        for i, js in rows[bisect.bisect_left(lines, alo) : bisect.bisect_left(lines, ahi)]:
            if i != last + 1:
                before = {}
            now = {}
            for j in js:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = now[j] = before.get(j - 1, 0) + 1
                if k > size:
                    x, y, size = i - k + 1, j - k + 1, k
            before, last = now, i
        while x > alo and y > blo and a[x - 1] == b[y - 1]:
            x, y, size = x - 1, y - 1, size + 1
        while x + size < ahi and y + size < bhi and a[x + size] == b[y + size]:
            size += 1
        if size:
            total += size
            if alo < x and blo < y:
                todo.append((alo, x, blo, y))
            if x + size < ahi and y + size < bhi:
                todo.append((x + size, ahi, y + size, bhi))
    return 2.0 * total / (len(a) + len(b))


class _Row:
    """Texts one after the other, each with a place between that no character has."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.n = int((self.sizes + 1).sum())
        self.codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.codes[self.starts + self.sizes] = -1
        self.order = np.argsort(self.codes, kind="stable")
        self.sorted = self.codes[self.order]
        bits = np.ones(self.n, np.uint8)
        bits[self.starts + self.sizes] = 0
        self.all = self.number(bits)
        self.of = np.repeat(np.arange(len(texts)), self.sizes + 1)
        self.long = self.sizes >= LONG

    @staticmethod
    def number(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    @cached_property
    def where(self) -> dict[str, int]:
        """The places of characters asked for so far, as bits."""
        return {}

    def places_of(self, c: str) -> int:
        if c not in self.where:
            lo, hi = np.searchsorted(self.sorted, ord(c)), np.searchsorted(self.sorted, ord(c), "right")
            bits = np.zeros(self.n if hi > lo else 0, np.uint8)
            bits[self.order[lo:hi]] = 1
            self.where[c] = self.number(bits)
        return self.where[c]

    @cached_property
    def rare(self) -> np.ndarray:
        """(place, character) of those of long texts that aren't frequent."""
        at = np.flatnonzero(self.long[self.of] & (self.codes >= 0))
        _, kind, count = np.unique((self.of[at] << 21) | self.codes[at], return_inverse=True, return_counts=True)
        at = at[count[kind] <= self.sizes[self.of[at]] // 100 + 1]
        return np.column_stack((at, self.codes[at]))

    def common(self, a: str) -> np.ndarray:
        """The longest common subsequence of ``a`` with each: a bit that is 0 in the end counts."""
        v = self.all
        for c in a:
            if p := self.places_of(c):
                u = v & p
                v = ((v + u) | (v - u)) & self.all
        left = np.unpackbits(np.frombuffer(v.to_bytes((self.n + 7) // 8, "little"), np.uint8), count=self.n, bitorder="little")
        return self.sizes - np.bincount(self.of, left, len(self.texts)).astype(np.int64)

    def covered(self, a: str) -> np.ndarray:
        """For long texts, the most that their blocks with ``a`` can hold: a block has a character
        that isn't frequent, or begins both texts."""
        x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        x = np.concatenate(([-2], x, [-2]))  # equals nothing
        b = np.concatenate(([-1], self.codes, [-1]))
        order = np.argsort(x, kind="stable")
        lo, hi = np.searchsorted(x[order], self.rare[:, 1]), np.searchsorted(x[order], self.rare[:, 1], "right")
        sizes = hi - lo
        k = np.repeat(np.arange(len(self.rare)), sizes)
        i = order[np.arange(len(k)) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)]
        j = self.rare[k, 0] + 1
        edge = np.zeros(self.n + 2, np.int64)
        for step in (-1, 1):
            far, alive, d = np.zeros(len(self.rare), np.int64), np.arange(len(k)), step
            while len(alive):
                alive = alive[x[i[alive] + d] == b[j[alive] + d]]
                far[k[alive]] = abs(d)
                d += step
            some = sizes > 0
            at = self.rare[some, 0]
            edge += np.bincount(at - far[some] if step < 0 else at, minlength=self.n + 2)
            edge -= np.bincount((at if step < 0 else at + far[some]) + 1, minlength=self.n + 2)
        held = np.bincount(self.of, np.cumsum(edge)[: self.n] > 0, len(self.texts)).astype(np.int64)
        same = np.ones(len(self.texts), bool)
        for d, c in enumerate(x[1:-1]):  # the beginning they share
            same &= self.sizes > d
            same[same] = self.codes[self.starts[same] + d] == c
            if not same.any():
                break
            held += same
        return held


class Texts:
    """Texts to be compared with one at a time."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        wide = np.fromiter(map(_wide, texts), bool, len(texts))
        # apart, as texts of different scripts have few characters in common
        self.rows = [(at, _Row([texts[i] for i in at])) for at in (np.flatnonzero(wide), np.flatnonzero(~wide)) if len(at)]
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at: dict[int, dict[str, list[int]]] = {}

    def bounds(self, a: str) -> np.ndarray:
        """The most each ratio can be."""
        out = np.zeros(len(self.texts))
        for at, row in self.rows if a else []:
            out[at] = 2.0 * row.common(a) / (len(a) + row.sizes)
        return out

    def closer(self, a: str, bounds: np.ndarray) -> np.ndarray:
        """Bounds that are lower for long texts, which takes longer."""
        out = bounds.copy()
        for at, row in self.rows if a else []:
            if len(row.rare):
                out[at] = np.where(row.long, np.minimum(bounds[at], 2.0 * row.covered(a) / (len(a) + row.sizes)), bounds[at])
        return out

    def ratio(self, a: str, i: int) -> float:
        b = self.texts[i]
        if not a or not b:
            return 0.0
        if len(b) < LONG:
            return difflib.SequenceMatcher(None, a, b).ratio()
        if i not in self.at:
            self.at[i] = places(b)
        return long_ratio(a, b, self.at[i])


def most_alike(a: tuple[str, ...], fields: tuple[Texts, ...], n: int) -> list[tuple[float, int]]:
    """The ``n`` best (score, place): the best ratio of any field with its counterpart, then the place."""
    bounds = [f.bounds(x) for f, x in zip(fields, a)]
    best: list[tuple[float, int]] = []
    seen = np.zeros(len(bounds[0]), bool)
    for last in (False, True):
        most = np.maximum.reduce(bounds)
        left = np.flatnonzero(~seen)
        for tried, i in enumerate(left[np.lexsort((left, -most[left]))].tolist()):
            if len(best) == n and (best[-1][0], -best[-1][1]) > (most[i], -i):
                return best
            if tried == FEW and not last:
                break
            score = 0.0
            for k in sorted(range(len(fields)), key=lambda k: -bounds[k][i]):
                if bounds[k][i] > score:
                    score = max(score, fields[k].ratio(a[k], i))
            seen[i] = True
            best = sorted([*best, (score, i)], key=lambda x: (-x[0], x[1]))[:n]
        else:
            return best
        bounds = [f.closer(x, y) for f, x, y in zip(fields, a, bounds)]
    return best
