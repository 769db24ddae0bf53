"""Suffix sort on hash comparisons.

Two suffixes are compared by their longest common extension, found by binary
search over prefix polynomial hashes, so a comparison takes a logarithmic
number of hash tests; the byte after the extension decides the order. The sort
is a bottom-up mergesort in which all merges of a level run together. Suffixes
that come out equal are compared byte by byte; if a hash collision shows up,
the sort is done again with direct comparisons.
"""

from __future__ import annotations

import numpy as np

from swissline.llm.common import Poly
from swissline.llm.firsts import same_bytes

_POLY = Poly(701)


class Suffixes:
    """Suffixes of ``text`` that start at ``start`` and are read for ``limit`` bytes."""

    def __init__(self, text: np.ndarray, start: np.ndarray, limit: np.ndarray):
        self.text, self.start, self.limit = text, start.astype(np.int64), limit.astype(np.int64)
        self.prefix = _POLY.prefix(text)
        _POLY.grow(len(text))
        self.back = _POLY.down[self.start] if len(start) else np.zeros(0, np.uint64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension, up to the shorter limit."""
        h, a, b, u, v = self.prefix, self.start[i], self.start[j], self.back[i], self.back[j]
        hi = np.minimum(self.limit[i], self.limit[j])
        lo = np.zeros(len(i), np.int64)
        ha, hb = h[a], h[b]
        same = (h[a + hi] - ha) * u == (h[b + hi] - hb) * v
        lo = np.where(same, hi, lo)
        while True:
            open_ = np.flatnonzero(hi - lo > (~same).astype(np.int64))
            open_ = open_[~same[open_]]
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            ok = (h[a[open_] + mid] - ha[open_]) * u[open_] == (h[b[open_] + mid] - hb[open_]) * v[open_]
            lo[open_[ok]] = mid[ok]
            hi[open_[~ok]] = mid[~ok]

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        k = self.common(i, j)
        li, lj = self.limit[i], self.limit[j]
        end = (k >= li) | (k >= lj)
        n = len(self.text) - 1
        x = self.text[np.minimum(self.start[i] + k, n)]
        y = self.text[np.minimum(self.start[j] + k, n)]
        return np.where(end, np.where(li == lj, or_equal, li < lj), x < y)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the suffixes ordered by (group, suffix), equal ones in input order, and which equal the one before."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        if not len(g):
            return order, np.zeros(0, bool)
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(g)))
        first, size = np.repeat(at, size), np.repeat(size, size)
        width = 1
        while True:
            place = np.flatnonzero(size > width)
            if not len(place):
                break
            local = place - first[place]
            left = (local // width) % 2 == 0
            base = first[place] + local - local % (2 * width)
            end = first[place] + size[place]
            lo0 = np.where(left, base + width, base)
            lo0 = np.minimum(lo0, end)
            hi0 = np.minimum(np.where(left, base + 2 * width, base + width), end)
            lo, hi = lo0.copy(), hi0.copy()
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                goes = self.less(order[mid], order[place[open_]], ~left[open_])
                lo[open_[goes]] = mid[goes] + 1
                hi[open_[~goes]] = mid[~goes]
            to = np.where(left, place, place - width) + (lo - lo0)
            moved = order[place]
            order[to] = moved
            width *= 2
        eq = np.zeros(len(order), bool)
        near = np.flatnonzero(~new)
        i, j = order[near - 1], order[near]
        full = (self.limit[i] == self.limit[j]) & (self.common(i, j) == self.limit[i])
        near, i, j = near[full], i[full], j[full]
        if not same_bytes(self.text, self.start[i], self.start[j], self.limit[i]).all():
            return self._direct(group)
        eq[near] = True
        return order, eq

    def _direct(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = self.text.tobytes()
        key = [(g, raw[s : s + n]) for g, s, n in zip(group.tolist(), self.start.tolist(), self.limit.tolist())]
        order = sorted(range(len(key)), key=key.__getitem__)
        eq = [k > 0 and key[order[k]] == key[order[k - 1]] for k in range(len(order))]
        return np.array(order, np.int64), np.array(eq, bool)
