"""Gray-order hierarchical index over 64-bit fingerprints, and unions of the links found.

Fingerprints sorted by Gray rank put long runs with shared bits side by side. A node
stands for a run of them and holds ``mask`` (bits in which the whole run agrees) and
``pattern`` (their values). A child tests only the masked bits that no node above it has
tested and adds its differences to those of the path, so one comparison at an upper node
prunes the whole group below it. Everything here is array work within one task.
"""

from __future__ import annotations

import numpy as np

FAN = 4
#: Rows of a search front handled at a time; larger fronts are split, never dropped.
FRONT = 1 << 18


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each fingerprint (uint64) in the Gray sequence."""
    r = fp.astype(np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    return r


class GrayTree:
    """Index over groups given by their (and, or) bits in Gray order; single fingerprints
    are groups with equal bits."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        levels = []
        while True:
            levels.append((low & high, ~(low ^ high)))
            if len(low) <= FAN:
                break
            at = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
        self.levels = levels[::-1]  # root level first

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level, the common label of each node's members, or -1."""
        lo = hi = labels
        out = [labels]
        for _ in range(len(self.levels) - 1):
            at = np.arange(0, len(lo), FAN)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            out.append(np.where(lo == hi, lo, -1))
        return out[::-1]

    def near(self, queries: np.ndarray, limit: int, skip=None):
        """Yields (query numbers, group numbers) whose shared bits differ from the query in
        at most ``limit`` places. ``skip(level, q, node)`` may rule further pairs out."""
        if not len(queries) or not len(self.levels[-1][0]):
            return
        n0 = len(self.levels[0][0])
        step = max(1, FRONT // max(n0, 1))
        for a in range(0, len(queries), step):
            q = np.repeat(np.arange(a, min(a + step, len(queries))), n0)
            node = np.tile(np.arange(n0), len(q) // n0)
            stack = [(0, q, node, np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint64))]
            while stack:
                level, q, node, acc, tested = stack.pop()
                if len(q) > FRONT:
                    h = len(q) // 2
                    stack.append((level, q[h:], node[h:], acc[h:], tested[h:]))
                    stack.append((level, q[:h], node[:h], acc[:h], tested[:h]))
                    continue
                pattern, mask = self.levels[level]
                m = mask[node]
                acc = acc + np.bitwise_count((queries[q] ^ pattern[node]) & m & ~tested)
                ok = acc <= limit
                if skip is not None:
                    ok &= ~skip(level, q, node)
                q, node, acc, m = q[ok], node[ok], acc[ok], m[ok]
                if not len(q):
                    continue
                if level == len(self.levels) - 1:
                    yield q, node
                    continue
                below = len(self.levels[level + 1][0])
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = child < below
                q, acc, m = (np.repeat(x, FAN)[real] for x in (q, acc, m))
                stack.append((level + 1, q, child[real], acc, m))


class Unions:
    """Disjoint sets over 0..n-1 with array-wise merging; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return self.up
            self.up = nxt

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.roots()
            a, b = up[a], up[b]
            ne = a != b
            a, b = a[ne], b[ne]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
