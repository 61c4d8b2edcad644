"""Signature trees: a similarity self-join of sets by dual traversal.

Entries are sets with a token bitmap; a node holds the OR of its entries' bitmaps,
the range of their sizes and the most tokens that any of them lost to shared bits.
Two nodes are left aside if their sizes cannot match, if the bits they have in
common allow too small an overlap, or if all they hold is linked already. Levels
are traversed as arrays of node pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FANOUT = 16
#: 64-bit words of bitmaps that are compared in one array operation.
CHUNK_WORDS = 1 << 20


def width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two, 64 at least."""
    return max(64, 1 << (int(n) - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    held = np.zeros(bits, bool)
    held[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (a row each) of ``bits`` bits from wider ones."""
    while words.shape[1] * 64 > bits:
        half = words.shape[1] // 2
        words = words[:, :half] | words[:, half:]
    return words


class Groups:
    """Union-find over keys; ``links`` are the pairs that joined two groups."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def roots(self, keys: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.root, keys.tolist()), np.int64, len(keys))

    def link(self, a: int, b: int, known: bool = False) -> None:
        """Joins two groups; ``known`` says that the link is not a new one."""
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            if not known:
                self.links.append((a, b))


class Similarity:
    """Jaccard of at least ``num`` / ``den``, as exact integer tests."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def sizes(self, small, large):
        return small * self.den >= large * self.num

    def overlap(self, common, a, b):
        return common * (self.num + self.den) >= self.num * (a + b)


def _pairs_within(count: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(count)


def join(keys: np.ndarray, sizes: np.ndarray, words: np.ndarray, like: Similarity, groups: Groups, same: Callable[[int, int], bool] | None, sides: np.ndarray | None = None) -> None:
    """Links the keys whose sets are alike: all pairs that the bitmaps allow, and of
    these the ones for which ``same(i, j)`` holds, if given. With ``sides`` only pairs
    of different sides count. Pairs within one group are not looked at again."""
    n = len(keys)
    if n < 2:
        return
    order = np.lexsort((words[:, 0], sizes))
    keys, sizes, words = keys[order], sizes[order].astype(np.int64), words[order]
    sides = None if sides is None else sides[order]
    chunk = max(FANOUT**2, min(1 << 16, CHUNK_WORDS // words.shape[1]))
    slack = sizes - np.bitwise_count(words).sum(1, dtype=np.int64)

    def test(i: np.ndarray, j: np.ndarray) -> None:
        ok = like.sizes(sizes[i], sizes[j])
        if sides is not None:
            ok &= sides[i] != sides[j]
        i, j = i[ok], j[ok]
        for at in range(0, len(i), chunk):
            a, b = i[at : at + chunk], j[at : at + chunk]
            root = groups.roots(keys)
            ok = root[a] != root[b]
            a, b = a[ok], b[ok]
            lost = np.bitwise_count(words[a] & ~words[b]).sum(1, dtype=np.int64)
            gained = np.bitwise_count(words[b] & ~words[a]).sum(1, dtype=np.int64)
            ok = like.overlap(np.minimum(sizes[a] - lost, sizes[b] - gained), sizes[a], sizes[b])
            for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                p, q = int(keys[x]), int(keys[y])
                if groups.root(p) != groups.root(q) and (same is None or same(int(order[x]), int(order[y]))):
                    groups.link(p, q)

    # neighbours first: copies stand together, and what they link need not be looked at again
    for step in (1, 2):
        test(np.arange(n - step), np.arange(step, n))
    if len(np.unique(groups.roots(keys))) == 1:
        return
    levels = [(words, sizes, sizes, slack)]
    while len(levels[-1][0]) > FANOUT:
        held, low, high, lost = levels[-1]
        cut = np.arange(0, len(held), FANOUT)
        levels.append((np.bitwise_or.reduceat(held, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(lost, cut)))

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> None:
        """Node pairs a <= b of a level."""
        if not level:
            apart = a < b
            test(a[apart], b[apart])
            return
        held, low, high, lost = levels[level]
        # the one group that all of a node's entries are in, or a negative number of its own
        root = np.unique(groups.roots(keys), return_inverse=True)[1]
        for _ in range(level):
            cut = np.arange(0, len(root), FANOUT)
            first, last = np.minimum.reduceat(root, cut), np.maximum.reduceat(root, cut)
            root = np.where((first == last) & (first >= 0), first, -1 - np.arange(len(cut)))
        for at in range(0, len(a), chunk):
            x, y = a[at : at + chunk], b[at : at + chunk]
            ok = like.sizes(high[x], low[y]) & ((root[x] != root[y]) | (root[x] < 0))
            x, y = x[ok], y[ok]
            common = np.bitwise_count(held[x] & held[y]).sum(1, dtype=np.int64) + np.minimum(lost[x], lost[y])
            ok = like.overlap(common, low[x], low[y])
            x, y = x[ok], y[ok]
            below = len(levels[level - 1][0])
            for cut in range(0, len(x), chunk // FANOUT**2):
                p, q = x[cut : cut + chunk // FANOUT**2], y[cut : cut + chunk // FANOUT**2]
                fan = np.arange(FANOUT)
                i = np.broadcast_to((p[:, None] * FANOUT + fan)[:, :, None], (len(p), FANOUT, FANOUT)).ravel()
                j = np.broadcast_to((q[:, None] * FANOUT + fan)[:, None, :], (len(p), FANOUT, FANOUT)).ravel()
                ok = (i < below) & (j < below) & (i <= j)
                descend(level - 1, i[ok], j[ok])

    descend(len(levels) - 1, *_pairs_within(len(levels[-1][0])))


def join_all(keys: np.ndarray, sizes: np.ndarray, bitmaps: list[np.ndarray], like: Similarity, groups: Groups, same: Callable[[int, int], bool] | None = None) -> None:
    """``join`` over sets of any sizes: those with bitmaps of one width together, then each
    width's largest with the next width's smallest."""
    bits = np.array([len(b) * 64 for b in bitmaps])
    for w in np.unique(bits):
        own = np.flatnonzero(bits == w)
        words = np.stack([bitmaps[k] for k in own])
        join(keys[own], sizes[own], words, like, groups, same and (lambda i, j, own=own: same(int(own[i]), int(own[j]))))
        upper = own[like.sizes(w + 1, sizes[own]) & like.sizes(sizes[own], w + 1)]
        lower = np.flatnonzero((bits == 2 * w) & like.sizes(w, sizes))
        if len(upper) and len(lower):
            both = np.concatenate([upper, lower])
            words = np.concatenate([np.stack([bitmaps[k] for k in upper]), folded(np.stack([bitmaps[k] for k in lower]), w)])
            join(keys[both], sizes[both], words, like, groups, same and (lambda i, j, both=both: same(int(both[i]), int(both[j]))), np.repeat([0, 1], [len(upper), len(lower)]))
