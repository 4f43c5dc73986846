"""Byte-pair merges of the tokens of a vocabulary, and which tokens may stand side by side."""

from __future__ import annotations

import numpy as np

from gistmill.llm.words import U64, mix

NONE = np.int32(0x7FFFFFFF)
#: Pairs that are remembered in a worker, 9 bytes each; a pair that takes another's place is told anew when it is met again.
PAIRS = 1 << 20


class Merges:
    """Pairs of symbols (below 2^31) that may be merged: the pair of least rank goes first, the first one of ties."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        keys = left.astype(np.int64) << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], rank[order].astype(np.int32), made[order].astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, hit = self._find(left, right)
        return np.where(hit, self.ranks[at], NONE)

    def rank_of(self, left: int, right: int) -> int:
        """The rank of one pair, NONE if it may not be merged."""
        key = left << 32 | right
        at = min(int(self.keys.searchsorted(key)), len(self.keys) - 1)
        return self.ranks.item(at) if self.keys.item(at) == key else int(NONE)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def traced(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each row of ids step by step: its first symbol, its last one and the rank of the next merge (NONE: none is left), a column each for every step; and the symbols left."""
        n, size = ids.shape
        ids, line, left = ids.copy(), np.arange(n), np.full(n, size)
        first, last, then = np.empty((n, size), np.int64), np.empty((n, size), np.int64), np.full((n, size), NONE, np.int32)
        for step in range(size):
            first[:, step], last[:, step] = ids[:, 0], ids[line, left - 1]
            if size == 1:
                break
            rank = np.where(np.arange(1, size)[None] < left[:, None], self._rank(ids[:, :-1], ids[:, 1:]), NONE)
            best = rank.argmin(1)
            then[:, step] = rank[line, best]
            rows = np.flatnonzero(then[:, step] < NONE)
            at, _ = self._find(ids[rows, best[rows]], ids[rows, best[rows] + 1])
            ids[rows, best[rows]] = self.made[at]
            shifted = np.zeros((n, size - 1), bool)
            shifted[rows] = np.arange(size - 1)[None] > best[rows, None]
            ids[:, :-1] = np.where(shifted, ids[:, 1:], ids[:, :-1])
            # The last place of a merged row is beyond its end now, and so is its neighbour if the merge was there.
            left[rows] -= 1
        return first, last, then, left


class Pairs:
    """Which two tokens are compatible: merging their joined texts gives them again.

    The merges of a text are those of its parts wherever none crosses from part to part. So tokens side by side are the encoding of their text if each is
    whole (merging its symbols gives it) and each two neighbours are compatible, and each prefix of a text has exactly one last token.
    Whether a merge crosses follows from the steps in which both are merged; these are kept one after the other for all tokens.
    """

    def __init__(self, merges: Merges, ids: np.ndarray, symbols: list[np.ndarray], base: int):
        """symbols: of each token in ids, which are below base. What has no steps, or is base or more, is a symbol by itself."""
        self.merges, self.base = merges, base
        sizes = np.array([len(x) for x in symbols], np.int64)
        self.begin, self.whole = np.zeros(base + 1, np.int64), np.zeros(base + 1, bool)
        self.begin[ids] = 1 + np.cumsum(sizes) - sizes
        n = 1 + int(sizes.sum())
        self.first, self.last, self.then = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, NONE, np.int32)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            first, last, then, left = merges.traced(np.array([symbols[k] for k in rows], np.int64))
            at = self.begin[ids[rows], None] + np.arange(size)
            self.first[at], self.last[at], self.then[at] = first, last, then
            self.whole[ids[rows]] = (left == 1) & (first[:, -1] == ids[rows])
        self.known, self.fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no merge crosses from the left to the right token. Both take their steps in the order of ranks, the left one's first among equals."""
        fits, going = np.ones(len(left), bool), np.arange(len(left))
        a, b = self.begin[np.minimum(left, self.base)], self.begin[np.minimum(right, self.base)]
        while len(going):
            j, k = a[going], b[going]
            next_left, next_right = self.then[j], self.then[k]
            crossing = self.merges._rank(np.where(j > 0, self.last[j], left[going]), np.where(k > 0, self.first[k], right[going]))
            crosses = (crossing < next_left) & (crossing <= next_right) & (crossing < NONE)
            fits[going[crosses]] = False
            by_left = next_left <= next_right
            a[going] += by_left
            b[going] += ~by_left
            going = going[~crosses & (np.minimum(next_left, next_right) < NONE)]
        return fits

    def pair_apart(self, left: int, right: int) -> bool:
        """As `apart`, for one pair."""
        a, b = self.begin.item(min(left, self.base)), self.begin.item(min(right, self.base))
        while True:
            next_left, next_right = self.then.item(a), self.then.item(b)
            crossing = self.merges.rank_of(self.last.item(a) if a else left, self.first.item(b) if b else right)
            if crossing < next_left and crossing <= next_right:
                return False
            if min(next_left, next_right) == NONE:
                return True
            if next_left <= next_right:
                a += 1
            else:
                b += 1

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As `apart`, with what is remembered."""
        pairs = left << 32 | right
        slot = (mix(pairs.astype(U64)) >> U64(20)).astype(np.int64) & (len(self.known) - 1)
        fits = self.fits[slot]
        new = np.flatnonzero(self.known[slot] != pairs)
        if len(new):
            distinct, firsts, back = np.unique(pairs[new], return_index=True, return_inverse=True)
            told = self.apart(distinct >> 32, distinct & 0xFFFFFFFF)
            fits[new] = told[back]
            places, one = np.unique(slot[new[firsts]], return_index=True)
            self.known[places], self.fits[places] = distinct[one], told[one]
        return fits
