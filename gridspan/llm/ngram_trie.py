"""A trie of n-grams up to three words in Elias-Fano levels.

A trie is a set of flat arrays in one file that its task maps into memory; nothing is
unpacked to be queried. Words in front of a word b are its contexts, words behind it its
successors. A successor of a pair (a, b) is kept as its rank among the successors of b,
so a level's numbers lie in a universe as small as the contexts allow.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Additive pseudo counts of the smoothing: what a word's and a pair's lower order weighs.
MU_WORD, MU_PAIR = 2000.0, 20.0
#: A probability p above 0 is kept as a 16-bit code, 65535 + STEPS * log2 p at the nearest, at least 1.
STEPS = 1024


def quantised(p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), np.uint16)
    some = p > 0
    out[some] = np.clip(np.rint(65535 + STEPS * np.log2(p[some])), 1, 65535)
    return out


def probabilities(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2((codes.astype(np.float64) - 65535) / STEPS), 0.0)


class _File:
    """Arrays written one behind the other, then mapped."""

    def __init__(self) -> None:
        self.file, self.places = tempfile.TemporaryFile(), []

    def put(self, a: np.ndarray) -> int:
        self.places.append((self.file.tell(), len(a), a.dtype))
        self.file.write(np.ascontiguousarray(a).data)
        self.file.write(bytes(-self.file.tell() % 8))
        return len(self.places) - 1

    def map(self) -> list[np.ndarray]:
        self.file.flush()
        whole = np.memmap(self.file, np.uint8, "r").view(np.ndarray) if self.file.tell() else np.zeros(0, np.uint8)
        return [whole[at : at + n * kind.itemsize].view(kind) for at, n, kind in self.places]


class EliasFano:
    """Ascending numbers below a bound: low bits as they are, high bits in unary, and how many
    zeros lie before each word of them."""

    def __init__(self, file: _File, values: np.ndarray, bound: int) -> None:
        n = len(values)
        self.n, self.low_bits = n, max(0, (max(1, bound) // max(1, n)).bit_length() - 1)
        l, values = self.low_bits, values.astype(np.uint64)
        size = n + (bound >> l) + 2
        high = np.zeros(-(-size // 64) * 64, np.uint8)
        high[(values >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
        words = np.packbits(high, bitorder="little").view(np.uint64)
        zeros = np.zeros(len(words) + 1, np.int64)
        np.cumsum(64 - np.bitwise_count(words).astype(np.int64), out=zeros[1:])
        low = np.zeros(n * l // 64 + 2, np.uint64)
        if l:
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            word, shift, part = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63), values & np.uint64((1 << l) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(l) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        self.parts = [file.put(words), file.put(zeros), file.put(low)]

    def open(self, arrays: list[np.ndarray]) -> EliasFano:
        self.high, self.zeros, self.low = (arrays[k] for k in self.parts)
        return self

    def _lows(self, i: np.ndarray) -> np.ndarray:
        l = self.low_bits
        if not l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(l)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        over = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | over) & np.uint64((1 << l) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the zero that has k zeros before it."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        left, x = (k - self.zeros[word]).astype(np.uint8), ~self.high[word]
        at = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            part = x & np.uint64((1 << width) - 1)
            n = np.bitwise_count(part)
            on = left >= n
            left = left - n * on
            x = np.where(on, x >> np.uint64(width), part)
            at += width * on
        return at

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted number, -1 if it isn't there: the numbers that share its
        high bits lie between two zeros, and their low bits are searched by halves."""
        out = np.full(len(wanted), -1, np.int64)
        if not self.n:
            return out
        wanted = wanted.astype(np.uint64)
        h, low = (wanted >> np.uint64(self.low_bits)).astype(np.int64), wanted & np.uint64((1 << self.low_bits) - 1)
        live = np.flatnonzero(h < self.zeros[-1])
        h, low = h[live], low[live]
        first, last = np.zeros(len(h), np.int64), self._zero(h) - h
        some = h > 0
        first[some] = self._zero(h[some] - 1) + 1 - h[some]
        some = np.flatnonzero(first < last)
        live, low, first, last = live[some], low[some], first[some], last[some]
        end, left = last.copy(), np.arange(len(live))
        while len(left):  # the first low bits that aren't below
            middle = (first[left] + last[left]) >> 1
            below = self._lows(middle) < low[left]
            first[left[below]] = middle[below] + 1
            last[left[~below]] = middle[~below]
            left = left[first[left] < last[left]]
        found = np.flatnonzero(first < end)
        found = found[self._lows(first[found]) == low[found]]
        out[live[found]] = first[found]
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, i, side="right") - 1
        left, x = (i - ones[word]).astype(np.uint8), self.high[word]
        at = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            part = x & np.uint64((1 << width) - 1)
            n = np.bitwise_count(part)
            on = left >= n
            left = left - n * on
            x = np.where(on, x >> np.uint64(width), part)
            at += width * on
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits) | self._lows(i)).astype(np.int64)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins, and which of the distinct ones each is."""
    first = np.flatnonzero(np.diff(sorted_values, prepend=sorted_values[:1] - 1 if len(sorted_values) else 0))
    return first, np.repeat(np.arange(len(first)), np.diff(first, append=len(sorted_values)))


class Trie:
    """Built from distinct triples (b, a, c) of ids in ascending order, with their counts: c
    came so often after a and b. succeeding says whether all occurrences of (b, c) are
    among the triples, so that the smoothing knows them here."""

    def __init__(self, b: np.ndarray, a: np.ndarray, c: np.ndarray, counts: np.ndarray, succeeding: bool = True) -> None:
        file, counts = _File(), counts.astype(np.float64)
        first, rb = _runs(b)
        roots, words = b[first], np.unique(np.concatenate([a, c]))
        nb, u = len(roots), max(1, len(words))
        la, lc = np.searchsorted(words, a), np.searchsorted(words, c)
        pairs, of = np.unique(rb * u + lc, return_inverse=True)
        contexts, ctx = np.unique(rb * u + la, return_inverse=True)
        pair_from = np.searchsorted(pairs, np.arange(nb + 1) * u)
        context_from = np.searchsorted(contexts, np.arange(nb + 1) * u)
        degree = np.diff(pair_from)
        base = np.concatenate([[0], np.cumsum(np.diff(context_from) * degree)]).astype(np.int64)
        triples = base[rb] + (ctx - context_from[rb]) * degree[rb] + of - pair_from[rb]
        order = np.argsort(triples, kind="stable")
        n_pair, n_context, n_root = np.bincount(of, counts), np.bincount(ctx, counts), np.bincount(rb, counts)
        self.smoothed = [file.put(quantised(x)) for x in (
            n_pair / (n_root[pairs // u] + MU_WORD) if succeeding else np.zeros(len(pairs)),
            MU_PAIR / (n_context + MU_PAIR),
            (counts / (n_context[ctx] + MU_PAIR))[order],
        )]
        top = int(max(roots.max(initial=0), words.max(initial=0))) + 1
        self.u = u
        self.levels = [EliasFano(file, v, bound) for v, bound in (
            (roots, top), (words, top), (pairs, nb * u), (contexts, nb * u), (triples[order], int(base[-1])),
            (pair_from, len(pairs) + 1), (context_from, len(contexts) + 1), (base, int(base[-1]) + 1),
        )]
        arrays = file.map()
        self.bytes = sum(a.nbytes for a in arrays)
        for level in self.levels:
            level.open(arrays)
        self.smoothed = [arrays[k] for k in self.smoothed]

    def __call__(self, b: np.ndarray, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For triples in ascending order (p, weight): the probability that the counts give c
        after a and b, and what weight is left for c by the lowest order."""
        roots, words, pairs, contexts, triples, pair_from, context_from, base = self.levels
        pair_p, pair_weight, triple_p = self.smoothed
        first, run = _runs(b)
        rb = roots.find(b[first])
        known, of = np.unique(np.concatenate([a, c]), return_inverse=True)
        local = words.find(known)[of]
        la, lc = local[: len(a)], local[len(a) :]
        root = rb[run]
        pair, context = np.full(len(b), -1, np.int64), np.full(len(b), -1, np.int64)
        for out, level, side in ((pair, pairs, lc), (context, contexts, la)):
            some = np.flatnonzero((root >= 0) & (side >= 0))
            out[some] = level.find(root[some] * self.u + side[some])
        p, weight = np.zeros(len(b)), np.ones(len(b))
        met = np.flatnonzero(context >= 0)
        weight[met] = probabilities(pair_weight[context[met]])
        some = np.flatnonzero(pair >= 0)
        p[some] = weight[some] * probabilities(pair_p[pair[some]])
        met = met[pair[met] >= 0]
        at = np.flatnonzero(rb >= 0)
        place = np.zeros((4, len(rb)), np.int64)
        if len(at):
            place[:, at] = pair_from[rb[at]], context_from[rb[at]], base[rb[at]], pair_from[rb[at] + 1]
        start, context_start, low, end = place[:, run[met]]
        found = triples.find(low + (context[met] - context_start) * (end - start) + pair[met] - start)
        p[met[found >= 0]] += probabilities(triple_p[found[found >= 0]])
        return p, weight
