"""Elias-Fano sequences and an n-gram trie made of them, in one memory-mapped file."""

from __future__ import annotations

import math
import mmap
import tempfile

import numpy as np

_U = np.uint64


#: Keys that find() and access() look up at a time, which bounds their scratch memory.
CHUNK = 1 << 16


class EliasFano:
    """A sorted sequence of n integers below a bound: the upper bits in unary, the lower bits as they are.

    Lower bits lie in byte planes. The unary part stays packed in 64-bit words, beside the number of ones before each word
    (`ranks`); the k-th one or zero is in the word that its rank names, and bits are counted on from there. find() goes to
    the bucket of a key (all elements with the same upper bits) and searches the lower bits in it.
    """

    def __init__(self, n: int, low_bits: int, buckets: int, planes: np.ndarray, unary: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.buckets, self.planes, self.unary, self.ranks = n, low_bits, buckets, planes, unary, ranks
        self.mask = _U((1 << low_bits) - 1)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        planes = np.stack([(values >> _U(8 * k)).astype(np.uint8) if 8 * k + 8 <= low else ((values & _U((1 << low) - 1)) >> _U(8 * k)).astype(np.uint8) for k in range(-(-low // 8))]) if low else np.zeros((0, n), np.uint8)
        high = (values >> _U(low)).astype(np.int64)
        buckets = (int(high[-1]) if n else 0) + 1  # each ends with a zero
        bits = np.zeros(n + buckets, np.uint8)
        bits[high + np.arange(n)] = 1
        unary = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 64, np.uint8)]), bitorder="little").view(_U)
        ones = np.bitwise_count(unary)
        ranks = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.uint32 if n < 1 << 31 else np.int64)
        return [n, low, buckets], [planes, unary, ranks]

    def _low(self, at: np.ndarray) -> np.ndarray:
        x = np.zeros(len(at), _U)
        for k in range(len(self.planes)):
            x |= self.planes[k][at].astype(_U) << _U(8 * k)
        return x

    def _zeros(self) -> np.ndarray:
        """The number of zeros before each word."""
        return np.arange(0, 64 * len(self.ranks), 64) - self.ranks

    @staticmethod
    def _select(k: np.ndarray, before: np.ndarray, words: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th (from 0) one of the words, or zero with flip; `before` counts those in front of each word."""
        word = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        x, left = words[word], (k - before[word]).astype(np.uint8)
        if flip:
            x = ~x
        at = np.zeros(len(k), np.uint8)
        for width in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(x & _U((1 << width) - 1))
            skip = np.where(here <= left, np.uint8(width), np.uint8(0))
            left -= np.where(skip, here, np.uint8(0))
            x >>= skip.astype(_U)
            at += skip
        return 64 * word + at

    def access(self, at: np.ndarray) -> np.ndarray:
        parts = [at[i : i + CHUNK] for i in range(0, len(at), CHUNK)]
        return np.concatenate([np.zeros(0, _U)] + [((self._select(p, self.ranks, self.unary, False) - p).astype(_U) << _U(self.low_bits)) | self._low(p) for p in parts])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1: the successor of a key in its bucket, if it equals the key."""
        if not self.n:
            return np.full(len(keys), -1)
        zeros = self._zeros()
        return np.concatenate([np.zeros(0, np.int64)] + [self._find(keys[i : i + CHUNK], zeros) for i in range(0, len(keys), CHUNK)])

    def _find(self, keys: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        bucket, low = keys >> _U(self.low_bits), keys & self.mask
        inside = bucket < _U(self.buckets)
        b = np.where(inside, bucket, _U(0)).astype(np.int64)
        until = lambda b: self._select(b, zeros, self.unary, True) - b  # noqa: E731 elements in buckets up to this one
        lo, end = np.where(b > 0, until(np.maximum(b - 1, 0)), 0), until(b)
        end = np.where(inside, end, lo)
        hi = end.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < low[todo]
            lo[todo[less]], hi[todo[~less]] = mid[less] + 1, mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        at = np.minimum(lo, self.n - 1)
        return np.where((lo < end) & (self._low(at) == low), lo, -1)


def count_code(c: np.ndarray) -> np.ndarray:
    """Counts in 8 bits: exact below 64, then eighths of a doubling."""
    c = np.maximum(c, 0)
    return np.where(c < 64, c, np.minimum(255, 64 + np.rint(8 * np.log2(np.maximum(c, 64) / 64)))).astype(np.uint8)


def count_of(code: np.ndarray) -> np.ndarray:
    x = code.astype(np.float64)
    return np.where(x < 64, x, 64 * 2 ** ((x - 64) / 8))


#: Finest step of quantised probabilities, in decades.
STEP = 1 / 40


def prob_step(*probs: np.ndarray) -> float:
    """The step at which the smallest positive probability still has a code: STEP, or more where it is below 10 ** -6.35."""
    low = min((float(p[p > 0].min()) for p in probs if (p > 0).any()), default=1.0)
    return max(STEP, -math.log10(low) / 254)


def prob_code(p: np.ndarray, step: float = STEP) -> np.ndarray:
    """Probabilities in 8 bits: 0 for none, else steps of a decade."""
    return np.where(p > 0, 1 + np.minimum(254, np.rint(-np.log10(np.maximum(p, 1e-30)) / step)), 0).astype(np.uint8)


def prob_of(code: np.ndarray, step: float | np.ndarray = STEP) -> np.ndarray:
    return np.where(code > 0, 10 ** (-(code.astype(np.float64) - 1) * step), 0.0)


class NgramTrie:
    """Words, their successors, and the successors of each pair, as Elias-Fano levels of a memory-mapped file.

    A level holds (context index << 32) + successor id, one rising sequence over all contexts, so the search for a
    successor is relative to its context. Rising pointers give the range of each context's successors; their number T
    and the count C of the context give the Witten-Bell weight T / (C + T) and the smoothed probability c / (C + T),
    both quantised in steps that follow the smallest of them (`step`). Pairs keep their quantised count: a word's total is known only over all shards.
    """

    def __init__(self, words: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray):
        first = lambda keys, n: np.searchsorted(keys >> _U(32), np.arange(n + 1, dtype=_U)).astype(_U)
        starts = first(triples, len(pairs))
        t = np.diff(starts).astype(np.float64)
        total = np.maximum(pair_counts + t, 1)
        of = (triples >> _U(32)).astype(np.int64)
        levels = [words, first(pairs, len(words)), pairs, starts, triples]
        weight, smoothed = t / total, triple_counts / total[of] if len(of) else np.zeros(0)
        self.step = prob_step(weight, smoothed)
        codes = [count_code(pair_counts), prob_code(weight, self.step), prob_code(smoothed, self.step)]
        del weight, smoothed
        heads, blocks = zip(*map(EliasFano.encode, levels))
        parts = [x for b in blocks for x in b] + codes
        with tempfile.TemporaryFile() as f:  # task scratch without a name, gone with the task
            for x in parts:
                f.write(np.ascontiguousarray(x).tobytes())
            f.write(b"\0")
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at, views = 0, []
        for x in parts:
            views.append(np.frombuffer(self.map, x.dtype, x.size, at).reshape(x.shape))
            at += x.nbytes
        self.size = at
        self.words, self.pair_start, self.pairs, self.triple_start, self.triples = (EliasFano(*h, *views[3 * k : 3 * k + 3]) for k, h in enumerate(heads))
        self.pair_codes, self.weight_codes, self.triple_codes = views[-3:]

    def successors(self, words: np.ndarray) -> np.ndarray:
        """How many different words of this trie follow each word."""
        i = self.words.find(words)
        at = np.maximum(i, 0)
        if not self.words.n:
            return np.zeros(len(words), np.int64)
        return np.where(i >= 0, (self.pair_start.access(at + 1) - self.pair_start.access(at)).astype(np.int64), 0)

    @staticmethod
    def _in(level: EliasFano, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        found = level.find((np.maximum(context, 0).astype(_U) << _U(32)) | ids.astype(_U))
        return np.where(context >= 0, found, -1)

    def pair(self, word_index: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self._in(self.pairs, word_index, ids)

    def triple(self, pair_index: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self._in(self.triples, pair_index, ids)

    @staticmethod
    def take(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, codes[np.maximum(at, 0)], 0).astype(np.uint8) if len(codes) else np.zeros(len(at), np.uint8)
