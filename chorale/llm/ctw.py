"""Context-tree weighting over bytes, on arrays of counted byte n-grams.

A byte is coded bit by bit. Each of the 255 places in that decision has a tree of its own, whose branches are the bytes
before, the nearest first. A node's Krichevsky-Trofimov estimate is mixed with what its children say, with weight one
half each before any data; the data's own likelihoods then settle the weights, at every depth.

An n-gram is a number: the nearest context byte in the highest place, then the ones before it, and the coded byte last.
"""

from __future__ import annotations

import numpy as np

HALF = np.log(0.5)


def grams(data: np.ndarray, depth: int) -> np.ndarray:
    """The n-gram at every position from ``depth`` on."""
    out = np.zeros(max(len(data) - depth, 0), np.uint64)
    for k in range(1, depth + 1):
        out = out << np.uint64(8) | data[depth - k : len(data) - k]
    return out << np.uint64(8) | data[depth:]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive x (up to 1e30), by Stirling's series after a shift by 8."""
    y, product = x + 8, x.copy()
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Nodes:
    """The nodes of one depth: sorted keys (context, place), bit counts, KT and weighted log probabilities."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, below: Nodes | None):
        """``pairs``: sorted distinct (context, byte); ``below``: the nodes one byte deeper, or None at the bottom."""
        keys, zeros, ones = [], [], []
        for k in range(8):
            place = (pairs & ~np.uint64(0xFF)) | (np.uint64(1 << k) | ((pairs & np.uint64(0xFF)) >> np.uint64(8 - k)))
            bit = (pairs >> np.uint64(7 - k)) & np.uint64(1)
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, int)
            keys.append(place[first])
            zeros.append(np.add.reduceat(counts * (bit == 0), first) if len(first) else np.zeros(0))
            ones.append(np.add.reduceat(counts * (bit == 1), first) if len(first) else np.zeros(0))
        key = np.concatenate(keys)
        order = np.argsort(key)
        self.keys, self.zeros, self.ones = key[order], np.concatenate(zeros)[order].astype(float), np.concatenate(ones)[order].astype(float)
        self.kt = kt_log(self.zeros, self.ones)
        if below is None:
            self.weighted = self.kt
        else:
            parent = ((below.keys >> np.uint64(16)) << np.uint64(8)) | (below.keys & np.uint64(0xFF))
            children = np.bincount(self.find(parent)[0], below.weighted, len(self.keys)) if len(parent) else np.zeros(len(self.keys))
            self.weighted = HALF + np.logaddexp(self.kt, children)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the keys, and which of them there are."""
        if not len(self.keys):
            return np.zeros(len(keys), int), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def mix(self, context: np.ndarray, byte: np.ndarray, deeper: np.ndarray, bottom: bool) -> np.ndarray:
        """Probabilities of a byte's eight bits given those (8 rows) of the next deeper context."""
        out = deeper.copy()
        for k in range(8):
            place = (context << np.uint64(8)) | (np.uint64(1 << k) | (byte >> np.uint64(8 - k)))
            at, there = self.find(place)
            if not there.any():
                continue
            at = at[there]
            bit = ((byte[there] >> np.uint64(7 - k)) & np.uint64(1)) == 1
            own = (np.where(bit, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1)
            weight = 1.0 if bottom else np.exp(np.minimum(HALF + self.kt[at] - self.weighted[at], 0))
            out[k, there] = weight * own + (1 - weight) * deeper[k, there]
        return out


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def shorten(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) pairs of the context without its farthest byte."""
    return merge(((pairs >> np.uint64(16)) << np.uint64(8)) | (pairs & np.uint64(0xFF)), counts)


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Nodes]:
    """Nodes of depths ``depth`` down to ``top`` from counted n-grams that hold every n-gram of their top contexts."""
    seen = counts > 0
    pairs, counts, levels = keys[seen], counts[seen], []
    for d in range(depth, top - 1, -1):
        levels.append(Nodes(pairs, counts, levels[-1] if levels else None))
        if d > top:
            pairs, counts = shorten(pairs, counts)
    return levels


def deep_probabilities(keys: np.ndarray, levels: list[Nodes], depth: int) -> np.ndarray:
    """For each n-gram the mixed probabilities of its bits, from the bottom up to the last of ``levels``."""
    out, byte = np.full((8, len(keys)), 0.5), keys & np.uint64(0xFF)
    for i, nodes in enumerate(levels):
        out = nodes.mix(keys >> np.uint64(8 * (i + 1)), byte, out, bottom=i == 0 and len(levels) >= 1)
    return out


def join_top(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[Nodes]:
    """Nodes of depths 1 and 0 from 256 by 256 tables (nearest byte, place) of what the deeper nodes sum to."""
    out = []
    for z, o, w in ((zeros, ones, below), (zeros.sum(0, keepdims=True), ones.sum(0, keepdims=True), None)):
        nodes = Nodes.__new__(Nodes)
        nodes.keys = np.arange(z.size, dtype=np.uint64)
        nodes.zeros, nodes.ones = z.ravel(), o.ravel()
        nodes.kt = np.where(nodes.zeros + nodes.ones > 0, kt_log(nodes.zeros, nodes.ones), 0.0)
        children = w.ravel() if w is not None else np.where(ones + zeros > 0, out[0].weighted.reshape(zeros.shape), 0.0).sum(0)
        nodes.weighted = HALF + np.logaddexp(nodes.kt, children)
        out.append(nodes)
    return out


def top_sums(levels: list[Nodes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest byte, place) keys of the nodes of depth 2, with sums of zeros, ones and weighted log probabilities."""
    nodes = levels[-1]
    key = ((nodes.keys >> np.uint64(16)) << np.uint64(8)) | (nodes.keys & np.uint64(0xFF))
    found, at = np.unique(key, return_inverse=True)
    return (found, *(np.bincount(at, x, len(found)) for x in (nodes.zeros, nodes.ones, nodes.weighted)))


class Lookup:
    """Indices of numbers in a sorted array of distinct ones, all of which are there."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(4 * len(keys)).bit_length())
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, queries: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(queries)]
        lost = np.flatnonzero(self.keys[at] != queries)
        at[lost] = np.searchsorted(self.keys, queries[lost])
        return at
