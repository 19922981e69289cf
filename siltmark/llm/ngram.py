"""Character n-gram language models with Kneser-Ney smoothing in sorted hash arrays.

An n-gram is a number: 8 bits a character class, the newest class lowest. Its hash is that
number times an odd constant modulo 2**64, so different n-grams never share one.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class HashArray:
    """A sorted array of hashes, with the place where each prefix of bits begins."""

    def __init__(self, codes: np.ndarray):
        hashes = codes.astype(np.uint64) * _MIX
        self.order = np.argsort(hashes, kind="stable")  # only the builder needs it
        self.hashes = hashes[self.order]
        self.size = len(codes)
        self.bits = max(1, len(codes).bit_length())
        starts = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.starts = starts.astype(np.int32)
        self.probes = int(np.diff(np.append(starts, len(codes))).max(initial=0))
        self.hashes = np.append(self.hashes, np.full(self.probes + 1, np.iinfo(np.uint64).max))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of ``codes`` in the sorted array, -1 for those that it lacks."""
        h = codes.astype(np.uint64) * _MIX
        at = self.starts[h >> np.uint64(64 - self.bits)]
        for _ in range(self.probes - 1):
            at += self.hashes[at] < h
        return np.where((self.hashes[at] == h) & (at < self.size), at, -1)


def _discounts(counts: np.ndarray, modified: bool) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (max(1, int((counts == i).sum())) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    if not modified:
        return np.array([0.0, y, y, y])
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.0, [0.0, 0.95, 1.9, 2.85])


class CharModel:
    """Interpolated Kneser-Ney over counts of n-grams of one length.

    The longest n-grams keep their counts; a shorter one counts the different classes seen
    before it. ``modified`` uses three discounts a length instead of one.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, symbols: int = 256, modified: bool = False):
        self.order, self.symbols = order, symbols
        levels = []
        codes, counts = np.asarray(codes, np.uint64), np.asarray(counts, np.int64)
        by = np.argsort(codes)
        codes, counts = codes[by], counts[by]
        for k in range(order, 0, -1):
            levels.append((codes, counts))
            if k > 1:
                codes, counts = np.unique(codes & np.uint64((1 << 8 * (k - 1)) - 1), return_counts=True)
        self.levels: list[tuple] = []
        for codes, counts in reversed(levels):
            taken = _discounts(counts, modified)
            contexts, at = np.unique(codes >> np.uint64(8), return_inverse=True)
            total = np.bincount(at, counts, minlength=len(contexts))
            off = taken[np.minimum(counts, 3)]
            spare = np.bincount(at, off, minlength=len(contexts)) / np.maximum(total, 1)
            p = (counts - off) / total[at] if len(codes) else np.zeros(0)
            p = p + spare[at] * np.exp(self.log_prob(codes, len(self.levels)))
            spare = np.log(np.maximum(spare, 1e-12))
            self.levels.append((codes, np.log(np.maximum(p, 1e-12)), contexts, spare))

    def log_prob(self, codes: np.ndarray, level: int | None = None) -> np.ndarray:
        """Natural log of the probability of each n-gram's newest class after the others."""
        level = self.order if level is None else level
        if level == 0:
            return np.full(len(codes), -np.log(self.symbols))
        codes = codes & np.uint64((1 << 8 * level) - 1)
        have, logs, contexts, _ = self.levels[level - 1]
        if not len(contexts):
            return self.log_prob(codes, level - 1)
        at = np.minimum(np.searchsorted(have, codes), len(have) - 1)
        out = logs[at]
        lost = np.flatnonzero(have[at] != codes)
        if len(lost):
            out[lost] = self.backed_off(codes[lost], level)
        return out

    def backed_off(self, codes: np.ndarray, level: int) -> np.ndarray:
        """``log_prob`` of n-grams that were not seen at ``level``."""
        *_, contexts, spare = self.levels[level - 1]
        if not len(contexts):
            return self.log_prob(codes, level - 1)
        codes = codes & np.uint64((1 << 8 * level) - 1)
        context = codes >> np.uint64(8)
        c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        return np.where(contexts[c] == context, spare[c], 0.0) + self.log_prob(codes, level - 1)


class Scorer:
    """Several models in one hash array: a row of log probabilities, one a model, for every n-gram that any has seen.

    The models' own tables of longest n-grams go: what the array lacks no model has seen.
    """

    def __init__(self, models: list[CharModel]):
        self.models, self.order = models, models[0].order
        codes = np.unique(np.concatenate([m.levels[-1][0] for m in models]))
        self.array = HashArray(codes)
        rows = np.stack([m.log_prob(codes) for m in models], axis=1).astype(np.float32)
        self.rows = np.ascontiguousarray(rows[self.array.order])
        self.array.order = None
        for m in models:
            m.levels[-1] = (None, None, *m.levels[-1][2:])

    def score(self, codes: np.ndarray) -> np.ndarray:
        if not self.array.size:
            return np.stack([m.backed_off(codes, self.order) for m in self.models], axis=1)
        at = self.array.find(codes)
        out = self.rows[at]
        lost = np.flatnonzero(at < 0)
        if len(lost):
            out[lost] = np.stack([m.backed_off(codes[lost], self.order) for m in self.models], axis=1)
        return out

    @property
    def nbytes(self) -> int:
        held = [a.nbytes for m in self.models for level in m.levels for a in level if a is not None]
        return self.array.hashes.nbytes + self.array.starts.nbytes + self.rows.nbytes + sum(held)


def codes_of(classes: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each class; before the first stand zeros."""
    out = classes.astype(np.uint64)
    for i in range(1, order):
        out[i:] |= classes[:-i].astype(np.uint64) << np.uint64(8 * i)
    return out


def parts(sizes: list[int], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of consecutive items of about ``most`` in size; a larger item is a range of its own."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            out.append((start, i))
            start, held = i, 0
        held += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def add_counts(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes and the sum of their counts (1 each if none are given)."""
    if counts is None:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts[order], first) if len(codes) else counts
