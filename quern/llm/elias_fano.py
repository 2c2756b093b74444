"""Elias-Fano sequences and a two-level n-gram trie of them, in one memory-mapped file.

A rising sequence of n numbers below u takes about 2 + log2(u / n) bits a number: the
low bits as they are, the high bits in unary.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from dataclasses import dataclass

import numpy as np


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(0, np.uint8)
    wide = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(wide.astype(np.uint8).ravel(), bitorder="little")


def _unpacked(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    if not bits:
        return np.zeros(n, np.uint64)
    wide = np.unpackbits(data, count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros(n, np.uint64)
    for i in range(bits):
        out |= wide[:, i].astype(np.uint64) << np.uint64(i)
    return out


#: Questions answered at once, so that what they need beside the levels stays small.
_ASKED = 1 << 16


@dataclass
class EliasFano:
    """A rising sequence (equal numbers may follow each other)."""

    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        ratio = (int(values[-1]) + 1) // n if n else 0
        bits = max(0, ratio.bit_length() - 1)
        top = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros(int(top[-1]) + n + 1 if n else 1, np.uint8)
        unary[top + np.arange(n)] = 1
        return cls(n, bits, _packed(values & np.uint64((1 << bits) - 1), bits), np.packbits(unary, bitorder="little"))

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        top = (ones - np.arange(self.n)).astype(np.uint64)
        return (top << np.uint64(self.bits)) | _unpacked(self.low, self.bits, self.n)


class Searched:
    """Numbers of a sequence and places in it, from the packed bits as they lie.

    Beside them there is only how many ones come before every 64th of the high bits.
    """

    def __init__(self, level: EliasFano):
        self.level = level
        ones = np.bitwise_count(level.high)
        self._ones = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), 8), dtype=np.int64))])
        self._zeros = np.arange(len(self._ones), dtype=np.int64) * 64 - self._ones
        self._top = int(self._select(np.array([level.n - 1]), True)[0]) - level.n + 1 if level.n else -1

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Where the k-th one (or zero) of the high bits is, from 0."""
        high = self.level.high
        before = self._ones if one else self._zeros
        word = np.searchsorted(before, k, side="right") - 1
        at = word[:, None] * 8 + np.arange(8)
        found = np.where(at < len(high), high[np.minimum(at, len(high) - 1)], 0).astype(np.uint8)
        seen = np.cumsum(np.unpackbits(found if one else ~found, axis=1, bitorder="little"), axis=1, dtype=np.uint8)
        return word * 64 + (seen <= (k - before[word])[:, None]).sum(axis=1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bits, low = self.level.bits, self.level.low
        if not bits:
            return np.zeros(len(i), np.uint64)
        byte, off = np.divmod(i * bits, 8)
        off = off.astype(np.uint64)
        near = low[np.minimum(byte[:, None] + np.arange(9), len(low) - 1)]
        wide = np.ascontiguousarray(near[:, :8]).view("<u8").ravel() >> off
        last = near[:, 8].astype(np.uint64) << ((np.uint64(64) - off) & np.uint64(63))
        return (wide | np.where(off > 0, last, np.uint64(0))) & np.uint64((1 << bits) - 1)

    def numbers(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places `i`."""
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.level.bits)) | self._low(i)

    def _upto(self, top: np.ndarray) -> np.ndarray:
        """How many numbers have these high bits or smaller ones."""
        inside = np.clip(top, 0, self._top)
        return np.where(top < 0, 0, np.where(top > self._top, self.level.n, self._select(inside, False) - inside))

    def find(
        self, wanted: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each wanted number, and whether it is there, of all places
        or those from `start` to before `stop`."""
        if not self.level.n:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        top = np.minimum(wanted >> np.uint64(self.level.bits), np.uint64(self._top + 1)).astype(np.int64)
        rest = wanted & np.uint64((1 << self.level.bits) - 1)
        lo, end = self._upto(top - 1), self._upto(top)
        if start is not None:
            lo, end = np.maximum(lo, start), np.minimum(end, stop)
        hi = np.maximum(lo, end)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < rest[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        inside = np.minimum(lo, self.level.n - 1)
        return inside, (lo < end) & (self._low(inside) == rest)


class Trie:
    """Contexts and the words that follow them, with a 16-bit code each.

    The levels lie in a file of their own that is mapped into memory and has no name
    any more, so nothing is left behind whatever ends the task. Level one: the
    contexts, and where the successors of each begin. Level two: the successors, each
    a number relative to its context (context · words + word), so that they rise
    throughout; and their codes.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, keys: np.ndarray, codes: np.ndarray):
        """`contexts` and `words` are the distinct ids, rising; `keys` are the rising
        (place of the context) · len(words) + (place of the word)."""
        starts = np.searchsorted(keys, np.arange(len(contexts) + 1, dtype=np.uint64) * np.uint64(max(1, len(words))))
        self.levels = [EliasFano.of(v) for v in (contexts, words, starts, keys)]
        parts = [a for level in self.levels for a in (level.low, level.high)]
        parts.append(codes.astype("<u2").view(np.uint8))
        handle, path = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(handle, "w+b") as file:
            os.unlink(path)
            for part in parts:
                file.write(part.tobytes())
            file.write(b"\0")  # an empty file cannot be mapped
            file.flush()
            mapped = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
        at = 0
        views = []
        for part in parts:
            views.append(mapped[at:at + len(part)])
            at += len(part)
        for i, level in enumerate(self.levels):
            level.low, level.high = views[2 * i], views[2 * i + 1]
        self._codes = views[-1]

    def reader(self) -> Reader:
        return Reader(*map(Searched, self.levels), self._codes.view("<u2"))


@dataclass
class Reader:
    """Answers from the mapped levels, none of which is decoded."""

    contexts: Searched
    words: Searched
    starts: Searched
    keys: Searched
    codes: np.ndarray

    def look_up(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The codes of (context, word) pairs, 0 where a pair is not in the trie."""
        out = np.zeros(len(words), np.uint16)
        for at in range(0, len(words), _ASKED):
            out[at:at + _ASKED] = self._codes_of(contexts[at:at + _ASKED], words[at:at + _ASKED])
        return out

    def _codes_of(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.uint16)
        context, place_v = np.unique(contexts, return_inverse=True)
        word, place_w = np.unique(words, return_inverse=True)
        context, known = self.contexts.find(context)
        word, also = self.words.find(word)
        ask = np.flatnonzero(known[place_v] & also[place_w])
        if len(ask):  # the word is searched among the context's own only
            start, stop = (self.starts.numbers(context + step).astype(np.int64)[place_v[ask]] for step in (0, 1))
            key = context[place_v[ask]] * self.words.level.n + word[place_w[ask]]
            at, there = self.keys.find(key.astype(np.uint64), start, stop)
            out[ask] = np.where(there, self.codes[at], 0)
        return out
