"""License texts in documents, by MinHash bands over text windows.

Templates of similar length form a class. A document is looked at through windows of
three strides, one stride apart, with a stride of at least half the longest template
of the class: wherever a template lies, some window holds it whole. If a share of
`similarity` of a template's shingles is there, the window's set and the template's
have at least the Jaccard similarity that `least_jaccard` states, and the number of
bands is the smallest that lets such a window pass unseen with a probability of
`MISS` or less. A table from (band, value) to templates holds the signatures of all
templates of a class: a window looks its own values up and so retrieves the templates
that agree with it in some band, whatever their number. What is retrieved is compared
shingle by shingle.

Words are runs of letters, digits and underscores, lower-cased; shingles have five
words, or all words of a shorter template.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import prepared, table

WORDS = 5
SIMILARITY = 0.8
#: Chance that no band of a window that holds a template agrees with it.
MISS = 1e-4
#: Rows of a band. Unrelated texts hardly share a five-word shingle, so one is enough.
BAND_ROWS = 1
MIN_STRIDE = 4
#: Characters of templates sent to the tasks at once; more take a pass over the documents each.
MAX_CHARS = 16_000_000
#: Remainders of hashes by which most shingles are told to be no template's.
_REMAINDERS = 1 << 16
_SLICE = 1 << 16
_KEPT_WORDS = 200_000
_find = re.compile(r"\w+").findall

#: Notices the registered query looks for (fixed values, public license notices).
TEMPLATES = (
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("mit-line", "Released under the MIT License."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
     "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions:"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met:"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
     "file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version."),
)

FOUND = "array<struct<template: int, first_word: int, end_word: int, containment: double>>"
_FOUND = pa.list_(pa.struct([
    ("template", pa.int32()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("containment", pa.float64())]))


def words_of(text: str | None) -> list[str]:
    return _find((text or "").lower())


def shingles(words: Sequence[str], size: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(size))))


def least_jaccard(n: int, window: int, similarity: float) -> float:
    """Of a template of n shingles and a window that holds `similarity` of them."""
    held = math.ceil(similarity * n - 1e-9)
    return held / (window + n - held)


def bands_for(jaccard: float, rows: int, miss: float = MISS) -> int:
    chance = jaccard**rows
    return 1 if chance >= 1 else math.ceil(math.log(miss) / math.log1p(-chance))


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
        code = self[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return code


def _hashed(codes: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash of each run of `size` words."""
    n = max(0, len(codes) - size + 1)
    x = np.zeros(n, np.uint64)
    for i in range(size):
        x = (x ^ codes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(32)).astype(np.uint32)


@dataclass
class _Class:
    """Templates of one shingle size and similar length, with their MinHash bands."""

    size: int
    stride: int
    numbers: list[int]
    factor: np.ndarray
    shift: np.ndarray
    rows: int
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # (band, value), rising
    template: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each key
    shingles: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))  # of all templates, hashed, rising
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # remainders of these

    def store(self, signs: np.ndarray, hashed: np.ndarray) -> None:
        """`signs`: templates × bands; `hashed`: the shingles of all templates."""
        self.shingles = np.unique(hashed)
        self.known = np.zeros(_REMAINDERS, bool)
        self.known[self.shingles & np.uint32(_REMAINDERS - 1)] = True
        n, bands = signs.shape
        values = signs.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        keys = (np.arange(bands, dtype=np.uint64) << np.uint64(32) | values).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.template = keys[order], np.repeat(np.array(self.numbers), bands)[order]

    def retrieved(self, seen: np.ndarray) -> np.ndarray:
        """(template, window) pairs, rising, that agree in a band; `seen`: bands × windows."""
        values = seen.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        keys = (np.arange(len(seen), dtype=np.uint64)[:, None] << np.uint64(32) | values).ravel()
        window = np.tile(np.arange(seen.shape[1]), len(seen))
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.unique(np.stack([self.template[at], np.repeat(window, n)], axis=1), axis=0)

    def _banded(self, least: np.ndarray) -> np.ndarray:
        """bands × windows from (bands · rows) × windows minima."""
        if self.rows == 1:
            return least
        out = least[0::self.rows].astype(np.uint64)
        for i in range(1, self.rows):
            out = (out ^ least[i::self.rows]) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def holds(self, x: np.ndarray) -> np.ndarray:
        """Which shingles (hashed) some template of the class has."""
        at = np.flatnonzero(self.known[x & np.uint32(_REMAINDERS - 1)])
        place = np.minimum(np.searchsorted(self.shingles, x[at]), len(self.shingles) - 1)
        return at[self.shingles[place] == x[at]]

    def windows(self, x: np.ndarray, holds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of windows (at 0, stride, 2 · stride, …) and their signatures: bands ×
        windows. `holds` are the places of shingles that some template has. Left out are windows without a shingle of any template: their minima are
        those of other shingles, and as hashes of unlike shingles differ, in no band could
        they be a template's."""
        blocks, three = -(-len(x) // self.stride), np.arange(3)
        number = np.unique((np.unique(holds // self.stride)[:, None] - three).ravel())
        number = number[number >= 0]
        need = np.unique((number[:, None] + three).ravel())
        need = need[need < blocks]
        least = np.full((len(self.factor), len(need) + 1), 0xFFFFFFFF, np.uint32)  # the last stands for no block
        step = max(1, _SLICE // len(self.factor))
        for at in range(0, len(need), step):
            part = slice(at, min(at + step, len(need)))
            for i in range(self.stride):
                index = need[part] * self.stride + i
                hashed = x[np.minimum(index, len(x) - 1)] * self.factor[:, None] + self.shift[:, None]
                hashed[:, index >= len(x)] = 0xFFFFFFFF
                np.minimum(least[:, part], hashed, out=least[:, part])
        place = np.searchsorted(need, number[:, None] + three)
        return number, self._banded(least[:, place].min(axis=2))


class Scanner:
    """Finds the templates (texts) in texts."""

    def __init__(self, templates: Sequence[str], similarity: float = SIMILARITY, rows: int = BAND_ROWS, seed: int = 7):
        self.similarity, self.codes = similarity, _Codes()
        self.words = [words_of(t) for t in templates]
        self.sizes = [min(WORDS, len(w)) for w in self.words]
        self.sets = [set(shingles(w, k)) if k else set() for w, k in zip(self.words, self.sizes)]
        alike: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, s in enumerate(self.sets):
            if s:
                alike[self.sizes[i], (len(self.words[i]) - self.sizes[i] + 1).bit_length()].append(i)
        random = np.random.default_rng(seed)
        self.classes = []
        for (size, _), numbers in sorted(alike.items()):
            longest = max(len(self.words[i]) - size + 1 for i in numbers)
            stride = max(MIN_STRIDE, -(-longest // 2))
            bands = max(bands_for(least_jaccard(len(self.sets[i]), 3 * stride, similarity), rows) for i in numbers)
            factor = random.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
            shift = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
            one = _Class(size, stride, numbers, factor, shift, rows)
            hashed = [self._hash(self.words[i], size) for i in numbers]
            least = [(x * factor[:, None] + shift[:, None]).min(axis=1)[:, None] for x in hashed]
            one.store(np.array([one._banded(x)[:, 0] for x in least]), np.concatenate(hashed))
            self.classes.append(one)

    def _hash(self, words: Sequence[str], size: int) -> np.ndarray:
        codes = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        return _hashed(codes, size)

    def __call__(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(template, first word, word after the last, containment), overlapping finds
        of a template as one with the best containment."""
        words = words_of(text)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        hashed = {size: _hashed(codes, size) for size in {c.size for c in self.classes}}
        found = []
        for c in self.classes:
            at = c.holds(hashed[c.size])
            if not len(at):
                continue
            windows, seen = c.windows(hashed[c.size], at)
            pairs = c.retrieved(seen)
            for number in np.unique(pairs[:, 0]).tolist():
                hits = windows[pairs[pairs[:, 0] == number, 1]]
                found += self.verified(words, number, c.size, 3 * c.stride, (hits * c.stride).tolist())
        return sorted(found)

    def verified(
        self, words: Sequence[str], number: int, size: int, window: int, starts: Sequence[int]
    ) -> list[tuple[int, int, int, float]]:
        """Of the windows (in shingles) at `starts`, in order, those that hold the template."""
        spans: list[tuple[int, int, int, float]] = []
        wanted = self.sets[number]
        for start in starts:
            here = shingles(words[start:start + window + size - 1], size)
            at = [i for i, s in enumerate(here) if s in wanted]
            share = len({here[i] for i in at}) / len(wanted)
            if share < self.similarity - 1e-9:
                continue
            first, end = start + at[0], start + at[-1] + size
            if spans and first < spans[-1][2]:
                _, f, e, best = spans.pop()
                spans.append((number, min(f, first), max(e, end), max(best, share)))
            else:
                spans.append((number, first, end, share))
        return spans


def notices(text: Column, templates: Sequence[str], similarity: float = SIMILARITY) -> Column:
    """The templates in a text, each as its number, words and containment."""
    made: list[Scanner] = []

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Scanner(templates, similarity))
        names = ("template", "first_word", "end_word", "containment")
        return pa.array([[dict(zip(names, x)) for x in made[0](t.as_py())] for t in texts], _FOUND)

    return scan(text.cast("string"))


def license_scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(doc_id, template, first_word, end_word, containment) of each notice found.

    Null or wordless texts and templates match nothing. Rows that repeat are answered
    each time; null ids stay null. No documents or no templates give no rows. Templates
    of more than `MAX_CHARS` characters take a pass over the documents for each such part.
    """
    prepared(docs.sparkSession)
    parts: list[list[tuple[str, str]]] = [[]]
    size = 0
    for name, text in templates:
        if parts[-1] and size + len(text or "") > MAX_CHARS:
            parts.append([])
            size = 0
        parts[-1].append((name, text))
        size += len(text or "")
    found = None
    for part in parts:
        names = F.array(*(F.lit(n) for n, _ in part)) if part else F.array(F.lit(None).cast("string"))
        one = docs.select(
            F.col(id_col).alias("doc_id"), F.explode(notices(F.col(text_col), [t for _, t in part], similarity)).alias("f"),
        ).select("doc_id", names[F.col("f.template")].alias("template"), "f.first_word", "f.end_word", "f.containment")
        found = one if found is None else found.unionByName(one)
    return found


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    return license_scan(table(prepared(spark), sf_dir, "documents"), TEMPLATES)
