"""Grams of texts by rolling hashes over code points.

A batch of texts is one array of code points. The hash of every window is a polynomial modulo
2^64, made by doubling: windows of 2 k from two of k. Equal grams have equal hashes; equal hashes
are only ever candidates, and are verified on the texts themselves, so no result depends on the
hash. A task holds PORTION characters of texts and their hashes at a time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters handled at a time; a longer text is a portion of its own.
PORTION = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def portions(texts: list[str | None], size: int = PORTION):
    """(first row, texts) of about so many characters; a null text is empty."""
    at, held, n = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t or "")
        n += len(held[-1])
        if n >= size:
            yield at, held
            at, held, n = k + 1, [], 0
    if held:
        yield at, held


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and the length of each text."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, texts), np.int64, len(texts))


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the window of the size at each place."""
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    power, width, held, out, filled = _BASE, 1, codes.astype(np.uint64) + np.uint64(1), None, 0
    while True:
        if size & width:  # the windows so far, then one of this width
            if out is None:
                out = held
            else:
                out = out[: len(held) - filled] * np.uint64(power) + held[filled:]
            filled += width
        if 2 * width > size:
            return out[: len(codes) - size + 1]
        held = held[:-width] * np.uint64(power) + held[width:]
        power, width = power * power & _MASK, 2 * width


def strided_places(lengths: np.ndarray, strides: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts that stand one after the other: the text and the place of 0, stride, 2 stride ...
    below the end in each."""
    counts = np.maximum(0, -(-ends // strides))
    text = np.repeat(np.arange(len(lengths)), counts)
    k = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, (np.cumsum(lengths) - lengths)[text] + k * strides[text]


def repeating(texts: list[str | None], gram: int, times: int, least: int, sampled: bool) -> np.ndarray:
    """Whether a gram occurs `times` times in each text of `least` characters or more. sampled: of
    the places 0, step, 2 step ... but the last place, where step is length // 2000 (1 at least);
    else of all places."""
    out = np.zeros(len(texts), bool)
    for at, part in portions(texts):
        codes, lengths = codes_of(part)
        strides = np.maximum(1, lengths // 2000) if sampled else np.ones(len(part), np.int64)
        ends = np.where(lengths >= least, lengths - gram + (0 if sampled else 1), 0)
        text, places = strided_places(lengths, strides, ends)
        if len(places) < times:
            continue
        # a text's own salt keeps equal grams of different texts apart
        keys = window_hashes(codes, gram)[places] * np.uint64(_BASE) + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.cumsum(lengths) - lengths
        for k in np.unique(text[order[: len(keys) - times + 1][keys[times - 1 :] == keys[: len(keys) - times + 1]]]):
            mine = places[np.searchsorted(text, k) : np.searchsorted(text, k, "right")] - starts[k]
            found = Counter(part[k][p : p + gram] for p in mine.tolist())
            out[at + k] = found.most_common(1)[0][1] >= times
    return out


def repeats(text: Column, gram: int, times: int, least: int, sampled: bool = False) -> Column:
    """repeating() as a column; false for a null text."""

    @F.arrow_udf("boolean")
    def flags(texts: pa.Array) -> pa.Array:
        return pa.array(repeating(texts.to_pylist(), gram, times, least, sampled))

    return flags(text)


class Seeds:
    """The windows of `seed` characters at the first places of some patterns, by their hash: what a
    text that holds a pattern shares with it at one of its own places 0, first, 2 first ... (first
    None: at all places). Compact arrays: hashes in order, and the pattern and place of each."""

    def __init__(self, patterns: list[str], seed: int, first: int | None):
        self.patterns, self.seed = patterns, seed
        codes, lengths = codes_of(patterns)
        ends = lengths - seed + 1 if first is None else np.minimum(lengths - seed + 1, first)
        pattern, places = strided_places(lengths, np.ones(len(patterns), np.int64), ends)
        hashes = window_hashes(codes, seed)[places] if len(places) else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.pattern, self.at = pattern[order].astype(np.int32), (places - (np.cumsum(lengths) - lengths)[pattern])[order].astype(np.int32)
        bits = min(24, max(10, len(hashes).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.flags = np.zeros(1 << bits, bool)
        self.flags[(self.hashes >> self.shift).astype(np.int64)] = True

    def meetings(self, texts: list[str], stride: int):
        """(text, place in it, pattern, place in that) of equal hashes, at the texts' strided places."""
        codes, lengths = codes_of(texts)
        text, places = strided_places(lengths, np.full(len(texts), stride), lengths - self.seed + 1)
        if not len(places) or not len(self.hashes):
            return
        hashes = np.zeros(len(places), np.uint64)
        for k in range(self.seed):
            hashes = hashes * np.uint64(_BASE) + (codes[places + k].astype(np.uint64) + np.uint64(1))
        seen = np.flatnonzero(self.flags[(hashes >> self.shift).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, hashes[seen]), np.searchsorted(self.hashes, hashes[seen], "right")
        starts = np.cumsum(lengths) - lengths
        for n, a, b in zip(seen[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            k = int(text[n])
            for j in range(a, b):
                yield k, int(places[n] - starts[k]), int(self.pattern[j]), int(self.at[j])


def common(a: str, b: str, i: int, j: int, size: int) -> bool:
    """Whether what a from i on and b from j on share, grown to both sides, has size characters."""
    lo = 0
    while lo < min(i, j, size) and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    hi = 0
    while lo + hi < size and i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
        hi += 1
    return lo + hi >= size
