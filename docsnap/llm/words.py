"""Hashes of the words and word shingles of many texts at once, over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from docsnap.llm.common import mix, remembered

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
PLACE = _RANDOM.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64, for k below ``size``."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` of them; a longer table than the usual one replaces it."""
    size = max(1 << 20, 1 << (size - 1).bit_length() if size else 1)
    return remembered("powers", size, lambda: _powers(size))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the maximal runs without white space, and the word offsets of each text.

    The hash of a run is a polynomial in its bytes, taken from running sums, then scrambled.
    """
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer words than ``width`` has one shingle of all its words, one without words none.
    """
    hashes, bounds = word_hashes(data, offsets)
    long = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        long += hashes[k : k + len(long)] * PLACE[k]
    long = mix(long)
    sets = []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - start >= width:
            found = long[start : end - width + 1].copy()
            found.sort()
            if len(found) > 1:
                found = found[np.concatenate(([True], found[1:] != found[:-1]))]
            sets.append(found)
        else:
            short = (hashes[start:end] * PLACE[width : width + end - start]).sum(dtype=np.uint64, keepdims=True)
            sets.append(mix(short)[: min(1, end - start)])
    return sets
