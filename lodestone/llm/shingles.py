"""Hashed word shingles of many documents at once."""

from __future__ import annotations

import numpy as np

from lodestone.llm.suffix_dedup import BASE, Powers, scramble

WORDS = 5
CHUNK = 1 << 18


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower, space = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    space[[32, 9, 10, 11, 12, 13]] = True
    return lower, space


LOWER, SPACE = _byte_tables()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of every document's WORDS-word shingles (all its words if it has fewer)."""
    out: list[np.ndarray] = []
    begin, n_docs = 0, len(offsets) - 1
    while begin < n_docs:
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK, side="right")) - 1)
        stop = min(stop, n_docs)
        out += _shingle_chunk(data[int(offsets[begin]) : int(offsets[stop])], offsets[begin : stop + 1] - offsets[begin], powers)
        begin = stop
    return out


def _shingle_chunk(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> list[np.ndarray]:
    n_docs = len(offsets) - 1
    none = np.zeros(0, np.uint64)
    if not len(data):
        return [none] * n_docs
    if len(data) > len(powers.up) - 1:  # a document of more than a chunk
        powers = Powers(len(data) + 1)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | edge[1:-1]])
    stop = np.flatnonzero(inside & np.r_[~inside[1:] | edge[1:-1], True]) + 1
    sums = powers.sums(LOWER[data])
    word = powers.ranges(sums, start, stop) ^ scramble((stop - start).astype(np.uint64))
    first = np.searchsorted(start, offsets[:-1])
    count = np.diff(np.r_[first, len(start)])
    chain = np.full(len(word), np.uint64(BASE))
    chains = []  # hash of the k + 1 words from each word on
    for k in range(WORDS):
        n = len(word) - k
        if n <= 0:
            break
        chain = scramble(chain[:n] * np.uint64(BASE) + word[k:])
        chains.append(chain)
    out = []
    for at, n in zip(first.tolist(), count.tolist()):
        if n >= WORDS:
            out.append(np.unique(chains[WORDS - 1][at : at + n - WORDS + 1]))
        else:
            out.append(chains[n - 1][at : at + 1].copy() if n else none)
    return out
