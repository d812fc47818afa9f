"""Words and word shingles of a block of documents, vectorised over its bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .blocks import Block, hash_runs, mix

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Word i is the run data[start:start + size] and lies in document doc; per_doc counts them."""

    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    per_doc: np.ndarray


def words(b: Block, blank: np.ndarray | None = None) -> Words:
    blank = BLANK[b.data] if blank is None else blank
    n = len(blank)
    if not n:
        return Words(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(len(b.doc_id), np.int64))
    cut = np.zeros(n + 1, bool)  # a document begins here
    cut[b.at] = True
    begin = ~blank
    begin[1:] &= blank[:-1] | cut[1:-1]
    start = np.flatnonzero(begin)
    end = ~blank
    end[:-1] &= blank[1:] | cut[1:-1]
    size = np.flatnonzero(end) + 1 - start
    first = np.searchsorted(start, b.at)
    per_doc = np.diff(first)
    return Words(start, size, np.repeat(np.arange(len(per_doc)), per_doc), per_doc)


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that lie within a document, and the place of their first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out *= _STEP
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out[first]), first


def word_hashes(b: Block, w: Words, lower: bool = False) -> np.ndarray:
    return hash_runs(LOWER[b.data] if lower else b.data, w.start, w.size)
