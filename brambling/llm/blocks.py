"""Blocks of whole documents as numpy arrays, and vectorised kernels over their bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes of text that a worker handles at once; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of a run that is hashed by itself, and words of it that are mixed at a time.
LONG, PIECE = 4096, 1 << 18


class Block(NamedTuple):
    """Documents whose texts lie one after the other: text i is data[at[i]:at[i + 1]]; rest has the batch's other columns."""

    doc_id: pa.Array
    data: np.ndarray
    at: np.ndarray
    rest: list[pa.Array]


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets; nulls are empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts batches of (doc_id, text, ...) into blocks of about `most` bytes, and joins batches that are smaller."""
    held: list[Block] = []
    size = 0
    for batch in batches:
        ids, rest = batch.column(0), batch.columns[2:]
        data, at = _strings(batch.column(1))
        i = 0
        while i < len(ids):
            j = int(np.searchsorted(at, at[i] + most - size, side="right")) - 1
            j = min(len(ids), max(j, i + (not held)))
            if j > i:
                held.append(Block(ids[i:j], data[at[i] : at[j]], at[i : j + 1] - at[i], [c[i:j] for c in rest]))
                size += int(at[j] - at[i])
            if j < len(ids) or size >= most:
                yield _joined(held)
                held, size = [], 0
            i = j
    if held:
        yield _joined(held)
    release()


def release() -> None:
    """Gives freed memory back to the system, as Python workers stay for later tasks; does nothing where the C library cannot."""
    if _TRIM is not None:
        _TRIM(0)


def _joined(parts: list[Block]) -> Block:
    if len(parts) == 1:
        return parts[0]
    base = np.cumsum([0, *(len(p.data) for p in parts)])
    at = np.concatenate([[0], *(p.at[1:] + b for p, b in zip(parts, base))])
    rest = [pa.concat_arrays(c) for c in zip(*(p.rest for p in parts))]
    return Block(pa.concat_arrays([p.doc_id for p in parts]), np.concatenate([p.data for p in parts]), at, rest)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then start[1], ..."""
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    out = np.repeat(start - (ends - count), count)
    out += np.arange(int(ends[-1]))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words8(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of raw on, as one number; beyond the end they are 0."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def _low(n: np.ndarray) -> np.ndarray:
    """Masks of the n lowest bytes, of 8 at most."""
    return np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * np.minimum(n, 8).astype(np.uint64))


def _hash_long(load: np.ndarray, start: int, size: int) -> np.uint64:
    """A hash of a long run: the sum of its 8-byte words, each mixed with its number."""
    total = np.zeros(1, np.uint64)
    for k in range(0, size, 8 * PIECE):
        place = np.arange(k, min(size, k + 8 * PIECE), 8)
        number = mix(place.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
        total += mix((load[start + place] & _low(size - place)) ^ number).sum(dtype=np.uint64)
    return mix(total)[0]


def hash_runs(raw: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the runs raw[start:start + size], each of a byte at least; of runs up to 8 bytes no two share one unless their sizes differ.

    Short runs are hashed together, 8 bytes of each at a time; runs of more than
    LONG bytes one by one, so that a line of megabytes does not take a step for
    every 8 of its bytes.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    load = words8(raw)
    out = mix((load[start] & _low(size)) + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] ^= _hash_long(load, int(start[i]), int(size[i]))
    left = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(left):
        rest = size[left] - done
        out[left] = mix(out[left] * np.uint64(0x9E3779B97F4A7C15) ^ (load[start[left] + done] & _low(rest)))
        left = left[rest > 8]
        done += 8
    return out
