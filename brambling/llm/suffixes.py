"""Operator 1, suffix dedup: bytes covered by strings of LENGTH bytes that also start in a document with a smaller id.

Difference-cover blockwise construction, for suffixes compared to LENGTH bytes.
A cover is a sample of positions such that any two suffixes that may be equal
reach a sampled position after the same shift; ranks of the sample then settle
ties of suffixes. In one string residues modulo v do that. Over a sharded
corpus without common coordinates the sample is chosen by content: of the
ANCHOR-byte strings within the LENGTH bytes after a position, the one of the
least hash. Equal suffixes meet their anchor at the same shift, and the sample
has two positions of 32 rather than six of 31.

1. Anchors of all documents, as sorted hashes in buckets, tell which anchors
   occur in several documents. Suffixes of no other anchor can be repeated.
2. The suffixes of repeated anchors, sixteen for each on average, go to buckets
   by their anchor, one short context for all of them. In a bucket the sample is
   ranked once: contexts sorted from the anchor to the right, and to the left,
   with the common prefixes of neighbours. Suffixes of one shift are then sorted
   at a time, by the two ranks; equal ones lie together, and all but those of the
   smallest id are marked. The number of buckets grows with the corpus, and each
   is a task of its own.
3. Marks return to their documents.

Every block of documents settles its own repeats first, so that of a passage
that a third of all documents share only one context for each block travels. An
anchor of more than HOT blocks, most often a common phrase in ever new contexts,
is split: its shorter shifts go to a bucket by the FINE bytes from the anchor on,
which all suffixes of such shifts share, and its longer ones to a bucket by the
bytes on either side of the anchor. Where a document repeats itself, one of its
equal contexts travels for all of them. Exact copies of whole documents are covered
without any of that. A long document is worked on in pieces that overlap by
LENGTH - 1 bytes.

Null and empty texts have 0 bytes; rows of one doc_id do not repeat each other;
a null doc_id counts as larger than every other one; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks, mix, ragged, release, words8
from .common import documents, id_key, stored, text_key, texts, tidy

LENGTH, ANCHOR = 50, 20
#: Longest shift from a suffix to its anchor; a context has as many bytes before the anchor and LENGTH from it on.
REACH = LENGTH - ANCHOR
CONTEXT = REACH + LENGTH
KEY_BITS = 44
BUCKET_BYTES = 6 << 20
BATCH = 3 << 19
#: Blocks that may have an anchor before its suffixes are split by shift, up to NEAR or beyond it; FINE bytes follow from every anchor of the former.
HOT, NEAR = 128, 15
FINE = LENGTH - NEAR
_FLAG = np.uint64(1 << 63)
#: Rows (30 bytes and a document's few spans) that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 200_000
_ROW = "dest long, kind int, block long, a binary, b binary, c binary"
_ROW_NAMES = ["dest", "kind", "block", "a", "b", "c"]
_DOCS, _LOCAL, _TRAVELS = 0, 1, 2


class Records(NamedTuple):
    """Runs of suffixes that share an anchor: their document, the anchor's hash and place, and the first and last suffix."""

    key: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray


def records(data: np.ndarray, at: np.ndarray) -> Records:
    """The anchors of all suffixes of at least LENGTH bytes in documents data[at[i]:at[i + 1]]."""
    count = np.maximum(0, np.diff(at) - LENGTH + 1)
    if not count.sum():
        none = np.zeros(0, np.int64)
        return Records(none.astype(np.uint64), none, none, none, none)
    load = words8(data)
    m = len(data) - ANCHOR + 1
    gram = load[:m] * np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(29)
    gram += load[8 : 8 + m] * np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(31)
    gram += load[ANCHOR - 8 : ANCHOR - 8 + m] * np.uint64(0x94D049BB133111EB)
    gram = mix(gram)
    # the least of REACH + 1 neighbours, the leftmost if equal: hash above, place below
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    span = 1
    while span * 2 <= REACH + 1:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < REACH + 1:
        rest = REACH + 1 - span
        least = np.minimum(least[: len(least) - rest], least[rest:])
    suffix = ragged(at[:-1], count)
    anchor = (least[suffix] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    anchor = anchor[new]
    end = np.append(new[1:], len(suffix)) - 1
    return Records(gram[anchor], np.searchsorted(at, suffix[new], side="right") - 1, anchor, suffix[new], suffix[end])


def contexts(data: np.ndarray, r: Records) -> np.ndarray:
    """A row of CONTEXT bytes for each record: those before the anchor, backwards, then those from it on; zero beyond its suffixes."""
    padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[r.anchor]
    left, right = around[:, REACH - 1 :: -1].copy(), around[:, REACH:]
    left[np.arange(REACH) >= (r.anchor - r.first)[:, None]] = 0
    right[np.arange(LENGTH) >= (r.last + LENGTH - r.anchor)[:, None]] = 0
    return np.concatenate([left, right], axis=1)


def _ranked(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by key, then bytes, and how many bytes each has in common with its predecessor, -1 under another key."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    numbers = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*numbers.T[::-1], key))
    now, before = rows[order][1:], rows[order][:-1]
    differ = now != before
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common[key[order][1:] != key[order][:-1]] = -1
    return order, np.append(-1, common)


def _classes(ranked: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """The number of each row's class of rows that agree in `depth` bytes."""
    order, common = ranked
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated(key: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A mask for each record: bit o is set if its suffix o bytes before the anchor also starts in a document with a smaller id.

    left: the shift of a record's first suffix; right: bytes of its last suffix from the anchor on.
    """
    out = np.zeros(len(key), np.uint32)
    if not len(key):
        return out
    to_left, to_right = _ranked(key, context[:, :REACH]), _ranked(key, context[:, REACH:])
    for shift in range(REACH + 1):
        own = np.flatnonzero((left >= shift) & (right >= LENGTH - shift))
        if not len(own):
            continue
        # equal suffixes of this shift: equal to the left of the anchor and from it on
        same = (_classes(to_left, shift)[own] << 32) | _classes(to_right, LENGTH - shift)[own]
        order = np.argsort(same)
        head = np.flatnonzero(np.diff(same[order], prepend=-1))
        least = np.minimum.reduceat(doc[own][order], head)
        size = np.diff(np.append(head, len(own)))
        late = own[order[doc[own][order] > np.repeat(least, size)]]
        out[late] |= np.uint32(1 << shift)
    return out


def _all_masks(r: Records) -> np.ndarray:
    """The mask of all of a record's suffixes."""
    low, high = (r.anchor - r.last).astype(np.uint64), (r.anchor - r.first).astype(np.uint64)
    return (((np.uint64(2) << high) - np.uint64(1)) & ~((np.uint64(1) << low) - np.uint64(1))).astype(np.uint32)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes, the lowest bytes of all numbers first, which compresses better."""
    codec = pa.Codec("zstd", compression_level=1)
    parts = [np.ascontiguousarray(x) for x in arrays]
    raw = b"".join((x.view(np.uint8).reshape(len(x), x.itemsize).T if x.ndim == 1 else x).tobytes() for x in parts)
    return len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of _pack; a kind is a numpy type, or a number of bytes in a row."""
    size = int.from_bytes(raw[:8], "little")
    data = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], size, asbytes=True) if size else b"", np.uint8)
    widths = [int(k) if k.isdigit() else np.dtype(k).itemsize for k in kinds]
    n, out, at = len(data) // sum(widths), [], 0
    for k, w in zip(kinds, widths):
        part = data[at : at + n * w]
        out.append(part.reshape(n, w) if k.isdigit() else np.ascontiguousarray(part.reshape(w, n).T).view(k).ravel())
        at += n * w
    return out


class _Blocks:
    """Numbers blocks of documents, of all tasks, without overlap."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 32

    def take(self) -> int:
        self.next += 1
        return self.next


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _ROW_NAMES)


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows, as tuples, by runs of one value in a column."""
    held: list[tuple] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if held and row[column] != held[-1][column]:
                yield held[-1][column], held
                held = []
            held.append(row)
    if held:
        yield held[-1][column], held
    release()


def _dealt(df: DataFrame, by: str, n: int) -> DataFrame:
    """In n partitions: bucket k is alone in the partition of that number, blocks are spread."""
    spread = F.pmod(F.xxhash64(by), F.lit(n))
    place = F.when(F.col(by) >= 0, F.col(by)).otherwise(spread) if by == "dest" else spread
    return df.repartitionById(n, place.cast("int")).sortWithinPartitions(by, "kind")


def _bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Block, int]]:
    """Blocks, and long documents in pieces, with the place where a piece begins."""
    for b in blocks(batches, most):
        if len(b.doc_id) > 1 or len(b.data) <= 2 * most:
            yield b, 0
            continue
        for s in range(0, len(b.data) - LENGTH + 1, most):
            data = b.data[s : s + most + LENGTH - 1]
            yield Block(b.doc_id, data, np.array([0, len(data)]), b.rest), s


def _docs_row(block: int, b: Block) -> tuple:
    ids = b.doc_id.to_numpy(zero_copy_only=False).astype(np.int64)
    return (-block, _DOCS, block, _pack(ids, b.rest[0].to_numpy(zero_copy_only=False).astype(np.int64)), b"", b"")


def _anchors(docs: DataFrame, n_buckets: int, batch: int) -> DataFrame:
    """Rows for documents, for anchors that a block repeats itself, and for each bucket's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Blocks()
        for b, _ in _cut(batches, batch):
            block, r = number.take(), records(b.data, b.at)
            key = r.key >> np.uint64(64 - KEY_BITS)
            order = np.lexsort((r.doc, key))
            key, doc = key[order], r.doc[order].astype(np.int32)
            new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
            key, doc = key[new], doc[new]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            several = np.diff(np.append(head, len(key))) > 1
            own = np.repeat(several, np.diff(np.append(head, len(key))))
            out = [_docs_row(block, b)]
            if own.any():
                out.append((-block, _LOCAL, block, _pack(key[own], doc[own]), b"", b""))
            once, whose = key[head], np.where(several, -1, doc[head])
            step = np.searchsorted(_bucket_of(once << np.uint64(64 - KEY_BITS), n_buckets), np.arange(n_buckets + 1))
            for k in np.flatnonzero(np.diff(step)).tolist():
                part = once[step[k] : step[k + 1]]
                out.append((k, _TRAVELS, block, _pack(np.diff(part, prepend=np.uint64(0)), whose[step[k] : step[k + 1]]), b"", b""))
            yield _rows(out)

    return docs.select("_id", "text", "_text").mapInArrow(run, _ROW)


def _shared(rows: DataFrame, n: int, hot: int) -> DataFrame:
    """Which anchors of which documents lie in several documents: _id, _text, keys, with a flag on those of more than `hot` blocks."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _grouped(batches, 0):
            travels = [r for r in own if r[1] == _TRAVELS]
            if not travels:
                yield _rows(own)
                continue
            parts = [_unpack(r[3], "<u8", "<i4") for r in travels]
            key = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts])
            whose = np.concatenate([w for _, w in parts])
            source = np.repeat(np.arange(len(parts)), [len(w) for _, w in parts])
            order = np.argsort(key, kind="stable")
            head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            size = np.diff(np.append(head, len(key)))
            many = np.zeros(len(key), bool)
            many[order] = np.repeat(size > hot, size)
            hit = order[np.repeat(size > 1, size)]
            hit = np.sort(hit[(whose[hit] >= 0) | many[hit]])  # an anchor that its block repeats is known there, but for the flag
            key = np.where(many, key | _FLAG, key)
            edge = np.searchsorted(source[hit], np.arange(len(parts) + 1))
            out = [(-travels[i][2], _LOCAL, travels[i][2], _pack(key[hit[a:z]], whose[hit[a:z]]), b"", b"") for i, (a, z) in enumerate(zip(edge[:-1], edge[1:])) if z > a]
            if out:
                yield _rows(out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _grouped(batches, 2):
            ids, text_keys = _unpack(own[0][3], "<i8", "<i8")
            parts = [_unpack(r[3], "<u8", "<i4") for r in own[1:]]
            if not parts:
                continue
            key, doc = (np.concatenate(x) for x in zip(*parts))
            plain = key & ~_FLAG
            key = np.where(np.isin(plain, plain[key != plain]), plain | _FLAG, plain)[doc >= 0]
            doc = doc[doc >= 0]
            order = np.argsort(doc, kind="stable")
            key, doc = key[order], doc[order]
            edge = np.searchsorted(doc, np.arange(len(ids) + 1))
            some = np.flatnonzero(np.diff(edge))
            keys = [key[edge[i] : edge[i + 1]].astype("<u8").tobytes() for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(text_keys[some]), pa.array(keys, pa.binary())], ["_id", "_text", "_keys"])

    met = _dealt(rows, "dest", n).mapInArrow(meet, _ROW)
    return _dealt(met, "block", n).mapInArrow(gather, "_id long, _text long, _keys binary")


def _row_hash(key: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A hash of a key and a row of bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    out = key.copy()
    for word in padded.view("<u8").T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ word)
    return out


def _routes(key: np.ndarray, left: np.ndarray, right: np.ndarray, context: np.ndarray, hot: np.ndarray, n_buckets: int) -> tuple[np.ndarray, ...]:
    """Which records go to which buckets, and with which shifts: record, bucket, left and right."""
    plain = np.flatnonzero(~hot)
    short = np.flatnonzero(hot & (right >= FINE))
    far = np.flatnonzero(hot & (left > NEAR))
    around = np.concatenate([context[far, : NEAR + 1], context[far, REACH : REACH + ANCHOR]], axis=1)
    hashes = np.concatenate([key[plain], _row_hash(key[short], context[short, REACH : REACH + FINE]), _row_hash(key[far] ^ _FLAG, around)])
    return (
        np.concatenate([plain, short, far]),
        _bucket_of(hashes, n_buckets),
        np.concatenate([left[plain], np.minimum(left[short], NEAR), left[far]]),
        np.concatenate([right[plain], right[short], np.minimum(right[far], FINE - 1)]),
    )


def _firsts(key: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, context: np.ndarray) -> np.ndarray:
    """For each record the first one of its document with the same key, reach and context."""
    same = _row_hash(key ^ mix((doc.astype(np.uint64) << np.uint64(16)) + (left.astype(np.uint64) << np.uint64(8)) + right.astype(np.uint64)), context)
    _, first, which = np.unique(same, return_index=True, return_inverse=True)
    return first[which]


def _travelling(docs: DataFrame, n_buckets: int, batch: int) -> DataFrame:
    """Documents with their shared anchors: rows for documents, for marks that a block makes itself, and for contexts in buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Blocks()
        for b, begin in _cut(batches, batch):
            block, r = number.take(), records(b.data, b.at)
            listed = [b"".join(x) for x in b.rest[1].to_pylist()]
            salt = mix(np.arange(1, len(listed) + 1, dtype=np.uint64))
            known = np.frombuffer(b"".join(listed), "<u8")
            plain = (known & ~_FLAG) ^ np.repeat(salt, [len(x) // 8 for x in listed])
            own_key = (r.key >> np.uint64(64 - KEY_BITS)) ^ salt[r.doc]
            hot = np.isin(own_key, plain[known >= _FLAG])
            some = np.isin(own_key, plain)
            r, hot = Records(*(x[some] for x in r)), hot[some]
            context = contexts(b.data, r)
            ids = b.doc_id.to_numpy(zero_copy_only=False).astype(np.int64)
            left, right = r.anchor - r.first, r.last + LENGTH - r.anchor
            mask = repeated(r.key, ids[r.doc], left, right, context)
            place = r.anchor - b.at[r.doc] + begin
            first = _firsts(r.key, r.doc, left, right, context)
            yield _rows([_docs_row(block, b), (-block, _LOCAL, block, _pack(r.doc.astype("<i4"), place), _pack(mask, first.astype("<i4")), b"")])
            rest = np.flatnonzero((mask != _all_masks(r)) & (first == np.arange(len(first))))
            which, bucket, left, right = _routes(r.key[rest], left[rest], right[rest], context[rest], hot[rest], n_buckets)
            which = rest[which]
            order = np.lexsort((r.key[which], bucket))
            which, left, right = which[order], left[order].astype(np.uint8), right[order].astype(np.uint8)
            step = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            out = []
            for k in np.flatnonzero(np.diff(step)).tolist():
                part = slice(step[k], step[k + 1])
                own = which[part]
                what = _pack(np.diff(r.key[own], prepend=np.uint64(0)), ids[r.doc[own]], own.astype("<i4"))
                out.append((k, _TRAVELS, block, what, _pack(left[part], right[part]), _pack(context[own])))
            if out:
                yield _rows(out)

    return docs.select("_id", "text", "_text", "_keys").mapInArrow(run, _ROW)


def _spans(rows: DataFrame, n: int) -> DataFrame:
    """_id, _text, _spans: begin and end of each maximal removed run, as 64-bit numbers."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _grouped(batches, 0):
            travels = [r for r in own if r[1] == _TRAVELS]
            if not travels:
                yield _rows(own)
                continue
            first = [_unpack(r[3], "<u8", "<i8", "<i4") for r in travels]
            key = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in first])
            ids, record = (np.concatenate([x[i] for x in first]) for i in (1, 2))
            left, right = (np.concatenate(x).astype(np.int64) for x in zip(*(_unpack(r[4], "u1", "u1") for r in travels)))
            context = np.concatenate([_unpack(r[5], str(CONTEXT))[0] for r in travels])
            mask = repeated(key, ids, left, right, context)
            edge = np.cumsum([0, *(len(x[0]) for x in first)])
            out = []
            for r, a, z in zip(travels, edge[:-1], edge[1:]):
                hit = a + np.flatnonzero(mask[a:z])
                if len(hit):
                    out.append((-r[2], _TRAVELS, r[2], _pack(record[hit]), _pack(mask[hit]), b""))  # a split record's parts come one by one
            if out:
                yield _rows(out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _grouped(batches, 2):
            ids, text_keys = _unpack(own[0][3], "<i8", "<i8")
            doc, place = _unpack(own[1][3], "<i4", "<i8")
            mask, first = _unpack(own[1][4], "<u4", "<i4")
            mask = mask.copy()
            for r in own[2:]:
                np.bitwise_or.at(mask, _unpack(r[3], "<i4")[0], _unpack(r[4], "<u4")[0])
            mask |= mask[first]
            bit = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))
            record, shift = bit >> 5, bit & 31
            start, owner = place[record] - shift, doc[record]
            order = np.lexsort((start, owner))
            start, owner = start[order], owner[order]
            if not len(start):
                continue
            new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + LENGTH))
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(start)) - 1
            pairs = np.stack([start[begin], start[end] + LENGTH], axis=1).astype("<i8")
            edge = np.searchsorted(owner[begin], np.arange(len(ids) + 1))
            some = np.flatnonzero(np.diff(edge))
            spans = [pairs[edge[i] : edge[i + 1]].tobytes() for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(text_keys[some]), pa.array(spans, pa.binary())], ["_id", "_text", "_spans"])

    sorted_ = _dealt(rows, "dest", n).mapInArrow(sort, _ROW)
    return _dealt(sorted_, "block", n).mapInArrow(gather, "_id long, _text long, _spans binary")


def repeated_spans(docs: DataFrame, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """_id, _text, _spans of documents with removed bytes: lists of begins and ends, one for each piece; an empty one where all bytes are removed. docs: _id, _text, text."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]  # one row
    n_buckets = min(1 << 20, max(16, -(-n_bytes // BUCKET_BYTES)))
    hashed = docs.filter(F.octet_length("text") >= LENGTH).select("_id", "_text", F.unhex(F.sha2("text", 256)).alias("_sha"))
    hashed = stored(hashed, "hashes")
    least = hashed.groupBy("_sha").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most").select("_sha", "_least")
    copies = stored(hashed.join(least, "_sha").filter("_id > _least").select("_id", "_text").distinct(), "copies")
    few = copies.count() <= BROADCAST_ROWS
    others = docs.join(F.broadcast(copies) if few else copies, ["_id", "_text"], "left_anti")
    # lists of one document's pieces
    shared = _shared(_anchors(others, n_buckets, batch), n_buckets, hot).groupBy("_id", "_text").agg(F.collect_list("_keys").alias("_keys"))
    spans = _spans(_travelling(others.join(shared, ["_id", "_text"]), n_buckets, batch), n_buckets)
    spans = spans.groupBy("_id", "_text").agg(F.collect_list("_spans").alias("_spans"))
    return stored(spans.union(copies.select("_id", "_text", F.array(F.lit(b"")).alias("_spans"))), "spans")


def _merged(lists: list[bytes] | None, size: int) -> list[tuple[int, int]]:
    """The maximal removed runs of a document."""
    out: list[list[int]] = []
    for s, e in sorted((0, size) if not x else tuple(p) for x in lists or [] for p in (np.frombuffer(x, "<i8").reshape(-1, 2).tolist() or [()])):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


@tidy
def remove_repeats(docs: DataFrame, keep_text: bool = False, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) if asked for."""
    plain = texts(docs).withColumn("_id", id_key()).withColumn("_text", text_key())
    spans = repeated_spans(plain, hot, batch)
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            raw = b.data.tobytes()
            out = []
            for s, e, own in zip(b.at[:-1].tolist(), b.at[1:].tolist(), b.rest[0].to_pylist()):
                pairs = _merged(own, e - s)
                kept, at = [], s
                for i, j in pairs:
                    kept.append(raw[at : s + i])
                    at = s + j
                text = b"".join([*kept, raw[at:e]])
                out.append((e - s, e - s - len(text), len(pairs), hashlib.sha256(text).hexdigest(), text))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.doc_id, *(pa.array(c, k) for c, k in zip(columns[: 4 + keep_text], kinds))], [c.split()[0] for c in schema.split(", ")])

    return plain.join(spans, ["_id", "_text"], "left").select("doc_id", "text", "_spans").mapInArrow(run, schema)


@tidy
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
