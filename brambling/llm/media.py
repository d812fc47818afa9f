"""Operator 4, media columns: texts as baseline JPEG files, read back as DC-only thumbnails.

A text's UTF-8 bytes, padded with zeros to rows of 64, become the greys of 8 x 8
blocks: a block's DC coefficient is one byte, which is the format's unit, so the
file keeps the bytes without loss. The file is then parsed, its scan
Huffman-decoded, and the luminance thumbnail rebuilt from DC coefficients alone;
all that is reported beside n_bytes and the file's own size and hash comes from
the thumbnail.

Null and empty texts are one row of zeros; repeated rows are reported each; an
empty table gives no rows. A text of more than 8,191 rows is several files one
after the other; a text of more than 4 MB is worked on a few files at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import jpeg
from .blocks import Block, blocks
from .common import documents, texts

_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, width int, height long, thumbnail_hash string"
)
#: Bytes of text whose files are made together.
BATCH = 2 << 20
#: Rows of a longer text that are stored and read together: four files.
ROWS = 4 * jpeg.MAX_ROWS


def store(b: Block) -> list[bytes]:
    """The file of each text of a block."""
    size = np.diff(b.at)
    rows = np.maximum(1, -(-size // jpeg.SIDE))
    payload = np.zeros(int(rows.sum()) * jpeg.SIDE, np.uint8)
    first = (np.cumsum(rows) - rows) * jpeg.SIDE
    payload[np.arange(len(b.data)) + np.repeat(first - b.at[:-1], size)] = b.data
    return jpeg.write(payload, rows)


def thumbnails(files: list[bytes]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail of each file, of several that lie one after the other the rows of all."""
    parsed = [jpeg.parse(f) for f in files]
    read = iter(jpeg.read_dc([f for own in parsed for f in own]))
    out = []
    for own in parsed:
        parts = [next(read) for _ in own]
        out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
    return out


def thumbnail_hash(grey: np.ndarray) -> str:
    """Difference hash: 9 bands of rows by 8 of columns, a bit for each step down that gets brighter."""
    edge = np.arange(9) * len(grey) // 9
    columns = np.add.reduceat(grey, np.arange(8) * grey.shape[1] // 8, axis=1, dtype=np.int64)
    bands = np.add.reduceat(columns, edge, axis=0) / np.maximum(1, np.diff(edge, append=len(grey)))[:, None]
    return np.packbits(bands[1:] > bands[:-1]).tobytes().hex()


class Stored(NamedTuple):
    """What is known of a text's stored form, and its thumbnail."""

    grey: np.ndarray
    payload_sha256: str
    media_bytes: int
    media_sha256: str


def _stored(files: list[bytes]) -> list[Stored]:
    return [Stored(g, hashlib.sha256(g).hexdigest(), len(f), hashlib.sha256(f).hexdigest()) for f, g in zip(files, thumbnails(files))]


def _stored_long(data: np.ndarray) -> Stored:
    """The same of one long text, whose files are made and read a few at a time."""
    payload, media, size = hashlib.sha256(), hashlib.sha256(), 0
    grey = np.zeros((-(-len(data) // jpeg.SIDE), jpeg.SIDE), np.uint8)
    for first in range(0, len(grey), ROWS):
        part = data[first * jpeg.SIDE : (first + ROWS) * jpeg.SIDE]
        file = store(Block(pa.nulls(1), part, np.array([0, len(part)]), []))[0]
        read = thumbnails([file])[0]
        grey[first : first + len(read)] = read
        payload.update(read)
        media.update(file)
        size += len(file)
    return Stored(grey, payload.hexdigest(), size, media.hexdigest())


def media_columns(docs: DataFrame) -> DataFrame:
    """A row for each document; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, BATCH):
            found = [_stored_long(b.data)] if len(b.data) > 2 * BATCH else _stored(store(b))
            greys = [f.grey for f in found]
            hashes = [thumbnail_hash(g) for g in greys]
            sizes = [(g.shape[1] * 8, g.shape[0] * 8) for g in greys]
            columns = [
                b.doc_id,
                pa.array(np.diff(b.at), pa.int64()),
                pa.array([g.size for g in greys], pa.int64()),
                pa.array([f.payload_sha256 for f in found]),
                pa.array([zlib.crc32(g[-1]) for g in greys], pa.int64()),
                pa.array([f.media_bytes for f in found], pa.int64()),
                pa.array([f.media_sha256 for f in found]),
                pa.array([f"{w}x{h}:{x}" for (w, h), x in zip(sizes, hashes)]),
                pa.array([w for w, _ in sizes], pa.int32()),
                pa.array([h for _, h in sizes], pa.int64()),
                pa.array(hashes),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCHEMA.split(", ")])

    return texts(docs).mapInArrow(run, _SCHEMA)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
