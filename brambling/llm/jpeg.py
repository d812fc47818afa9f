"""Baseline JPEG in numpy: a writer of DC-only grey images, and a reader of DC coefficients.

The reader parses the markers of any baseline image (8 bits, Huffman-coded, one
interleaved scan), splits scans at restart markers and decodes all restart
intervals of equal layout together, one block after the other, so that the work
is vectorised over intervals. AC coefficients are decoded and passed over.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from typing import NamedTuple

import numpy as np

SIDE = 64  # blocks, and samples of the thumbnail, in a row
MAX_ROWS = 65535 // 8
#: Code lengths of the writer's DC categories 0 to 8: differences of text bytes are mostly of 4 to 7 bits.
_DC_LENGTHS = {5: 2, 6: 2, 4: 3, 7: 3, 0: 4, 3: 4, 1: 5, 2: 5, 8: 6}


def _canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a table with so many codes of each length from 1 to 16."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _writer_tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """The DHT segment, and for each difference from -255 to 255 the bits of its block and how many they are."""
    symbols = sorted(_DC_LENGTHS, key=lambda s: (_DC_LENGTHS[s], s))
    counts = [sum(n == k for n in _DC_LENGTHS.values()) for k in range(1, 17)]
    dht = b"\x00" + bytes(counts) + bytes(symbols) + b"\x10" + bytes([1] + [0] * 15) + b"\x00"
    codes = _canonical(counts, symbols)
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = codes[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        bits[d + 255] = ((code << category) | extra) << 1  # and the end of the block, a single 0
        sizes[d + 255] = length + category + 1
    return b"\xff\xc4" + struct.pack(">H", len(dht) + 2) + dht, bits, sizes


_DHT, _BITS, _SIZES = _writer_tables()


def _header(rows: int) -> bytes:
    quantisers = bytes([8] + [1] * 63)  # a DC coefficient is then 8 samples' worth, so its block's grey is one byte exactly
    return b"".join(
        [
            b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + quantisers,
            b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, rows * 8, SIDE * 8, 1) + bytes([1, 0x11, 0]),
            _DHT,
            b"\xff\xdd" + struct.pack(">HH", 4, SIDE),
            b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 63, 0]),
        ]
    )


def write(samples: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """For each image, whose samples are so many rows of 64 bytes one after the other, its file.

    A row is a restart interval of 64 blocks, whose grey is the sample. An image
    of more rows than a file can have is several files one after the other.
    """
    grid = samples.reshape(-1, SIDE).astype(np.int16)
    n = len(grid)
    frames: list[tuple[int, int]] = []  # first row, rows
    of_image: list[int] = []
    at = 0
    for r in rows.tolist():
        own = [(at + k, min(MAX_ROWS, r - k)) for k in range(0, r, MAX_ROWS)]
        frames += own
        of_image.append(len(own))
        at += r
    step = np.diff(grid, axis=1, prepend=np.int16(128)) + 255
    size = _SIZES[step]
    bits = _BITS[step]
    end = np.cumsum(size, axis=1)
    length = (end[:, -1] + 7) >> 3
    buffer = np.zeros((n, int(length.max()) + 3), np.uint8)
    every = np.arange(n)
    for c in range(SIDE):
        place = end[:, c] - size[:, c]
        word = bits[:, c] << (24 - size[:, c] - (place & 7)).astype(np.uint32)
        first = place >> 3
        buffer[every, first] |= (word >> 16).astype(np.uint8)
        buffer[every, first + 1] |= (word >> 8 & 255).astype(np.uint8)
        buffer[every, first + 2] |= (word & 255).astype(np.uint8)
    spare = -end[:, -1] & 7
    buffer[every, length - 1] |= ((1 << spare) - 1).astype(np.uint8)
    used = np.arange(buffer.shape[1]) < length[:, None]
    flat = buffer[used]
    row = np.repeat(every, length)
    full = flat == 255
    out = np.zeros(len(flat) + int(full.sum()) + 2 * n, np.uint8)  # a 0 follows every 255, a marker every row
    out[np.arange(len(flat)) + np.cumsum(full) - full + 2 * row] = flat
    stop = np.cumsum(length + np.bincount(row[full], minlength=n) + 2)
    first_row = np.array([f for f, _ in frames])
    last_row = np.array([f + r - 1 for f, r in frames])
    marker = 0xD0 + (every - np.repeat(first_row, last_row - first_row + 1)) % 8
    marker[last_row] = 0xD9
    out[stop - 2], out[stop - 1] = 255, marker
    raw = out.tobytes()
    begin = np.append(0, stop)
    files = [_header(r) + raw[begin[f] : begin[f + r]] for f, r in frames]
    done, images = 0, []
    for k in of_image:
        images.append(b"".join(files[done : done + k]))
        done += k
    return images


class Frame(NamedTuple):
    """What the markers of one file say. tables: for each block of a unit its component and its DC and AC tables."""

    width: int
    height: int
    quantiser: int
    units: int
    interval: int
    blocks: tuple[tuple[int, bytes, bytes], ...]
    luminance: tuple[int, int]
    per_line: int
    scan: bytes


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


def parse(data: bytes) -> list[Frame]:
    """The files that lie one after the other in data."""
    out: list[Frame] = []
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at += 2
        quantisers: dict[int, int] = {}
        huffman: dict[int, bytes] = {}
        components: list[tuple[int, int, int, int]] = []
        height = width = restart = 0
        while data[at : at + 2] != b"\xff\xd9":
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quantisers[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huffman[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif kind == 0xC0:
                bits, height, width, n = struct.unpack(">BHHB", body[:6])
                if bits != 8:
                    raise ValueError("samples of other than 8 bits")
                components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline file")
            elif kind == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif kind == 0xDA:
                stop = m.start() if (m := _SCAN_END.search(data, at)) else len(data)
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                if len(chosen) != len(components):
                    raise ValueError("more than one scan")
                if len(components) == 1:
                    components = [(components[0][0], 1, 1, components[0][3])]
                h, v = max(c[1] for c in components), max(c[2] for c in components)
                wide, high = -(-width // (8 * h)), -(-height // (8 * v))
                blocks_ = tuple((i, huffman[chosen[c[0]] >> 4], huffman[0x10 | chosen[c[0]] & 15]) for i, c in enumerate(components) for _ in range(c[1] * c[2]))
                out.append(Frame(width, height, quantisers[components[0][3]], wide * high, restart or wide * high, blocks_, components[0][1:3], wide, data[at:stop]))
                at = stop
        at += 2
    return out


_LOOKUP: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits, length << 8 | symbol of the code that they begin with."""
    if table not in _LOOKUP:
        out = np.zeros(1 << 16, np.int64)
        for s, (code, length) in _canonical(list(table[:16]), list(table[16:])).items():
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | s
        _LOOKUP[table] = out
    return _LOOKUP[table]


def _extend(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n highest bits of a 64-bit word as a signed difference."""
    value = ((word >> np.uint64(1)) >> (np.uint64(63) - n.astype(np.uint64))).astype(np.int64)
    return np.where((n > 0) & (value < (1 << np.maximum(n - 1, 0))), value - (1 << n) + 1, value)


def read_dc(frames: list[Frame]) -> list[np.ndarray]:
    """The luminance thumbnail of each frame, a sample for each of its blocks, as bytes."""
    groups: defaultdict[tuple, list[int]] = defaultdict(list)
    for i, f in enumerate(frames):
        groups[f.blocks, f.interval].append(i)
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(frames)
    for (layout, interval), members in groups.items():
        own = [frames[i] for i in members]
        raw = np.frombuffer(b"\xff\xd0".join([*(f.scan for f in own), b""]), np.uint8)
        follows = np.append(raw[1:], 0)
        mark = (raw == 255) & (follows >= 0xD0) & (follows <= 0xD7)
        drop = mark.copy()
        drop[1:] |= mark[:-1] | ((raw[1:] == 0) & (raw[:-1] == 255))
        first = np.append(0, (np.cumsum(~drop))[mark])[:-1]  # where intervals begin among the bytes that stay
        units = np.concatenate([np.minimum(interval, f.units - np.arange(0, f.units, interval)) for f in own])
        if len(first) != len(units):
            raise ValueError("restart markers and units differ")
        dc = _decode(raw[~drop], first, units, layout)
        bound = np.cumsum([0, *(f.units for f in own)])
        for i, f, a, b in zip(members, own, bound[:-1], bound[1:]):
            h, v = f.luminance
            grey = np.clip((dc[a:b] * f.quantiser + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            grid = grey.reshape(-1, f.per_line, v, h).transpose(0, 2, 1, 3).reshape(-1, f.per_line * h)
            out[i] = grid[: -(-f.height // 8), : -(-f.width // 8)]
    return out


def _decode(data: np.ndarray, first: np.ndarray, units: np.ndarray, layout: tuple[tuple[int, bytes, bytes], ...]) -> np.ndarray:
    """DC coefficients of the first component, a row for each unit, intervals one after the other."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    load = np.ndarray((len(data) + 8,), ">u8", padded, strides=(1,))
    most = int(units.max())
    per = sum(c == 0 for c, _, _ in layout)
    found = np.zeros((len(first), most, per), np.int32)
    bit = first * 8
    before = np.zeros((1 + max(c for c, _, _ in layout), len(first)), np.int64)
    everyone = np.arange(len(first))
    even = int(units.min())
    for u in range(most):
        live = everyone if u < even else np.flatnonzero(units > u)
        place = bit[live]
        k = 0
        for component, dc_table, ac_table in layout:
            word = load[np.minimum(place >> 3, len(load) - 1)].astype(np.uint64) << (place & 7).astype(np.uint64)
            hit = _lookup(dc_table)[(word >> np.uint64(48)).astype(np.int64)]
            length, size = hit >> 8, hit & 255
            word <<= length.astype(np.uint64)
            before[component, live] += _extend(word, size)
            word <<= size.astype(np.uint64)
            place = place + length + size
            if component == 0:
                found[live, u, k] = before[0, live]
                k += 1
            ac = _lookup(ac_table)
            hit = ac[(word >> np.uint64(48)).astype(np.int64)]
            place += hit >> 8
            symbol, seen = hit & 255, np.zeros(len(place), np.int64)
            going = np.flatnonzero(symbol)
            while len(going):  # passes over coefficients until the end of the block
                s = symbol[going]
                seen[going] += (s >> 4) + 1
                place[going] += s & 15
                going = going[seen[going] < 63]
                at = place[going]
                word = load[np.minimum(at >> 3, len(load) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)
                hit = ac[(word >> np.uint64(48)).astype(np.int64)]
                place[going] += hit >> 8
                symbol[going] = hit & 255
                going = going[symbol[going] != 0]
        bit[live] = place
    return found[np.arange(most) < units[:, None]]
