"""Exact, vectorised encoding of whole texts with a public byte-pair vocabulary.

`BlockEncoder` encodes a block of documents at once: lower-cased bytes are cut
into pieces by character class, equal pieces are found by hash, and the merges
run over all distinct pieces of the block together in numpy. Texts that need
more than that (non-letters beyond ASCII, other normal forms, special-token
strings) go through the `tokenizers` library whole, so results always equal
the library's.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from .blocks import hash_runs, ragged

#: Texts with these characters are left to the library: their lower case depends on context.
_ODD = frozenset("İΣ")
_LETTER, _DIGIT, _OTHER = 1, 2, 3
#: The cache of pieces has 2**CACHE_BITS slots; it is emptied when its ids are more than POOL_IDS.
CACHE_BITS, POOL_IDS = 20, 6 << 20


def default_tokenizer() -> str:
    """Path of the tokenizer file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for i, b in enumerate(hidden):
        out[b] = chr(0x100 + i)
    return out


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[ord("0") : ord("9") + 1] = _DIGIT
    for first, last in ("az", "AZ"):
        out[ord(first) : ord(last) + 1] = _LETTER
    out[128:] = _LETTER
    return out


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _PairRanks:
    """Open-addressed table from a pair of ids to the merge's rank and result."""

    NONE = np.int64(1 << 30)

    def __init__(self, pairs: np.ndarray, result: np.ndarray):
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << self.bits, self.NONE, np.int64)
        self.result = result.astype(np.int32)
        left = np.arange(len(pairs))
        slot = self._slot(pairs)
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            first = np.unique(slot[left][free], return_index=True)[1]
            take = left[free][first]
            self.keys[slot[take]], self.rank[slot[take]] = pairs[take], take
            left = np.setdiff1d(left, take, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slot(key)
        at = self.keys[slot]
        out = np.where(at == key, self.rank[slot], self.NONE)
        left = np.flatnonzero((at != key) & (at != np.uint64(2**64 - 1)))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[left]]
            hit = at == key[left]
            out[left[hit]] = self.rank[slot[left[hit]]]
            left = left[~hit & (at != np.uint64(2**64 - 1))]
        return out


class BlockEncoder:
    """Encodes blocks of texts; one per worker process and file."""

    _open: dict[str, BlockEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._end = spec["model"]["end_of_word_suffix"] or ""
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.vectorised = kinds == ["NFC", "Replace", "Lowercase"] and self._end == "</w>"
        if not self.vectorised:
            return
        chars = _byte_chars()
        self._inner = np.array([vocab[c] for c in chars], np.int32)
        self._last = np.array([vocab[c + self._end] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        codes = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.uint64)
        self._cached = np.zeros(1 << CACHE_BITS, np.uint64)
        self._offset = np.zeros(1 << CACHE_BITS, np.int32)
        self._count = np.zeros(1 << CACHE_BITS, np.int32)
        self._pool, self._used = np.empty(POOL_IDS // 4, np.uint32), 0
        self._ranks = _PairRanks(codes, np.array([vocab[a + b] for a, b in pairs]))

    @classmethod
    def open(cls, path: str) -> BlockEncoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _plain(self, text: str) -> bytes | None:
        """The text's lower-cased bytes if its pieces can be cut by byte, else None."""
        if "<|" in text and any(s in text for s in self._special):
            return None
        if text.isascii():
            return text.encode()
        if any(not (c.isalpha() or c.isascii()) or c in _ODD for c in set(text)) or not unicodedata.is_normalized("NFC", text):
            return None
        return text.lower().encode()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and each text's number of ids."""
        plain = [self._plain(t) if self.vectorised else None for t in texts]
        rest = [i for i, p in enumerate(plain) if p is None]
        ids, counts = self._encode_plain([p or b"" for p in plain])
        if rest:
            own = [np.asarray(self._library.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in rest]
            at = np.concatenate([[0], np.cumsum(counts)])
            parts, done = [], 0
            for i, x in zip(rest, own):
                parts += [ids[done : at[i]], x]
                done = at[i]
                counts[i] = len(x)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, counts

    def _encode_plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A space is put after every text, so that no piece crosses texts."""
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = _LOWER[raw]
        kind = _CLASS[raw]
        start = np.empty(len(raw), bool)
        start[0] = True
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        self._contractions(raw, kind, start)
        at = np.flatnonzero(start)
        size = np.diff(at, append=len(raw))
        real = kind[at] != 0
        at, size = at[real], size[real]
        ends = np.cumsum([len(t) + 1 for t in texts])
        per_text = np.diff(np.searchsorted(at, ends), prepend=0)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        offset, count = self._lookup(raw, at, size)
        total = np.concatenate([[0], np.cumsum(count)])
        bound = np.concatenate([[0], np.cumsum(per_text)])
        return self._pool[ragged(offset, count)], np.diff(total[bound])

    def _lookup(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids lie in the pool, and how many they are; pieces that the cache lacks are merged now."""
        if self._used > POOL_IDS:
            self._cached[:] = 0
            self._used = 0
        key = hash_runs(raw, at, size)
        key |= np.uint64(1)  # 0 marks a free slot
        slot = (key >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        offset, count = self._offset[slot].astype(np.int64), self._count[slot].astype(np.int64)
        miss = np.flatnonzero(self._cached[slot] != key)
        if len(miss):
            _, first, which = np.unique(key[miss], return_index=True, return_inverse=True)
            first = miss[first]
            ids, n = self._merge(raw, at[first], size[first])
            if self._used + len(ids) > len(self._pool):
                self._pool = np.concatenate([self._pool[: self._used], np.empty(len(ids) + POOL_IDS // 4, np.uint32)])
            self._pool[self._used : self._used + len(ids)] = ids
            where = self._used + np.cumsum(n) - n
            self._used += len(ids)
            self._cached[slot[first]], self._offset[slot[first]], self._count[slot[first]] = key[first], where, n
            offset[miss], count[miss] = where[which], n[which]
        return offset, count

    @staticmethod
    def _contractions(raw: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are pieces where an apostrophe starts a run of other signs."""
        at = np.flatnonzero(raw == 39)
        at = at[start[at]]
        at = at[at + 2 < len(raw)]
        if not len(at):
            return
        a, b = raw[at + 1], raw[at + 2]
        one = (a == ord("s")) | (a == ord("t"))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        one |= (a == ord("m")) | (a == ord("d"))
        for hit, n in ((at[one], 1), (at[two & ~one], 2)):
            start[hit + 1] = False
            after = hit + 1 + n
            after = after[after < len(raw)]
            start[after] = True

    def _merge(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces raw[at:at+size], by repeated merging of each piece's lowest-ranked pair, the leftmost first."""
        sym = self._inner[raw[ragged(at, size)]]
        stop = np.cumsum(size)
        sym[stop - 1] = self._last[raw[at + size - 1]]
        word = np.repeat(np.arange(len(at)), size)
        rank = np.full(len(sym), _PairRanks.NONE, np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._ranks.get(sym[inner], sym[inner + 1])
        done_word, done_sym = [], []
        while len(sym):
            head = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), head)
            live = (best >> 32) < _PairRanks.NONE
            length = np.diff(np.append(head, len(sym)))
            keep = np.repeat(live, length)
            if not live.all():
                done_word.append(word[~keep])
                done_sym.append(sym[~keep])
            if not live.any():
                break
            i = best[live] & 0xFFFFFFFF
            sym[i] = self._ranks.result[rank[i]]
            keep[i + 1] = False
            # the pair at i is now with what followed i + 1
            last = (i + 2 >= len(sym)) | (word[np.minimum(i + 2, len(sym) - 1)] != word[i])
            rank[i] = _PairRanks.NONE
            j = i[~last]
            rank[j] = self._ranks.get(sym[j], sym[j + 2])
            p = i[(i > 0) & (word[np.maximum(i - 1, 0)] == word[i])] - 1
            rank[p] = self._ranks.get(sym[p], sym[p + 1])
            sym, word, rank = sym[keep], word[keep], rank[keep]
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(at))
