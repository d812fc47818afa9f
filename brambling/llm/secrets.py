"""Operator 10, secret scans with a trigram inverted index.

A Boolean trigram query is derived from each rule's regular expression: strings
the expression must contain become conjunctions of their trigrams, alternatives
become disjunctions. Each block of documents gets an inverted index of the
trigrams that any query names, postings are intersected and united, and only
candidate documents are verified with the expression. A rule without mandatory
trigrams, such as a run of hexadecimal digits, scans everything.

Texts are whole; null and empty texts have no spans; repeated rows are reported
each; an empty table gives no rows. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks
from .common import documents, texts


class Rule(NamedTuple):
    """An ASCII expression over UTF-8 bytes, and what a match must satisfy; failing matches are dropped without a retry."""

    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = lambda m: True


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The base kinds, in their order.
BASE = (
    Rule("assign", rf"""({_either_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    Rule("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    Rule("hex", "[0-9a-f]{16,}"),  # the runs [0-9a-f]+ of 16 characters or more
)
#: Kinds that the method adds: prefixes that issuers publish for their credentials.
EXTRA = (
    Rule("private_key", "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("hub_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer\x20[A-Za-z0-9._~+/=-]{20,}"),
)

#: Strings that a part of an expression may stand for, before it only adds to the query.
MOST_STRINGS = 64
#: A trigram query: True (no constraint), a trigram of folded bytes, or ("and" | "or", queries).
Query = bool | bytes | tuple


def _join(op: str, parts: list[Query]) -> Query:
    if op == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))
    if any(p is True for p in parts):
        return True
    return parts[0] if len(parts) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _of_strings(strings: set[bytes]) -> Query:
    """What a text must have that holds one of the strings."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items: list) -> set[bytes] | None:
    out: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(arg)
        elif op is sre.RANGE:
            out |= set(range(arg[0], arg[1] + 1))
        else:
            return None
    return {bytes([c]).lower() for c in out} if len(out) <= 2 * MOST_STRINGS and max(out) < 128 else None


def _walk(nodes) -> tuple[set[bytes] | None, Query]:
    """The strings that a sequence stands for, if few, and else the query that every match satisfies."""
    now: set[bytes] = {b""}
    exact, found = True, []

    def flush(then: set[bytes]) -> None:
        nonlocal now, exact
        found.append(_of_strings(now))
        now, exact = then, False

    for op, arg in nodes:
        own: set[bytes] | None = None
        query: Query = True
        if op is sre.LITERAL:
            own = {bytes([arg]).lower()} if arg < 128 else None
        elif op is sre.IN:
            own = _class(arg)
        elif op is sre.SUBPATTERN:
            own, query = _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                own = set().union(*(e for e, _ in parts))
            query = _join("or", [_of_strings(e) if e is not None else q for e, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, inner_query = _walk(body)
            if (low, high) == (0, 1) and inner is not None:
                own = inner | {b""}
            elif low:
                query = inner_query if inner is None else _of_strings(inner)
                if inner is not None and len(inner) * len(now) <= MOST_STRINGS:  # its first turn follows what came before
                    now = {a + b for a in now for b in inner}
        elif op is sre.AT:
            continue
        if own is not None and len(own) * len(now) <= MOST_STRINGS:
            now = {a + b for a in now for b in own}
        elif own is not None and len(own) <= MOST_STRINGS:
            flush(own)
        else:
            found.append(query)
            flush({b""})
    return (now, True) if exact else (None, _join("and", [*found, _of_strings(now)]))


def trigram_query(pattern: str) -> Query:
    """The Boolean query over trigrams of lower-cased bytes that every text with a match satisfies; True if there is none."""
    exact, query = _walk(sre_parser.parse(pattern))
    return query if exact is None else _of_strings(exact)


def _trigrams(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set() if query is True else set().union(*map(_trigrams, query[1]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r.kind, re.compile(r.pattern.encode()), r.accept, trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted(set().union(*(_trigrams(q) for *_, q in self.rules)))
        wide = np.uint8 if len(self.trigrams) < 255 else np.uint16
        self.number = np.zeros(1 << 24, wide)  # of a trigram's code, from 1 on
        for i, t in enumerate(self.trigrams):
            self.number[(t[0] << 16) | (t[1] << 8) | t[2]] = i + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, b: Block) -> np.ndarray:
        """For each trigram, in which documents of the block it is."""
        out = np.zeros((len(self.trigrams), len(b.doc_id)), bool)
        if len(b.data) < 3:
            return out
        low = self.fold[b.data].astype(np.int32)
        found = self.number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        hit = np.flatnonzero(found)
        doc = np.searchsorted(b.at, hit, side="right") - 1
        inside = hit + 3 <= b.at[doc + 1]
        out[found[hit[inside]].astype(np.int64) - 1, doc[inside]] = True
        return out

    def _match(self, query: Query, postings: np.ndarray) -> np.ndarray:
        if isinstance(query, bytes):
            return postings[self.trigrams.index(query)]
        parts = [self._match(q, postings) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, b: Block) -> dict[int, list[tuple[int, int, int]]]:
        """Documents of the block with spans: (start byte, number of the kind, end byte), sorted."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        postings = self.postings(b)
        raw = b.data.tobytes()
        for k, (_, expression, accept, query) in enumerate(self.rules):
            if query is True:
                for i, s, e in self._everywhere(expression, accept, b, raw):
                    out.setdefault(i, []).append((s, k, e))
                continue
            for i in np.flatnonzero(self._match(query, postings)).tolist():
                for m in expression.finditer(raw[b.at[i] : b.at[i + 1]]):
                    if accept(m):
                        out.setdefault(i, []).append((m.start(), k, m.end()))
        return {i: sorted(spans) for i, spans in out.items()}

    @staticmethod
    def _everywhere(expression: re.Pattern, accept: Callable, b: Block, raw: bytes) -> Iterator[tuple[int, int, int]]:
        for i, (s, e) in enumerate(zip(b.at[:-1].tolist(), b.at[1:].tolist())):
            for m in expression.finditer(raw, s, e):
                if accept(m):
                    yield i, m.start() - s, m.end() - s


def _code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if raw.isascii():
        return spans
    first = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(first[s]), k, int(first[e])) for s, k, e in spans]


def scan_secrets(docs: DataFrame, extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> for every document, base kinds first where starts are equal."""
    rules = (*BASE, *extra)
    kinds = [r.kind for r in rules]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in blocks(batches):
            found = scanner.scan(b)
            spans = [[] for _ in b.doc_id]
            for i, own in found.items():
                points = _code_points(b.data[b.at[i] : b.at[i + 1]].tobytes(), own)
                spans[i] = [{"kind": kinds[k], "start": s, "end": e} for s, k, e in points]
            yield pa.RecordBatch.from_arrays([b.doc_id, pa.array(spans, span)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(scanned: DataFrame, base: list[str]) -> DataFrame:
    """Counts of the base kinds, the hash of their spans and all spans as a string."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(*kinds: str):
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    own = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    of_base = of(*base)
    return scanned.select("doc_id", *own, F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(documents(spark, sf_dir)), [r.kind for r in BASE])
