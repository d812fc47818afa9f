"""Operator 3, best-fit packing with Martello-Toth dominance reduction.

Documents become pieces of at most `capacity` tokens. How many pieces there are
of each length is all that packing needs, and that histogram has at most
`capacity` rows however large the corpus is; so the plan is made on the driver
from bounded data and is a list of patterns with multiplicities. Pieces find
their place by their rank among the pieces of their length.

1. Dominance reduction: a set of lengths that contains the longest piece and
   provably dominates every other set with it is fixed for as many sequences as
   its counts allow (Martello and Toth's criteria for one and two companions).
2. What remains is packed best-fit, longest first, a whole group of equally
   filled sequences at a time.

Null and empty texts are one piece of one token, the separator. Repeated rows
are packed each by itself. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import blocks
from .common import documents, shards_for, stored, texts, tidy
from .tokens import BlockEncoder, default_tokenizer

CAPACITY, SEPARATOR = 4096, 1
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Pattern(NamedTuple):
    """`times` sequences that each hold, from offset 0 on, `per` pieces of each `length`."""

    parts: tuple[tuple[int, int], ...]
    times: int


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The documents' ids and a separator, cut into pieces of `capacity` ids where they are more."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BlockEncoder.open(path)
        tail = np.array([SEPARATOR], "<u4").tobytes()
        for b in blocks(batches):
            raw = b.data.tobytes()
            ids, n = encoder.encode([raw[i:j].decode("utf-8", "replace") for i, j in zip(b.at[:-1], b.at[1:])])
            stream = memoryview(ids.astype("<u4", copy=False).tobytes())
            total = n + 1
            count = -(-total // capacity)
            owner = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(total[owner] - start, capacity)
            base = (np.cumsum(n) - n)[owner] + start
            last = piece == count[owner] - 1
            crc = [
                zlib.crc32(tail, zlib.crc32(stream[4 * i : 4 * (i + k - 1)])) if e else zlib.crc32(stream[4 * i : 4 * (i + k)])
                for i, k, e in zip(base.tolist(), length.tolist(), last.tolist())
            ]
            ids_of = b.doc_id.take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [ids_of, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return texts(docs).mapInArrow(run, _PIECES)


class _Lengths:
    """How many pieces of each length are left, with the largest one up to a bound."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.n[length] = n

    def largest(self, bound: int, without: tuple[int, ...] = ()) -> int:
        """The largest length up to bound of which a piece is left besides those in `without`; 0 if none."""
        for length in np.flatnonzero(self.n[: max(bound, 0) + 1])[::-1].tolist():
            if self.n[length] > without.count(length):
                return length
        return 0

    def smallest(self, k: int, without: tuple[int, ...] = ()) -> list[int]:
        """The k smallest pieces left besides those in `without`."""
        out: list[int] = []
        for length in np.flatnonzero(self.n).tolist():
            out += [length] * min(k, int(self.n[length]) - without.count(length))
            if len(out) >= k:
                break
        return out[:k]

    def take(self, chosen: list[int]) -> int:
        """Takes the set as often as the counts allow."""
        need = {x: chosen.count(x) for x in chosen}
        times = min(int(self.n[x]) // c for x, c in need.items())
        for x, c in need.items():
            self.n[x] -= times * c
        return times


def _dominating(left: _Lengths, j: int, capacity: int) -> list[int] | None:
    """A set with a piece of length j that dominates every other feasible set with it, or None if none is proved.

    A set F dominates G if G's pieces can be parted into groups that fit one by
    one into the places of F's pieces. With room for no companion {j} is the
    only set. A companion that fills the sequence, or is the largest one where
    no two fit, dominates. Where no three fit, the largest companion dominates
    if no fitting pair is longer than it; and the largest companion k with the
    largest piece b that fits beside it dominates if the shorter piece of every
    fitting pair is at most b, as the longer one is at most k.
    """
    room = capacity - j
    k = left.largest(room, (j,))
    if not k:
        return [j]
    few = left.smallest(3, (j,))
    if k == room or len(few) < 2 or few[0] + few[1] > room:
        return [j, k]
    if len(few) == 3 and sum(few) <= room:
        return None
    lengths = np.flatnonzero(left.n[: room + 1])
    shorter = [0]
    longest_pair = 0
    for a in lengths[::-1].tolist():
        if left.n[a] <= (a == j):
            continue
        b = left.largest(min(a, room - a), (j, a))
        if b:
            longest_pair = max(longest_pair, a + b)
            shorter.append(b)
    if longest_pair <= k:
        return [j, k]
    b = left.largest(room - k, (j, k))
    return [j, k, b] if b and max(shorter) <= b else None


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that dominance fixes, and the counts that remain."""
    left, out = _Lengths(counts, capacity), []
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(left.n)[::-1].tolist():
            while left.n[j] and (chosen := _dominating(left, j, capacity)):
                times = left.take(chosen)
                if not times:
                    break
                out.append(Pattern(tuple((x, chosen.count(x)) for x in dict.fromkeys(chosen)), times))
                changed = True
    return out, {int(x): int(left.n[x]) for x in np.flatnonzero(left.n)}


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on groups of equally filled sequences."""
    open_: defaultdict[int, list[Pattern]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            groups, open_[room] = open_[room], []
            for i, g in enumerate(groups):
                if not n:
                    open_[room] += groups[i:]
                    break
                per = room // length
                full = min(g.times, n // per)
                if full:
                    open_[room - per * length].append(Pattern((*g.parts, (length, per)), full))
                    n -= full * per
                times = g.times - full
                if times and 0 < n < per:
                    open_[room - n * length].append(Pattern((*g.parts, (length, n)), 1))
                    n, times = 0, times - 1
                if times:
                    open_[room].append(Pattern(g.parts, times))
            if not n:
                break
        per = capacity // length
        if n >= per:
            open_[capacity - per * length].append(Pattern(((length, per),), n // per))
        if n % per:
            open_[capacity - n % per * length].append(Pattern(((length, n % per),), 1))
    return [g for groups in open_.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first and end rank, sequence of the first, pieces in each sequence, their offset."""
    out, used, sequence = [], defaultdict(int), 0
    for parts, times in patterns:
        offset = 0
        for length, per in parts:
            out.append((length, used[length], used[length] + per * times, sequence, per, offset))
            used[length] += per * times
            offset += per * length
        sequence += times
    return out


@tidy
def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns beside `length`).

    Ranks among equal lengths have two levels, the shard's count before and the
    rank within the shard, so that a length which a third of all pieces have is
    dealt to many tasks.
    """
    spark = made.sparkSession
    columns = made.columns
    rows = stored(made.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # `capacity` rows at most
    places = spark.createDataFrame(_places(plan(counts, capacity)), "length long, _first long, _end long, _sequence long, _per long, _offset long")
    rows = rows.withColumn("_shard", F.pmod(F.hash("_row"), F.lit(shards_for(sum(counts.values())))))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "_shard").count().select("length", "_shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_shard").orderBy("_row")) - 1)
    ranked = ranked.join(base, ["length", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    # a pattern is made of what one length and one group of sequences leave, so `places` is bounded by the capacity, not by the corpus
    found = ranked.join(F.broadcast(places), "length").filter("_rank >= _first and _rank < _end")
    within = F.col("_rank") - F.col("_first")
    return found.select(
        *columns,
        (F.col("_sequence") + F.floor(within / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + within % F.col("_per") * F.col("length")).cast("long").alias("offset"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir)))
