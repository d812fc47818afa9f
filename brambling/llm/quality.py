"""Operator 8, quality rules: decision lists that sequential covering learns.

Statistics of whole texts are computed in one pass. From those of labelled
documents a list of rules for low quality is learned: each rule is grown as a
conjunction of thresholds by information gain, pruned on rows that growing did
not see, and kept if it is precise there; covered rows are then set aside. The
list is emitted as an ordered Spark conditional expression.

Null and empty texts have no words and fail the base rule; repeated rows are
judged each; labels that are null or lack a document are not used; without
labels of both kinds the list is empty and keeps everything; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks, hash_runs, mix
from .common import documents, labels, stored, texts, tidy
from .words import BLANK, windows, word_hashes, words

#: Labelled rows that the list is learned from, about, at most (by a hash of their ids); more labels only narrow its thresholds.
TRAINING_ROWS = 40_000
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVER = 12, 4, 0.9, 8
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_capitals", "n_marks")
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_DIGITS = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
_CAPITALS = np.isin(np.arange(256), np.arange(65, 91))
_MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def _per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1, np.int64)
    full = at[1:] > at[:-1]  # an empty text has no place of its own, wherever it stands
    if full.any():
        out[full] = np.add.reduceat(flags.view(np.uint8), at[:-1][full], dtype=np.int64)
    return out


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def statistics(b: Block) -> dict[str, np.ndarray]:
    """The counts of each document of a block."""
    n, data = len(b.doc_id), b.data
    blank = BLANK[data]
    w = words(b, blank)
    hashes = word_hashes(b, w)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    key, first = windows(hashes, w.doc, 5)
    twice, _ = _repeated(key ^ salt[w.doc[first]])
    mark = np.zeros(len(w.start) + 1, np.int32)
    np.add.at(mark, first[twice], 1)
    np.add.at(mark, first[twice] + 5, -1)
    covered = np.cumsum(mark[:-1]) > 0
    # lines with a word: runs between line feeds and ends of documents
    feeds = np.flatnonzero(data == 10)
    start = np.union1d(b.at[:-1], feeds + 1)
    start = start[start < len(data)]
    stop = np.append(start[1:], len(data))
    stop = stop - (data[np.maximum(stop - 1, 0)] == 10) if len(data) else stop
    real = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)  # a word begins in it
    start, stop = start[real], stop[real]
    doc = np.searchsorted(b.at, start, side="right") - 1
    _, later = _repeated(hash_runs(data, start, stop - start, 7) ^ salt[doc])
    _, again = _repeated(hashes ^ salt[w.doc])
    return {
        "n_words": w.per_doc,
        "word_chars": _per_doc(~blank & ((data & 0xC0) != 0x80), b.at),
        "n_symbols": _per_doc(_SYMBOLS[data], b.at),
        "n_dup_lines": np.bincount(doc[later], minlength=n),
        "n_repeat_words": np.bincount(w.doc[covered], minlength=n),
        "n_lines": np.bincount(doc, minlength=n),
        "n_distinct": np.bincount(w.doc[~again], minlength=n),
        "n_digits": _per_doc(_DIGITS[data], b.at),
        "n_capitals": _per_doc(_CAPITALS[data], b.at),
        "n_marks": _per_doc(_MARKS[data], b.at),
    }


def quality_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            found = statistics(b)
            yield pa.RecordBatch.from_arrays([b.doc_id, *(pa.array(found[c], pa.int64()) for c in _COUNTS)], ["doc_id", *_COUNTS])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _features() -> dict[str, Column]:
    """What rules may put thresholds on."""
    words_, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words_,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words_,
        "distinct_share": F.col("n_distinct") / words_,
        "words_per_line": F.col("n_words") / lines,
        "digit_share": F.col("n_digits") / chars,
        "capital_share": F.col("n_capitals") / chars,
        "mark_share": F.col("n_marks") / words_,
    }


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] > self.threshold if self.above else rows[self.feature] <= self.threshold

    def column(self) -> Column:
        value = _features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(rows)
    return out


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray) -> Rule:
    """Adds the threshold of the largest gain until only low quality is covered."""
    rule: list[Condition] = []
    inside = live.copy()
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best: tuple[float, Condition | None] = (0.0, None)
        for name, values in rows.items():
            own, target = values[inside], bad[inside]
            order = np.argsort(own, kind="stable")
            own, target = own[order], target[order]
            edge = np.flatnonzero(own[1:] != own[:-1])
            if not len(edge):
                continue
            p_low = np.cumsum(target)[edge]
            n_low = edge + 1 - p_low
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p >= MIN_COVER, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float((own[edge[k]] + own[edge[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(rows)
    return tuple(rule)


def _worth(rule: Rule, rows: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray) -> tuple[float, float]:
    inside = live & _covers(rule, rows, len(bad))
    p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0


def learn_rules(rows: dict[str, np.ndarray], bad: np.ndarray, pruning: np.ndarray) -> list[Rule]:
    """Sequential covering: grow on the rows that are not for pruning, prune on the others, set covered rows aside."""
    rules: list[Rule] = []
    live = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (live & bad & ~pruning).sum() >= MIN_COVER and (live & ~bad & ~pruning).any():
        rule = _grow(rows, bad, live & ~pruning)
        while len(rule) > 1 and _worth(rule[:-1], rows, bad, live & pruning)[0] >= _worth(rule, rows, bad, live & pruning)[0]:
            rule = rule[:-1]
        if not rule or _worth(rule, rows, bad, live & pruning)[1] < MIN_PRECISION:
            break
        rules.append(rule)
        live &= ~_covers(rule, rows, len(bad))
    return rules


def decision_list(rules: list[Rule]) -> Column:
    """True where no rule for low quality holds; the first one that holds decides."""
    out = None
    for rule in rules:
        held = F.lit(True)
        for c in rule:
            held = held & c.column()
        out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(stats: DataFrame, marked: DataFrame, rows: int = TRAINING_ROWS) -> list[Rule]:
    """A decision list from about `rows` labelled documents at most: all, or those whose ids' hashes lie below a bound."""
    marked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("_quality")).filter("_quality in (0, 1) and doc_id is not null")
    marked = marked.withColumn("_hash", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    bound = min(1.0, rows / max(1, marked.count()))
    sample = stats.filter(~base_failed()).join(marked.filter(F.col("_hash") < int(bound * (1 << 30))), "doc_id")
    got = sample.select("doc_id", "_quality", *(c.alias(n) for n, c in _features().items())).toPandas()  # about `rows` at most
    if not len(got):
        return []
    got = got.sort_values("doc_id", kind="stable")
    return learn_rules({n: got[n].to_numpy() for n in _features()}, got["_quality"].to_numpy() == 0, mix(got["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(3) == 0)


@tidy
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality_statistics(documents(spark, sf_dir)), "quality")
    verdict = decision_list(learn(stats, labels(spark, sf_dir)))
    counts = [F.col(c) for c in _COUNTS[:5]]
    return stats.select("doc_id", *counts, base_failed().alias("base_failed"), (~base_failed() & verdict).alias("kept"))
