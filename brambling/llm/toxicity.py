"""Operator 2, toxicity: a lexicon trie intersected with Levenshtein automata, and context windows.

1. From labelled documents, words and stems (beginnings of words) are counted by
   label; those that mark the label strongly become the lexicon, the shortest
   sufficient stem instead of all its words.
2. In every text, words are matched with the lexicon exactly or with one edit.
3. A context window separates quotation from abuse: a match between quotation
   marks of its line counts as quoted.
4. A term's evidence, exact and misspelt, is learned from the same documents,
   and a logistic function of the four sums (exact or misspelt, quoted or not)
   gives the score. Its coefficients have a prior, so that what the labels never
   show, such as quotations, has a sensible weight.

Labels are learned from rows whose crc32 of the id, modulo 5, is not 0. They are
never inputs of a score, and neither is anything but the text.

Null and empty texts have the score of a text without matches; repeated rows are
scored each; labels that are null, lack a document or have other values are not
used; without labels of both kinds no term is learned and all scores are equal
and below 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks, hash_runs
from .common import documents, labels, stored, texts, tidy
from .lexicon import Matcher

#: Labelled documents that are learned from, about, at most (by a hash of their ids).
TRAINING_ROWS = 20_000
#: Letters of a stem.
MIN_STEM, MAX_STEM = 4, 24
#: What makes a term: toxic documents that have it, their share of all that have it, and how much rarer than one in all words that share is by chance, in bits.
MIN_TOXIC, MIN_SHARE, MIN_BITS = 3, 0.9, 1.0
FOLDS = 5
BATCH = 4 << 20
#: Words on either side of a match that its context window has.
WINDOW = 8
#: Prior means of the intercept and of the four sums' coefficients: exact, quoted, misspelt, misspelt and quoted.
PRIOR = np.array([-3.0, 1.5, 0.2, 0.6, 0.1])
PRIOR_WEIGHT = 1.0

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256), ord("@"), ord("$"), ord("*")]] = True
_QUOTES = "“”„«»‟"


class Model(NamedTuple):
    terms: list[tuple[str, bool]]
    weights: np.ndarray  # a row for each term: of exact and of misspelt matches
    coefficients: np.ndarray


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def _folded(text: str) -> bytes:
    text = text.lower()
    if not text.isascii():
        for q in _QUOTES:
            text = text.replace(q, '"')
    return text.encode("utf-8", "replace")


class _Words(NamedTuple):
    """Distinct words of a block, and for each occurrence its word, document and whether it is quoted."""

    distinct: list[str]
    which: np.ndarray
    doc: np.ndarray
    quoted: np.ndarray
    n_docs: int


def _words(b: Block) -> _Words:
    raw = b.data.tobytes()
    parts = [_folded(raw[i:j].decode("utf-8", "replace")) for i, j in zip(b.at[:-1], b.at[1:])]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    at = np.cumsum([0, *(len(p) + 1 for p in parts)])
    if not len(data):
        return _Words([], *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, bool), len(parts))
    inside = _WORD_BYTE[data]
    start = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    end = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    if not len(start):
        return _Words([], *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, bool), len(parts))
    _, first, which = np.unique(hash_runs(data, start, end - start), return_index=True, return_inverse=True)
    flat = data.tobytes()
    distinct = [flat[s:e].decode("utf-8", "replace") for s, e in zip(start[first].tolist(), end[first].tolist())]
    # quoted: an odd number of marks in the line before, within the window, and a mark behind, within the window
    mark = np.append(0, np.cumsum(data == ord('"')))
    line = np.flatnonzero(data == 10)
    own = np.searchsorted(line, start)
    begin, stop = np.append(0, line + 1)[own], line[own]
    left = np.maximum(begin, start[np.maximum(np.arange(len(start)) - WINDOW, 0)])
    right = np.minimum(stop, end[np.minimum(np.arange(len(start)) + WINDOW, len(start) - 1)])
    odd = (mark[start] - mark[begin]) % 2 == 1
    quoted = odd & (mark[start] > mark[np.maximum(left - 1, 0)]) & (mark[np.minimum(right + 1, len(data))] > mark[end])
    return _Words(distinct, which, np.searchsorted(at, start, side="right") - 1, quoted, len(parts))


def _word_counts(train: DataFrame) -> DataFrame:
    """word, toxic, clean: documents of either label that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, BATCH):
            w = _words(b)
            toxic = b.rest[0].to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = np.unique(w.which * np.int64(w.n_docs) + w.doc)
            which, doc = np.divmod(pairs, np.int64(max(1, w.n_docs)))
            n = np.bincount(which, minlength=len(w.distinct))
            t = np.bincount(which, weights=toxic[doc], minlength=len(w.distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w.distinct, pa.string()), pa.array(t), pa.array(n - t)], ["word", "toxic", "clean"])

    counted = train.select("doc_id", "text", "_toxic").mapInArrow(run, "word string, toxic long, clean long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _marks(base: float, n_words: int) -> Column:
    """Whether a term's documents are toxic too often for chance, given the share of toxic documents and how many words there are to choose from."""
    toxic, every = F.col("toxic"), F.col("toxic") + F.col("clean")
    share = toxic / every
    clean = F.when(share < 1, F.col("clean") * F.log2((1 - share) / (1 - base))).otherwise(F.lit(0.0))
    bits = toxic * F.log2(share / base) + clean
    return (toxic >= MIN_TOXIC) & (share >= MIN_SHARE) & (bits >= math.log2(max(1, n_words)) + MIN_BITS)


def _lexicon(train: DataFrame, n_toxic: int, n: int) -> list[tuple[str, bool]]:
    """Words, and stems instead of the words that begin with them. All that mark the label: of a bounded training sample there are few."""
    counts = stored(_word_counts(train), "words")
    marks = _marks(n_toxic / n, counts.count())
    sizes = F.sequence(F.lit(MIN_STEM), F.least(F.length("word") - 1, F.lit(MAX_STEM)))
    begun = counts.filter(F.length("word") > MIN_STEM).select("word", "toxic", "clean", F.explode(sizes).alias("_n"))
    stems = begun.groupBy(F.substr("word", F.lit(1), F.col("_n")).alias("term")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.when(F.col("toxic") > 0, 1)).alias("_words"))
    stems = stems.filter(marks & (F.col("_words") >= 3))
    shorter = stems.select(F.col("term").alias("_shorter"))
    stems = stems.join(shorter, F.expr("left(term, length(term) - 1)") == F.col("_shorter"), "left_anti").select("term", "toxic", F.lit(True).alias("is_stem"))
    words = counts.filter(marks & (F.length("word") >= 3)).select(F.col("word").alias("term"), "toxic", F.lit(False).alias("is_stem"))
    best = words.union(stems).orderBy(F.desc("toxic"), "term", "is_stem").collect()  # each has MIN_TOXIC of the training documents
    chosen = [(r["term"], r["is_stem"]) for r in best]
    begins = {t for t, s in chosen if s}
    return [(t, s) for t, s in chosen if s or not any(t[:k] in begins for k in range(MIN_STEM, len(t) + 1))]


def _matches(b: Block, matcher: Matcher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term, edits and quotation of each match in a block."""
    w = _words(b)
    term, edits = matcher.match(w.distinct)
    hit = np.flatnonzero(term[w.which] >= 0) if len(w.distinct) else np.zeros(0, np.int64)
    which = w.which[hit]
    return w.doc[hit], term[which], edits[which], w.quoted[hit]


def _sums(doc: np.ndarray, value: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Four columns of log(1 + sum of evidence), by exact or misspelt and quoted or not."""
    out = np.zeros((n, 4))
    for g in range(4):
        own = group == g
        out[:, g] = np.log1p(np.maximum(0, np.bincount(doc[own], weights=value[own], minlength=n)))
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic coefficients under a Gaussian prior, by Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    c = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        gradient = x.T @ (y - p) - PRIOR_WEIGHT * (c - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + PRIOR_WEIGHT * np.eye(5)
        move = np.linalg.solve(curve, gradient)
        c = c + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return np.append(c[0], np.maximum(c[1:], 0))


@tidy
def learn(docs: DataFrame, marked: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """A model from about `rows` labelled documents at most, none of them held out."""
    marked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("_toxic"))
    marked = marked.filter("_toxic in (0, 1) and doc_id is not null").filter(~held_out())
    bound = min(1.0, rows / max(1, marked.count()))
    sample = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(bound * (1 << 30)))
    train = stored(texts(docs).join(F.broadcast(sample), "doc_id"), "training")  # about `rows` rows
    n = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic")).collect()[0]
    n_toxic, n_clean = n["toxic"], n["n"] - n["toxic"]
    if not n_toxic or not n_clean:
        return Model([], np.zeros((0, 2)), np.append(PRIOR[0], np.zeros(4)))
    terms = _lexicon(train, n_toxic, n["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for b in blocks(batches, BATCH):
            doc, term, edits, quoted = _matches(b, matcher)
            key = np.stack([doc, term, edits * 2 + quoted], axis=1)
            key, count = np.unique(key, axis=0, return_counts=True)
            per = np.bincount(key[:, 0], minlength=len(b.doc_id))
            edge = np.cumsum(per) - per
            found = [np.concatenate([key[i : i + k, 1:], count[i : i + k, None]], axis=1).astype("<i4").tobytes() for i, k in zip(edge.tolist(), per.tolist())]
            yield pa.RecordBatch.from_arrays([b.doc_id, b.rest[0], pa.array(found, pa.binary())], ["doc_id", "toxic", "found"])

    got = train.select("doc_id", "text", "_toxic").mapInArrow(run, "doc_id long, toxic long, found binary").toPandas()  # about `rows` rows
    got = got.sort_values(["doc_id", "found"], kind="stable")
    y = got["toxic"].to_numpy().astype(float)
    parts = [np.frombuffer(f, "<i4").reshape(-1, 3) for f in got["found"]]
    flat = np.concatenate(parts) if parts else np.zeros((0, 3), np.int32)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    # evidence of a term: log odds of the label among documents that have it, exact and misspelt
    weights = np.zeros((len(terms), 2))
    for e, (prior_toxic, prior_clean) in enumerate(((0.5, 0.5), (0.3, 0.3))):
        own = flat[:, 1] // 2 == e
        pairs = np.unique(np.stack([doc[own], flat[own, 0]], axis=1), axis=0)
        t = np.bincount(pairs[:, 1], weights=y[pairs[:, 0]], minlength=len(terms))
        c = np.bincount(pairs[:, 1], weights=1 - y[pairs[:, 0]], minlength=len(terms))
        weights[:, e] = np.maximum(0, np.log((t + prior_toxic) / (n_toxic + 1)) - np.log((c + prior_clean) / (n_clean + 1)))
    x = _sums(doc, weights[flat[:, 0], flat[:, 1] // 2] * flat[:, 2], flat[:, 1], len(parts))
    return Model(terms, weights, _fit(x, y))


def _scores(found: tuple[np.ndarray, ...], weights: np.ndarray, coefficients: np.ndarray, n: int) -> np.ndarray:
    doc, term, edits, quoted = found
    x = _sums(doc, weights[term, edits] if len(weights) else np.zeros(len(term)), edits * 2 + quoted, n)
    return 1 / (1 + np.exp(-np.clip(coefficients[0] + x @ coefficients[1:], -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the number of matches of every document."""
    terms, weights, coefficients = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for b in blocks(batches, BATCH):
            found = _matches(b, matcher)
            p = _scores(found, weights, coefficients, len(b.doc_id))
            yield pa.RecordBatch.from_arrays([b.doc_id, pa.array(p), pa.array(np.bincount(found[0], minlength=len(b.doc_id)))], ["doc_id", "score", "n_matches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_matches long")


def toxicity(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_matches of every document."""
    scored = score(texts(docs), learn(docs, marked))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def drop_toxic(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs, with all their columns, without those that a model learned from the labels predicts to be toxic."""
    terms, weights, coefficients = learn(docs, marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            keep = []
            for b in blocks(iter([pa.RecordBatch.from_arrays([text, text], ["doc_id", "text"])]), BATCH):
                keep.append(_scores(_matches(b, matcher), weights, coefficients, len(b.doc_id)) < 0.5)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


@tidy
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
