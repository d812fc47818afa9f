"""Operator 9, near-duplicates by circulant MinHash.

Signatures: an initial permutation (a hash onto 2**20 places) breaks up the
structure of a document's shingles; a second permutation of the places, shifted
by 0, 1, ..., K - 1, gives all K coordinates, so a shingle's K values are K
neighbouring entries of one table and a signature is the minimum of such rows.

1. Documents with equal shingle sets (128-bit sums of hashes) become one node.
2. Coordinates are banded, BANDS x ROWS; at a similarity of 0.75 a pair shares
   no band with probability (1 - 0.75**4)**48, about 1e-8. There is no cap on a
   bucket.
3. A bucket's members are linked to one of them, chosen anew in each of a few
   rounds, so that a large group of copies costs links in proportion to its
   members; every link is confirmed on the full sets.
   The weightiest member is chosen, the one that shares most buckets with most
   others: of edited copies that is the document they were made from.
4. Members of buckets that are still of several components are compared by an
   exact prefix filter: a document's shingles are put in order, the rarest of
   these documents first, and two sets at a similarity of 0.75 share one among
   the first quarter of both, and among the first seventh of one. So documents
   that have a common passage and little else in common never meet, and pairs
   grow with those that are nearly similar, not with the size of a bucket. A
   shingle's largest component is compared with the others only, not with
   itself. Every pair found is confirmed on the full sets.
5. Components come from distributed star contraction.

Documents without words are linked with nothing. Repeated rows have equal sets
and so one component; a null doc_id sorts after all others, and a component of
null ids only has the id null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Block, _strings, blocks, hash_runs, mix
from .common import BROADCAST_ROWS, LAST_ID, documents, id_key, stored, text_key, texts, tidy
from .components import components
from .words import windows, word_hashes, words

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 48, 4
K = BANDS * ROWS
PLACES = 1 << 20
SKETCH_BITS = 56
STAR_ROUNDS = 2
#: The second permutation, with its first entries again at the end, so that shifts need no wrapping.
_table: np.ndarray | None = None


def _rows(k: int) -> np.ndarray:
    """Row p has the second permutation's values at places p, p + 1, ..., p + k - 1."""
    global _table
    if _table is None:
        order = np.argsort(mix(np.arange(PLACES, dtype=np.uint64) + np.uint64(1 << 40)), kind="stable").astype(np.uint32)
        _table = np.concatenate([order, order[:K]])
    return np.lib.stride_tricks.sliding_window_view(_table[: PLACES + k - 1], k)


def shingle_sets(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct shingles, one document after the other, and how many each has."""
    n = len(b.at) - 1
    w = words(b)
    hashes = word_hashes(b, w, lower=True)
    key, first = windows(hashes, w.doc, SHINGLE)
    doc = w.doc[first]
    short = np.flatnonzero((w.per_doc > 0) & (w.per_doc < SHINGLE))
    if len(short):  # the whole sequence is one shingle
        at = np.concatenate([[0], np.cumsum(w.per_doc)])
        own = np.array([hash_of_sequence(hashes[at[i] : at[i + 1]]) for i in short], np.uint64)
        place = np.searchsorted(doc, short)
        key, doc = np.insert(key, place, own), np.insert(doc, place, short)
    salted = key ^ mix(np.arange(1, n + 1, dtype=np.uint64))[doc]
    order = np.argsort(salted)
    new = np.ones(len(key), bool)
    new[order[1:]] = salted[order][1:] != salted[order][:-1]
    return key[new], np.bincount(doc[new], minlength=n)


def hash_of_sequence(hashes: np.ndarray) -> np.uint64:
    raw = hashes.astype("<u8").view(np.uint8)
    return hash_runs(raw, np.array([0]), np.array([len(raw)]), 11)[0]


def signatures(keys: np.ndarray, counts: np.ndarray, k: int = K) -> np.ndarray:
    """The minima of k shifts for each document; of an empty set the largest value."""
    rows = _rows(k)
    place = (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    out = np.full((len(counts), k), PLACES, np.uint32)
    at = np.concatenate([[0], np.cumsum(counts)])
    for i in np.flatnonzero(counts).tolist():
        for s in range(at[i], at[i + 1], 256):
            np.minimum(out[i], rows[place[s : min(s + 256, at[i + 1])]].min(axis=0), out=out[i])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A hash of each band's coordinates and number."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out ^ parts[:, :, k])
    return out.view(np.int64)


def _signed(b: DataFrame) -> DataFrame:
    """doc_id, _text, n_shingles, a 128-bit hash of the set, sketch and band keys of every document."""
    schema = "doc_id long, _text long, n_shingles long, _h0 long, _h1 long, _s0 long, _s1 long, _s2 long, _bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 << 20):
            keys, counts = shingle_sets(block)
            at = np.concatenate([[0], np.cumsum(counts)])
            sums = []
            for seed in (0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys + np.uint64(seed)), dtype=np.uint64)])
                sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            signature = signatures(keys, counts)
            sketch = np.packbits((signature & 1).astype(np.uint8), axis=1).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(signature).ravel()))
            columns = [block.doc_id, block.rest[0], pa.array(counts, pa.int64()), *map(pa.array, sums), *(pa.array(sketch[:, k].copy()) for k in range(3)), bands]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return b.select("doc_id", "text", text_key().alias("_text")).mapInArrow(run, schema)


def _confirmed(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose full sets are similar enough; found has the text of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 2 << 20):
            n = len(b.doc_id)
            data, at = _strings(b.rest[1])
            left, n_left = shingle_sets(b)
            right, n_right = shingle_sets(Block(b.doc_id, data, at, []))
            salt = mix(np.arange(1, n + 1, dtype=np.uint64))
            pair = np.concatenate([np.repeat(np.arange(n), n_left), np.repeat(np.arange(n), n_right)])
            key = np.concatenate([left, right]) ^ salt[pair]
            order = np.argsort(key)
            shared = np.bincount(pair[order[1:][key[order][1:] == key[order][:-1]]], minlength=n)
            good = pa.array(100 * shared >= PERCENT * (n_left + n_right - shared))
            yield pa.RecordBatch.from_arrays([b.doc_id.filter(good), b.rest[0].filter(good)], ["u", "v"])

    left = found.select(F.col("_node").alias("u"), F.col("_found").alias("_left"))
    right = found.select(F.col("_node").alias("v"), F.col("_found").alias("_right"))
    both = pairs.join(left, "u").join(right, "v")
    return both.select("u", "_left", "v", "_right").mapInArrow(run, "u long, v long")


_SKETCH = ("_s0", "_s1", "_s2")


def _alike() -> Column:
    """Whether the sketches of a and b differ in few bits: at a similarity of 0.75 24 are expected, with a deviation of 5."""
    return sum((F.bit_count(F.col(f"a.{n}").bitwiseXOR(F.col(f"b.{n}"))) for n in _SKETCH), F.lit(0)) <= SKETCH_BITS


def _prefixes(found: DataFrame, pool: DataFrame) -> DataFrame:
    """_node, _size, _h, _place of the shingles that are among the first quarter of their document's, the rarest in the pool first; _place counts from 0. Shingles of one document only have their places but no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1 << 20):
            keys, counts = shingle_sets(b)
            node = np.repeat(b.doc_id.to_numpy(zero_copy_only=False).astype(np.int64), counts)
            rows = pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat(counts, counts), pa.int64()), pa.array(keys.view(np.int64))], ["_node", "_size", "_h"])
            for i in range(0, len(rows), 1 << 16):
                yield rows.slice(i, 1 << 16)

    own = found.join(pool.select("_node"), "_node", "left_semi").select("_node", "_found")
    shingles = stored(own.mapInArrow(run, "_node long, _size long, _h long"), "shingles")
    common = shingles.groupBy("_h").agg(F.count("*").alias("_df")).filter("_df > 1")
    document = Window.partitionBy("_node")  # one document's shingles
    rows = shingles.join(common, "_h").select("_node", "_size", "_h", F.row_number().over(document.orderBy("_df", "_h")).alias("_k"), F.count("*").over(document).alias("_n"))
    return rows.select("_node", "_size", "_h", (F.col("_size") - F.col("_n") + F.col("_k") - 1).alias("_place")).filter(4 * F.col("_place") <= F.col("_size"))


def _prefix_pairs(found: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs of nodes of different classes that may be similar. pool: _node, _class and sketches, stored.

    Similar sets share at least 3/7 of their sizes' sum. If their first common
    shingle is at places i and j, at least so many of either follow from it on,
    so that the smaller one's is early: 7 i is at most its size. Places beyond a
    quarter leave less than 3/4.
    """
    rows = stored(_prefixes(found, pool).join(pool, "_node"), "prefixes")
    main = rows.groupBy("_h", "_class").agg(F.count("*").alias("_n")).groupBy("_h").agg(F.max(F.struct("_n", "_class"))["_class"].alias("_main"), F.count("*").alias("_classes"))
    rows = rows.join(main.filter("_classes > 1").select("_h", "_main"), "_h")
    rows = stored(rows.withColumn("_main", F.col("_class") == F.col("_main")).withColumn("_early", 7 * F.col("_place") <= F.col("_size")), "mixed_prefixes")
    several = rows.filter(~F.col("_main"))
    close = (4 * F.least("a._size", "b._size") >= 3 * F.greatest("a._size", "b._size")) & (7 * F.least(F.col("a._size") - F.col("a._place"), F.col("b._size") - F.col("b._place")) >= 3 * (F.col("a._size") + F.col("b._size")))
    wanted = (F.col("a._class") != F.col("b._class")) & (F.col("b._main") | (F.col("a._node") < F.col("b._node"))) & close & _alike()
    met = [several.filter(a).alias("a").join(rows.filter(b).alias("b"), "_h").filter(wanted) for a, b in (("_early", "true"), ("not _early", "_early"))]
    return met[0].select("a._node", F.col("b._node").alias("_other")).union(met[1].select("a._node", F.col("b._node").alias("_other")))


def _classified(docs: DataFrame) -> DataFrame:
    """_row, doc_id, _id, _text, n_shingles and _class of every document."""
    plain = texts(docs)
    signed = stored(_signed(plain).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    # one node for each distinct set: the first of its rows
    nodes = signed.filter("n_shingles > 0").groupBy("_h0", "_h1").agg(F.min("_row").alias("_node"))
    of_row = signed.select("_row", "_h0", "_h1", "doc_id", "_text", "n_shingles").join(nodes, ["_h0", "_h1"], "left").select("_row", "doc_id", "_text", "n_shingles", "_node")
    own = signed.join(nodes.select(F.col("_node").alias("_row")), "_row", "left_semi")
    banded = own.select(F.col("_row").alias("_node"), F.explode("_bands").alias("_bucket"))
    shared = banded.groupBy("_bucket").agg(F.count("*").alias("_n")).filter("_n > 1")
    members = stored(banded.join(shared, "_bucket"), "buckets")
    # of a group of copies the document that the others were made from shares most buckets with most of them
    weight = members.groupBy("_node").agg(F.sum("_n").alias("_weight"))
    where = own.select(F.col("_row").alias("_node"), id_key().alias("_id"), "_text", "_s0", "_s1", "_s2").join(weight, "_node")
    where = stored(where, "candidates")
    ids = where.select("_node", "_id", "_text")
    ids = F.broadcast(ids) if where.count() <= BROADCAST_ROWS else ids
    keyed = plain.select(id_key().alias("_id"), text_key().alias("_text"), F.col("text").alias("_found"))
    found = stored(keyed.join(ids, ["_id", "_text"]).groupBy("_node").agg(F.first("_found").alias("_found")), "candidate_texts")

    classes = where.select("_node", F.col("_node").alias("_class"))
    members = members.select("_bucket", "_node").join(where.select("_node", "_weight", "_s0", "_s1", "_s2"), "_node")
    tested: DataFrame | None = None
    for turn in range(STAR_ROUNDS + 1):
        now = members.join(classes, "_node")
        if turn:  # only buckets with members of several classes still matter
            mixed = now.groupBy("_bucket").agg(F.min("_class").alias("_low"), F.max("_class").alias("_high")).filter("_low <> _high")
            now = now.join(mixed, "_bucket")
            now = stored(now, "mixed")
            if now.isEmpty():
                break
        one = F.struct("_weight", "_node", "_class", "_s0", "_s1", "_s2")
        if not turn:
            other = now.groupBy("_bucket").agg(F.max(one).alias("_c")).select("_bucket", "_c.*")
        elif turn < STAR_ROUNDS:  # the weightiest member of two of the bucket's classes
            ends = F.array(F.max(F.when(F.col("_class") == F.col("_low"), one)), F.max(F.when(F.col("_class") == F.col("_high"), one)))
            other = now.groupBy("_bucket").agg(ends.alias("_c")).select("_bucket", F.explode("_c").alias("_c")).select("_bucket", "_c.*")
        if turn < STAR_ROUNDS:
            pairs = now.alias("a").join(other.alias("b"), "_bucket").filter((F.col("a._class") != F.col("b._class")) & _alike()).select("a._node", F.col("b._node").alias("_other"))
        else:
            pairs = _prefix_pairs(found, stored(now.select("_node", "_class", *_SKETCH).distinct(), "pool"))
        pairs = pairs.select(F.greatest("_node", "_other").alias("u"), F.least("_node", "_other").alias("v")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        links = stored(_confirmed(pairs, found), "links")
        left, right = classes.select(F.col("_node").alias("u"), F.col("_class").alias("_cu")), classes.select(F.col("_node").alias("v"), F.col("_class").alias("_cv"))
        joined = components(links.join(left, "u").join(right, "v").select(F.col("_cu").alias("u"), F.col("_cv").alias("v")))
        moved = classes.join(joined, F.col("_class") == F.col("node"), "left").select("_node", F.coalesce("component", "_class").alias("_class"))
        classes = stored(moved, "classes")
    of_row = of_row.join(classes, "_node", "left")
    return of_row.withColumn("_class", F.coalesce("_class", "_node", F.col("_row"))).withColumn("_id", id_key())


@tidy
def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    classified = _classified(docs)
    least = classified.groupBy("_class").agg(F.min("_id").alias("_least"))
    return classified.join(least, "_class").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("_least") != LAST_ID, F.col("_least")).alias("component_id"),
        (F.col("_id") == F.col("_least")).alias("kept"),
    )


@tidy
def keep_one(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, without near-duplicates: of each class the document of the smallest id stays, of repeated rows one."""
    classified = stored(_classified(docs).select("_id", "_text", "_class"), "classes")
    first = classified.groupBy("_class").agg(F.min(F.struct("_id", "_text")).alias("_first"))
    gone = classified.join(first, "_class").filter(F.struct("_id", "_text") != F.col("_first")).select("_id", "_text").distinct()
    gone = stored(gone, "gone")
    keys = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text")
    held = docs.select(F.struct("*").alias("_doc"), *keys)
    kept = held.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ["_id", "_text"], "left_anti")
    if not classified.groupBy("_id", "_text").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_text"])
    return kept.select("_doc.*")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
