"""Bags of visual words: codebook, nearest words, histograms, weights, norms.

Descriptors have image_id and vec (array of doubles). The codebook has word and
center; it is broadcast in rows of at most STRETCH words, one after the other,
so assigning words needs no shuffle, however many words there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambling.functions.vectors import squared_distance

#: Words of a codebook that are broadcast at once, at most about.
STRETCH = 65_536


class VisualIndex(NamedTuple):
    """The tables of an index; postings carry their image's norm."""

    codebook: DataFrame
    histograms: DataFrame
    idf: DataFrame
    postings: DataFrame
    norms: DataFrame


def train_codebook(descriptors: DataFrame, k: int = 1000, sample_images: int = 3000, seed: int = 7, batch: int = 1000, passes: int = 5) -> DataFrame:
    """word, center by mini-batch k-means on the descriptors of a seeded sample of images.

    The sample is read in the order of a hash, a partition at a time, so that the
    driver holds one partition's vectors and the centers. Equal descriptors in any
    partitioning give equal centers.
    """
    images = sample(descriptors.select("image_id").distinct(), "image_id", sample_images, seed)
    rows = descriptors.join(F.broadcast(images), "image_id").select("vec")  # sample_images ids
    rows = rows.orderBy(F.xxhash64("vec", F.lit(seed)), "vec").mapInArrow(_packed, "width int, vectors binary")
    trainer = MiniBatch(k, seed, batch)
    for _ in range(passes):
        for row in rows.toLocalIterator():
            trainer.add(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["width"]))
        trainer.finish()
    centers = trainer.centers.tolist()
    return descriptors.sparkSession.createDataFrame(pa.table({"word": pa.array(range(len(centers)), pa.int32()), "center": pa.array(centers, pa.list_(pa.float64()))}))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([len(flat) // b.num_rows], pa.int32()), pa.array([flat.tobytes()], pa.binary())], ["width", "vectors"])


class MiniBatch:
    """Mini-batch k-means: seeded by k-means++ on the first batches, then each center is the running mean of what it was nearest to."""

    def __init__(self, k: int, seed: int, batch: int):
        self.k, self.batch, self.random = k, batch, np.random.default_rng(seed)
        self.centers = np.zeros((0, 0))
        self.counts = np.zeros(0)
        self.held: list[np.ndarray] = []

    def add(self, vectors: np.ndarray) -> None:
        """Takes vectors in; whole batches of them move the centers."""
        self.held.append(vectors)
        first = max(3 * self.batch, self.k)  # vectors that the centers are seeded from
        while sum(map(len, self.held)) >= (self.batch if len(self.centers) else first):
            every = np.concatenate(self.held)
            if not len(self.centers):
                self._seed(every[:first])
            self._step(every[: self.batch])
            self.held = [every[self.batch :]]

    def finish(self) -> None:
        """The rest of a pass, less than a batch."""
        every = np.concatenate([v for v in self.held if len(v)]) if any(map(len, self.held)) else None
        self.held = []
        if every is not None:
            if not len(self.centers):
                self._seed(every)
            self._step(every)

    def _distances(self, vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return (vectors**2).sum(axis=1)[:, None] - 2 * vectors @ centers.T + (centers**2).sum(axis=1)

    def _seed(self, vectors: np.ndarray) -> None:
        chosen = [vectors[int(self.random.integers(len(vectors)))]]
        nearest = self._distances(vectors, chosen[0][None])[:, 0].clip(0)
        while len(chosen) < min(self.k, len(vectors)):
            chance = nearest if nearest.sum() > 0 else np.ones(len(vectors))
            chosen.append(vectors[int(self.random.choice(len(vectors), p=chance / chance.sum()))])
            nearest = np.minimum(nearest, self._distances(vectors, chosen[-1][None])[:, 0].clip(0))
        self.centers, self.counts = np.stack(chosen), np.zeros(len(chosen))

    def _step(self, vectors: np.ndarray) -> None:
        word = self._distances(vectors, self.centers).argmin(axis=1)
        n = np.bincount(word, minlength=len(self.centers))
        total = np.zeros_like(self.centers)
        np.add.at(total, word, vectors)
        self.counts += n
        moved = n > 0
        self.centers[moved] += (total[moved] - n[moved, None] * self.centers[moved]) / self.counts[moved, None]


def sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows, the first in the order of a seeded hash, so that a rerun gives the same ones."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def assign_words(descriptors: DataFrame, codebook: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """descriptors with `word`, the nearest center's, the lower one of two. A codebook of more than a stretch is compared stretch by stretch."""
    n = -(-codebook.count() // stretch)
    out = descriptors
    for i in range(max(1, n)):
        part = codebook if n <= 1 else codebook.filter(F.pmod(F.xxhash64("word"), F.lit(n)) == i)
        book = part.agg(F.sort_array(F.collect_list(F.struct("word", "center"))).alias("_book"))
        near = F.array_min(F.transform("_book", lambda c: F.struct(squared_distance(F.col("vec"), c["center"]).alias("d"), c["word"].alias("word"))))
        out = out.crossJoin(F.broadcast(book)).withColumn("_near", F.least("_near", near) if i else near).drop("_book")  # one row
    return out.withColumn("word", F.col("_near")["word"]).drop("_near")


def histograms(words: DataFrame) -> DataFrame:
    """image_id, word, tf: shares of the image's descriptors."""
    counts = words.groupBy("image_id", "word").agg(F.count("*").alias("_n"))
    totals = counts.groupBy("image_id").agg(F.sum("_n").alias("_total"))
    return counts.join(totals, "image_id").select("image_id", "word", (F.col("_n") / F.col("_total")).alias("tf"))


def visual_idf(hist: DataFrame, codebook: DataFrame, images: DataFrame) -> DataFrame:
    """word, df, idf of all words of the codebook; ln(images / (df + 1)) may be negative."""
    df = hist.groupBy("word").agg(F.count("*").alias("_df"))
    n = images.agg(F.count("*").alias("_n"))
    all_words = codebook.select("word").join(df, "word", "left").select("word", F.coalesce("_df", F.lit(0)).cast("long").alias("df"))
    return all_words.crossJoin(F.broadcast(n)).select("word", "df", F.ln(F.col("_n") / (F.col("df") + 1)).alias("idf"))  # one row


def visual_weights(hist: DataFrame, idf: DataFrame) -> DataFrame:
    return hist.join(idf, "word").select("word", "image_id", (F.col("tf") * F.col("idf")).alias("w"))


def visual_norms(weighted: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, norm of all images, 0 where an image has no descriptors."""
    own = weighted.groupBy("image_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return images.select("image_id").join(own, "image_id", "left").select("image_id", F.coalesce("norm", F.lit(0.0)).alias("norm"))


def visual_postings(weighted: DataFrame, lengths: DataFrame) -> DataFrame:
    """word, image_id, w and the image's norm."""
    return weighted.join(lengths, "image_id").select("word", "image_id", "w", "norm")


def from_histograms(hist: DataFrame, codebook: DataFrame, images: DataFrame) -> VisualIndex:
    idf = visual_idf(hist, codebook, images)
    weighted = visual_weights(hist, idf)
    lengths = visual_norms(weighted, images)
    return VisualIndex(codebook, hist, idf, visual_postings(weighted, lengths), lengths)


def build_visual_index(descriptors: DataFrame, codebook: DataFrame, images: DataFrame | None = None) -> VisualIndex:
    """An index whose tables are derived when they are used; IndexStore.save_visual writes one. images has image_id of all images, with descriptors or without."""
    images = descriptors.select("image_id").distinct() if images is None else images
    return from_histograms(histograms(assign_words(descriptors, codebook)), codebook, images)


def cluster_stats(words: DataFrame, codebook: DataFrame) -> DataFrame:
    """k, n_empty, min_size, median_size, mean_size, max_size of the words' descriptor counts."""
    counts = words.groupBy("word").agg(F.count("*").alias("_n"))
    full = codebook.select("word").join(counts, "word", "left").select(F.coalesce("_n", F.lit(0)).cast("long").alias("n"))
    return full.agg(
        F.count("*").alias("k"),
        F.count_if(F.col("n") == 0).alias("n_empty"),
        F.min("n").alias("min_size"),
        F.median("n").alias("median_size"),
        F.round(F.avg("n"), 6).alias("mean_size"),
        F.max("n").alias("max_size"),
    )
