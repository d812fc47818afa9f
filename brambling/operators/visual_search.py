"""Nearest images: exhaustive cosine, inverted-index cosine, inner product.

A query's vector is a dictionary {word: weight}, no longer than the codebook or
its image's descriptors; its words are literals, so that they reach the scan of
the postings, and it is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambling.functions.vectors import dot
from brambling.operators.visual_index import VisualIndex, assign_words, histograms

#: Scores up to this one are left out of an inverted search.
LEAST_SCORE = 0.001
#: What stands in for a title that metadata lacks, and where images are served.
NO_TITLE, BASE_URL = "Sin título", "http://127.0.0.1:8000/static/"


def query_vector(descriptors: DataFrame, index: VisualIndex) -> DataFrame:
    """word, wq of one query image's descriptors; no rows if it has none."""
    own = histograms(assign_words(descriptors.withColumn("image_id", F.lit(0)), index.codebook))
    return own.join(index.idf, "word").select("word", (F.col("tf") * F.col("idf")).alias("wq"))


def one_vector(descriptors: DataFrame, index: VisualIndex) -> dict[int, float]:
    """The same for one image, as a dictionary."""
    words = Counter(r["word"] for r in assign_words(descriptors, index.codebook).select("word").collect())  # one image's descriptors
    if not words:
        return {}
    idf = index.idf.filter(F.col("word").isin(*words)).collect()  # its words
    return {r["word"]: words[r["word"]] / words.total() * r["idf"] for r in idf}


def _dots(vector: dict[int, float], index: VisualIndex) -> DataFrame:
    """image_id, _dot, _norm of images that share a word."""
    spark = index.postings.sparkSession
    local = spark.createDataFrame(pa.table({"word": pa.array(list(vector), pa.int64()), "wq": pa.array(list(vector.values()), pa.float64())}))
    local = local.withColumn("word", F.col("word").cast(index.postings.schema["word"].dataType))
    hits = index.postings.filter(F.col("word").isin(*vector)).join(F.broadcast(local), "word")  # words of one image
    return hits.groupBy("image_id").agg(F.sum(F.col("w") * F.col("wq")).alias("_dot"), F.max("norm").alias("_norm"))


def _length(vector: dict[int, float]) -> float:
    return math.sqrt(sum(x * x for x in vector.values()))


def sequential_scores(vector: dict[int, float], index: VisualIndex) -> DataFrame:
    """image_id, score of every image, with 0 where nothing is shared or a norm is 0; no rows for an empty query."""
    every = index.norms if vector else index.norms.limit(0)
    found = every.join(_dots(vector, index), "image_id", "left")
    score = F.coalesce(F.try_divide(F.col("_dot"), F.col("norm") * _length(vector)), F.lit(0.0))
    return found.select("image_id", F.round(score, 6).alias("score"))


def inverted_scores(vector: dict[int, float], index: VisualIndex, least: float | None = LEAST_SCORE) -> DataFrame:
    """image_id, score of images that share a word of positive weight; the query's norm is that of all its words."""
    found = _dots({word: w for word, w in vector.items() if w > 0}, index).filter("_norm > 0")
    found = found.select("image_id", F.try_divide(F.col("_dot"), F.col("_norm") * _length(vector)).alias("_score"))
    found = found if least is None else found.filter(F.col("_score") > least)
    return found.select("image_id", F.round("_score", 6).alias("score"))


def top_k(scores: DataFrame, k: int, key: str = "image_id", score: str = "score") -> DataFrame:
    if k < 0:
        raise ValueError("k must not be negative")
    return scores.orderBy(F.desc(score), key).limit(k)


def search(descriptors: DataFrame, index: VisualIndex, k: int = 8, method: str = "inverted") -> DataFrame:
    """image_id, score; only the method "sequential" compares with every image."""
    vector = one_vector(descriptors, index)
    return top_k(sequential_scores(vector, index) if method == "sequential" else inverted_scores(vector, index), k)


def inner_products(vectors: DataFrame, query: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, ip of every vector with the one query row (column q)."""
    return vectors.crossJoin(F.broadcast(query)).select(key, F.round(dot(F.col("vec"), F.col("q")), 6).alias("ip"))


def mini_index(index: VisualIndex, first: int) -> VisualIndex:
    """The index of images below an id, with the whole corpus's codebook and idf."""
    own = {t: getattr(index, t).filter(F.col("image_id") < first) for t in ("histograms", "postings", "norms")}
    return index._replace(**own)


def format_hits(hits: DataFrame, metadata: DataFrame, base_url: str = BASE_URL) -> DataFrame:
    """id, score, title, gender, year, url of k hits; metadata has id, title, gender, year, and defaults stand in for what it lacks."""
    named = hits.withColumn("id", F.col("image_id").cast("string")).withColumn("_key", F.replace(F.col("image_id").cast("string"), F.lit(".jpg"), F.lit("")))
    meta = metadata.select(F.col("id").cast("string").alias("_key"), "title", "gender", F.col("year").cast("string").alias("year"))
    meta = meta.join(F.broadcast(named.select("_key")), "_key", "left_semi").dropDuplicates(["_key"])  # k rows
    return meta.join(F.broadcast(named), "_key", "right").select(  # k rows
        "id",
        "score",
        F.coalesce("title", F.lit(NO_TITLE)).alias("title"),
        F.coalesce("gender", F.lit("")).alias("gender"),
        F.coalesce("year", F.lit("")).alias("year"),
        F.concat(F.lit(base_url), F.col("id")).alias("url"),
    )
