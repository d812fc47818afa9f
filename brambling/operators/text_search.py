"""Ranked retrieval: cosine of log-TF-IDF vectors, top k, snippets.

One query is a dictionary of its analysed words and their counts: its terms are
literals, so that they reach the scans of dictionary and postings, and its
vector, no longer than the query itself, is broadcast. Many queries are a
DataFrame (query_id, term, qtf) of any size: they are counted, and broadcast if they
are few, so that the postings stay where they are.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brambling.functions.analysis import stemmed, token_rows, tokens
from brambling.functions.snippets import snippet
from brambling.operators.text_index import TextIndex, log_tf


#: Rows of query words or of query vectors that are broadcast at once.
BROADCAST_ROWS = 300_000
#: Scores of queries and documents in one task of a batch, at most.
PAIRS = 1_000_000


def _few(rows: DataFrame) -> DataFrame:
    """The rows, to be broadcast if there are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows  # counted


def query_words(queries: DataFrame, stem: bool = False, stopwords: tuple[str, ...] | None = None) -> DataFrame:
    """query_id, term, qtf from rows with query_id and text."""
    words = token_rows(queries, ["query_id"], stopwords=stopwords).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    if not stem:
        return words
    words = words.join(stemmed(words.select("term").distinct()), "term")
    return words.groupBy("query_id", F.col("stem").alias("term")).agg(F.sum("qtf").alias("qtf"))


def one_query(spark: SparkSession, text: str, stem: bool = False, stopwords: tuple[str, ...] | None = None) -> DataFrame:
    return query_words(spark.createDataFrame([(0, text)], "query_id long, text string"), stem, stopwords)


def analysed(spark: SparkSession, text: str, stem: bool = False, stopwords: tuple[str, ...] | None = None) -> dict[str, int]:
    """The query's words in their order, and how often it has each."""
    words = spark.createDataFrame(pa.table({"text": [text]})).select(tokens(F.col("text"), stopwords)).collect()[0][0]  # one query's words
    if stem and words:
        stems = dict(tuple(r) for r in stemmed(spark.createDataFrame(pa.table({"term": sorted(set(words))}))).select("term", "stem").collect())
        words = [stems[w] for w in words]
    return dict(Counter(words))


def query_vector(words: DataFrame, index: TextIndex) -> DataFrame:
    """query_id, term, wq: normalised weights of the terms that the dictionary has."""
    raw = index.dictionary.join(_few(words), "term").crossJoin(F.broadcast(index.stats.select("n_query")))  # one row
    raw = raw.select("query_id", "term", (log_tf(F.col("qtf")) * F.ln(F.col("n_query") / F.col("df"))).alias("raw"))
    length = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return raw.join(length, "query_id").select("query_id", "term", F.when(F.col("length") > 0, F.col("raw") / F.col("length")).otherwise(F.col("raw")).alias("wq"))


def one_vector(words: dict[str, int], index: TextIndex) -> dict[str, float]:
    """The same for one query, as a dictionary."""
    if not words:
        return {}
    known = index.dictionary.filter(F.col("term").isin(*words)).select("term", "df").crossJoin(F.broadcast(index.stats.select("n_query")))  # one row
    raw = {r["term"]: (1 + math.log(words[r["term"]])) * math.log(r["n_query"] / r["df"]) for r in known.collect()}  # the query's terms
    length = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / length if length > 0 else x for t, x in raw.items()}


def partial_scores(vector: DataFrame, index: TextIndex) -> DataFrame:
    """query_id, doc_id, dot, norm: every document with a query term, even where the product is 0."""
    hits = index.postings.join(_few(vector), "term")
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("w")).alias("dot"), F.max("norm").alias("norm"))


def cosine(dot: Column, norm: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot, norm), F.lit(0.0))))


def cosine_scores(vector: DataFrame, index: TextIndex) -> DataFrame:
    found = partial_scores(vector, index)
    return found.select("query_id", "doc_id", F.round(cosine(F.col("dot"), F.col("norm")), 6).alias("score"))


def scores(vector: dict[str, float], index: TextIndex) -> DataFrame:
    """doc_id, score, n_terms (how many of the vector's terms it has) of every document with a term of one query."""
    spark = index.postings.sparkSession
    local = spark.createDataFrame(pa.table({"term": pa.array(list(vector), pa.string()), "wq": pa.array(list(vector.values()), pa.float64())}))
    hits = index.postings.filter(F.col("term").isin(*vector)).join(F.broadcast(local), "term")  # no longer than the query
    found = hits.groupBy("doc_id").agg(F.sum(F.col("wq") * F.col("w")).alias("_dot"), F.max("norm").alias("_norm"), F.count("*").alias("n_terms"))
    return found.select("doc_id", F.round(cosine(F.col("_dot"), F.col("_norm")), 6).alias("score"), "n_terms")


def top_k(found: DataFrame, k: int) -> DataFrame:
    """The k best of one query, ties by id."""
    if k < 0:
        raise ValueError("k must not be negative")
    return found.orderBy(F.desc("score"), "doc_id").limit(k)


def top_k_each(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, score of the k best of each of many queries."""
    if k < 0:
        raise ValueError("k must not be negative")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def search_each(vector: DataFrame, index: TextIndex, k: int) -> DataFrame:
    """The same from the queries' vectors. What the queries share with a document is added up and ranked where its postings meet: a posting is shuffled once to its document, whatever the number of queries, and then the k best of each task. More queries than are broadcast at once are searched one part after the other, a query in one part."""
    rows, queries = vector.agg(F.count("*"), F.countDistinct("query_id")).first()
    parts = max(1, math.ceil(rows / BROADCAST_ROWS))
    pairs = math.ceil(queries / parts) * index.stats.first()["n_query"]
    tasks = max(int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, math.ceil(pairs / PAIRS)))
    found = []
    for i in range(parts):
        asked = F.broadcast(vector.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i))  # about BROADCAST_ROWS
        own = index.postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")  # no more than these
        hits = own.select("term", "doc_id", "w", "norm").repartition(tasks, "doc_id").join(asked, "term")
        sums = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("w")).alias("_dot"), F.max("norm").alias("_norm"))
        found.append(top_k_each(sums.select("query_id", "doc_id", F.round(cosine(F.col("_dot"), F.col("_norm")), 6).alias("score")), k))
    return reduce(DataFrame.union, found)


def search(index: TextIndex, words: dict[str, int], k: int = 10) -> DataFrame:
    """doc_id, score of one query's words."""
    return top_k(scores(one_vector(words, index), index).select("doc_id", "score"), k)


def with_snippets(best: DataFrame, index: TextIndex, terms: list[str]) -> DataFrame:
    """doc_id, score, name, snippet of the k best; their ids are literals, so that other documents' texts are not read. Missing documents drop out."""
    spark = best.sparkSession
    rows = best.collect()  # k rows
    hits = spark.createDataFrame(rows, best.schema)
    wanted = F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")
    shown = index.documents.filter(F.col("doc_id").isin(*(r["doc_id"] for r in rows))).join(F.broadcast(hits), "doc_id")  # k rows
    return shown.select("doc_id", "score", "name", snippet(F.col("text"), wanted).alias("snippet"))
