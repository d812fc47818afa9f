"""Visual-word queries over the embeddings table, each with its SQL.

An image is ten neighbouring vectors; the codebook is the first sixteen vectors;
the part table stands in for product metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brambling.functions.vectors import doubles
from brambling.operators import visual_index as vi
from brambling.operators import visual_search as vs
from brambling.plans.indexes import store, visual_index

VECTORS, WORDS, QUERY_IMAGE, K = 10, 16, 3, 8
#: Sizes of the benchmark's series; the table's own size is the last one.
SIZES = (10, 25, 50)


def _descriptors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / VECTORS).alias("image_id"), doubles(F.col("embedding")).alias("vec"))


def _codebook(descriptors: DataFrame) -> DataFrame:
    return descriptors.filter(F.col("vec_id") < WORDS).select(F.col("vec_id").alias("word"), F.col("vec").alias("center"))


def _index(spark: SparkSession, d: str) -> vi.VisualIndex:
    def build():
        own = _descriptors(spark, d)
        return own, _codebook(own)

    return visual_index(spark, f"{d}/embeddings.parquet", build)


def _vector(spark: SparkSession, d: str, index: vi.VisualIndex) -> dict[int, float]:
    first = QUERY_IMAGE * VECTORS
    return vs.one_vector(_descriptors(spark, d).filter(F.col("vec_id").between(first, first + VECTORS - 1)), index)


def visual_words(spark, d):
    own = _descriptors(spark, d)
    return vi.assign_words(own, _codebook(own)).select("vec_id", "word")


def visual_index_build(spark, d):
    """Rows of each table of an index that is built and stored anew."""
    own = _descriptors(spark, d)
    store(spark).save_visual("built", own, _codebook(own))
    rows = store(spark).sizes("built", "visual")
    tables = ("codebook", "histograms", "idf", "postings", "norms")
    return spark.createDataFrame([(t, rows[t][0]) for t in tables], "name string, n long")


def visual_histogram(spark, d):
    return _index(spark, d).histograms.withColumn("tf", F.round("tf", 6))


def visual_idf(spark, d):
    return _index(spark, d).idf.withColumn("idf", F.round("idf", 6))


def visual_postings(spark, d):
    return _index(spark, d).postings.select("word", "image_id", F.round("w", 6).alias("w"))


def visual_norms(spark, d):
    return _index(spark, d).norms.withColumn("norm", F.round("norm", 6))


def visual_query_vector(spark, d):
    own = _descriptors(spark, d).filter(F.col("image_id") == QUERY_IMAGE)
    return vs.query_vector(own, _index(spark, d)).withColumn("wq", F.round("wq", 6))


def visual_search_sequential(spark, d):
    index = _index(spark, d)
    return vs.top_k(vs.sequential_scores(_vector(spark, d, index), index), K)


def visual_search_inverted(spark, d):
    index = _index(spark, d)
    return vs.top_k(vs.inverted_scores(_vector(spark, d, index), index), K)


def visual_search_hits(spark, d):
    meta = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("gender"), F.col("p_size").alias("year"))
    return vs.format_hits(visual_search_inverted(spark, d), meta)


def mode_agreement(spark, d):
    index = _index(spark, d)
    vector = _vector(spark, d, index)
    one = vs.sequential_scores(vector, index).withColumnRenamed("score", "seq_score")
    two = vs.inverted_scores(vector, index).withColumnRenamed("score", "inv_score")
    return one.join(two, "image_id", "left").select("image_id", "seq_score", F.coalesce("inv_score", F.lit(0.0)).alias("inv_score"))


def inner_product_topk(spark, d):
    own = _descriptors(spark, d)
    query = own.filter(F.col("vec_id") == QUERY_IMAGE).select(F.col("vec").alias("q"))  # one row
    return vs.top_k(vs.inner_products(own, query), K, key="vec_id", score="ip")


def _bench(spark, d, scores):
    index = _index(spark, d)
    vector = _vector(spark, d, index)
    out = None
    whole = index.norms.agg(F.max("image_id")).collect()[0][0] + 1  # one row
    for n in (*SIZES, whole):
        best = vs.top_k(scores(vector, vs.mini_index(index, n)), K)
        ranked = best.select(F.lit(n).cast("long").alias("n"), F.row_number().over(Window.orderBy(F.desc("score"), "image_id")).cast("long").alias("rank"), "score")  # K rows
        out = ranked if out is None else out.union(ranked)
    return out


def bench_sequential_topk(spark, d):
    return _bench(spark, d, vs.sequential_scores)


def bench_inverted_topk(spark, d):
    return _bench(spark, d, lambda v, i: vs.inverted_scores(v, i, least=None))


def codebook_sample(spark, d):
    return vi.sample(_descriptors(spark, d).select("vec_id"), "vec_id", 100)


def codebook_kmeans(spark, d):
    own = _descriptors(spark, d)
    return vi.assign_words(own, vi.train_codebook(own, k=WORDS)).groupBy("word").agg(F.count("*").alias("n_vectors"))


def cluster_stats(spark, d):
    own = _descriptors(spark, d)
    book = _codebook(own)
    return vi.cluster_stats(vi.assign_words(own, book), book)


QUERIES = {
    f.__name__: f
    for f in (
        visual_words, visual_index_build, visual_histogram, visual_idf, visual_postings, visual_norms, visual_query_vector, visual_search_sequential, visual_search_inverted, visual_search_hits,
        mode_agreement, inner_product_topk, bench_sequential_topk, bench_inverted_topk, codebook_sample, codebook_kmeans, cluster_stats,
    )
}

_BASE = f"""with e as (select vec_id, vec_id // 10 as image_id, embedding::double[] as vec from embeddings),
book as (select vec_id as word, vec as center from e where vec_id < {WORDS}),
words as (select vec_id, any_value(image_id) as image_id, arg_min(word, (dist, word)) as word from (select vec_id, image_id, word, list_distance(vec, center) as dist from e, book) group by vec_id),
counts as (select image_id, word, count(*) as n from words group by all),
hist as (select image_id, word, n / sum(n) over (partition by image_id) as tf from counts),
images as (select distinct image_id from e),
idf as (select b.word, count(h.image_id)::bigint as df, ln((select count(*) from images) / (count(h.image_id) + 1)) as idf from book b left join hist h on b.word = h.word group by b.word),
post as (select word, image_id, tf * idf as w from hist join idf using (word)),
norms as (select i.image_id, coalesce(sqrt(sum(w * w)), 0.0) as norm from images i left join post p on i.image_id = p.image_id group by 1),
vec as (select word, tf * idf as wq from hist join idf using (word) where image_id = {QUERY_IMAGE}),
qn as (select sqrt(sum(wq * wq)) as qnorm from vec),
seq as (select n.image_id, round(coalesce(case when norm * any_value(qnorm) > 0 then sum(w * wq) / (norm * any_value(qnorm)) end, 0.0), 6) as score from norms n cross join qn left join (select image_id, w, wq from post join vec using (word)) p on p.image_id = n.image_id group by n.image_id, norm),
inv0 as (select image_id, any_value(qnorm) as qnorm, any_value(norm) as norm, sum(w * wq) as dot from post join vec using (word) join norms using (image_id), qn where wq > 0 and norm > 0 group by image_id),
inv as (select image_id, dot / (norm * qnorm) as exact, round(dot / (norm * qnorm), 6) as score from inv0)
"""


def _bench_sql(table: str) -> str:
    sizes = [*(f"{n}::bigint" for n in SIZES), "(select max(image_id) + 1 from images)"]
    parts = [f"select {n} as n, rank, score from (select row_number() over (order by score desc, image_id) as rank, score from {table} where image_id < {n}) where rank <= {K}" for n in sizes]
    return _BASE + " union all ".join(parts)


def sql() -> dict[str, str]:
    best = f"order by score desc, image_id limit {K}"
    found = f"select image_id, score from inv where exact > {vs.LEAST_SCORE} {best}"
    return {
        "visual_words": _BASE + "select vec_id, word from words",
        "visual_index_build": _BASE
        + " union all ".join(f"select '{name}' as name, count(*)::bigint as n from {table}" for name, table in (("codebook", "book"), ("histograms", "hist"), ("idf", "idf"), ("postings", "post"), ("norms", "norms"))),
        "visual_histogram": _BASE + "select image_id, word, round(tf, 6) as tf from hist",
        "visual_idf": _BASE + "select word, df, round(idf, 6) as idf from idf",
        "visual_postings": _BASE + "select word, image_id, round(w, 6) as w from post",
        "visual_norms": _BASE + "select image_id, round(norm, 6) as norm from norms",
        "visual_query_vector": _BASE + "select word, round(wq, 6) as wq from vec",
        "visual_search_sequential": _BASE + f"select image_id, score from seq {best}",
        "visual_search_inverted": _BASE + found,
        "visual_search_hits": _BASE
        + f", hits as ({found}) select image_id::varchar as id, score, coalesce(p_name, '{vs.NO_TITLE}') as title, coalesce(p_brand, '') as gender, coalesce(p_size::varchar, '') as year, "
        f"concat('{vs.BASE_URL}', image_id) as url from hits left join part on p_partkey = image_id",
        "mode_agreement": _BASE + f"select seq.image_id, seq.score as seq_score, coalesce(case when exact > {vs.LEAST_SCORE} then inv.score end, 0.0) as inv_score from seq left join inv on seq.image_id = inv.image_id",
        "inner_product_topk": f"with e as (select vec_id, embedding::double[] as vec from embeddings) select vec_id, round(list_inner_product(vec, (select vec from e where vec_id = {QUERY_IMAGE})), 6) as ip from e order by ip desc, vec_id limit {K}",
        "bench_sequential_topk": _bench_sql("seq"),
        "bench_inverted_topk": _bench_sql("inv"),
        "cluster_stats": _BASE
        + "select count(*)::bigint as k, count(*) filter (n = 0)::bigint as n_empty, min(n) as min_size, median(n)::double as median_size, round(avg(n), 6) as mean_size, max(n) as max_size "
        "from (select b.word, count(w.vec_id)::bigint as n from book b left join words w on w.word = b.word group by 1)",
    }
