"""Text queries over the documents table, each with its SQL.

Queries that search do so on a stored index, which the first of them in a
session builds; queries that are named after a table of the index show that table
of the same index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brambling.functions.analysis import spanish_stopwords, stem_steps, tokens
from brambling.functions.snippets import snippet
from brambling.operators import text_index as ti
from brambling.operators import text_search as ts
from brambling.plans.indexes import store, text_index

QUERY, ABSENT, STEMMED, K = "the thing thnd The zzzz", "qqqqzzzz", "queso ciones osado adoras menteces", 10
TERMS = ["the", "thing", "thnd", "zzzz"]
PREFIXES = (50, 100, 200)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return ti.corpus(spark.read.parquet(f"{d}/documents.parquet"), name="source")


def _index(spark: SparkSession, d: str, stem: bool = False) -> ti.TextIndex:
    return text_index(spark, f"{d}/documents.parquet", lambda: _docs(spark, d), stem)


def _vector(spark: SparkSession, index: ti.TextIndex, text: str = QUERY, stem: bool = False) -> DataFrame:
    return ts.query_vector(ts.one_query(spark, text, stem), index)


def _scores(spark: SparkSession, index: ti.TextIndex) -> DataFrame:
    return ts.scores(ts.one_vector(ts.analysed(spark, QUERY), index), index)


def corpus_scan(spark, d):
    return _docs(spark, d)


def token_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


def term_frequency(spark, d):
    return ti.term_frequencies(_docs(spark, d))


def text_index_build(spark, d):
    """Rows of each table of an index that is built and stored anew."""
    name = "built"
    store(spark).save_text(name, _docs(spark, d), stem=False)
    rows = store(spark).sizes(name)
    tables = ("dictionary", "postings", "norms")
    return spark.createDataFrame([(t, rows[t][0]) for t in tables], "name string, n long")


def document_frequency(spark, d):
    return _index(spark, d).dictionary.withColumn("idf", F.round("idf", 6))


def blocks_by_docs(spark, d):
    per_block = ti.blocks_by_docs(_docs(spark, d)).groupBy("block_id", "term").agg(F.count("*").alias("_n"))
    return per_block.groupBy("block_id").agg(F.count("*").alias("n_terms"), F.sum("_n").alias("n_postings"))


def block_merge_equals_direct(spark, d):
    return ti.merge_dictionaries(ti.blocks_by_docs(_docs(spark, d)))


def postings_weighted(spark, d):
    return _index(spark, d).postings.select("term", "doc_id", F.round("w", 6).alias("w"))


def postings_nested(spark, d):
    index = _index(spark, d)
    listed = ti.nested(index.postings, index.dictionary)
    first, last = F.element_at("postings", 1)["doc_id"], F.element_at("postings", -1)["doc_id"]
    return listed.groupBy("term").agg(F.sum(F.size("postings")).alias("n_postings"), F.min(first).alias("first_doc"), F.max(last).alias("last_doc"))


def document_norms(spark, d):
    return _index(spark, d).norms.withColumn("norm", F.round("norm", 6))


def index_stats(spark, d):
    return _index(spark, d).stats


def dictionary_lookup(spark, d):
    return _index(spark, d).dictionary.filter(F.col("term").isin(TERMS)).select("term", "df")


def postings_batch(spark, d):
    return _index(spark, d).postings.filter(F.col("term").isin(TERMS)).select("term", "doc_id", F.round("w", 6).alias("w"))


def query_vector(spark, d):
    return _vector(spark, _index(spark, d)).select("term", F.round("wq", 6).alias("wq"))


def partial_scores(spark, d):
    index = _index(spark, d)
    return ts.partial_scores(_vector(spark, index), index).select("doc_id", F.round("dot", 6).alias("dot"))


def cosine_scores(spark, d):
    index = _index(spark, d)
    return ts.cosine_scores(_vector(spark, index), index).select("doc_id", "score")


def text_search_topk(spark, d):
    index = _index(spark, d)
    return ts.search(index, ts.analysed(spark, QUERY), K)


def text_search_hits(spark, d):
    index = _index(spark, d)
    words = ts.analysed(spark, QUERY)
    return ts.with_snippets(ts.search(index, words, K), index, list(words))


def snippet_fallback(spark, d):
    return _docs(spark, d).select("doc_id", snippet(F.col("text"), F.array(F.lit(ABSENT))).alias("snippet"))


def text_search_empty(spark, d):
    index = _index(spark, d)
    return ts.search(index, ts.analysed(spark, ABSENT), K)


def text_search_batch(spark, d):
    index = _index(spark, d)
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return ts.search_each(ts.query_vector(ts.query_words(asked), index), index, K)


def text_search_stemmed(spark, d):
    index = _index(spark, d, stem=True)
    return ts.search(index, ts.analysed(spark, STEMMED, stem=True), K)


def prefix_sample(spark, d):
    numbered = _docs(spark, d).orderBy("doc_id").limit(max(PREFIXES)).withColumn("_r", F.row_number().over(Window.orderBy("doc_id")))  # the largest prefix
    sizes = F.broadcast(spark.createDataFrame([(n,) for n in PREFIXES], "n long"))
    words = numbered.join(sizes, F.col("_r") <= F.col("n")).select("n", "doc_id", F.explode_outer(tokens(F.col("text"))).alias("term"))
    return words.groupBy("n").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("term").alias("n_terms"))


def text_search_filtered(spark, d):
    """Beyond parity: the best documents of one language."""
    index = _index(spark, d)
    scores = _scores(spark, index).select("doc_id", "score")
    chosen = spark.read.parquet(f"{d}/documents.parquet").filter("lang = 'en'").select("doc_id")
    return ts.top_k(scores.join(chosen, "doc_id", "left_semi"), K)


def text_search_all_terms(spark, d):
    """Beyond parity: only documents that have every known query term."""
    index = _index(spark, d)
    vector = ts.one_vector(ts.analysed(spark, QUERY), index)
    return ts.top_k(ts.scores(vector, index).filter(F.col("n_terms") == len(vector)).select("doc_id", "score"), K)


QUERIES = {
    f.__name__: f
    for f in (
        corpus_scan, token_counts, term_frequency, text_index_build, document_frequency, blocks_by_docs, block_merge_equals_direct, postings_weighted, postings_nested, document_norms, index_stats,
        dictionary_lookup, postings_batch, query_vector, partial_scores, cosine_scores, text_search_topk, text_search_hits, snippet_fallback, text_search_empty, text_search_batch,
        text_search_stemmed, prefix_sample, text_search_filtered, text_search_all_terms,
    )
}


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _cut(table: str, key: str, where: str = "") -> str:
    """Tokens of a table's texts."""
    return (
        f"select {key}, t as term from (select {key}, unnest(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9áéíóúñü]+', ' ', 'g')), ' ')) as t from {table} {where}) "
        f"where t <> '' and t not in ({_list(spanish_stopwords())})"
    )


def _base(tok: str) -> str:
    return f"""with tok as ({tok}),
tf as (select term, doc_id, count(*)::bigint as tf from tok group by all),
n as (select count(*)::bigint as n_build from documents),
dict as (select term, count(*)::bigint as df, ln(any_value(n_build) / count(*)) as idf from tf, n group by term),
post as (select term, doc_id, tf, (1 + ln(tf)) * idf as w from tf join dict using (term)),
norms as (select doc_id, sqrt(sum(w * w)) as norm from post group by doc_id),
nq as (select count(*)::bigint as n_query from norms)
"""


def _scored(words: list[str]) -> str:
    """CTEs of one query's vector and scores, after _base."""
    counts = {w: words.count(w) for w in words}
    rows = ", ".join(f"('{w}', {n})" for w, n in counts.items())
    return f""", q as (select * from (values {rows}) as v(term, qtf)),
raw as (select term, (1 + ln(qtf)) * ln(n_query / df) as raw from q join dict using (term), nq),
vec as (select term, case when (select sqrt(sum(raw * raw)) from raw) > 0 then raw / (select sqrt(sum(raw * raw)) from raw) else raw end as wq from raw),
dots as (select doc_id, sum(wq * w) as dot from vec join post using (term) group by doc_id),
scores as (select doc_id, round(least(1.0, greatest(0.0, case when norm > 0 then dot / norm else 0.0 end)), 6) as score from dots left join norms using (doc_id))
"""


def _snippet(terms: list[str]) -> str:
    found = f"list_transform(ws, lambda w: list_bool_or(list_transform([{_list(terms)}], lambda t: contains(lower(w), t))))"
    return f"array_to_string(case when list_position({found}, true) > 0 then list_slice(ws, greatest(1, list_position({found}, true) - 40), list_position({found}, true) + 39) else list_slice(ws, 1, 40) end, ' ')"


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"


def _stemmed_sql() -> str:
    chain, last = [], "vocabulary"
    for i, (name, sql) in enumerate(stem_steps("term")):
        chain.append(f"s{i} as (select *, {sql} as {name} from {last})")
        last = f"s{i}"
    words = STEMMED.split()
    raw = "raw_tok as (" + _cut("documents", "doc_id") + ")"
    asked = "asked as (select unnest([" + _list(words) + "]) as term)"
    vocabulary = "vocabulary as (select distinct term from (select term from raw_tok union all select term from asked))"
    head = f"with {raw}, {asked}, {vocabulary}, {', '.join(chain)}, tok as (select doc_id, stem as term from raw_tok join {last} using (term)), "
    base = _base("select 1").split("tf as", 1)[1]
    q = f"q as (select stem as term, count(*) as qtf from asked join {last} using (term) group by 1)"
    return head + "tf as" + base + ", " + q + _scored(["x"]).split("as v(term, qtf))", 1)[1] + f"select doc_id, score from scores order by score desc, doc_id limit {K}"


def sql() -> dict[str, str]:
    base = _base(_cut("documents", "doc_id"))
    words = QUERY.lower().split()
    one, absent = base + _scored(words), base + _scored([ABSENT])
    block = "with b as (select doc_id // 100 as block_id, term, doc_id, count(*)::bigint as tf from (" + _cut("documents", "doc_id") + ") group by all) "
    batch_q = f""", qt as (select query_id, term, count(*) as qtf from ({_cut('(select item_id as query_id, text from benchmark)', 'query_id')}) group by all),
raw as (select query_id, term, (1 + ln(qtf)) * ln(n_query / df) as raw from qt join dict using (term), nq),
vec as (select query_id, term, case when sqrt(sum(raw * raw) over (partition by query_id)) > 0 then raw / sqrt(sum(raw * raw) over (partition by query_id)) else raw end as wq from raw),
dots as (select query_id, doc_id, sum(wq * w) as dot from vec join post using (term) group by all),
scores as (select query_id, doc_id, round(least(1.0, greatest(0.0, case when norm > 0 then dot / norm else 0.0 end)), 6) as score from dots left join norms using (doc_id))
"""
    best = f"select doc_id, score from scores order by score desc, doc_id limit {K}"
    sizes = " union all ".join(f"select {n}::bigint as n" for n in PREFIXES)
    return {
        "corpus_scan": "select doc_id, text, source as name from documents",
        "token_counts": f"select d.doc_id, count(t.term)::bigint as n_tokens from documents d left join ({_cut('documents', 'doc_id')}) t on d.doc_id = t.doc_id group by 1",
        "term_frequency": base + "select term, doc_id, tf from tf",
        "text_index_build": base + "select 'dictionary' as name, count(*)::bigint as n from dict union all select 'postings', count(*)::bigint from post union all select 'norms', count(*)::bigint from norms",
        "document_frequency": base + "select term, df, round(idf, 6) as idf from dict",
        "blocks_by_docs": block + "select block_id, count(distinct term)::bigint as n_terms, count(*)::bigint as n_postings from b group by 1",
        "block_merge_equals_direct": base + "select term, count(*)::bigint as df, sum(tf)::bigint as cf from tf group by 1",
        "postings_weighted": base + "select term, doc_id, round(w, 6) as w from post",
        "postings_nested": base + "select term, count(*)::bigint as n_postings, min(doc_id) as first_doc, max(doc_id) as last_doc from post group by 1",
        "document_norms": base + "select doc_id, round(norm, 6) as norm from norms",
        "index_stats": base + "select n_build, n_query, (select count(*)::bigint from dict) as n_terms, (select sum(df)::bigint from dict) as n_postings from n, nq",
        "dictionary_lookup": base + f"select term, df from dict where term in ({_list(TERMS)})",
        "postings_batch": base + f"select term, doc_id, round(w, 6) as w from post where term in ({_list(TERMS)})",
        "query_vector": one + "select term, round(wq, 6) as wq from vec",
        "partial_scores": one + "select doc_id, round(dot, 6) as dot from dots",
        "cosine_scores": one + "select doc_id, score from scores",
        "text_search_topk": one + best,
        "text_search_hits": one + f", best as ({best}) select doc_id, score, source as name, {_snippet(TERMS)} as snippet from (select best.*, source, {_WORDS} as ws from best join documents using (doc_id))",
        "snippet_fallback": f"select doc_id, {_snippet([ABSENT])} as snippet from (select doc_id, {_WORDS} as ws from documents)",
        "text_search_empty": absent + best,
        "text_search_batch": base + batch_q + f"select query_id, rank, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scores) where rank <= {K}",
        "text_search_stemmed": _stemmed_sql(),
        "prefix_sample": f"with z as ({sizes}), d as (select *, row_number() over (order by doc_id) as r from documents), t as ({_cut('documents', 'doc_id')}) "
        "select n, count(distinct d.doc_id)::bigint as n_docs, count(distinct term)::bigint as n_terms from z join d on r <= n left join t on t.doc_id = d.doc_id group by n",
        "text_search_filtered": one + best.replace("from scores", "from scores where doc_id in (select doc_id from documents where lang = 'en')"),
        "text_search_all_terms": one + best.replace("from scores", "from scores where doc_id in (select doc_id from post join vec using (term) group by doc_id having count(*) = (select count(*) from vec))"),
    }
