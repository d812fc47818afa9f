import math
import os
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brambling.functions.analysis import SEPARATORS, spanish_stopwords, stemmed, tokens
from brambling.functions.snippets import snippet
from brambling.operators import text_index as ti
from brambling.operators import text_search as ts
from brambling.plans import registry
from brambling.service import Engine
from brambling.sources.tables import IndexStore, read_corpus_csv

SMALL = "/root/testdata/sf0.001"


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, name string")


def test_tokens_fold_cut_and_drop_stopwords(spark):
    df = spark.createDataFrame([("¡Canción, de   la NIÑA!  x-y",), ("",), (None,), ("de la",)], "text string")
    assert [r[0] for r in df.select(tokens(F.col("text"))).collect()] == [["canción", "niña", "x"] + (["y"] if "y" not in spanish_stopwords() else []), [], [], []]


@pytest.mark.parametrize(
    "word, stem",
    [("chica", "chic"), ("chicharrones", "chicharron"), ("cheques", "chequ"), ("checar", "chec"), ("torá", "tor"), ("toreándolo", "tor"), ("toreado", "tor"), ("tormentas", "torment"), ("torneos", "torne"), ("torreón", "torreon"), ("torrenciales", "torrencial")],
)
def test_stems(spark, word, stem):
    key = "_stems"
    if not hasattr(test_stems, key):
        words = ["chica", "chicharrones", "cheques", "checar", "torá", "toreándolo", "toreado", "tormentas", "torneos", "torreón", "torrenciales"]
        setattr(test_stems, key, {r["term"]: r["stem"] for r in stemmed(spark.createDataFrame([(w,) for w in words], "term string")).collect()})
    assert getattr(test_stems, key)[word] == stem


def test_weights_norms_and_scores_by_hand(spark):
    docs = _corpus(spark, [(1, "gato gato perro", "a"), (2, "perro", "b"), (3, "perro pez", "c"), (4, "", "d")])
    index = ti.build_index(docs, stem=False)
    assert index.stats.collect()[0].asDict() == {"n_build": 4, "n_query": 3, "n_terms": 3, "n_postings": 5}
    w = {(r["term"], r["doc_id"]): r["w"] for r in index.postings.collect()}
    assert w["gato", 1] == pytest.approx((1 + math.log(2)) * math.log(4))
    assert w["perro", 2] == pytest.approx(math.log(4 / 3))
    norms = {r["doc_id"]: r["norm"] for r in index.norms.collect()}
    assert norms[2] == pytest.approx(math.log(4 / 3))
    assert {r["doc_id"]: r["norm"] for r in index.postings.select("doc_id", "norm").distinct().collect()} == norms
    # query weights use the three documents with a term: perro is in all of them, so it weighs nothing, yet its documents are candidates
    vector = ts.query_vector(ts.one_query(spark, "perro"), index)
    assert [(r["term"], r["wq"]) for r in vector.collect()] == [("perro", 0.0)]
    found = ts.top_k(ts.cosine_scores(vector, index).select("doc_id", "score"), 10).collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert [tuple(r) for r in ts.search(index, ts.analysed(spark, "perro"), 10).collect()] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert ts.analysed(spark, "Perro de gato, perro") == {"perro": 2, "gato": 1} and ts.analysed(spark, "de la") == {}
    assert ts.search(index, {}, 10).count() == ts.search(index, {"zzz": 1}, 10).count() == 0


def test_stopwords_are_those_that_spark_ships():
    import glob
    import zipfile

    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if not jars:
        pytest.skip("no jar beside the package")
    with zipfile.ZipFile(jars[0]) as z:
        assert set(spanish_stopwords()) == set(z.read("org/apache/spark/ml/feature/stopwords/spanish.txt").decode().split())


def test_queries_and_sql_load_without_jars_or_optional_modules(tmp_path):
    """In a process of its own, without a Spark folder, and with the optional subpackage's dependencies missing."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = """
import sys, pyspark
pyspark.__file__ = sys.argv[2] + "/pyspark/__init__.py"
sys.path.insert(0, sys.argv[1])
if sys.argv[3] == "1":
    sys.modules["re._parser"] = sys.modules["brambling.llm"] = sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()))
"""
    for missing in "01":
        out = subprocess.run([sys.executable, "-c", code, root, str(tmp_path), missing], capture_output=True, text=True, env={**os.environ, "SPARK_HOME": str(tmp_path)}, check=True)
        n, n_sql = map(int, out.stdout.split()[-2:])
        assert n >= n_sql >= 40


def test_queries_of_any_length(spark):
    """Beyond 10,000 words, as one query and as one of many."""
    docs = _corpus(spark, [(1, "gato", "a"), (2, "perro", "b"), (3, "pez", "c")])
    index = ti.build_index(docs, stem=False)
    text = " ".join(f"w{i}" for i in range(12_000)) + " gato"
    assert [tuple(r) for r in ts.search(index, ts.analysed(spark, text)).collect()] == [(1, 1.0)]
    many = ts.query_words(spark.createDataFrame([(7, text), (8, "pez pez")], "query_id long, text string"))
    assert many.filter("query_id = 7").count() == 12_001
    found = ts.top_k_each(ts.cosine_scores(ts.query_vector(many, index), index), 5).collect()
    assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in found) == [(7, 1, 1.0), (8, 3, 1.0)]


def test_separators_as_ranges_are_the_same(spark):
    """Over all code points; a negated class takes several times as long."""
    assert "^" not in SEPARATORS
    df = spark.createDataFrame(pa.table({"c": [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]}))
    assert df.filter(F.regexp_replace("c", SEPARATORS, " ") != F.regexp_replace("c", "[^a-z0-9áéíóúñü]+", " ")).isEmpty()
    assert df.filter(F.regexp_replace("c", SEPARATORS, "") != "").count() == 43


def _exchanges(df) -> int:
    return len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))


def test_words_are_counted_in_their_row(spark):
    docs = _corpus(spark, [(1, "gato de perro gato, ßgato perro gato", "a"), (2, "", "b"), (3, None, "c"), (4, "pez", "d")])
    counts = ti.term_frequencies(docs)
    assert _exchanges(counts) == 0
    assert sorted(map(tuple, counts.collect())) == [("gato", 1, 4), ("perro", 1, 2), ("pez", 4, 1)]
    assert sorted(map(tuple, ti.term_frequencies(docs, stopwords=("gato",)).collect())) == [("de", 1, 1), ("perro", 1, 2), ("pez", 4, 1)]
    again = docs.union(docs)
    assert sorted(map(tuple, ti.term_frequencies(again).collect())) == [("gato", 1, 8), ("perro", 1, 4), ("pez", 4, 2)]


def test_blocks_shuffle_nothing(spark):
    docs = _corpus(spark, [(99, "gato perro gato", "a"), (100, "gato", "b"), (101, "pez", "c")])
    blocks = ti.blocks_by_docs(docs)
    assert _exchanges(blocks) == 0
    assert _exchanges(ti.merge_blocks(blocks)) == 1
    assert sorted(map(tuple, blocks.collect())) == [(0, "gato", 99, 2), (0, "perro", 99, 1), (1, "gato", 100, 1), (1, "pez", 101, 1)]


def test_block_merge_shuffles_terms_not_postings(spark):
    """One exchange by term, of rows that were added up before it; the same as by way of the postings, with ids repeated, null and below zero."""
    plan = registry.queries()["block_merge_equals_direct"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert len(keys) == 1 and re.fullmatch(r"term#\d+", keys[0]) and plan.count("HashAggregate") == 2
    rows = [(99, "gato perro gato", "a"), (100, "gato", "b"), (101, "pez", "c"), (-1, "pez pez", "d"), (None, "gato", "e"), (205, "", "f"), (206, None, "g")]
    for more in ([], [(99, "gato pez", "h"), (None, "gato luna", "i"), (205, "luna", "j")]):
        blocks = ti.blocks_by_docs(_corpus(spark, rows + more).repartition(3))
        direct = ti.merge_blocks(blocks).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        assert sorted(map(tuple, ti.merge_dictionaries(blocks).collect())) == sorted(map(tuple, direct.collect()))
    assert ("gato", 3, 6) in map(tuple, ti.merge_dictionaries(blocks).collect())


def test_repeated_ids_add_up_and_show_the_last_row(spark):
    docs = spark.createDataFrame([(1, "gato", "old", 0), (1, "gato pez", "new", 1), (2, "pez", "x", 2)], "doc_id long, text string, name string, ord long")
    index = ti.build_index(docs, stem=False)
    assert {(r["term"], r["doc_id"]): r["tf"] for r in index.postings.collect()} == {("gato", 1): 2, ("pez", 1): 1, ("pez", 2): 1}
    assert {r["doc_id"]: r["name"] for r in index.documents.collect()} == {1: "new", 2: "x"}


def test_csv_edges(spark, tmp_path):
    """Quoted commas and line feeds, places from the end, a null text, and of a repeated id the last row of the file."""
    path = tmp_path / "odd.csv"
    path.write_text('id,lyrics,other\n1,"a, b\nc",x\n2,,y\n1,"last ""one""",z\n', encoding="utf-8")
    docs = read_corpus_csv(spark, str(path), -3, -2)
    assert [(r["doc_id"], r["text"], r["name"]) for r in docs.collect()] == [("1", "a, b\nc", None), ("2", None, None), ("1", 'last "one"', None)]
    assert {r["doc_id"]: r["text"] for r in ti.last_rows(docs).collect()} == {"1": 'last "one"', "2": None}
    from brambling.sources.tables import write_prefixes

    write_prefixes(docs.drop("ord").filter("text is not null"), "text", [1, 2], str(tmp_path / "out"))
    assert [spark.read.csv(f"{tmp_path}/out/prefix_{n}", header=True, multiLine=True).count() for n in (1, 2)] == [1, 2]


def test_long_lists_come_in_parts(spark):
    index = ti.build_index(_corpus(spark, [(i, "gato" if i else "gato pez", "a") for i in range(50)]), stem=False)
    rows = ti.nested(index.postings, index.dictionary, most=8).collect()
    lists = [[p["doc_id"] for p in r["postings"]] for r in rows if r["term"] == "gato"]
    assert sorted(sum(lists, [])) == list(range(50)) and all(x == sorted(x) for x in lists) and len(lists) > 4 and len(rows) == len(lists) + 1


def test_lists_are_shuffled_once(spark):
    rows = spark.createDataFrame([("gato", 1, 1, 0.5, 1.0)], "term string, doc_id long, tf long, w double, norm double")
    plan = ti.nested(rows, spark.createDataFrame([("gato", 1, 0.5)], "term string, df long, idf double"))
    assert _exchanges(plan) == 1 and "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [2, 300_000])
def test_batches_equal_single_searches(spark, monkeypatch, rows):
    """All queries at once, or in parts; also a query without known words, and ties."""
    words = ["gato", "perro", "pez", "ave", "sol"]
    index = ti.build_index(_corpus(spark, [(i, " ".join(words[j] for j in range(5) if (i * 7 + j * 3) % (j + 2) == 0) or "mar", "a") for i in range(40)]), stem=False)
    asked = {1: "gato perro", 2: "pez", 3: "sol sol ave", 4: "zzz", 5: "mar gato"}
    want = {q: [tuple(r) for r in ts.search(index, ts.analysed(spark, text), 4).collect()] for q, text in asked.items()}
    monkeypatch.setattr(ts, "BROADCAST_ROWS", rows)
    vector = ts.query_vector(ts.query_words(spark.createDataFrame(list(asked.items()), "query_id long, text string")), index)
    got = sorted(map(tuple, ts.search_each(vector, index, 4).collect()))
    assert got == [(q, k + 1, *hit) for q in sorted(want) for k, hit in enumerate(want[q])] and len(got) == 16
    with pytest.raises(ValueError):
        ts.search_each(vector, index, -1)


def test_postings_stay_for_few_queries(spark, tmp_path):
    index = IndexStore(spark, str(tmp_path)).save_text("a", _corpus(spark, [(1, "gato gato perro", "x"), (2, "perro", "y")]), stem=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        vector = ts.query_vector(ts.one_query(spark, "gato"), index)
        plan = ts.partial_scores(vector, index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin Inner" not in plan.split("BroadcastExchange")[0] and "BroadcastHashJoin [term" in plan


def test_block_plan():
    assert ti.plan_blocks(18_000, 512) == (8738, 3) and ti.plan_blocks(0)[1] == 1


def test_store_publishes_versions(spark, tmp_path):
    from brambling.service import build_with_statistics, index_sizes

    store = IndexStore(spark, str(tmp_path))
    first = store.save_text("a", _corpus(spark, [(1, "gato perro", "x"), (2, "perro", "y")]), stem=False)
    store.save_text("a", _corpus(spark, [(1, "gato", "x")]), stem=False)
    assert first.postings.count() == 3 and store.load("a").postings.count() == 1
    store.save_text("a", _corpus(spark, []), stem=False)
    assert len(store._versions("a", "text")) == 2 and store.load("a").stats.collect()[0]["n_build"] == 0
    assert not store.exists("b") and not store.exists("a", "visual")
    with pytest.raises(FileNotFoundError):
        store.load("b")
    told = build_with_statistics(store, "a", _corpus(spark, [(1, "gato perro", "x"), (2, "perro", "y")]), stem=False)
    assert told["rows"] == index_sizes(store, "a") == {"documents": 2, "dictionary": 2, "postings": 3, "norms": 2, "stats": 1}
    assert told["seconds"] > 0 and told["throughput"] > 0 and told["megabytes"]["postings"] > 0
    assert store.dictionary_lookup("a", ["perro", "zzz"]).count() == 1 and store.postings_batch("a", ["perro"]).count() == 2


@pytest.mark.parametrize("most", [1, 200_000])
@pytest.mark.parametrize("stem", [False, True])
def test_stored_tables_equal_derived_ones(spark, tmp_path, monkeypatch, most, stem):
    """With frequent terms only among the broadcast ones, or all of them; rows that share an id, documents without words."""
    monkeypatch.setattr(ti, "BROADCAST_TERMS", most)
    rows = [(i, f"gatos gato {'perros' if i % 3 else ''} w{i} canciones, canción", "a") for i in range(40)] + [(50, "de la", "b"), (51, None, "c"), (52, "", "d")]
    for k, docs in enumerate((_corpus(spark, rows), _corpus(spark, [*rows, (3, "gato pez", "e")]))):
        got, want = IndexStore(spark, str(tmp_path)).save_text(f"a{k}", docs, stem), ti.build_index(docs, stem)
        for table in ("dictionary", "postings", "norms", "stats"):
            a, b = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in getattr(index, table).collect()) for index in (got, want))
            assert a == b and a
        own = [[(r["term"], r["doc_id"]) for r in part] for part in got.postings.rdd.glom().collect()]
        assert all(part == sorted(part) for part in own)


def test_building_sorts_for_no_join(spark):
    docs = _corpus(spark, [(1, "gato gato perro", "a"), (2, "perro", "b")])
    words, terms = ti.document_words(docs), ti.dictionary(ti.term_frequencies(docs), ti.n_build(docs))
    lengths = ti.document_norms(words, terms)
    for df in (lengths, ti.laid_out(words, terms, lengths), ti.term_frequencies(docs, stem=True)):
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from brambling.sources.scratch import has_shared_dir, shared_dir

    def fake(master, folder):
        conf = SimpleNamespace(get=lambda *a: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master=master, applicationId="app"))

    assert shared_dir(fake("spark://a:7077", "hdfs://b/c/")) == "hdfs://b/c" and not has_shared_dir(fake("yarn", None))
    assert shared_dir(fake("local[2]", None)).startswith("file:///")
    with pytest.raises(RuntimeError):
        shared_dir(fake("yarn", None))


def test_snippet_window(spark):
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(" ".join(words), ["w100"]), ("Uno DOS tres", ["dos"]), ("", ["x"]), (" ".join(words), ["zz"]), (" ".join(words), ["w3"])], "text string, terms array<string>")
    got = [r[0].split(" ") for r in df.select(snippet(F.col("text"), F.col("terms"))).collect()]
    assert got[0] == words[60:140]
    assert got[1] == ["Uno", "DOS", "tres"]
    assert got[2] == [""]
    assert got[3] == words[:40]
    assert got[4] == words[:43]


def test_top_k_rejects_negative(spark):
    with pytest.raises(ValueError):
        ts.top_k(spark.createDataFrame([(1, 0.5)], "doc_id long, score double"), -1)


def test_csv_store_and_service(spark, tmp_path):
    path = tmp_path / "songs.csv"
    path.write_text('id,track_name,lyrics\na,First,"amor, eterno\nsi ""te"" vas"\nb,Second,nada de amor\nc,Third,otra cosa\n', encoding="utf-8")
    docs = read_corpus_csv(spark, str(path), 0, -1)
    assert [tuple(r) for r in docs.select("doc_id", "name").orderBy("doc_id").collect()] == [("a", "First"), ("b", "Second"), ("c", "Third")]
    engine = Engine(spark, str(tmp_path / "indexes"))
    assert engine.search_text("amor", name="songs")["results"] == []
    engine.build_text("songs", str(path), 0, 2)
    found = engine.search_text("amores eternos", k=5, name="songs")
    assert [r["doc_id"] for r in found["results"]] == ["a", "b"]
    assert found["results"][0]["score"] <= 1 and found["execution_time"] > 0
    assert engine.search_text("zzzz", name="songs")["results"] == []
    plan = engine.store.postings_batch("songs", ["amor"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "amor" in plan
    with pytest.raises(ValueError):
        IndexStore(spark, str(tmp_path))._path("../x", "stats")


def test_streamed_index_equals_batch_index(spark, tmp_path):
    from brambling.streaming.incremental import append_documents, load_appended

    rows = [(1, "gato gato perro", "a"), (2, "perro", "b"), (3, "perro pez", "c")]
    docs = _corpus(spark, rows)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append_documents(stream, str(tmp_path / "out"), str(tmp_path / "cp"), stem=False).awaitTermination()
    got = {(r["term"], r["doc_id"], round(r["w"], 9)) for r in load_appended(spark, str(tmp_path / "out")).postings.collect()}
    want = {(r["term"], r["doc_id"], round(r["w"], 9)) for r in ti.build_index(docs, stem=False).postings.collect()}
    assert got == want


def _views(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    p = registry.queries()[name](spark, SMALL).toPandas()
    q = _views(SMALL).execute(registry.oracle_sql()[name]).df()
    c = sorted(p.columns)
    assert c == sorted(q.columns)
    assert sorted(map(tuple, p[c].astype(str).to_numpy())) == sorted(map(tuple, q[c].astype(str).to_numpy()))
