"""Inverted index of a corpus: dictionary, postings, norms and sizes as DataFrames.

A corpus has doc_id, text and, optionally, name. Weights are (1 + ln tf) * idf
with idf = ln(rows of the corpus / documents of the term). Rows that share a
doc_id count as one document whose frequencies add up. Postings carry their
document's norm, so that a search needs no join with the norms.

Words travel with their document as one row until they are laid out by term, and
no join sorts: the hashed side is the dictionary or the norms. Only terms of which
there are few, because each is in many documents, are broadcast by hint; a term
that a third of all documents have is split by the adaptive skew join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambling.functions.analysis import is_token, stemmed, token_rows, word_counts


#: At most so many terms are broadcast: those that have at least this part of all postings each.
BROADCAST_TERMS = 200_000


class TextIndex(NamedTuple):
    """The tables of an index. stats has one row: n_build rows, n_query documents with a term, n_terms, n_postings."""

    documents: DataFrame
    dictionary: DataFrame
    postings: DataFrame
    norms: DataFrame
    stats: DataFrame


def corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    label = F.col(name).cast("string") if name else F.lit(None).cast("string")
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), label.alias("name"))


def repeated(docs: DataFrame) -> bool:
    """Whether rows share a doc_id; only ids are read."""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def counted(docs: DataFrame, keys: list[str | Column], stopwords: tuple[str, ...] | None = None) -> DataFrame:
    """The keys (the last one is the doc_id), term, tf. Words are counted within their row, without a shuffle, unless rows share an id."""
    if repeated(docs):
        rows = token_rows(docs, keys, stopwords=stopwords)
        return rows.groupBy(*rows.columns).agg(F.count("*").alias("tf"))
    return docs.select(*keys, F.inline(word_counts(F.col("text")))).filter(is_token(F.col("term"), stopwords))


def term_frequencies(docs: DataFrame, stem: bool = False, stopwords: tuple[str, ...] | None = None) -> DataFrame:
    """term, doc_id, tf. Words are counted before they are stemmed, and only distinct words are stemmed."""
    counts = counted(docs, ["doc_id"], stopwords).select("term", "doc_id", "tf")
    if not stem:
        return counts
    stems = stemmed(counts.select("term").distinct()).hint("shuffle_hash")
    rows = counts.join(stems, "term").select(F.col("stem").alias("term"), "doc_id", "tf")
    return rows.repartition("doc_id").groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def document_words(docs: DataFrame, stem: bool = False, stopwords: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, words (distinct, between blanks), tfs: the term frequencies with a short row for each document."""
    if stem or repeated(docs):
        rows = term_frequencies(docs, stem, stopwords)
        listed = rows.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("_words"))
    else:
        listed = docs.select("doc_id", F.filter(word_counts(F.col("text")), lambda w: is_token(w["term"], stopwords)).alias("_words"))
    return listed.select("doc_id", F.array_join("_words.term", " ").alias("words"), F.col("_words.tf").cast("array<int>").alias("tfs"))


def _word_rows(words: DataFrame, *keys: str) -> DataFrame:
    zipped = F.arrays_zip(F.split("words", " ").alias("term"), F.col("tfs").alias("tf"))
    return words.filter(F.size("tfs") > 0).select(*keys, F.inline(zipped).alias("term", "tf")).withColumn("tf", F.col("tf").cast("long"))


def flat_words(words: DataFrame) -> DataFrame:
    """term, doc_id, tf of document_words."""
    return _word_rows(words, "doc_id").select("term", "doc_id", "tf")


def n_build(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_build"))


def log_tf(tf: Column) -> Column:
    return 1 + F.ln(tf)


def dictionary(frequencies: DataFrame, rows: DataFrame) -> DataFrame:
    """term, df, idf; rows has one row with n_build."""
    df = frequencies.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(rows)).select("term", "df", F.ln(F.col("n_build") / F.col("df")).alias("idf"))  # one row


def weights(frequencies: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, tf, w."""
    return frequencies.join(terms, "term").select("term", "doc_id", "tf", (log_tf(F.col("tf")) * F.col("idf")).alias("w"))


def norms(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def postings(weighted: DataFrame, lengths: DataFrame) -> DataFrame:
    """term, doc_id, tf, w and the document's norm."""
    return weighted.join(lengths, "doc_id").select("term", "doc_id", "tf", "w", "norm")


def document_norms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, norm from document_words and a dictionary as written. Frequent terms' rows meet a broadcast and add up where they are; only rare ones' are shuffled by term."""
    n = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    often = terms.filter(F.col("df") * BROADCAST_TERMS >= n).select("term", "idf")
    rows, seldom = flat_words(words), terms.select("term", "idf").hint("shuffle_hash")
    rare = rows.join(F.broadcast(often.select("term")), "term", "left_anti").join(seldom, "term")  # at most BROADCAST_TERMS
    weighted = rows.join(F.broadcast(often), "term").unionByName(rare)  # at most BROADCAST_TERMS
    return norms(weighted.select("doc_id", (log_tf(F.col("tf")) * F.col("idf")).alias("w")))


def laid_out(words: DataFrame, terms: DataFrame, lengths: DataFrame) -> DataFrame:
    """Postings from document_words, each partition sorted by term and document. Whole documents are shuffled to their norms, single words once to their term."""
    rows = words.join(lengths.hint("shuffle_hash"), "doc_id")
    rows = _word_rows(rows, "doc_id", "norm").join(terms.select("term", "idf").hint("shuffle_hash"), "term")
    return rows.select("term", "doc_id", "tf", (log_tf(F.col("tf")) * F.col("idf")).alias("w"), "norm").sortWithinPartitions("term", "doc_id")


def nested(flat: DataFrame, terms: DataFrame, most: int = 65_536) -> DataFrame:
    """term, part, postings: a row for each term with its list. A list of more than `most` postings is dealt to several parts by a hash of the document."""
    long = terms.filter(F.col("df") > most).select("term", F.ceil(F.col("df") / most).alias("_parts"))  # at most postings / most rows
    own = flat.join(F.broadcast(long), "term", "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("_parts", F.lit(1))))
    placed = own.select("term", "part", "doc_id", "w").repartition("term", "part")
    return placed.groupBy("term", "part").agg(F.sort_array(F.collect_list(F.struct("doc_id", "w"))).alias("postings"))


def stats(rows: DataFrame, lengths: DataFrame, terms: DataFrame) -> DataFrame:
    return rows.crossJoin(lengths.agg(F.count("*").alias("n_query"))).crossJoin(terms.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings")))


def from_frequencies(frequencies: DataFrame, rows: DataFrame, shown: DataFrame) -> TextIndex:
    """All tables from term frequencies, the number of rows and the documents to display."""
    terms = dictionary(frequencies, rows)
    weighted = weights(frequencies, terms)
    lengths = norms(weighted)
    return TextIndex(shown, terms, postings(weighted, lengths), lengths, stats(rows, lengths, terms))


def build_index(docs: DataFrame, stem: bool = True, stopwords: tuple[str, ...] | None = None) -> TextIndex:
    """An index whose tables are derived when they are used; IndexStore.save_text writes one. Of rows that share a doc_id the last one is displayed, by `ord` if there is such a column."""
    return from_frequencies(term_frequencies(docs, stem, stopwords), n_build(docs), last_rows(docs))


def last_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, name of the last row of each id. Only ids are shuffled, unless some are repeated."""
    shown = docs.select("doc_id", "text", "name", (F.col("ord") if "ord" in docs.columns else F.monotonically_increasing_id()).alias("_ord"))
    if not repeated(shown):
        return shown.drop("_ord")
    last = shown.select("doc_id", "_ord").groupBy("doc_id").agg(F.max("_ord").alias("_ord"))
    return shown.join(last, ["doc_id", "_ord"], "left_semi").select("doc_id", "text", "name")


def blocks_by_docs(docs: DataFrame, per_block: int = 100, stopwords: tuple[str, ...] | None = None) -> DataFrame:
    """block_id, term, doc_id, tf of blocks of so many ids."""
    block = F.floor(F.col("doc_id") / per_block).alias("block_id")
    return counted(docs, [block, "doc_id"], stopwords).select("block_id", "term", "doc_id", "tf")


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """term, doc_id, tf of all blocks together."""
    return blocks.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def merge_dictionaries(blocks: DataFrame) -> DataFrame:
    """term, df, cf of all blocks together, if no document has postings of one term in two rows, as in blocks_by_docs: then what the blocks say of a term adds up, and postings stay where they are. Other blocks go through merge_blocks first."""
    return blocks.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def plan_blocks(total_docs: int, available_ram_mb: int = 512, doc_bytes: int = 30 * 1024) -> tuple[int, int]:
    """Documents in a block that half the memory holds, and how many blocks that makes."""
    per_block = int(available_ram_mb * 0.5 * 1024 * 1024 / doc_bytes)
    return per_block, total_docs // per_block + 1
