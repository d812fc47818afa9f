"""Streaming extension: documents that arrive are analysed and their term counts appended; weights are derived when an index is loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brambling.operators.text_index import TextIndex, from_frequencies, last_rows, n_build, term_frequencies


def append_documents(stream: DataFrame, folder: str, checkpoint: str, stem: bool = True) -> StreamingQuery:
    """Writes each micro-batch's documents and term counts under its number, so that a batch that is run again replaces itself."""

    def batch(docs: DataFrame, number: int) -> None:
        docs.write.mode("overwrite").parquet(f"{folder}/documents/batch={number}")
        term_frequencies(docs, stem).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_appended(spark, folder: str) -> TextIndex:
    docs = spark.read.parquet(f"{folder}/documents")
    frequencies = spark.read.parquet(f"{folder}/counts").groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    shown = last_rows(docs.select("doc_id", "text", "name", F.col("batch").alias("ord")))
    return from_frequencies(frequencies, n_build(docs), shown)
