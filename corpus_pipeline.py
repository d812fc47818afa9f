"""A corpus pipeline: toxicity, near-duplicates, personal data, the mix of sources, packing.

Each stage works on the documents that its predecessor kept. All but the last
return documents; the last returns their pieces and where they are packed. A
document that the mix takes more than once is packed more than once.

Encoding and MinHash are beyond SQL, so there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brambling.llm.common import documents, labels, stored, tidy
from brambling.llm.minhash import keep_one
from brambling.llm.mixing import mixed_documents
from brambling.llm.packing import pack, pieces
from brambling.llm.pii import sanitise
from brambling.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, labels(spark, sf_dir))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again for the next one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage, name, spark, docs, sf_dir)
    return STAGES[-1][1](spark, docs, sf_dir)


@tidy
def written(stage, name: str, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A stage's documents as a table; what the stage itself has written goes."""
    return stored(stage(spark, docs, sf_dir), f"stage-{name}")
