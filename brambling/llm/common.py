"""What the operators of this subpackage share: scratch tables, clean inputs, sharding."""

from __future__ import annotations

import atexit
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.sources.scratch import shared_dir

#: Stands for a null doc_id where ids are compared: it sorts after every other one.
LAST_ID = (1 << 63) - 1
#: Tables of up to this many short rows (an id or two, a number) are broadcast after they have been counted; larger ones are joined by a shuffle.
BROADCAST_ROWS = 300_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, whatever other columns there are; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_key() -> Column:
    """Tells rows of one doc_id apart by their text, so that repeated ids do not mix."""
    return F.xxhash64("text")


def id_key() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(LAST_ID))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner clears it
        return


#: Scratch tables that still exist, in the order in which they were written.
_made: list[tuple[SparkSession, str]] = []


def _remove_all() -> None:
    for spark, path in _made:
        _remove(spark, path)


atexit.register(_remove_all)


def _roots(df: DataFrame) -> set[str]:
    """The folders that a DataFrame reads, without their scheme."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out: set[str] = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            out |= {paths.apply(k).toUri().getPath() for k in range(paths.size())}
    return out


def tidy(operator: Callable) -> Callable:
    """An operator that, when it returns, drops the scratch tables that it has written and its result does not read."""

    @functools.wraps(operator)
    def run(*args, **kwargs):
        first = len(_made)
        out = operator(*args, **kwargs)
        used = _roots(out) if isinstance(out, DataFrame) else set()
        own = _made[first:]
        _made[first:] = [(s, p) for s, p in own if any(p.endswith(u) for u in used)]
        for spark, path in own:
            if not any(path.endswith(u) for u in used):
                _remove(spark, path)
        return out

    return run


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared scratch folder and reads it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brambling/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def shards_for(n: int, rows: int = 20_000, least: int = 16) -> int:
    """Into how many shards n rows are dealt, so that a shard of any hot key has few of them."""
    return max(least, -(-n // rows))
