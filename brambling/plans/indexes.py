"""The stored indexes that the named queries search, built by the first query of a session that needs one.

Where a cluster names no shared folder they are derived within each query instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brambling.operators.text_index import TextIndex, build_index
from brambling.operators.visual_index import VisualIndex, build_visual_index
from brambling.sources.scratch import has_shared_dir, shared_dir
from brambling.sources.tables import IndexStore

#: Names of the indexes that this process has built, by what they were built from.
_built: dict[tuple, str] = {}


def store(spark: SparkSession) -> IndexStore:
    return IndexStore(spark, f"{shared_dir(spark)}/brambling/indexes-{spark.sparkContext.applicationId}")


def _state(spark: SparkSession, path: str) -> tuple:
    """What tells a changed table from the one that was indexed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(p)
    return path, fs.getFileStatus(p).getModificationTime(), summary.getLength(), summary.getFileCount()


def _name(spark: SparkSession, path: str, *more) -> tuple[tuple, str | None]:
    key = (spark.sparkContext.applicationId, *_state(spark, path), *more)
    return key, _built.get(key)


def text_index(spark: SparkSession, path: str, docs: Callable[[], DataFrame], stem: bool) -> TextIndex:
    if not has_shared_dir(spark):
        return build_index(docs(), stem)
    key, name = _name(spark, path, "text", stem)
    if name is None:
        name = f"t{len(_built)}"
        store(spark).save_text(name, docs(), stem)
        _built[key] = name
    return store(spark).load(name)


def visual_index(spark: SparkSession, path: str, parts: Callable[[], tuple[DataFrame, DataFrame]]) -> VisualIndex:
    """parts gives descriptors and codebook."""
    if not has_shared_dir(spark):
        return build_visual_index(*parts())
    key, name = _name(spark, path, "visual")
    if name is None:
        name = f"v{len(_built)}"
        store(spark).save_visual(name, *parts())
        _built[key] = name
    return store(spark).load_visual(name)
