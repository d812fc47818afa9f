"""The folder that the driver and all executors share, for tables that outlive one query."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import cache

from pyspark.sql import SparkSession


@cache
def _local_dir(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="brambling-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def _named(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def has_shared_dir(spark: SparkSession) -> bool:
    return bool(_named(spark)) or _is_local(spark)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a temporary folder in local mode, and an error on a cluster, whose executors would each write to their own disk."""
    if folder := _named(spark):
        return folder.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir(spark.sparkContext.applicationId)
