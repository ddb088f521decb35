"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Rows of one file. Readers put a bounded number of files into a task (each counts as 4 MB at least, a task takes 128 MB), so
#: the rows of a task are bounded too, however well they are packed.
FILE_ROWS = 150_000


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local session may fall back to a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="watchmill-")
    return _own[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/watchmill/{name}-{uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several branches read, and read it back.

    A written table is computed once, cuts the lineage, and survives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
