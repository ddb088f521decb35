"""Versions of metric tables: what a run wrote counts from the moment its row in the ledger is there (S6, ST2).

A run writes its metric rows and its state to folders of its own number, and its ledger rows last, in one file. Readers go by the
ledger alone: a run that was killed before its last write is invisible, and its number is used again by the next one, which
overwrites what is left of it. A full run replaces everything before it; any other run replaces the partitions it lists, those
included that have no rows any more. One table is worked on by one run at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTITIONS = ["granularity", "window_date"]
_ROWS = "run int, is_full boolean, mark string, settings string, kind string, granularity string, window_date date"


@dataclass(frozen=True)
class Committed:
    """The last committed run, the last full one, the mark up to which rows were taken in, and the settings they hold for."""

    run: int = 0
    full: int = 0
    mark: str | None = None
    settings: str | None = None


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a ledger; none if there is no ledger yet."""
    try:
        return spark.read.schema(_ROWS).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ROWS)


def committed(spark: SparkSession, path: str) -> Committed:
    """The state of a ledger, as one row."""
    last = F.max(F.struct("run", "mark", "settings")).alias("last")
    row = ledger(spark, path).agg(last, F.max(F.when(F.col("is_full"), F.col("run"))).alias("full")).first()
    return Committed() if row.last is None else Committed(row.last.run, row.full, row.last.mark, row.last.settings)


def commit(
    spark: SparkSession, path: str, run: int, *, full: bool, mark: str | None = None, settings: str | None = None, replaced: DataFrame | None = None
) -> None:
    """The last write of a run. ``replaced`` lists (kind, granularity, window_date) that a run other than a full one replaces."""
    head = spark.createDataFrame([(run, full, mark, settings, None, None, None)], _ROWS)
    rows = head
    if replaced is not None:
        facts = [F.lit(run).alias("run"), F.lit(full).alias("is_full"), F.lit(mark).cast("string").alias("mark"), F.lit(settings).cast("string").alias("settings")]
        rows = head.unionByName(replaced.select(*facts, "kind", *_PARTITIONS).distinct())
    # One file, so that the rows of a run are there together or not at all.
    rows.coalesce(1).write.mode("append").parquet(path)


def write_version(metrics: DataFrame, path: str, run: int) -> None:
    """Metric rows of a run, by granularity and window date. What an uncommitted run of that number left is replaced."""
    dated = metrics.withColumn("window_date", F.to_date("window.start"))
    dated.repartition(*_PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*_PARTITIONS).parquet(f"{path}/run={run}")


def read_version(spark: SparkSession, path: str, ledger_path: str, schema: T.StructType, kind: str) -> DataFrame:
    """The metric rows that committed runs stand for: of every partition those of the last run that replaced it."""
    last = committed(spark, ledger_path)
    if not last.run:
        return spark.createDataFrame([], schema)
    places = T.StructType([T.StructField("window_date", T.DateType()), T.StructField("run", T.IntegerType())])
    rows = spark.read.schema(T.StructType([*schema.fields, *places.fields])).parquet(path)
    rows = rows.filter(F.col("run").between(last.full, last.run))
    if last.run > last.full:
        later = ledger(spark, ledger_path).filter((F.col("kind") == kind) & F.col("run").between(last.full + 1, last.run))
        owners = later.groupBy(*_PARTITIONS).agg(F.max("run").alias("owner")).select(F.struct(*_PARTITIONS).alias("place"), "owner")
        rows = rows.withColumn("place", F.struct(*_PARTITIONS)).join(owners, "place", "left")
        rows = rows.filter(F.col("run") == F.coalesce("owner", F.lit(last.full)))
    return rows.select(*schema.fieldNames())
