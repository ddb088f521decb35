"""Writing metric tables, publishing unified views and reports."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

logger = logging.getLogger(__name__)

# How the views of a group are named.
VIEW_PREFIXES = {
    "drift": "unified_drift_metrics_",
    "profile": "unified_profile_metrics_",
    "performance": "unified_performance_metrics_",
}
_PARTITIONS = ["granularity", "window_date"]


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as Parquet, by granularity and window date; only the partitions that occur are replaced."""
    dated = metrics.withColumn("window_date", F.to_date("window.start"))
    # One file per partition: the rows of one partition meet in one task, and they are metric rows, not data.
    (
        dated.repartition(*_PARTITIONS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*_PARTITIONS)
        .parquet(path)
    )


def read_written_metrics(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Metric rows from their folder. The schema is given, so a table without rows so far can be read as well."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def ensure_schema(spark: SparkSession, name: str) -> None:
    """Create the output schema if it is not there."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def publish(df: DataFrame, name: str, *, materialized: bool = False) -> None:
    """A session view, or a stored table when materialized."""
    if materialized:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)


def publish_groups(
    frames: dict[str, dict[str, callable]], *, materialized: bool = False, schema: str | None = None
) -> dict[str, dict[str, str]]:
    """Publish the views of every group; ``frames`` maps group slug -> kind -> a function giving the frame.

    With a ``schema`` they are stored as its tables, and other sessions can read them. A performance view that fails is
    left out; the others have to succeed.
    """
    materialized = materialized or schema is not None
    place = f"{schema}." if schema else ""
    published: dict[str, dict[str, str]] = {}
    for slug, kinds in frames.items():
        published[slug] = {}
        for kind, build in kinds.items():
            name = place + VIEW_PREFIXES[kind] + slug
            try:
                publish(build(), name, materialized=materialized)
            except Exception as error:
                if kind != "performance":
                    raise
                logger.warning("no performance view for group %s: %s", slug, error)
                continue
            published[slug][kind] = name
    return published


def stale_views(views: DataFrame, active_slugs: DataFrame) -> DataFrame:
    """Views of groups that are gone, from rows (view_name) and (slug). No active group: nothing is stale."""
    cases = [
        F.when(F.startswith("view_name", F.lit(prefix)), F.substr("view_name", F.lit(len(prefix) + 1)))
        for prefix in VIEW_PREFIXES.values()
    ]
    ours = views.withColumn("slug", reduce(lambda a, b: F.coalesce(a, b), cases)).filter("slug IS NOT NULL")
    gone = ours.join(active_slugs, "slug", "left_anti").withColumn("any_active", F.lit(True))
    any_active = active_slugs.limit(1).select(F.lit(True).alias("any_active"))
    return gone.join(F.broadcast(any_active), "any_active", "left_semi").select("view_name", "slug")


def drop_stale_views(spark: SparkSession, active_slugs: list[str], *, schema: str | None = None) -> list[str]:
    """Drop the session views, or the stored tables of a schema, of groups that are gone; returns their names."""
    if not active_slugs:
        return []
    if schema:
        views = spark.sql(f"SHOW TABLES IN {schema}").filter("NOT isTemporary").select(F.col("tableName").alias("view_name"))
    else:
        views = spark.sql("SHOW VIEWS").select(F.col("viewName").alias("view_name"))
    active = spark.createDataFrame([(slug,) for slug in active_slugs], "slug string")
    names = [row.view_name for row in stale_views(views, active).orderBy("view_name").collect()]
    for name in names:
        if schema:
            spark.sql(f"DROP TABLE IF EXISTS {schema}.{name}")
        else:
            spark.catalog.dropTempView(name)
    return names


def write_report(report: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    report.write.mode("overwrite").json(path)
