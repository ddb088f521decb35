"""Monitoring coverage: what is watched, what is not, what has gone stale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchmill.functions.naming import whole_days_between

ACTIVE = ("ACTIVE", "DATA_PROFILING_STATUS_ACTIVE")


def monitored_tables(monitors: DataFrame, inventory: DataFrame, catalog: str) -> DataFrame:
    """Monitors of tables in the catalog, with the table's name."""
    tables = inventory.select(F.col("table_id").alias("object_id"), "full_name")
    return monitors.join(tables, "object_id").filter(F.startswith("full_name", F.lit(f"{catalog}.")))


def unmonitored_tables(inventory: DataFrame, monitored: DataFrame) -> DataFrame:
    """Tables without a monitor, with owner and department from their tags."""
    missing = inventory.join(monitored.select("full_name"), "full_name", "left_anti")
    return missing.select(
        "full_name",
        "schema_name",
        F.col("tags").getItem("owner").alias("owner"),
        F.col("tags").getItem("department").alias("department"),
        F.lit("no_monitor").alias("reason"),
    )


def orphan_monitors(monitored: DataFrame, known: DataFrame) -> DataFrame:
    """Monitors of tables that are neither configured nor discovered."""
    return monitored.join(known.select("full_name"), "full_name", "left_anti").select(
        "full_name", "monitor_id", F.lit("not_in_config").alias("reason")
    )


def refresh_states(monitored: DataFrame, refreshes: DataFrame, now: Column, stale_days: int = 30) -> DataFrame:
    """Monitors that need attention. ``refreshes`` holds (object_id, created_at); ``monitored`` may flag a failed
    lookup in ``lookup_failed``. An active monitor without any refresh is still starting and is left out.
    """
    latest = refreshes.groupBy("object_id").agg(F.max("created_at").alias("last_refresh"))
    joined = monitored.join(latest, "object_id", "left")
    failed = F.coalesce("lookup_failed", F.lit(False))
    never = F.col("last_refresh").isNull()
    old = F.col("last_refresh") < now - F.make_dt_interval(days=F.lit(stale_days))
    state = (
        F.when(failed, "refresh_history_unavailable")
        .when(never & F.col("status").isin(*ACTIVE), None)
        .when(never, "never_refreshed")
        .when(old, "stale")
    )
    stale = F.col("refresh_state") == "stale"
    return joined.withColumn("refresh_state", state).filter("refresh_state IS NOT NULL").select(
        "full_name",
        "monitor_id",
        "refresh_state",
        F.when(stale, F.col("last_refresh")).alias("last_refresh"),
        F.when(stale, whole_days_between(F.col("last_refresh"), now)).alias("days_since_refresh"),
        "status",
    )


def coverage_summary(inventory: DataFrame, monitored: DataFrame, attention: DataFrame, orphans: DataFrame) -> DataFrame:
    """A10: one row of totals. The share is monitored tables over catalog tables."""

    def counted(df: DataFrame, **columns: Column) -> DataFrame:
        return df.agg(*[value.alias(name) for name, value in columns.items()])

    every = F.count("*")
    watched = monitored.select("full_name").distinct()
    states = {
        f"{state}_count": F.count_if(F.col("refresh_state") == state)
        for state in ("stale", "never_refreshed", "refresh_history_unavailable")
    }
    # Every part is a single row; stacked and folded into one.
    parts = [
        counted(inventory, total_catalog_tables=every),
        counted(watched, total_monitored=every),
        counted(inventory.join(watched, "full_name", "left_anti"), unmonitored_count=every),
        counted(attention, refresh_attention_count=every, **states),
        counted(orphans, orphan_count=every),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    totals = stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
    share = F.try_divide(F.col("total_monitored") * 100.0, F.col("total_catalog_tables"))
    return totals.withColumn("coverage_pct", F.round(F.coalesce(share, F.lit(0.0)), 2))
