"""Summaries and panel data over the unified frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchmill.operators.alerts import drift_limits
from watchmill.operators.unify import column_rows

TOP_ROWS = 20
DRIFT_EVENT = 0.1
_TABLE = ["source_table_name", "department", "owner"]
WINDOW_KEYS = ["source_table_name", "window_start", "window_end", "granularity"]


def _js() -> Column:
    return F.col("js_distance")


def worst_drifters(drift: DataFrame, limit: int = TOP_ROWS) -> DataFrame:
    """A5, O3: tables with the largest drift."""
    events = drift.filter(_js() >= DRIFT_EVENT).groupBy(*_TABLE).agg(
        F.count("*").alias("drift_events"),
        F.max(_js()).alias("max_drift"),
        F.avg(_js()).alias("avg_drift"),
        F.max("window_end").alias("last_drift_time"),
    )
    return events.orderBy(F.desc("max_drift"), "source_table_name").limit(limit)


def quality_summary(profile: DataFrame, limit: int = TOP_ROWS) -> DataFrame:
    """Tables with the highest null rates."""
    tables = profile.groupBy(*_TABLE).agg(
        F.count_distinct("column_name").alias("columns_monitored"),
        F.avg("null_rate").alias("avg_null_rate"),
        F.max("null_rate").alias("max_null_rate"),
        F.sum("record_count").alias("total_records"),
        F.max("window_end").alias("last_profile_time"),
    )
    return tables.orderBy(F.desc("max_null_rate"), "source_table_name").limit(limit)


def feature_drift(drift: DataFrame, table: str) -> DataFrame:
    """Drift of one table's columns, newest first."""
    rows = drift.filter(F.col("source_table_name") == table).select(
        "column_name",
        "window_start",
        "window_end",
        "js_distance",
        "ks_statistic",
        "wasserstein_distance",
        "chi_square_statistic",
        "drift_type",
    )
    return rows.orderBy(F.desc("window_end"), F.desc("js_distance"))


def window_drift(drift: DataFrame) -> DataFrame:
    """Drift per table and window over all its columns and slices."""
    return drift.filter(_js().isNotNull()).groupBy(*WINDOW_KEYS).agg(
        F.max(_js()).alias("max_js_distance"),
        F.avg(_js()).alias("avg_js_distance"),
        F.count_distinct("column_name").alias("columns_drifted"),
    )


def performance_vs_drift(performance: DataFrame, drift: DataFrame, *, overall_only: bool = False) -> DataFrame:
    """Scores next to the drift of the same window. Slices are pooled on the drift side; ``overall_only`` keeps
    just the rows about whole tables on both sides.
    """
    if overall_only:
        performance = performance.filter("slice_key IS NULL")
        drift = drift.filter("slice_key IS NULL")
    scores = performance.select(*WINDOW_KEYS, "accuracy_score", "r2_score", "precision_weighted", "f1_weighted")
    return scores.join(window_drift(drift), WINDOW_KEYS, "left")


# --- drift panels -------------------------------------------------------------------------------------------------


def _critical(threshold: float) -> Column:
    return F.count(F.when(_js() >= drift_limits(threshold)[0], 1))


def drift_overview(drift: DataFrame, threshold: float) -> DataFrame:
    """W1"""
    critical, warning = drift_limits(threshold)
    return drift.agg(
        F.count_distinct("source_table_name").alias("total_tables"),
        _critical(threshold).alias("critical_alerts"),
        F.count(F.when((_js() >= warning) & (_js() < critical), 1)).alias("warning_alerts"),
    )


def drift_trend(drift: DataFrame) -> DataFrame:
    """W2"""
    return drift.groupBy("window_end").agg(F.avg(_js()).alias("avg_drift"), F.max(_js()).alias("max_drift"))


def top_drifters(drift: DataFrame, threshold: float) -> DataFrame:
    """W3"""
    return drift.groupBy(*_TABLE).agg(F.max(_js()).alias("max_drift"), _critical(threshold).alias("drift_count"))


def department_drift(drift: DataFrame) -> DataFrame:
    """W4"""
    return drift.groupBy("department").agg(
        F.avg(_js()).alias("avg_drift"), F.count_distinct("source_table_name").alias("table_count")
    )


def drift_heatmap(drift: DataFrame) -> DataFrame:
    """W5"""
    return drift.groupBy("source_table_name", "column_name").agg(F.max(_js()).alias("js_distance"))


def drift_details(drift: DataFrame) -> DataFrame:
    """W11"""
    return drift.select(
        "window_end",
        "source_table_name",
        "column_name",
        "js_distance",
        "ks_statistic",
        "wasserstein_distance",
        "drift_type",
        "owner",
    )


def drift_timeline(drift: DataFrame, table: str) -> DataFrame:
    """W19"""
    return drift.filter(F.col("source_table_name") == table).select("window_end", "column_name", "js_distance")


# --- quality panels -----------------------------------------------------------------------------------------------


def quality_overview(profile: DataFrame, null_rate: float | None, min_rows: int | None) -> DataFrame:
    """A limit that is not set counts nothing (rates above 1, fewer than 0 rows)."""
    high = F.col("null_rate") > (1.0 if null_rate is None else null_rate)
    low = F.col("record_count") < (0 if min_rows is None else min_rows)
    return profile.agg(
        F.count_distinct("source_table_name").alias("tables_profiled"),
        F.count(F.when(high, 1)).alias("high_null_columns"),
        F.count_distinct(F.when(low, F.col("source_table_name"))).alias("low_row_tables"),
    )


def null_rate_trend(profile: DataFrame) -> DataFrame:
    """W7"""
    return column_rows(profile).groupBy("window_end").agg(
        F.avg("null_rate").alias("avg_null_rate"), F.max("null_rate").alias("max_null_rate")
    )


def row_counts(profile: DataFrame) -> DataFrame:
    """W8"""
    return profile.groupBy("source_table_name").agg(
        F.max("record_count").alias("latest_record_count"), F.max("distinct_count").alias("latest_distinct_count")
    )


def null_rates(profile: DataFrame) -> DataFrame:
    """W9"""
    return column_rows(profile).groupBy("source_table_name", "column_name").agg(F.max("null_rate").alias("null_rate"))


def quality_details(profile: DataFrame) -> DataFrame:
    """W10"""
    return column_rows(profile).select(
        "window_end", "source_table_name", "column_name", "null_rate", "record_count", "distinct_count", "owner"
    )


# --- model panels -------------------------------------------------------------------------------------------------


def _score() -> Column:
    return F.coalesce("accuracy_score", "r2_score")


def model_overview(performance: DataFrame) -> DataFrame:
    """W12"""
    return performance.agg(
        F.count_distinct("source_table_name").alias("models_monitored"),
        F.count_distinct(F.when(_score().isNotNull(), F.col("source_table_name"))).alias("models_with_labels"),
    )


def score_trend(performance: DataFrame) -> DataFrame:
    """W13"""
    return performance.select("window_end", "source_table_name", _score().alias("score")).distinct()


def best_scores(performance: DataFrame) -> DataFrame:
    """W14"""
    names = ["accuracy_score", "r2_score", "f1_weighted", "precision_weighted", "owner"]
    return performance.groupBy("source_table_name").agg(*[F.max(name).alias(name) for name in names])


def score_vs_drift(performance: DataFrame, drift: DataFrame) -> DataFrame:
    """W15"""
    return performance_vs_drift(performance, drift).select(
        "source_table_name", _score().alias("score"), "max_js_distance"
    )


# --- panels over all groups ---------------------------------------------------------------------------------------


def group_summary(rollup: DataFrame, threshold: float) -> DataFrame:
    """Counts with the global threshold, not the row's."""
    return rollup.groupBy("monitor_group").agg(
        F.count_distinct("source_table_name").alias("tables_monitored"),
        F.count(F.when(_js() >= threshold, 1)).alias("critical_alerts"),
    )


def group_worst_drifters(rollup: DataFrame) -> DataFrame:
    """W17"""
    return rollup.groupBy("source_table_name", "monitor_group").agg(F.max(_js()).alias("max_drift"))


def group_health(rollup: DataFrame) -> DataFrame:
    """W18"""
    return rollup.groupBy("monitor_group").agg(F.avg(_js()).alias("avg_drift"))
