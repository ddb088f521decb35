"""One frame per metric kind for all tables of a group, with the context an alert needs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.schemas import (
    CLASSIFICATION_SCORES,
    REGRESSION_SCORES,
    TABLE_ROW,
    UNIFIED_DRIFT,
    UNIFIED_PERFORMANCE,
    UNIFIED_PROFILE,
    empty,
)
from watchmill.settings import REGRESSION, Monitor, TableSettings


@dataclass(frozen=True)
class Member:
    """A monitored table of a group: its resolved monitor, settings and tags."""

    monitor: Monitor
    settings: TableSettings = TableSettings()
    tags: dict[str, str] = field(default_factory=dict)


def drift_projection() -> list[Column]:
    """The drift columns, flat."""
    real = {
        "js_distance": "js_distance",
        "ks_statistic": "ks_test.statistic",
        "wasserstein_distance": "wasserstein_distance",
        "chi_square_statistic": "chi_squared_test.statistic",
        "psi": "population_stability_index",
    }
    return [
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        F.col("column_name"),
        *[F.col(source).cast("double").alias(name) for name, source in real.items()],
        *[F.col(name) for name in ("drift_type", "granularity", "slice_key", "slice_value")],
    ]


def profile_projection() -> list[Column]:
    """The profile columns under their unified names."""
    typed = [
        ("record_count", "count", "bigint"),
        ("null_count", "num_nulls", "bigint"),
        ("null_rate", "percent_null", "double"),
        ("distinct_count", "distinct_count", "bigint"),
        ("mean", "avg", "double"),
        ("stddev", "stddev", "double"),
        ("min_value", "min", "double"),
        ("max_value", "max", "double"),
    ]
    return [
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        F.col("column_name"),
        *[F.col(source).cast(kind).alias(name) for name, source, kind in typed],
        *[F.col(name) for name in ("granularity", "slice_key", "slice_value")],
    ]


def performance_projection(problem_type: str) -> list[Column]:
    """The scores of the table's problem family; the other family is NULL."""
    nested = {
        "precision_weighted": "precision.weighted",
        "recall_weighted": "recall.weighted",
        "f1_weighted": "f1_score.weighted",
        "roc_auc_weighted": "roc_auc_score.one_vs_one.weighted",
    }
    unused = CLASSIFICATION_SCORES if problem_type == REGRESSION else REGRESSION_SCORES
    scores = [
        (F.lit(None) if name in unused else F.col(nested.get(name, name))).cast("double").alias(name)
        for name in CLASSIFICATION_SCORES + REGRESSION_SCORES
    ]
    return [
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        F.col("granularity"),
        F.col("column_name"),
        *scores,
        F.col("slice_key"),
        F.col("slice_value"),
    ]


def input_rows(metrics: DataFrame) -> DataFrame:
    """Rows about current data, not about the baseline."""
    return metrics.filter(F.col("log_type") == "INPUT")


def table_rows(metrics: DataFrame) -> DataFrame:
    """P5: rows about whole tables."""
    return metrics.filter(F.col("column_name") == TABLE_ROW)


def column_rows(metrics: DataFrame) -> DataFrame:
    """P5: rows about columns."""
    return metrics.filter(F.col("column_name") != TABLE_ROW)


def _priority(tags: dict[str, str]) -> int:
    """P7 for one table."""
    try:
        return int(tags.get("monitor_priority", 99))
    except (TypeError, ValueError):
        return 99


def context(member: Member) -> list[Column]:
    """Owner and links (settings, then tags), department (tag), priority."""
    own, tags = member.settings, member.tags
    return [
        F.lit(member.monitor.table).alias("source_table_name"),
        F.lit(own.owner or tags.get("owner", "unknown")).alias("owner"),
        F.lit(tags.get("department", "unknown")).alias("department"),
        F.lit(_priority(tags)).cast("int").alias("priority"),
        F.lit(own.runbook_url or tags.get("runbook_url") or "").alias("runbook_url"),
        F.lit(own.lineage_url or tags.get("lineage_url") or "").alias("lineage_url"),
    ]


def threshold(member: Member, default: float) -> Column:
    """The table's own drift threshold, else the global one."""
    own = member.settings.drift_threshold
    return F.lit(float(default if own is None else own)).alias("drift_threshold")


def _union(spark: SparkSession, parts: list[DataFrame], schema) -> DataFrame:
    """All parts, or a typed empty frame."""
    if not parts:
        return empty(spark, schema)
    return reduce(DataFrame.unionByName, parts).select(*schema.fieldNames())


def unified_drift(spark: SparkSession, members: list[tuple[Member, DataFrame]], default_threshold: float) -> DataFrame:
    """Drift metric tables of all members."""
    parts = [
        metrics.select(*drift_projection(), *context(member), threshold(member, default_threshold))
        for member, metrics in members
    ]
    return _union(spark, parts, UNIFIED_DRIFT)


def unified_profile(spark: SparkSession, members: list[tuple[Member, DataFrame]]) -> DataFrame:
    """Profile metric tables of all members, current data only."""
    parts = [input_rows(metrics).select(*profile_projection(), *context(member)) for member, metrics in members]
    return _union(spark, parts, UNIFIED_PROFILE)


def unified_performance(spark: SparkSession, members: list[tuple[Member, DataFrame]]) -> DataFrame:
    """Scores of the inference members that have both a prediction and a label."""
    parts = []
    for member, metrics in members:
        monitor = member.monitor
        if monitor.profile_type != "INFERENCE" or not (monitor.prediction_column and monitor.label_column):
            continue
        table, owner = context(member)[:2]
        rows = table_rows(input_rows(metrics))
        parts.append(rows.select(*performance_projection(monitor.problem_type), table, owner))
    return _union(spark, parts, UNIFIED_PERFORMANCE)


def group_rollup(groups: dict[str, DataFrame]) -> DataFrame:
    """The unified drift frames of all groups, marked with their group."""
    return reduce(DataFrame.unionByName, [df.withColumn("monitor_group", F.lit(name)) for name, df in groups.items()])
