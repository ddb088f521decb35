"""Alert rows, alert states and their routing."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchmill.settings import AlertSettings

#: Rows an alert reports.
ALERT_ROWS = 100
#: Drift below this is never reported, unless the critical threshold is lower still.
WARNING_FLOOR = 0.1
COMPARISONS = {
    ">=": operator.ge,
    ">": operator.gt,
    "<=": operator.le,
    "<": operator.lt,
    "==": operator.eq,
    "!=": operator.ne,
}


def _js() -> Column:
    return F.col("js_distance")



def drift_limits(default: float) -> tuple[Column, Column]:
    """Critical and warning limit of a row; the warning limit never exceeds the critical one."""
    critical = F.coalesce("drift_threshold", F.lit(float(default)))
    return critical, F.least(critical, F.greatest(F.lit(WARNING_FLOOR), critical / 2))


def _ties(*columns: str) -> list[Column]:
    """Further sort keys, so that a limit cuts equal rows in the same place on every run."""
    names = ("source_table_name", "column_name", *columns, "granularity", "window_start", "slice_key", "slice_value")
    return [F.asc_nulls_last(name) for name in names]


def drift_issues(drift: DataFrame, alerts: AlertSettings) -> DataFrame:
    """Rows at or above their warning limit, with severity."""
    critical, warning = drift_limits(alerts.drift_threshold)
    return _drift_rows(drift.filter(_js() >= warning), critical, warning)


def _drift_rows(drift: DataFrame, critical: Column, warning: Column) -> DataFrame:
    return drift.select(
        "source_table_name",
        "owner",
        "department",
        "column_name",
        "js_distance",
        "chi_square_statistic",
        "drift_type",
        "drift_threshold",
        F.when(_js() >= critical, "CRITICAL").when(_js() >= warning, "WARNING").alias("severity"),
        F.lit(1.0).alias("trigger_value"),
        "runbook_url",
        "lineage_url",
        "window_start",
        "window_end",
    )


def drift_alert(drift: DataFrame, alerts: AlertSettings, limit: int = ALERT_ROWS) -> DataFrame:
    """O1: the strongest drift issues."""
    critical, warning = drift_limits(alerts.drift_threshold)
    # Beyond nine digits a distance depends on the order of its additions, which must not order equal rows.
    strongest = [F.desc(F.round("js_distance", 9)), *_ties("drift_type")]
    worst = drift.filter(_js() >= warning).orderBy(*strongest).limit(limit)
    return _drift_rows(worst, critical, warning)


def tiered_issues(drift: DataFrame, alerts: AlertSettings) -> dict[str, DataFrame]:
    """One frame for the warning band and one for critical drift."""
    critical, warning = drift_limits(alerts.drift_threshold)
    bands = {"WARNING": (_js() >= warning) & (_js() < critical), "CRITICAL": _js() >= critical}
    columns = ["source_table_name", "column_name", "js_distance"]
    return {
        name: drift.filter(band).select(*columns, F.lit(name).alias("severity")).orderBy(F.desc("js_distance"))
        for name, band in bands.items()
    }


def quality_issues(profile: DataFrame, alerts: AlertSettings, limit: int | None = None) -> DataFrame | None:
    """P20: rows that break an enabled limit, named by the first limit they break; None if no limit is set. With
    ``limit`` only the worst ones.
    """
    tests = [
        (alerts.null_rate_threshold, "HIGH_NULL_RATE", lambda bound: F.col("null_rate") > bound),
        (alerts.row_count_min, "LOW_ROW_COUNT", lambda bound: F.col("record_count") < bound),
        (alerts.distinct_count_min, "LOW_CARDINALITY", lambda bound: F.col("distinct_count") < bound),
    ]
    enabled = [(name, test(bound)) for bound, name, test in tests if bound is not None]
    if not enabled:
        return None
    issue = F.lit(None).cast("string")
    for name, test in reversed(enabled):
        issue = F.when(test, name).otherwise(issue)
    broken = reduce(operator.or_, [test for _, test in enabled])
    rows = profile.filter(broken)
    if limit is not None:
        order = [F.desc("null_rate"), F.asc("record_count"), *_ties()]
        rows = rows.orderBy(*order).limit(limit)
    return rows.select(
        "source_table_name",
        "owner",
        "department",
        "column_name",
        "null_rate",
        "record_count",
        "distinct_count",
        F.lit(1.0).alias("trigger_value"),
        issue.alias("issue_type"),
        "runbook_url",
        "lineage_url",
        "window_start",
        "window_end",
    )


def quality_alert(profile: DataFrame, alerts: AlertSettings, limit: int = ALERT_ROWS) -> DataFrame | None:
    """O2: the worst quality issues."""
    return quality_issues(profile, alerts, limit)


def rule_rows(drift: DataFrame, table: str, rule: str) -> DataFrame:
    """Rows of one table that meet a rule written in SQL."""
    rows = drift.filter(F.col("source_table_name") == table).filter(F.expr(rule))
    columns = ["source_table_name", "owner", "department", "column_name", "js_distance", "window_start", "window_end"]
    return rows.select(*columns).orderBy(F.desc("js_distance"))


def alert_status(drift: DataFrame, alerts: AlertSettings) -> DataFrame:
    """Critical and warning counts per table that has any."""
    critical, warning = drift_limits(alerts.drift_threshold)
    counts = drift.groupBy("source_table_name", "department", "owner").agg(
        F.count(F.when(_js() >= critical, 1)).alias("critical_count"),
        F.count(F.when((_js() >= warning) & (_js() < critical), 1)).alias("warning_count"),
        F.max("js_distance").alias("max_drift"),
        F.max("window_end").alias("last_check"),
    )
    return counts.filter("critical_count > 0 OR warning_count > 0").orderBy(
        F.desc("critical_count"), F.desc("warning_count")
    )


def combined_issues(drift: DataFrame, profile: DataFrame, threshold: float, warning: float, null_rate: float) -> DataFrame:
    """Drift and null-rate issues in one list."""
    severity = F.when(_js() >= threshold, "CRITICAL").otherwise("WARNING")
    drifted = drift.filter(_js() >= warning).select(
        "source_table_name",
        "owner",
        F.lit("DRIFT").alias("issue_category"),
        F.col("column_name").alias("affected_column"),
        F.col("js_distance").alias("metric_value"),
        F.lit("JS Divergence").alias("metric_name"),
        severity.alias("severity"),
    )
    sparse = profile.filter(F.col("null_rate") > null_rate).select(
        "source_table_name",
        "owner",
        F.lit("QUALITY").alias("issue_category"),
        F.col("column_name").alias("affected_column"),
        F.col("null_rate").alias("metric_value"),
        F.lit("Null Rate").alias("metric_name"),
        F.lit("WARNING").alias("severity"),
    )
    return drifted.unionByName(sparse).orderBy(F.desc("severity"), F.desc("metric_value"))


# --- states and routing -------------------------------------------------------------------------------------------


def alert_state(rows: DataFrame, name: str, op: str = ">=", limit: float = 1.0) -> DataFrame:
    """One row (alert_name, rows, state). It fires when any row meets the condition; no rows means OK."""
    met = COMPARISONS.get(op, operator.ge)(F.col("trigger_value"), F.lit(limit))
    return rows.agg(
        F.lit(name).alias("alert_name"),
        F.count("*").alias("rows"),
        F.when(F.coalesce(F.bool_or(met), F.lit(False)), "TRIGGERED").otherwise("OK").alias("state"),
    )


def due_notifications(states: DataFrame, history: DataFrame, now: Column, repeat_seconds: int = 3600) -> DataFrame:
    """Firing alerts that did not already notify within the repeat gap; OK stays silent."""
    last = history.groupBy("alert_name").agg(F.max("fired_at").alias("last_fired"))
    due = F.col("last_fired").isNull() | (
        F.col("last_fired") <= now - F.make_dt_interval(secs=F.lit(repeat_seconds))
    )
    firing = states.filter(F.col("state") == "TRIGGERED")
    return firing.join(last, "alert_name", "left").filter(due)


def routes(groups: DataFrame, routing: DataFrame, default: tuple[str, ...]) -> DataFrame:
    """Rows (monitor_group, destination). ``routing`` holds (monitor_group, destinations); a group without an
    entry uses the default list, an empty list means nobody.
    """
    fallback = F.array(*[F.lit(name) for name in default]).cast("array<string>")
    joined = groups.join(routing, "monitor_group", "left")
    return joined.select("monitor_group", F.explode(F.coalesce("destinations", fallback)).alias("destination"))


def resolve_destinations(routed: DataFrame, destinations: DataFrame) -> DataFrame:
    """add kind ('email' or 'destination') and address; ids pass, names are looked up, unknown ones drop out."""
    name = F.col("destination")
    is_email = F.contains(name, F.lit("@"))
    is_id = (F.length(name) == 36) & (F.length(name) - F.length(F.replace(name, F.lit("-"), F.lit(""))) == 4)
    known = destinations.select(F.col("name").alias("destination"), F.col("id").alias("known_id"))
    joined = routed.join(known, "destination", "left")
    address = F.when(is_email | is_id, name).otherwise(F.col("known_id"))
    kind = F.when(is_email, "email").otherwise("destination")
    return joined.withColumns({"kind": kind, "address": address}).filter("address IS NOT NULL").drop("known_id")


def states_by_group(
    drift: DataFrame, profile: DataFrame, alerts: AlertSettings, group: str = "monitor_group"
) -> DataFrame:
    """The state of both alerts for every group in one pass; rows (group, alert, rows, state)."""
    critical, warning = drift_limits(alerts.drift_threshold)
    drift_rows = drift.groupBy(group).agg(F.count(F.when(_js() >= warning, 1)).alias("rows"))
    result = drift_rows.withColumn("alert", F.lit("drift"))
    issues = quality_issues(profile.withColumn("owner", F.struct(group, "owner")), alerts)
    if issues is not None:
        # Groups without issues still report OK, so the groups come from the profile itself.
        found = issues.groupBy(F.col(f"owner.{group}").alias(group)).agg(F.count("*").alias("rows"))
        every = profile.select(group).distinct().join(found, group, "left")
        quality = every.select(group, F.coalesce("rows", F.lit(0)).alias("rows"), F.lit("quality").alias("alert"))
        result = result.unionByName(quality)
    state = F.when(F.col("rows") > 0, "TRIGGERED").otherwise("OK")
    return result.select(
        group, "alert", F.concat(F.initcap("alert"), F.lit(" alert - "), F.col(group)).alias("alert_name"), "rows",
        state.alias("state"),
    )
