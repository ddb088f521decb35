"""Checks of the reporting half: unified frames, alerts, summaries, panels, over metrics of five monitored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql
from checks.base import check, r, table
from checks.engine import PRICED, RETURNS, SEGMENTED, priced, returns, segmented
from watchmill.operators import alerts as A
from watchmill.operators import summaries as S
from watchmill.operators.drift import consecutive_drift
from watchmill.operators.performance import performance
from watchmill.operators.profile import profile, with_performance
from watchmill.operators.unify import (
    Member,
    column_rows,
    group_rollup,
    table_rows,
    unified_drift,
    unified_performance,
    unified_profile,
)
from watchmill.settings import REGRESSION, AlertSettings, Monitor, TableSettings
from watchmill.sources.scratch import materialize

# --- the monitored tables -----------------------------------------------------------------------------------------

LINES = Member(
    Monitor("main.sales.lineitem", "TIMESERIES", "l_shipdate", ("1 month",), ("l_returnflag",),
            ("l_quantity", "l_extendedprice", "l_linestatus")),
    TableSettings(drift_threshold=0.05, runbook_url="https://runbooks.example.com/lines"),
    {"owner": "logistics", "department": "sales", "monitor_priority": "1", "monitor_group": "sales"},
)
PRICES = Member(
    Monitor("main.ml.prices", "INFERENCE", "o_orderdate", ("1 month",), ("o_orderpriority",),
            ("total", "o_orderstatus"), "predicted", "total", problem_type=REGRESSION),
    TableSettings(owner="pricing's team", drift_threshold=0.4),
    {"owner": "ignored", "department": "science", "monitor_group": "ml"},
)
RETURNED = Member(
    Monitor("main.ml.returns", "INFERENCE", "l_shipdate", ("1 year",), ("l_linestatus",),
            ("l_quantity", "l_tax"), "chance", "returned"),
    TableSettings(drift_threshold=0.0),
    {"department": "science", "monitor_priority": "high", "monitor_group": "ml"},
)
EVENTS = Member(
    Monitor("main.web.events", "TIMESERIES", "ts", ("1 day", "1 week"), (), ("value", "event_type", "user_id")),
    TableSettings(),
    {"owner": "web", "lineage_url": "https://lineage.example.com/events"},
)
CUSTOMERS = Member(
    Monitor("main.sales.customer", "SNAPSHOT", granularities=(), slices=("c_nationkey",), columns=("segment", "c_acctbal")),
    TableSettings(),
    {"owner": "crm", "department": "sales", "monitor_priority": " 7 ", "monitor_group": "sales"},
)
GROUPS = {"sales": (LINES, CUSTOMERS), "ml": (PRICES, RETURNED), "default": (EVENTS,)}
ALERTS = AlertSettings(
    drift_threshold=0.1, null_rate_threshold=0.2, row_count_min=150, distinct_count_min=3,
    default_notifications=("oncall@example.com",),
)

_stored: dict[tuple[str, str, str], DataFrame] = {}


def forget_metrics() -> None:
    """Compute the metric tables anew on next use."""
    _stored.clear()


def _load(spark: SparkSession, sf: str, member: Member) -> DataFrame:
    name = member.monitor.leaf_name
    made = {"prices": priced, "returns": returns, "customer": segmented}.get(name)
    return made(spark, sf) if made else table(spark, sf, name)


def metrics(spark: SparkSession, sf: str, member: Member, kind: str) -> DataFrame:
    """The metric table of a monitored table, computed and written once per session, then read."""
    key = (spark.sparkContext.applicationId, sf, f"{member.monitor.leaf_name}-{kind}")
    if key not in _stored:
        df, monitor = _load(spark, sf, member), member.monitor
        if kind == "drift":
            rows = consecutive_drift(df, monitor)
        else:
            rows = with_performance(profile(df, monitor, distinct="exact"), performance(df, monitor))
        _stored[key] = materialize(rows, key[2])
    return _stored[key]


def _members(spark: SparkSession, sf: str, kind: str, group: str | None) -> list[tuple[Member, DataFrame]]:
    chosen = [m for name, found in GROUPS.items() for m in found if group in (None, name)]
    return [(m, metrics(spark, sf, m, kind)) for m in chosen if kind == "profile" or m.monitor.granularities]


def drift(spark: SparkSession, sf: str, group: str | None = None) -> DataFrame:
    return unified_drift(spark, _members(spark, sf, "drift", group), ALERTS.drift_threshold)


def profiles(spark: SparkSession, sf: str, group: str | None = None) -> DataFrame:
    return unified_profile(spark, _members(spark, sf, "profile", group))


def scores(spark: SparkSession, sf: str, group: str | None = None) -> DataFrame:
    return unified_performance(spark, _members(spark, sf, "profile", group))


# --- the same in SQL ----------------------------------------------------------------------------------------------


def _context(table_name, owner, department, priority, runbook, lineage) -> str:
    return (
        f"'{table_name}' AS source_table_name, '{owner}' AS owner, '{department}' AS department, "
        f"{priority} AS priority, '{runbook}' AS runbook_url, '{lineage}' AS lineage_url"
    )


_LINES_SQL = _context("main.sales.lineitem", "logistics", "sales", 1, "https://runbooks.example.com/lines", "")
_PRICES_SQL = _context("main.ml.prices", "pricing''s team", "science", 99, "", "")
_RETURNS_SQL = _context("main.ml.returns", "unknown", "science", 99, "", "")
_EVENTS_SQL = _context("main.web.events", "web", "unknown", 99, "", "https://lineage.example.com/events")
_CUSTOMERS_SQL = _context("main.sales.customer", "crm", "sales", 7, "", "")

_DRIFT_PARTS = {
    "sales": [
        (_LINES_SQL, "0.05", sql.drift("SELECT * FROM lineitem", "l_shipdate", ["1 month"], ["l_returnflag"],
                                       ["l_quantity", "l_extendedprice"], ["l_linestatus"]))
    ],
    "ml": [
        (_PRICES_SQL, "0.4", sql.drift(PRICED, "o_orderdate", ["1 month"], ["o_orderpriority"], ["total"], ["o_orderstatus"])),
        (_RETURNS_SQL, "0.0", sql.drift(RETURNS, "l_shipdate", ["1 year"], ["l_linestatus"], ["l_quantity", "l_tax"], [])),
    ],
    "default": [
        (_EVENTS_SQL, "0.1", sql.drift("SELECT * FROM events", "ts", ["1 day", "1 week"], [], ["value", "user_id"], ["event_type"]))
    ],
}
_PROFILE_PARTS = {
    "sales": [
        (_LINES_SQL, sql.profile("SELECT * FROM lineitem", "l_shipdate", ["1 month"], ["l_returnflag"],
                                 ["l_quantity", "l_extendedprice"], ["l_linestatus"])),
        (_CUSTOMERS_SQL, sql.profile(SEGMENTED, None, [], ["c_nationkey"], ["c_acctbal"], ["segment"])),
    ],
    "ml": [
        (_PRICES_SQL, sql.profile(PRICED, "o_orderdate", ["1 month"], ["o_orderpriority"], ["total"], ["o_orderstatus"])),
        (_RETURNS_SQL, sql.profile(RETURNS, "l_shipdate", ["1 year"], ["l_linestatus"], ["l_quantity", "l_tax"])),
    ],
    "default": [
        (_EVENTS_SQL, sql.profile("SELECT * FROM events", "ts", ["1 day", "1 week"], [], ["value", "user_id"], ["event_type"]))
    ],
}
_DRIFT_NAMES = (
    "window_start, window_end, column_name, js_distance, ks_statistic, wasserstein_distance, chi_square_statistic, psi, "
    "drift_type, granularity, slice_key, slice_value"
)
_PROFILE_NAMES = (
    "window_start, window_end, column_name, record_count, null_count, null_rate, distinct_count, mean, stddev, min_value, "
    "max_value, granularity, slice_key, slice_value"
)


def _with(group: str | None = None, *kinds: str) -> str:
    """CTEs d (drift), p (profile) and s (scores) as asked."""
    groups = [group] if group else list(GROUPS)
    parts = []
    if "d" in kinds:
        rows = [
            f"SELECT {_DRIFT_NAMES}, {context}, CAST({limit} AS DOUBLE) AS drift_threshold, '{g}' AS monitor_group FROM {inner}"
            for g in groups
            for context, limit, inner in _DRIFT_PARTS[g]
        ]
        parts.append(f"d AS ({' UNION ALL '.join(rows)})")
    if "p" in kinds:
        rows = [
            f"SELECT {_PROFILE_NAMES}, {context}, '{g}' AS monitor_group FROM {inner}"
            for g in groups
            for context, inner in _PROFILE_PARTS[g]
        ]
        parts.append(f"p AS ({' UNION ALL '.join(rows)})")
    if "s" in kinds:
        priced_sql = sql.regression(PRICED, "o_orderdate", ["1 month"], ["o_orderpriority"], "predicted", "total", True)
        returned_sql = sql.classification(RETURNS, "l_shipdate", ["1 year"], ["l_linestatus"], "chance", "returned")
        names = ", ".join(["window_start", "window_end", "granularity", "column_name", *sql.CLASSIFICATION, *sql.REGRESSION,
                           "slice_key", "slice_value"])
        parts.append(
            f"s AS (SELECT {names}, 'main.ml.prices' AS source_table_name, 'pricing''s team' AS owner FROM {priced_sql} "
            f"UNION ALL SELECT {names}, 'main.ml.returns', 'unknown' FROM {returned_sql})"
        )
    return "WITH " + ", ".join(parts)


# --- unified frames -----------------------------------------------------------------------------------------------

_DRIFT_DOUBLES = ["js_distance", "ks_statistic", "wasserstein_distance", "chi_square_statistic", "psi", "drift_threshold"]
_PROFILE_DOUBLES = ["null_rate", "mean", "stddev", "min_value", "max_value"]
_CONTEXT = "source_table_name, owner, department, priority, runbook_url, lineage_url"
_DRIFT_REST = "window_start, window_end, column_name, drift_type, granularity, slice_key, slice_value"


@check("unified_drift", f"{_with(None, 'd')} SELECT {_DRIFT_REST}, {_CONTEXT}, {sql.rounded_columns(_DRIFT_DOUBLES)} FROM d")
def unified_drift_all(spark, sf):
    """P1, P6, P7, P8, U1, S5"""
    return drift(spark, sf)


@check(
    "unified_profile",
    f"{_with(None, 'p')} SELECT window_start, window_end, column_name, record_count, coalesce(null_count, -1) AS null_count, "
    f"coalesce(distinct_count, -1) AS distinct_count, granularity, slice_key, slice_value, {_CONTEXT}, "
    f"{sql.rounded_columns(_PROFILE_DOUBLES)} FROM p",
)
def unified_profile_all(spark, sf):
    """P2, P4, P6, U2"""
    counts = {name: F.coalesce(name, F.lit(-1)) for name in ("null_count", "distinct_count")}
    return profiles(spark, sf).withColumns(counts)


@check(
    "unified_performance",
    f"{_with(None, 's')} SELECT window_start, window_end, granularity, column_name, slice_key, slice_value, "
    f"source_table_name, owner, {sql.rounded_columns(sql.CLASSIFICATION + sql.REGRESSION)} FROM s",
)
def unified_performance_all(spark, sf):
    """One table with class scores, one with regression scores."""
    return scores(spark, sf)


@check("unified_drift_one_group", f"{_with('ml', 'd')} SELECT source_table_name, count(*) AS n, "
       f"{r('max(js_distance)', 'worst')} FROM d GROUP BY 1")
def unified_drift_group(spark, sf):
    """U1 for one group."""
    return drift(spark, sf, "ml").groupBy("source_table_name").agg(
        F.count("*").alias("n"), F.max("js_distance").alias("worst")
    )


@check("table_and_column_rows", f"{_with(None, 'p')} SELECT source_table_name, count(*) FILTER (column_name = ':table') AS "
       "table_rows, count(*) FILTER (column_name <> ':table') AS column_rows FROM p GROUP BY 1")
def table_and_column_rows(spark, sf):
    """P5"""
    rows = profiles(spark, sf)
    tables = table_rows(rows).groupBy("source_table_name").agg(F.count("*").alias("table_rows"))
    columns = column_rows(rows).groupBy("source_table_name").agg(F.count("*").alias("column_rows"))
    return tables.join(columns, "source_table_name")


# --- alerts -------------------------------------------------------------------------------------------------------

_C = "coalesce(drift_threshold, 0.1)"
_W = f"least({_C}, greatest(0.1, {_C} / 2))"
_ISSUE = (
    f"SELECT source_table_name, owner, department, column_name, round(js_distance, 6) AS js_distance, "
    f"round(chi_square_statistic, 6) AS chi_square_statistic, drift_type, drift_threshold, "
    f"CASE WHEN js_distance >= {_C} THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 1.0::DOUBLE AS trigger_value, "
    f"runbook_url, lineage_url, window_start, window_end FROM d WHERE js_distance >= {_W}"
)


@check("drift_issues", f"{_with(None, 'd')} {_ISSUE}")
def drift_issues(spark, sf):
    """Three tables with thresholds 0.05, 0.4 and 0, one with the default."""
    return A.drift_issues(drift(spark, sf), ALERTS)


@check("drift_alert", f"{_with(None, 'd')} {_ISSUE} ORDER BY round(d.js_distance, 9) DESC, source_table_name, column_name, drift_type, "
       "granularity, window_start, slice_key NULLS LAST, slice_value NULLS LAST LIMIT 100")
def drift_alert(spark, sf):
    """O1: the flagship chain from raw tables to alert rows."""
    return A.drift_alert(drift(spark, sf), ALERTS)


for _tier, _band in {"warning": f"js_distance >= {_W} AND js_distance < {_C}", "critical": f"js_distance >= {_C}"}.items():

    @check(
        f"tiered_{_tier}",
        f"{_with(None, 'd')} SELECT source_table_name, column_name, round(js_distance, 6) AS js_distance, "
        f"'{_tier.upper()}' AS severity FROM d WHERE {_band}",
    )
    def _tiered(spark, sf, tier=_tier.upper()):
        """P19"""
        return A.tiered_issues(drift(spark, sf), ALERTS)[tier]


_QUALITY = (
    "SELECT source_table_name, owner, department, column_name, round(null_rate, 6) AS null_rate, record_count, "
    "coalesce(distinct_count, -1) AS distinct_count, 1.0::DOUBLE AS trigger_value, CASE WHEN null_rate > 0.2 THEN 'HIGH_NULL_RATE' "
    "WHEN record_count < 150 THEN 'LOW_ROW_COUNT' WHEN distinct_count < 3 THEN 'LOW_CARDINALITY' END AS issue_type, "
    "runbook_url, lineage_url, window_start, window_end FROM p "
    "WHERE null_rate > 0.2 OR record_count < 150 OR distinct_count < 3"
)


@check("quality_issues", f"{_with(None, 'p')} {_QUALITY}")
def quality_issues(spark, sf):
    """P20 with all three limits."""
    return A.quality_issues(profiles(spark, sf), ALERTS).withColumn(
        "distinct_count", F.coalesce("distinct_count", F.lit(-1))
    )


@check(
    "quality_issues_zero_null_rate",
    f"{_with('sales', 'p')} SELECT source_table_name, column_name, slice_value, round(null_rate, 6) AS null_rate FROM p "
    "WHERE null_rate > 0",
)
def quality_zero(spark, sf):
    """P20: a limit of zero is a limit."""
    rows = profiles(spark, sf, "sales").withColumn("owner", F.col("slice_value"))
    found = A.quality_issues(rows, AlertSettings(null_rate_threshold=0.0))
    return found.select("source_table_name", "column_name", F.col("owner").alias("slice_value"), "null_rate")


@check(
    "quality_alert_top",
    f"{_with(None, 'p')} SELECT round(null_rate, 6) AS null_rate, record_count FROM p "
    "WHERE null_rate > 0.2 OR record_count < 150 OR distinct_count < 3 "
    "ORDER BY p.null_rate DESC NULLS LAST, record_count LIMIT 100",
)
def quality_alert(spark, sf):
    """O2: the hundred worst; rows that tie may differ, their rates and counts may not."""
    return A.quality_alert(profiles(spark, sf), ALERTS).select("null_rate", "record_count")


@check(
    "custom_rule_rows",
    f"{_with('sales', 'd')} SELECT source_table_name, owner, department, column_name, round(js_distance, 6) AS js_distance, "
    "window_start, window_end FROM d WHERE source_table_name = 'main.sales.lineitem' AND js_distance >= 0.08 "
    "AND window_end >= TIMESTAMP '2001-11-10' - INTERVAL 600 DAY",
)
def custom_rule(spark, sf):
    """A rule in SQL with date arithmetic."""
    rule = "window_end >= TIMESTAMP'2001-11-10 00:00:00' - INTERVAL 600 DAYS AND js_distance >= 0.08"
    return A.rule_rows(drift(spark, sf, "sales"), "main.sales.lineitem", rule)


_STATUS = (
    f"SELECT source_table_name, department, owner, count(*) FILTER (js_distance >= {_C}) AS critical_count, "
    f"count(*) FILTER (js_distance >= {_W} AND js_distance < {_C}) AS warning_count, {r('max(js_distance)', 'max_drift')}, "
    "max(window_end) AS last_check FROM d GROUP BY ALL"
)


@check("alert_status", f"{_with(None, 'd')} SELECT * FROM ({_STATUS}) WHERE critical_count > 0 OR warning_count > 0")
def alert_status(spark, sf):
    """A7, O4"""
    return A.alert_status(drift(spark, sf), ALERTS)


@check(
    "combined_issues",
    f"{_with(None, 'd', 'p')} SELECT source_table_name, owner, 'DRIFT' AS issue_category, column_name AS affected_column, "
    "round(js_distance, 6) AS metric_value, 'JS Divergence' AS metric_name, "
    "CASE WHEN js_distance >= 0.15 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM d WHERE js_distance >= 0.1 "
    "UNION ALL SELECT source_table_name, owner, 'QUALITY', column_name, round(null_rate, 6), 'Null Rate', 'WARNING' "
    "FROM p WHERE null_rate > 0.1",
)
def combined(spark, sf):
    """U6"""
    return A.combined_issues(drift(spark, sf), profiles(spark, sf), 0.15, 0.1, 0.1)


@check(
    "alert_states",
    f"{_with(None, 'd', 'p')} SELECT 'Drift' AS alert_name, count(*) AS rows, "
    f"CASE WHEN count(*) > 0 THEN 'TRIGGERED' ELSE 'OK' END AS state FROM d WHERE js_distance >= {_W} "
    "UNION ALL SELECT 'Nulls', count(*), CASE WHEN count(*) > 0 THEN 'TRIGGERED' ELSE 'OK' END FROM p WHERE null_rate > 0.99",
)
def alert_states(spark, sf):
    """One alert fires, one has no rows and is OK."""
    fires = A.alert_state(A.drift_issues(drift(spark, sf), ALERTS), "Drift")
    none = A.quality_issues(profiles(spark, sf), AlertSettings(null_rate_threshold=0.99))
    return fires.unionByName(A.alert_state(none, "Nulls"))


@check(
    "alert_states_by_group",
    f"{_with(None, 'd', 'p')}, x AS (SELECT monitor_group, 'drift' AS alert, count(*) FILTER (js_distance >= {_W}) AS rows "
    "FROM d GROUP BY 1 UNION ALL SELECT monitor_group, 'quality', count(*) FILTER (null_rate > 0.2 OR record_count < 150 "
    "OR distinct_count < 3) FROM p GROUP BY 1) SELECT monitor_group, alert, "
    "CASE alert WHEN 'drift' THEN 'Drift' ELSE 'Quality' END || ' alert - ' || monitor_group AS alert_name, rows, "
    "CASE WHEN rows > 0 THEN 'TRIGGERED' ELSE 'OK' END AS state FROM x",
)
def group_states(spark, sf):
    """Both alerts of every group."""
    quality = group_rollup({name: profiles(spark, sf, name) for name in GROUPS})
    return A.states_by_group(_rollup(spark, sf), quality, ALERTS)


# --- summaries ----------------------------------------------------------------------------------------------------


@check(
    "worst_drifters",
    f"{_with(None, 'd')} SELECT source_table_name, department, owner, count(*) AS drift_events, "
    f"{r('max(js_distance)', 'max_drift')}, {r('avg(js_distance)', 'avg_drift')}, max(window_end) AS last_drift_time "
    "FROM d WHERE js_distance >= 0.1 GROUP BY ALL ORDER BY max(js_distance) DESC, source_table_name LIMIT 20",
)
def worst_drifters(spark, sf):
    """A5, O3"""
    return S.worst_drifters(drift(spark, sf))


@check(
    "quality_summary",
    f"{_with(None, 'p')} SELECT source_table_name, department, owner, count(DISTINCT column_name) AS columns_monitored, "
    f"{r('avg(null_rate)', 'avg_null_rate')}, {r('max(null_rate)', 'max_null_rate')}, "
    "sum(record_count)::BIGINT AS total_records, max(window_end) AS last_profile_time FROM p GROUP BY ALL "
    "ORDER BY max(null_rate) DESC, source_table_name LIMIT 20",
)
def quality_summary(spark, sf):
    """A6, O3"""
    return S.quality_summary(profiles(spark, sf))


@check(
    "feature_drift",
    f"{_with('default', 'd')} SELECT column_name, window_start, window_end, drift_type, "
    f"{sql.rounded_columns(['js_distance', 'ks_statistic', 'wasserstein_distance', 'chi_square_statistic'])} "
    "FROM d WHERE source_table_name = 'main.web.events'",
)
def feature_drift(spark, sf):
    """P22"""
    return S.feature_drift(drift(spark, sf), "main.web.events")


_WINDOW_DRIFT = (
    "SELECT source_table_name, window_start, window_end, granularity, max(js_distance) AS max_js_distance, "
    "avg(js_distance) AS avg_js_distance, count(DISTINCT column_name) AS columns_drifted FROM d "
    "WHERE js_distance IS NOT NULL GROUP BY ALL"
)


@check(
    "drift_per_window",
    f"{_with(None, 'd')} SELECT source_table_name, window_start, window_end, granularity, columns_drifted, "
    f"{sql.rounded_columns(['max_js_distance', 'avg_js_distance'])} FROM ({_WINDOW_DRIFT})",
)
def drift_per_window(spark, sf):
    """A8"""
    return S.window_drift(drift(spark, sf))


def _versus(extra: str, drift_extra: str) -> str:
    return (
        f"{_with('ml', 'd', 's')} SELECT s.source_table_name, s.window_start, s.window_end, s.granularity, "
        f"{sql.rounded_columns(['accuracy_score', 'r2_score', 'precision_weighted', 'f1_weighted', 'max_js_distance', 'avg_js_distance'])}, "
        f"coalesce(columns_drifted, -1) AS columns_drifted FROM s LEFT JOIN ({_WINDOW_DRIFT.replace('IS NOT NULL', 'IS NOT NULL' + drift_extra)}) w "
        "ON s.source_table_name = w.source_table_name AND s.window_start = w.window_start AND s.window_end = w.window_end "
        f"AND s.granularity = w.granularity {extra}"
    )


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("columns_drifted", F.coalesce("columns_drifted", F.lit(-1)))


@check("performance_vs_drift", _versus("", ""))
def performance_vs_drift(spark, sf):
    """Drift pooled over slices next to the scores of every slice."""
    return _counted(S.performance_vs_drift(scores(spark, sf), drift(spark, sf, "ml")))


@check("performance_vs_drift_overall", _versus("WHERE s.slice_key IS NULL", " AND slice_key IS NULL"))
def performance_vs_drift_overall(spark, sf):
    """J1 on whole tables only."""
    return _counted(S.performance_vs_drift(scores(spark, sf), drift(spark, sf, "ml"), overall_only=True))


# --- panels -------------------------------------------------------------------------------------------------------

_JS_AGG = f"{r('avg(js_distance)', 'avg_drift')}, {r('max(js_distance)', 'max_drift')}"
_CRIT = f"count(*) FILTER (js_distance >= {_C})"

_DRIFT_PANELS = {
    "panel_drift_overview": (
        lambda d: S.drift_overview(d, 0.1),
        f"SELECT count(DISTINCT source_table_name) AS total_tables, {_CRIT} AS critical_alerts, "
        f"count(*) FILTER (js_distance >= {_W} AND js_distance < {_C}) AS warning_alerts FROM d",
    ),
    "panel_drift_trend": (S.drift_trend, f"SELECT window_end, {_JS_AGG} FROM d GROUP BY 1"),
    "panel_top_drifters": (
        lambda d: S.top_drifters(d, 0.1),
        f"SELECT source_table_name, department, owner, {r('max(js_distance)', 'max_drift')}, {_CRIT} AS drift_count "
        "FROM d GROUP BY 1, 2, 3",
    ),
    "panel_department_drift": (
        S.department_drift,
        f"SELECT department, {r('avg(js_distance)', 'avg_drift')}, count(DISTINCT source_table_name) AS table_count "
        "FROM d GROUP BY 1",
    ),
    "panel_drift_heatmap": (
        S.drift_heatmap,
        f"SELECT source_table_name, column_name, {r('max(js_distance)', 'js_distance')} FROM d GROUP BY 1, 2",
    ),
    "panel_drift_details": (
        S.drift_details,
        "SELECT window_end, source_table_name, column_name, drift_type, owner, "
        f"{sql.rounded_columns(['js_distance', 'ks_statistic', 'wasserstein_distance'])} FROM d",
    ),
    "panel_drift_timeline": (
        lambda d: S.drift_timeline(d, "main.ml.prices"),
        "SELECT window_end, column_name, round(js_distance, 6) AS js_distance FROM d WHERE source_table_name = 'main.ml.prices'",
    ),
}
_PROFILE_PANELS = {
    "panel_quality_overview": (
        lambda p: S.quality_overview(p, 0.2, 150),
        "SELECT count(DISTINCT source_table_name) AS tables_profiled, count(*) FILTER (null_rate > 0.2) AS "
        "high_null_columns, count(DISTINCT CASE WHEN record_count < 150 THEN source_table_name END) AS low_row_tables FROM p",
    ),
    "panel_quality_overview_no_limits": (
        lambda p: S.quality_overview(p, None, None),
        "SELECT count(DISTINCT source_table_name) AS tables_profiled, 0::BIGINT AS high_null_columns, "
        "0::BIGINT AS low_row_tables FROM p",
    ),
    "panel_null_rate_trend": (
        S.null_rate_trend,
        f"SELECT window_end, {r('avg(null_rate)', 'avg_null_rate')}, {r('max(null_rate)', 'max_null_rate')} FROM p "
        "WHERE column_name <> ':table' GROUP BY 1",
    ),
    "panel_row_counts": (
        S.row_counts,
        "SELECT source_table_name, max(record_count) AS latest_record_count, max(distinct_count) AS latest_distinct_count "
        "FROM p GROUP BY 1",
    ),
    "panel_null_rates": (
        S.null_rates,
        f"SELECT source_table_name, column_name, {r('max(null_rate)', 'null_rate')} FROM p "
        "WHERE column_name <> ':table' GROUP BY 1, 2",
    ),
    "panel_quality_details": (
        S.quality_details,
        "SELECT window_end, source_table_name, column_name, round(null_rate, 6) AS null_rate, record_count, distinct_count, "
        "owner FROM p WHERE column_name <> ':table'",
    ),
}
_SCORE_PANELS = {
    "panel_model_overview": (
        S.model_overview,
        "SELECT count(DISTINCT source_table_name) AS models_monitored, count(DISTINCT CASE WHEN accuracy_score IS NOT NULL "
        "OR r2_score IS NOT NULL THEN source_table_name END) AS models_with_labels FROM s",
    ),
    "panel_score_trend": (
        S.score_trend,
        "SELECT window_end, source_table_name, round(score, 6) AS score FROM (SELECT DISTINCT window_end, source_table_name, "
        "coalesce(accuracy_score, r2_score) AS score FROM s)",
    ),
    "panel_best_scores": (
        S.best_scores,
        f"SELECT source_table_name, {r('max(accuracy_score)', 'accuracy_score')}, {r('max(r2_score)', 'r2_score')}, "
        f"{r('max(f1_weighted)', 'f1_weighted')}, {r('max(precision_weighted)', 'precision_weighted')}, max(owner) AS owner "
        "FROM s GROUP BY 1",
    ),
}
_ROLLUP_PANELS = {
    "panel_group_summary": (
        lambda g: S.group_summary(g, 0.1),
        "SELECT monitor_group, count(DISTINCT source_table_name) AS tables_monitored, "
        "count(*) FILTER (js_distance >= 0.1) AS critical_alerts FROM d GROUP BY 1",
    ),
    "panel_group_worst_drifters": (
        S.group_worst_drifters,
        f"SELECT source_table_name, monitor_group, {r('max(js_distance)', 'max_drift')} FROM d GROUP BY 1, 2",
    ),
    "panel_group_health": (
        S.group_health, f"SELECT monitor_group, {r('avg(js_distance)', 'avg_drift')} FROM d GROUP BY 1"
    ),
    "group_rollup": (
        lambda g: g.groupBy("monitor_group", "granularity").agg(F.count("*").alias("n")),
        "SELECT monitor_group, granularity, count(*) AS n FROM d GROUP BY 1, 2",
    ),
}


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    """U5"""
    return group_rollup({name: drift(spark, sf, name) for name in GROUPS})


for _panels, _frame, _cte in (
    (_DRIFT_PANELS, drift, "d"), (_PROFILE_PANELS, profiles, "p"), (_SCORE_PANELS, scores, "s"), (_ROLLUP_PANELS, _rollup, "d"),
):
    for _title, (_make, _sql) in _panels.items():

        @check(_title, f"{_with(None, _cte)} {_sql}")
        def _panel(spark, sf, make=_make, frame=_frame):
            """W1-W14, W16-W19"""
            return make(frame(spark, sf))


@check(
    "panel_score_vs_drift",
    f"{_with('ml', 'd', 's')} SELECT s.source_table_name, round(coalesce(accuracy_score, r2_score), 6) AS score, "
    f"round(max_js_distance, 6) AS max_js_distance FROM s LEFT JOIN ({_WINDOW_DRIFT}) w "
    "ON s.source_table_name = w.source_table_name AND s.window_start = w.window_start AND s.window_end = w.window_end "
    "AND s.granularity = w.granularity",
)
def panel_score_vs_drift(spark, sf):
    """W15"""
    return S.score_vs_drift(scores(spark, sf), drift(spark, sf, "ml"))
