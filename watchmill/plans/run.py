"""One monitoring run: resolve the settings, compute and store the metrics of every table, publish per group, alert."""

from __future__ import annotations

import json
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.functions.naming import DEFAULT_GROUP, group_slug
from watchmill.functions.templates import template_problems
from watchmill.functions.windows import as_instant
from watchmill.operators.alerts import (
    alert_state,
    drift_issues,
    due_notifications,
    quality_issues,
    resolve_destinations,
    routes,
)
from watchmill.operators.custom import (
    ROW_KEYS,
    custom_aggregates,
    custom_drift,
    missing_functions,
    with_custom_aggregates,
    with_derived,
)
from watchmill.operators.discovery import discover, leaf_collisions, slug_collisions
from watchmill.operators.drift import (
    baseline_drift,
    compared_fields,
    consecutive_drift,
    counted_drift,
    drift_fields,
    shared_with_baseline,
    snapshot_drift,
    stored_counts,
)
from watchmill.operators.frequencies import ALL_ROWS, value_counts
from watchmill.operators.grouping import is_number, name_at
from watchmill.operators.performance import labelled, performance, scored
from watchmill.operators.profile import profile, safe_slices, with_performance
from watchmill.operators.provisioning import run_summary
from watchmill.operators.sketch_drift import sketch_baseline_drift, sketch_drift, stored_sketches
from watchmill.operators.unify import Member, unified_drift, unified_performance, unified_profile
from watchmill.plans.increment import CHANGE, State, renewed_aggregates, renewed_metrics, settings_text, take_in
from watchmill.schemas import DRIFT_METRICS, PROFILE_METRICS, empty
from watchmill.settings import Monitor, RunSettings, TableSettings, resolve_monitor, settings_problems
from watchmill.sources.ledger import Committed, commit, committed, read_version, write_version
from watchmill.sources.sinks import drop_stale_views, ensure_schema, publish_groups
from watchmill.sources.tables import read_table
from watchmill.streaming.live import new_rows

#: Tables worked on at the same time; Spark schedules their jobs together.
PARALLEL_TABLES = 4


@dataclass
class TableMetrics:
    """The metric frames of one table."""

    profile: DataFrame
    drift: DataFrame


@dataclass
class RunReport:
    """What a run did."""

    tables: dict[str, str] = field(default_factory=dict)
    views: dict[str, dict[str, str]] = field(default_factory=dict)
    alerts: DataFrame | None = None
    #: Firing alerts that are due, one row for each address.
    notifications: DataFrame | None = None
    #: Rows without an instant, which belong to no window, of each table that has any.
    without_time: dict[str, int] = field(default_factory=dict)

    def summary(self, spark: SparkSession) -> DataFrame:
        """Counts by action."""
        rows = [(name, text.split(":")[0]) for name, text in self.tables.items()]
        return run_summary(spark.createDataFrame(rows, "full_name string, action string"))


def compute_metrics(
    df: DataFrame,
    monitor: Monitor,
    baseline: DataFrame | None = None,
    previous: DataFrame | None = None,
    *,
    distinct: str = "approx",
    drift_mode: str = "exact",
) -> TableMetrics:
    """Profile, model quality, custom metrics and drift of one table.

    ``drift_mode`` 'sketch' compares numeric columns by mergeable sketches, for tables whose values hardly repeat,
    with the windows before and with a baseline.
    ``previous`` is the snapshot before this one, for SNAPSHOT tables.
    """
    rows = with_performance(profile(df, monitor, distinct=distinct), performance(df, monitor))
    if baseline is not None:
        rows = rows.unionByName(_baseline_profile(baseline, monitor, distinct))
    if any(metric.metric_type == "aggregate" for metric in monitor.custom_metrics):
        rows = with_custom_aggregates(rows, custom_aggregates(df, monitor))
    rows = with_derived(rows, monitor.custom_metrics, df.columns)

    parts = []
    counts = None
    sketches = None
    numbers = [f for f in drift_fields(df, monitor) if is_number(f)]
    if drift_mode == "sketch" and numbers and monitor.granularities:
        sketches = stored_sketches(df, monitor, numbers)
    if monitor.granularities and drift_mode == "sketch":
        parts.append(sketch_drift(df, monitor, sketches))
    elif monitor.granularities:
        fields = drift_fields(df, monitor)
        counts = stored_counts(df, monitor, fields) if fields else None
        parts.append(consecutive_drift(df, monitor, counts))
    elif previous is not None:
        parts.append(snapshot_drift(df, previous, monitor))
    if baseline is not None:
        shared = shared_with_baseline(monitor, baseline)
        alike = shared.slice_columns == monitor.slice_columns and compared_fields(df, baseline, shared) == drift_fields(df, monitor)
        if drift_mode == "sketch":
            parts.append(sketch_baseline_drift(df, baseline, monitor, sketches if alike else None))
        else:
            parts.append(baseline_drift(df, baseline, monitor, counts if alike else None))
    drift = parts[0] if parts else empty(df.sparkSession, DRIFT_METRICS)
    for part in parts[1:]:
        drift = drift.unionByName(part)
    return TableMetrics(rows, _with_custom_drift(drift, rows, monitor, baseline is not None))


def _baseline_profile(baseline: DataFrame, monitor: Monitor, distinct: str) -> DataFrame:
    common = shared_with_baseline(monitor, baseline).slice_columns
    still = Monitor(monitor.table, "SNAPSHOT", granularities=(), slices=common, columns=monitor.columns)
    return with_performance(profile(baseline, still, log_type="BASELINE", distinct=distinct), None)


def _snapshot_history(spark: SparkSession, df: DataFrame, monitor: Monitor, place: _Place) -> DataFrame | None:
    """T4 with J9: the snapshot's value counts are kept, and compared with those of the snapshot before, whose rows may be gone
    by now. Columns both have are compared, slices if they are the same ones.
    """
    fields = drift_fields(df, monitor)
    if not fields:
        return None
    value_counts(df, monitor, fields).write.mode("overwrite").parquet(f"{place.state}/snapshot/run={place.number}")
    if not place.last.run or place.last.settings is None:
        return None
    before = json.loads(place.last.settings)
    held = {name: (i, kind) for i, (name, kind) in enumerate(before["columns"])}
    common = [f for f in fields if held.get(f.name, (0, None))[1] == f.dataType.simpleString()]
    if not common:
        return None

    def in_common(run: int, places: list[int]) -> DataFrame:
        rows = spark.read.parquet(f"{place.state}/snapshot/run={run}")
        if before["slices"] != list(monitor.slice_columns):
            rows = rows.filter("g.slice IS NULL")
        at = F.when(F.col("c") == ALL_ROWS, ALL_ROWS)
        for new, old in enumerate(places):
            at = at.when(F.col("c") == old, new)
        return rows.withColumn("c", at).filter("c IS NOT NULL")

    now = in_common(place.number, [fields.index(f) for f in common])
    then = in_common(place.last.run, [held[f.name][0] for f in common])
    return counted_drift(now, then, monitor, common)


def _in_places(metrics: DataFrame, places: DataFrame, monitor: Monitor, *, kept: str) -> DataFrame:
    """Metric rows in some partitions (``left_semi``), or outside of them (``left_anti``)."""
    named = places.select(F.struct(name_at(F.col("granularity"), monitor.granularities).alias("granularity"), "window_date").alias("__place"))
    return metrics.join(named, F.struct("granularity", F.to_date("window.start").alias("window_date")) == F.col("__place"), kept)


@dataclass(frozen=True)
class _Place:
    """Where the metrics, the state and the ledger of a table are, and what its ledger says."""

    leaf: str
    last: Committed
    number: int

    @property
    def ledger(self) -> str:
        return f"{self.leaf}_ledger"

    @property
    def state(self) -> str:
        return f"{self.leaf}_state"

    @classmethod
    def of(cls, spark: SparkSession, leaf: str) -> _Place:
        last = committed(spark, f"{leaf}_ledger")
        return cls(leaf, last, last.run + 1)


def _incremental(
    spark: SparkSession,
    df: DataFrame,
    monitor: Monitor,
    baseline: DataFrame | None,
    place: _Place,
    settings: str,
    scored: bool | None,
    changes: DataFrame | None,
    distinct: str,
    lookback_days: int | None,
) -> int:
    """ST2, ST4: take in what is new and renew the windows it touches. Without a usable state before, all rows are new (or
    those of the last days). Returns the number of rows without an instant among the new ones.
    """
    at, last = monitor.timestamp_column, place.last
    full = not last.run or last.settings != settings
    if full:
        rows = df if lookback_days is None else new_rows(df, at, days=lookback_days)
    elif changes is not None:
        rows = changes.select(*df.columns, *([CHANGE] if CHANGE in changes.columns else []))
    else:
        kind = next(f.dataType for f in df.schema if f.name.lower() == at.lower())
        rows = new_rows(df, at, F.lit(last.mark).cast(kind)) if last.mark is not None else df
    state = State(spark, place.state, place.number, place.number if full else last.full)
    take_in(state, df, rows, monitor, distinct=distinct, scored=scored)
    found = renewed_metrics(state, df if not full else rows, monitor, baseline, distinct=distinct, scored=scored)

    profiles = found.profile
    if full and baseline is not None:
        profiles = profiles.unionByName(_baseline_profile(baseline, monitor, distinct))
    if any(metric.metric_type == "aggregate" for metric in monitor.custom_metrics):
        profiles = with_custom_aggregates(profiles, renewed_aggregates(df if not full else rows, monitor, found.touched))
    profiles = with_derived(profiles, monitor.custom_metrics, df.columns)
    write_version(profiles, f"{place.leaf}_profile_metrics", place.number)
    drift = found.drift if found.drift is not None else empty(spark, DRIFT_METRICS)
    if any(metric.metric_type == "drift" for metric in monitor.custom_metrics):
        fresh = spark.read.schema(profiles.schema).parquet(f"{place.leaf}_profile_metrics/run={place.number}").select(*profiles.columns)
        if not full:
            # A window is compared with the one before it, which may be an old row.
            old = read_version(spark, f"{place.leaf}_profile_metrics", place.ledger, profiles.schema, "profile")
            fresh = fresh.unionByName(_in_places(old, found.touched, monitor, kept="left_anti"))
        drift = _with_custom_drift(drift, fresh, monitor, baseline is not None)
        if not full:
            drift = _in_places(drift, found.drifted, monitor, kept="left_semi")
    write_version(drift, f"{place.leaf}_drift_metrics", place.number)

    instant = as_instant(rows, at)
    seen = rows.agg(F.max(instant).cast("string").alias("mark"), F.count_if(instant.isNull()).alias("lost")).first()
    marks = [mark for mark in (None if full else last.mark, seen.mark) if mark is not None]
    commit(spark, place.ledger, place.number, full=full, mark=max(marks, default=None), settings=settings, replaced=found.replaced(monitor))
    return seen.lost


def _with_custom_drift(drift: DataFrame, profiles: DataFrame, monitor: Monitor, has_baseline: bool) -> DataFrame:
    """Drift rows with the custom drift metrics beside them. A column without other drift gets rows of its own."""
    names = [metric.name for metric in monitor.custom_metrics if metric.metric_type == "drift"]
    if not names:
        return drift
    current = profiles.filter("log_type = 'INPUT'")
    found = custom_drift(current, monitor.custom_metrics) if monitor.granularities else None
    if has_baseline:
        against = custom_drift(current, monitor.custom_metrics, profiles.filter("log_type = 'BASELINE'"))
        found = against if found is None else found.unionByName(against)
    if found is None:
        return drift
    key = F.struct(*ROW_KEYS, "column_name", "drift_type")
    own = [f.name for f in DRIFT_METRICS if f.name not in (*ROW_KEYS, "column_name", "drift_type")]
    left, right = drift.select(key.alias("key"), *own), found.select(key.alias("key"), *names)
    return left.join(right, "key", "full").select("key.*", *own, *names)


def _table_names(
    settings: RunSettings, inventory: DataFrame | None, tags: dict[str, dict[str, str]]
) -> list[str]:
    """Tables found by their tags, most important first, then the configured ones. Tags found are added."""
    configured = list(settings.monitored_tables)
    if not (settings.include_tagged_tables and settings.discovery and inventory is not None):
        return configured
    # Names and tags of the tables to monitor, not their data.
    found = discover(inventory, settings.discovery).select("full_name", "tags").collect()
    for row in found:
        tags.setdefault(row.full_name, dict(row.tags))
    return [row.full_name for row in found if row.full_name not in settings.monitored_tables] + configured


def _missing_column(df: DataFrame, monitor: Monitor) -> str | None:
    """P15 for one table."""
    present = {name.lower() for name in df.columns}
    asked = (monitor.prediction_column, monitor.timestamp_column, monitor.label_column, monitor.model_id_column)
    return next((name for name in asked if name and name.lower() not in present), None)


def _decided(last: Committed, monitor: Monitor) -> dict | None:
    """What the run before found out about the rows of a table, if it still was asked the same."""
    if last.settings is None:
        return None
    found = json.loads(last.settings).get("decided")
    return found if found and found["asked"] == list(monitor.slice_columns) else None


def _collisions(spark: SparkSession, settings: RunSettings, names: list[str], tags: dict[str, dict[str, str]]) -> list:
    """Tables that would write to the same place, groups that would share views, metrics of one name."""
    found = []
    if names:
        frame = spark.createDataFrame([(name,) for name in names], "full_name string")
        found += [("leaf_name", row.full_name) for row in leaf_collisions(frame).collect()]
        groups = {tags.get(name, {}).get(settings.monitor_group_tag, DEFAULT_GROUP) for name in names}
        frame = spark.createDataFrame([(group,) for group in sorted(groups)], "group_name string")
        found += [("group_slug", row.group_name) for row in slug_collisions(frame).collect()]
    layers = {"defaults": settings.profile_defaults.custom_metrics}
    layers |= {name: own.custom_metrics or () for name, own in settings.monitored_tables.items()}
    for layer, metrics in layers.items():
        uses = Counter(metric.name for metric in metrics)
        found += [("metric_name", f"{layer}: {name}") for name, n in uses.items() if n > 1]
    return sorted(found)


def run(
    spark: SparkSession,
    settings: RunSettings,
    output_path: str,
    tags: dict[str, dict[str, str]] | None = None,
    paths: dict[str, str] | None = None,
    *,
    inventory: DataFrame | None = None,
    quota: int | None = None,
    distinct: str = "approx",
    drift_mode: str = "exact",
    materialized: bool = False,
    history: DataFrame | None = None,
    destinations: DataFrame | None = None,
    incremental: bool = False,
    changes: dict[str, DataFrame] | None = None,
    lookback_days: int | None = None,
) -> RunReport:
    """The whole run over the configured tables and, with an ``inventory``, the ones their tags enroll. Settings that
    break a rule, and names that collide, stop it before any work starts; a table that fails, lacks a column or exceeds
    the ``quota`` is reported and left out of its group's views.

    ``materialized`` stores the unified frames as tables of the output schema, which other sessions can read, and drops
    those of groups that are gone. ``history`` (alert_name, fired_at) holds earlier notifications and ``destinations``
    (name, id) the known ones.

    Every run gives each table a new version of its metrics; readers see it once its ledger row is written, last of all. An
    ``incremental`` run keeps mergeable counts and sums beside the metrics of tables with windows, and takes in only the rows
    past the mark of the run before, or the ``changes`` of a table: rows with a ``_change_type`` (insert, delete,
    update_preimage, update_postimage), or all new ones; these may be late. A first such run, and one whose settings changed,
    takes in the whole table, or its last ``lookback_days``. Snapshots are compared with the one of the run before. Sketch mode
    has no increments.
    """
    problems = [*settings_problems(settings), *template_problems(settings), *missing_functions(spark, settings)]
    if problems:
        raise ValueError(f"settings cannot be used: {problems}")
    tags = dict(tags or {})
    report = RunReport()
    names = _table_names(settings, inventory, tags)
    collisions = _collisions(spark, settings, names, tags)
    if collisions:
        raise ValueError(f"names collide: {collisions}")
    for name in names[quota:] if quota is not None else ():
        report.tables[name] = "skipped_quota"

    def one(name: str) -> Member | str:
        df = read_table(spark, name, paths)
        monitor = resolve_monitor(settings, name, tags.get(name), df.schema)
        missing = _missing_column(df, monitor)
        if missing:
            return f"skipped_column_missing: {missing}"
        limit = settings.profile_defaults.max_slicing_cardinality
        place = _Place.of(spark, f"{output_path}/{monitor.leaf_name}")
        keeps_state = incremental and bool(monitor.granularities) and drift_mode == "exact"
        decided = _decided(place.last, monitor) if keeps_state else None
        asked = monitor
        safe = decided["safe"] if decided else safe_slices(df, monitor.slice_columns, limit)
        model = monitor.model_id_column if monitor.model_id_column in safe else None
        monitor = replace(monitor, slices=tuple(s for s in monitor.slices if s in safe), model_id_column=model)
        baseline = read_table(spark, monitor.baseline_table, paths) if monitor.baseline_table else None
        if keeps_state:
            judged = monitor.profile_type == "INFERENCE" and monitor.prediction_column and monitor.label_column
            scores = (decided["scored"] if decided else scored(labelled(df, monitor), monitor)) if judged else None
            text = settings_text(df, monitor, distinct, {"safe": list(safe), "scored": scores, "asked": list(asked.slice_columns)})
            lost = _incremental(spark, df, monitor, baseline, place, text, scores, (changes or {}).get(name), distinct, lookback_days)
        else:
            lost = 0
            if monitor.granularities:
                lost = df.filter(as_instant(df, monitor.timestamp_column).isNull()).count()
            metrics = compute_metrics(df, monitor, baseline, distinct=distinct, drift_mode=drift_mode)
            drift, kept = metrics.drift, None
            if not monitor.granularities:
                against = _snapshot_history(spark, df, monitor, place)
                drift = drift.unionByName(against, allowMissingColumns=True) if against is not None else drift
                kept = json.dumps({"columns": [(f.name, f.dataType.simpleString()) for f in drift_fields(df, monitor)], "slices": monitor.slice_columns})
            write_version(metrics.profile, f"{place.leaf}_profile_metrics", place.number)
            write_version(drift, f"{place.leaf}_drift_metrics", place.number)
            commit(spark, place.ledger, place.number, full=True, settings=kept)
        if lost:
            report.without_time[name] = lost
        return Member(monitor, settings.monitored_tables.get(name, TableSettings()), tags.get(name, {}))

    members: dict[str, Member] = {}
    with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
        started = {name: pool.submit(one, name) for name in names[:quota]}
        for name, task in started.items():
            try:
                result = task.result()
            except Exception as error:
                report.tables[name] = f"failed: {error}"
                continue
            if isinstance(result, Member):
                members[name] = result
            report.tables[name] = "created" if isinstance(result, Member) else result

    groups: dict[str, list[Member]] = {}
    for name, member in members.items():
        groups.setdefault(tags.get(name, {}).get(settings.monitor_group_tag, DEFAULT_GROUP), []).append(member)
    slugs = _slugs(spark, list(groups))
    frames = {slugs[name]: _group_frames(spark, settings, output_path, found) for name, found in groups.items()}
    schema = settings.profile_defaults.output_schema_name if materialized else None
    if schema:
        ensure_schema(spark, schema)
    report.views = publish_groups(frames, schema=schema)
    if schema:
        drop_stale_views(spark, list(frames), schema=schema)
    report.alerts = _alerts(settings, {name: frames[slugs[name]] for name in groups})
    report.notifications = _notifications(spark, settings, report.alerts, history, destinations)
    return report


def _notifications(
    spark: SparkSession,
    settings: RunSettings,
    states: DataFrame | None,
    history: DataFrame | None,
    destinations: DataFrame | None,
) -> DataFrame | None:
    """Who is to be told of which firing alert now."""
    if states is None:
        return None
    history = history if history is not None else spark.createDataFrame([], "alert_name string, fired_at timestamp")
    known = destinations if destinations is not None else spark.createDataFrame([], "name string, id string")
    alerting = settings.alerting
    routing = spark.createDataFrame(
        [(group, list(names)) for group, names in alerting.group_notifications.items()],
        "monitor_group string, destinations array<string>",
    )
    due = due_notifications(states, history, F.current_timestamp(), alerting.repeat_seconds)
    routed = routes(due.select("monitor_group").distinct(), routing, alerting.default_notifications)
    return due.drop("last_fired").join(resolve_destinations(routed, known), "monitor_group")


def _slugs(spark: SparkSession, names: list[str]) -> dict[str, str]:
    if not names:
        return {}
    rows = spark.createDataFrame([(name,) for name in names], "name string")
    slugs = {r.name: r.slug for r in rows.select("name", group_slug(F.col("name")).alias("slug")).collect()}
    if len(set(slugs.values())) < len(slugs):
        raise ValueError(f"monitor groups share a slug: {slugs}")
    return slugs


def _group_frames(spark: SparkSession, settings: RunSettings, output_path: str, members: list[Member]) -> dict:
    def stored(kind: str, schema) -> list[tuple[Member, DataFrame]]:
        return [
            (m, read_version(spark, f"{leaf}_{kind}_metrics", f"{leaf}_ledger", schema, kind))
            for m in members
            for leaf in [f"{output_path}/{m.monitor.leaf_name}"]
        ]

    limit = settings.alerting.drift_threshold
    return {
        "drift": lambda: unified_drift(spark, stored("drift", DRIFT_METRICS), limit),
        "profile": lambda: unified_profile(spark, stored("profile", PROFILE_METRICS)),
        "performance": lambda: unified_performance(spark, stored("profile", PROFILE_METRICS)),
    }


def _alerts(settings: RunSettings, frames: dict[str, dict]) -> DataFrame | None:
    """States of both alerts of every group."""
    states = None
    for name, kinds in frames.items():
        issues = {"Drift": drift_issues(kinds["drift"](), settings.alerting)}
        quality = quality_issues(kinds["profile"](), settings.alerting)
        if quality is not None:
            issues["Quality"] = quality
        for title, rows in issues.items():
            state = alert_state(rows, f"{title} alert - {name}").withColumn("monitor_group", F.lit(name))
            states = state if states is None else states.unionByName(state)
    return states
