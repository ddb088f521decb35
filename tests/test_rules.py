"""Settings, names, alerts, policy and coverage on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from watchmill.functions.naming import duration_text, glob_match, group_slug, identifier_slug, priority, whole_days_between
from watchmill.functions.templates import render, template_problems
from watchmill.operators import alerts as A
from watchmill.operators import coverage as C
from watchmill.operators import provisioning as V
from watchmill.operators.custom import missing_functions
from watchmill.operators.unify import Member, context, threshold, unified_drift, unified_performance, unified_profile
from watchmill.schemas import UNIFIED_DRIFT, UNIFIED_PERFORMANCE, UNIFIED_PROFILE
from watchmill.settings import (
    CLASSIFICATION,
    REGRESSION,
    AlertSettings,
    CustomMetric,
    DiscoverySettings,
    Monitor,
    Objective,
    ProfileDefaults,
    RunSettings,
    TableSettings,
    resolve_granularities,
    resolve_metrics,
    resolve_monitor,
    resolve_problem_type,
    resolve_timestamp,
    settings_problems,
)
from watchmill.sources.tables import inventory_row

SLUGS = [
    ("ml_team", "ml_team"),
    ("ML_Team", "ml_team"),
    ("Marketing & Sales", "marketing_sales"),
    ("North America (NA)", "north_america_na"),
    ("Team-123", "team_123"),
    ("ml___team", "ml_team"),
    ("_team_", "team"),
    ("", "unnamed"),
    ("   ", "unnamed"),
    ("!@#$%", "unnamed"),
    ("a" * 100, "a" * 64),
    ("a" * 63 + "_b", "a" * 63),
]


def _values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_slugs(spark):
    got = _values(spark, [(raw,) for raw, _ in SLUGS], "t string", identifier_slug(F.col("t")))
    assert got == [slug for _, slug in SLUGS]
    assert _values(spark, [(None,), ("",), ("A b",)], "t string", group_slug(F.col("t"))) == ["default", "default", "a_b"]
    assert _values(spark, [("abcdefghij",)], "t string", identifier_slug(F.col("t"), 5)) == ["abcde"]


def test_priorities(spark):
    raw = ["1", " 7 ", "-3", "high", "1.5", "", None, "99999999999"]
    assert _values(spark, [(t,) for t in raw], "t string", priority(F.col("t"))) == [1, 7, -3, 99, 99, 99, 99, 99]


def test_globs(spark):
    names = [("tmp_a",), ("dev",), ("a.b",), ("axb",), ("s1",), ("s3",)]
    assert _values(spark, names, "t string", glob_match(F.col("t"), ("tmp_*", "a.b", "s[12]"))) == [
        True, False, True, False, True, False,
    ]


def test_durations(spark):
    got = _values(spark, [(30.5,), (59.0,), (60.0,), (120.0,), (3600.0,)], "s double", duration_text(F.col("s")))
    assert got == ["30.5s", "59.0s", "1.0m", "2.0m", "1.0h"]


def _run(**kwargs):
    defaults = kwargs.pop("defaults", ProfileDefaults("monitoring", timestamp_column="ts"))
    return RunSettings("main", defaults, **kwargs)


def test_settings_come_from_the_table_first(spark):
    run = _run(
        monitored_tables={"main.a.t": TableSettings(granularities=("1 hour", "1 day"), timestamp_column="at")},
        defaults=ProfileDefaults("m", granularity="1 week", timestamp_column="ts", slicing_exprs=("`region`",)),
    )
    assert resolve_granularities(run, "main.a.t") == ("1 hour", "1 day")
    assert resolve_granularities(run, "main.a.other") == ("1 week",)
    assert resolve_timestamp(run, "main.a.t") == "at" and resolve_timestamp(run, "main.a.other") == "ts"
    assert resolve_monitor(run, "main.a.t").slices == ("region",)
    odd = _run(defaults=ProfileDefaults("m", granularity="7 days", timestamp_column="ts"))
    assert resolve_granularities(odd, "x") == ("1 day",)


def test_problem_type_order(spark):
    schema = spark.range(1).selectExpr("id AS label", "'x' AS name").schema
    none = ProfileDefaults("m", problem_type=None, label_column="LABEL", timestamp_column="ts")
    assert resolve_problem_type(_run(defaults=none), "t", {}, schema) == REGRESSION
    texts = ProfileDefaults("m", problem_type=None, label_column="name", timestamp_column="ts")
    assert resolve_problem_type(_run(defaults=texts), "t", {}, schema) == CLASSIFICATION
    assert resolve_problem_type(_run(defaults=none), "t", {"monitor_problem_type": "classification"}, schema) == CLASSIFICATION
    own = _run(monitored_tables={"t": TableSettings(problem_type=REGRESSION)})
    assert resolve_problem_type(own, "t", {"monitor_problem_type": "classification"}) == REGRESSION


def test_metric_layers_and_objectives():
    def metric(name, text):
        return CustomMetric(name, "aggregate", (":table",), text)

    run = _run(
        defaults=ProfileDefaults("m", timestamp_column="ts", custom_metrics=(metric("a", "1"), metric("b", "1"))),
        objective_functions={"auc": Objective(metric("b", "2"), version="1.2"), "x": Objective(CustomMetric("z", "odd", (), "9"))},
        monitored_tables={"t": TableSettings(objective_function_ids=("auc", "x"), custom_metrics=(metric("c", "3"), metric("a", "3")))},
    )
    assert [(m.name, m.definition) for m in resolve_metrics(run, "t")] == [("a", "3"), ("b", "2"), ("c", "3")]
    assert [(m.name, m.definition) for m in resolve_metrics(run, "other")] == [("a", "1"), ("b", "1")]


def test_settings_problems():
    good = _run(monitored_tables={"main.a.t": TableSettings()})
    assert settings_problems(good) == []
    bad = _run(
        defaults=ProfileDefaults("a.b", prediction_column=None),
        include_tagged_tables=True,
        monitored_tables={
            "a.t": TableSettings(granularity="2 days"),
            "other.a.t": TableSettings(drift_threshold=1.5, objective_function_ids=("nope",)),
        },
    )
    assert {rule for rule, _ in settings_problems(bad)} == {
        "output_schema_name", "prediction_column", "timestamp_column", "discovery", "three_level_name", "granularity",
        "catalog", "drift_threshold", "objective_function",
    }
    series = _run(defaults=ProfileDefaults("m", profile_type="TIMESERIES"), monitored_tables={"main.a.t": TableSettings()})
    assert settings_problems(series) == [("timeseries_timestamp_column", "TIMESERIES")]
    assert settings_problems(_run()) == [("monitored_tables", "empty")]
    assert DiscoverySettings().include_tags == {"monitor_enabled": "true"}


def test_templates():
    assert render("SUM({{ input_column }}) / {{x}}", {"input_column": "`a`", "x": "2"}) == "SUM(`a`) / 2"
    with pytest.raises(ValueError, match="nope"):
        render("{{nope}}", {})
    metric = CustomMetric("auc", "aggregate", (":table",), "f({{prediction_col}}, {{label_col}})")
    needs = {"monitored_tables": {"t": TableSettings(objective_function_ids=("auc",))}, "objective_functions": {"auc": Objective(metric)}}
    assert template_problems(_run(**needs)) == [("t", "auc", "needs_label_column")]
    series = ProfileDefaults("m", profile_type="TIMESERIES", timeseries_timestamp_column="ts")
    assert template_problems(_run(defaults=series, **needs)) == [("t", "auc", "needs_inference")]


def test_missing_functions_are_listed_once(spark):
    metric = CustomMetric("m", "aggregate", (":table",), "count(1)")
    run = _run(
        objective_functions={
            "a": Objective(metric, function_name="no_such_function"),
            "b": Objective(metric, function_name="no_such_function"),
            "c": Objective(metric, function_name="abs"),
            "d": Objective(metric),
        }
    )
    assert missing_functions(spark, run) == [("a", "no_such_function")]


def _drift_rows(spark, rows):
    base = "source_table_name string, js_distance double, drift_threshold double"
    df = spark.createDataFrame(rows, base)
    df = df.withColumns({n: F.lit(None).cast("string") for n in ("granularity", "slice_key", "slice_value")})
    fixed = {"owner": "o", "department": "d", "column_name": "c", "drift_type": "CONSECUTIVE", "runbook_url": "", "lineage_url": ""}
    df = df.withColumns({k: F.lit(v) for k, v in fixed.items()})
    return df.withColumns(
        {"chi_square_statistic": F.lit(0.0), "window_start": F.lit(None).cast("timestamp"), "window_end": F.lit(None).cast("timestamp")}
    )


def test_severity_bands(spark):
    rows = [("high", 0.4, 0.4), ("high", 0.2, 0.4), ("high", 0.19, 0.4), ("low", 0.05, 0.05), ("low", 0.04, 0.05),
            ("zero", 0.0, 0.0), ("default", 0.2, None), ("default", 0.1, None), ("default", 0.09, None), ("none", None, 0.1)]
    found = A.drift_issues(_drift_rows(spark, rows), AlertSettings(drift_threshold=0.2)).collect()
    assert sorted((r.source_table_name, r.js_distance, r.severity) for r in found) == [
        ("default", 0.1, "WARNING"), ("default", 0.2, "CRITICAL"), ("high", 0.2, "WARNING"), ("high", 0.4, "CRITICAL"),
        ("low", 0.05, "CRITICAL"), ("zero", 0.0, "CRITICAL"),
    ]


def test_alert_is_limited_and_ordered(spark):
    rows = [("t", i / 1000, 0.0) for i in range(300)]
    found = A.drift_alert(_drift_rows(spark, rows), AlertSettings()).collect()
    assert [r.js_distance for r in found] == [i / 1000 for i in range(299, 199, -1)]


def test_quality_without_limits_has_no_alert(spark):
    assert A.quality_issues(spark.range(1), AlertSettings()) is None
    assert A.quality_alert(spark.range(1), AlertSettings()) is None


def test_alert_state_comparisons(spark):
    rows = spark.createDataFrame([(0.5,), (2.0,)], "trigger_value double")
    for op, limit, state in ((">=", 2.0, "TRIGGERED"), (">", 2.0, "OK"), ("<", 0.5, "OK"), ("<=", 0.5, "TRIGGERED"),
                             ("==", 2.0, "TRIGGERED"), ("!=", 0.5, "TRIGGERED"), ("?", 3.0, "OK")):
        assert A.alert_state(rows, "a", op, limit).first().state == state
    assert A.alert_state(rows.limit(0), "a").first().state == "OK"


def test_repeats_are_held_back(spark):
    now = dt.datetime(2024, 5, 1, 12)
    states = spark.createDataFrame([(n, s) for n, s in (("new", "TRIGGERED"), ("old", "TRIGGERED"), ("fresh", "TRIGGERED"), ("ok", "OK"))],
                                   "alert_name string, state string")
    history = spark.createDataFrame(
        [("old", now - dt.timedelta(hours=3)), ("old", now - dt.timedelta(seconds=3600)), ("fresh", now - dt.timedelta(minutes=59))],
        "alert_name string, fired_at timestamp",
    )
    due = A.due_notifications(states, history, F.lit(now))
    assert {r.alert_name for r in due.collect()} == {"new", "old"}


def test_empty_route_reaches_nobody(spark):
    groups = spark.createDataFrame([("a",), ("b",), ("c",)], "monitor_group string")
    routing = spark.createDataFrame([("a", ["x@y.z"]), ("b", [])], "monitor_group string, destinations array<string>")
    routed = A.routes(groups, routing, ("oncall",))
    assert sorted(map(tuple, routed.collect())) == [("a", "x@y.z"), ("c", "oncall")]
    known = spark.createDataFrame([("other", "1")], "name string, id string")
    assert [r.address for r in A.resolve_destinations(routed, known).collect()] == ["x@y.z"]


def test_refresh_states(spark):
    now = dt.datetime(2024, 5, 1)
    monitors = spark.createDataFrame(
        [(1, "fresh", "ACTIVE", False), (2, "old", "ACTIVE", False), (3, "starting", "ACTIVE", False), (4, "never", "FAILED", False),
         (5, "broken", "ACTIVE", True), (6, "edge", "ACTIVE", False)],
        "object_id int, full_name string, status string, lookup_failed boolean",
    ).withColumn("monitor_id", F.col("object_id").cast("string"))
    refreshes = spark.createDataFrame(
        [(1, now - dt.timedelta(days=3)), (2, now - dt.timedelta(days=31, hours=5)), (2, now - dt.timedelta(days=90)),
         (6, now - dt.timedelta(days=30))],
        "object_id int, created_at timestamp",
    )
    found = {r.full_name: (r.refresh_state, r.days_since_refresh) for r in C.refresh_states(monitors, refreshes, F.lit(now)).collect()}
    assert found == {"old": ("stale", 31), "never": ("never_refreshed", None), "broken": ("refresh_history_unavailable", None)}


def test_coverage_of_nothing(spark):
    inventory = spark.createDataFrame([], "full_name string, table_id int")
    monitored = spark.createDataFrame([], "full_name string, monitor_id string")
    attention = spark.createDataFrame([], "refresh_state string")
    row = C.coverage_summary(inventory, monitored, attention, monitored).first()
    assert row.total_catalog_tables == 0 and row.coverage_pct == 0.0 and row.stale_count == 0


def test_granularity_labels_and_slices(spark):
    rows = [(["AGGREGATION_GRANULARITY_1_DAY", "1 hour", "odd"], ["`a`", "b"]), (["odd"], []), (None, None)]
    df = spark.createDataFrame(rows, "g array<string>, s array<string>")
    got = df.select(V.granularity_labels(F.col("g")), V.slice_names(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(["1 day", "1 hour"], ["a", "b"]), (None, None), (None, None)]


def test_hash_covers_granularities_and_not_the_rest(spark):
    df = spark.createDataFrame([(["1 day"], "x", 1), (["1 hour"], "x", 1), (["1 day"], "x", 2)], "granularities array<string>, label_column string, monitor_id int")
    a, b, c = (r[0] for r in df.select(V.monitor_hash(df)).collect())
    assert a == c != b and len(a) == 16


def test_empty_unified_frames_are_typed(spark):
    assert unified_drift(spark, [], 0.2).schema == UNIFIED_DRIFT
    assert unified_profile(spark, []).schema == UNIFIED_PROFILE
    assert unified_performance(spark, []).schema == UNIFIED_PERFORMANCE


def test_context_of_a_member(spark):
    member = Member(Monitor("a.b.c"), TableSettings(owner="it's us", drift_threshold=0.0), {"owner": "tag", "monitor_priority": "x"})
    row = spark.range(1).select(*context(member), threshold(member, 0.2)).first()
    assert tuple(row) == ("a.b.c", "it's us", "unknown", 99, "", "", 0.0)
    bare = spark.range(1).select(*context(Member(Monitor("a.b.c"))), threshold(Member(Monitor("a.b.c")), 0.2)).first()
    assert (bare.owner, bare.drift_threshold) == ("unknown", 0.2)


def test_inventory_row(spark):
    row = inventory_row(spark.range(1).selectExpr("id", "'x' AS name"), "main.s.t").first()
    assert (row.full_name, row.schema_name, row.table_type) == ("main.s.t", "s", "MANAGED")
    assert [tuple(c) for c in row["columns"]] == [("id", "bigint"), ("name", "string")]


def test_a_day_is_complete_to_the_microsecond(spark):
    times = ["2024-02-01 00:00:00", "2024-02-01 00:00:00.000001", "2024-02-01 00:00:00.999", "2024-03-01 00:00:00.5", "1960-01-01 12:00:00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").orderBy("i")
    days = whole_days_between(F.col("t").cast("timestamp"), F.expr("TIMESTAMP'2024-03-01 00:00:00'"))
    assert [r.d for r in rows.select(days.alias("d")).collect()] == [29, 28, 28, -1, 23435]
