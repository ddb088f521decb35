"""The whole run, its views, and what is left on disk."""

import pytest
from pyspark.sql import functions as F

from watchmill.plans.run import compute_metrics, run
from watchmill.settings import (
    AlertSettings,
    CustomMetric,
    DiscoverySettings,
    Monitor,
    ProfileDefaults,
    RunSettings,
    TableSettings,
)
from watchmill.sources.scratch import new_path, scratch_folder
from watchmill.sources.sinks import drop_stale_views, ensure_schema, publish, publish_groups, write_report


def test_run_over_three_tables(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    scored = lines.withColumns({"y": (F.col("l_returnflag") == "R").cast("int"), "p": F.col("l_discount") * 10})
    scored_path = new_path(spark, "scored")
    scored.write.parquet(scored_path)
    baseline_path = new_path(spark, "baseline")
    lines.filter("l_quantity < 20").write.parquet(baseline_path)
    paths = {
        "main.sales.lineitem": f"{sf}/lineitem.parquet",
        "main.ml.returns": scored_path,
        "main.web.events": f"{sf}/events.parquet",
        "main.base.lines": baseline_path,
    }
    metric = CustomMetric("revenue", "aggregate", (":table",), "SUM(l_extendedprice)")
    settings = RunSettings(
        "main",
        ProfileDefaults("monitoring", granularity="1 year", timestamp_column="l_shipdate", prediction_column="p", label_column="y"),
        monitored_tables={
            "main.ml.returns": TableSettings(slicing_exprs=("l_linestatus", "l_orderkey"), drift_threshold=0.01),
            "main.sales.lineitem": TableSettings(profile_type="TIMESERIES", baseline_table_name="main.base.lines", custom_metrics=(metric,)),
            "main.web.events": TableSettings(profile_type="TIMESERIES", timestamp_column="ts", granularities=("1 day", "1 week")),
            "main.web.gone": TableSettings(profile_type="TIMESERIES"),
        },
        alerting=AlertSettings(drift_threshold=0.1, row_count_min=5),
    )
    tags = {"main.ml.returns": {"monitor_group": "ML Team", "owner": "ml"}, "main.sales.lineitem": {"monitor_group": "sales"}}
    out = new_path(spark, "run")
    report = run(spark, settings, out, tags, paths, distinct="none")

    assert {name: text.split(":")[0] for name, text in report.tables.items()} == {
        "main.ml.returns": "created", "main.sales.lineitem": "created", "main.web.events": "created", "main.web.gone": "failed",
    }
    assert set(report.views) == {"ml_team", "sales", "default"}
    scores = spark.table("unified_performance_metrics_ml_team")
    assert scores.filter("accuracy_score IS NOT NULL AND slice_key = 'l_linestatus'").count() > 0
    assert scores.filter("slice_key = 'l_orderkey'").count() == 0
    drift = spark.table("unified_drift_metrics_sales")
    assert {r.drift_type for r in drift.select("drift_type").distinct().collect()} == {"CONSECUTIVE", "BASELINE"}
    profile = spark.table("unified_profile_metrics_sales")
    assert profile.filter("window_start IS NULL").count() == 0
    stored = spark.read.parquet(f"{out}/lineitem_profile_metrics")
    assert {"revenue", "window_date", "granularity"} <= set(stored.columns)
    assert stored.filter("log_type = 'BASELINE'").count() > 0
    assert spark.table("unified_performance_metrics_sales").count() == 0
    states = {(r.monitor_group, r.alert_name): r.state for r in report.alerts.collect()}
    assert len(states) == 6 and states["ML Team", "Drift alert - ML Team"] == "TRIGGERED"


def test_tagged_tables_quota_and_missing_columns(spark, sf):
    names = ["main.web.events", "main.web.late", "main.sales.orders", "main.tmp_x.events"]
    inventory = spark.createDataFrame(
        [(n, n.split(".")[1], "MANAGED", {"monitor_enabled": "true"}, i) for i, n in enumerate(names)],
        "full_name string, schema_name string, table_type string, tags map<string,string>, priority int",
    )
    settings = RunSettings(
        "main",
        ProfileDefaults("monitoring", profile_type="TIMESERIES", timeseries_timestamp_column="ts", granularity="1 month"),
        include_tagged_tables=True,
        discovery=DiscoverySettings(),
        monitored_tables={"main.sales.orders": TableSettings(), "main.web.more": TableSettings()},
    )
    paths = {n: f"{sf}/events.parquet" for n in names} | {"main.sales.orders": f"{sf}/orders.parquet"}
    report = run(spark, settings, new_path(spark, "run"), {}, paths, inventory=inventory, quota=3, distinct="none")
    assert report.tables == {
        "main.web.events": "created",
        "main.web.late": "created",
        "main.sales.orders": "skipped_column_missing: ts",
        "main.web.more": "skipped_quota",
    }
    row = report.summary(spark).first()
    assert (row.tables_discovered, row.monitors_created, row.monitors_skipped) == (4, 2, 2)


def test_run_refuses_bad_settings(spark):
    settings = RunSettings("main", ProfileDefaults("a.b", timestamp_column="ts"), monitored_tables={"main.a.t": TableSettings()})
    with pytest.raises(ValueError, match="output_schema_name"):
        run(spark, settings, "unused")


def test_snapshot_metrics_with_a_previous_snapshot(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    monitor = Monitor("main.sales.customer", "SNAPSHOT", granularities=(), columns=("c_acctbal", "c_mktsegment"))
    found = compute_metrics(customers, monitor, previous=customers.filter("c_acctbal > 0"), distinct="none")
    assert {(r.drift_type, r.column_name) for r in found.drift.collect()} == {
        ("CONSECUTIVE", "c_acctbal"), ("CONSECUTIVE", "c_mktsegment"),
    }
    assert compute_metrics(customers, monitor, distinct="none").drift.count() == 0


def test_failed_performance_view_is_left_out(spark):
    def fails():
        raise RuntimeError("no")

    ok = lambda: spark.range(1)
    views = publish_groups({"g": {"drift": ok, "profile": ok, "performance": fails}})
    assert set(views["g"]) == {"drift", "profile"}
    with pytest.raises(RuntimeError):
        publish_groups({"g": {"drift": fails}})


def test_stale_views_are_dropped(spark):
    for name in ("unified_drift_metrics_keep", "unified_drift_metrics_lost", "unified_profile_metrics_lost", "foreign_lost"):
        publish(spark.range(1), name)
    assert drop_stale_views(spark, []) == []
    dropped = drop_stale_views(spark, ["keep", "ml_team", "sales", "default", "g"])
    assert dropped == ["unified_drift_metrics_lost", "unified_profile_metrics_lost"]
    left = {t.name for t in spark.catalog.listTables()}
    assert {"unified_drift_metrics_keep", "foreign_lost"} <= left and "unified_drift_metrics_lost" not in left


def test_schema_and_report(spark):
    ensure_schema(spark, "default")
    path = new_path(spark, "report")
    write_report(spark.createDataFrame([("t", "create")], "full_name string, action string"), path)
    assert spark.read.json(path).first().action == "create"


def test_scratch_folder_is_the_shared_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or scratch_folder(spark) == named
