"""What the tables at hand do not hold: NULL, NaN, maps, late rows, colliding names, baselines of another shape."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from watchmill.operators.drift import baseline_drift, consecutive_drift
from watchmill.operators.performance import performance
from watchmill.operators.profile import profile
from watchmill.plans.run import run
from watchmill.settings import AlertSettings, CustomMetric, Monitor, ProfileDefaults, RunSettings, TableSettings
from watchmill.sources.scratch import new_path
from watchmill.sources.sinks import stale_views
from watchmill.streaming.live import join_late_labels, run_available

DAY = Monitor("a.b.c", "TIMESERIES", "at", ("1 day",))


def test_null_is_no_value_by_default(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), (None,)], "s string")
    row = profile(df, Monitor("a.b.c", "SNAPSHOT", granularities=())).filter("column_name = 's'").first()
    assert (row["distinct_count"], row["num_nulls"]) == (1, 2)


def test_maps_are_profiled_by_default(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT NULL UNION ALL SELECT map('a', 2)")
    row = profile(df, Monitor("a.b.c", "SNAPSHOT", granularities=())).filter("column_name = 'm'").first()
    assert (row["distinct_count"], row["num_nulls"]) == (2, 1)


def test_a_day_of_nan_is_drift(spark):
    nan = float("nan")
    days = [(1, 1.0), (1, 2.0), (2, 1.0), (2, nan), (2, nan), (3, float("inf")), (3, nan)]
    df = spark.createDataFrame([(datetime.datetime(2024, 1, d), v) for d, v in days], "at timestamp, v double")
    rows = consecutive_drift(df, DAY).filter("column_name = 'v'").orderBy("window").collect()
    js = math.sqrt(sum(p / 2 * math.log2(p / ((p + q) / 2)) if p else 0 for p, q in [(1 / 3, 0.5), (0, 0.5), (2 / 3, 0)]) + sum(q / 2 * math.log2(q / ((p + q) / 2)) if q else 0 for p, q in [(1 / 3, 0.5), (0, 0.5), (2 / 3, 0)]))
    assert rows[0]["js_distance"] == pytest.approx(js)
    assert rows[0]["ks_test"]["statistic"] == pytest.approx(0.5) and rows[0]["chi_squared_test"]["statistic"] is None
    assert rows[1]["ks_test"]["statistic"] is None and rows[1]["wasserstein_distance"] is None
    assert rows[1]["js_distance"] > 0.5
    against = baseline_drift(df, df.filter("v < 10"), DAY).filter("column_name = 'v'").orderBy("window").collect()
    assert [round(r["js_distance"], 3) > 0.4 for r in against] == [False, True, True]
    assert against[2]["js_distance"] == pytest.approx(1.0) and against[2]["wasserstein_distance"] is None


def test_baseline_without_the_slice(spark):
    rows = [(datetime.datetime(2024, 1, d), float(d), s) for d in (1, 2) for s in "xy"]
    df = spark.createDataFrame(rows, "at timestamp, v double, s string")
    monitor = Monitor("a.b.c", "TIMESERIES", "at", ("1 day",), ("s",), ("v",))
    found = baseline_drift(df, df.select("at", "v"), monitor).collect()
    assert len(found) == 2 and all(r["slice_key"] is None for r in found)


@pytest.mark.parametrize(
    "schema, rows, accuracy, has_loss",
    [
        ("p double, y int", [(0.0, 0), (1.0, 1), (2.0, 2)], 1.0, False),
        ("p int, y double", [(0, 0.0), (1, 1.0), (2, 1.0)], 2 / 3, False),
        ("p boolean, y int", [(True, 1), (False, 0)], 1.0, False),
        ("p boolean, y string", [(True, "true"), (False, "true")], 0.5, False),
        ("p double, y int", [(0.9, 1), (0.2, 0), (0.4, 1)], 2 / 3, True),
        ("p double, y boolean", [(0.9, True), (0.2, False)], 1.0, True),
        ("p string, y int", [("1", 1), ("0", 1)], 0.5, False),
    ],
)
def test_classes_are_told_from_probabilities_by_the_data(spark, schema, rows, accuracy, has_loss):
    df = spark.createDataFrame(rows, schema)
    row = performance(df, Monitor("a.b.c", "INFERENCE", None, (), (), (), "p", "y")).first()
    assert row["accuracy_score"] == pytest.approx(accuracy)
    assert (row["log_loss"] is not None) == has_loss
    assert (row["roc_auc_score"] is not None) == has_loss


def test_labels_join_though_rows_are_out_of_order(spark):
    def at(minute):
        return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)

    folder = {"p": new_path(spark, "predictions"), "l": new_path(spark, "labels")}
    batches = [[(1, 100), (2, 200)], [(3, 300), (4, 120)], [(5, 150)], [(99, 90_000)]]  # 4 and 5 come late
    labels = [[(1, 110)], [(3, 310), (4, 130)], [(5, 160)], [(99, 90_001)]]
    for name, parts in (("p", batches), ("l", labels)):
        for rows in parts:
            frame = spark.createDataFrame([(k, at(m)) for k, m in rows], "id long, t timestamp").coalesce(1)
            frame = frame.withColumnRenamed("t", "predicted_at" if name == "p" else "labelled_at")
            frame.write.mode("append").parquet(folder[name])

    def joined(read):
        p, q = (read(folder[name], f"id long, {column} timestamp") for name, column in (("p", "predicted_at"), ("l", "labelled_at")))
        return join_late_labels(p, q, "id", "predicted_at", "labelled_at", "5 hours", "1 hour").select("id", "labelled_at")

    out = new_path(spark, "joined")
    stream = joined(lambda path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    run_available(stream, out, new_path(spark, "joined-state"))
    got = sorted((r["id"], r["labelled_at"] is None) for r in spark.read.schema("id long, labelled_at timestamp").parquet(out).collect() if r["id"] != 99)
    want = sorted((r["id"], r["labelled_at"] is None) for r in joined(lambda path, schema: spark.read.schema(schema).parquet(path)).collect() if r["id"] != 99)
    assert got == want == [(1, False), (2, True), (3, False), (4, False), (5, False)]


def test_long_view_names_keep_their_end(spark):
    slug = "g" * 1500
    views = spark.createDataFrame([(f"unified_drift_metrics_{slug}",), ("unified_profile_metrics_gone",)], "view_name string")
    active = spark.createDataFrame([(slug,)], "slug string")
    assert [r["slug"] for r in stale_views(views, active).collect()] == ["gone"]


def _settings(**tables):
    defaults = ProfileDefaults("monitoring", profile_type="TIMESERIES", timeseries_timestamp_column="ts", granularity="1 week")
    return RunSettings("main", defaults, monitored_tables={name.replace("__", "."): own for name, own in tables.items()})


def test_names_that_collide_stop_a_run(spark, sf):
    same_leaf = _settings(main__a__events=TableSettings(), main__b__events=TableSettings())
    with pytest.raises(ValueError, match="leaf_name"):
        run(spark, same_leaf, new_path(spark, "run"))
    groups = {"main.a.x": {"monitor_group": "ML Team"}, "main.a.y": {"monitor_group": "ml team"}}
    with pytest.raises(ValueError, match="group_slug"):
        run(spark, _settings(main__a__x=TableSettings(), main__a__y=TableSettings()), new_path(spark, "run"), groups)
    twice = CustomMetric("m", "aggregate", (":table",), "count(*)")
    with pytest.raises(ValueError, match="metric_name"):
        run(spark, _settings(main__a__x=TableSettings(custom_metrics=(twice, twice))), new_path(spark, "run"))


def test_a_run_does_what_its_parts_do(spark, sf):
    """Default distinct counts, custom drift, a baseline without the slice, a near-unique model id, stored views, routing."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("model", F.col("event_id").cast("string"))
    events = events.withColumn("one", F.when(F.col("event_id") % 2 == 0, "x"))
    timeless = events.limit(3).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    path, base = new_path(spark, "events"), new_path(spark, "base")
    events.unionByName(timeless).write.parquet(path)
    events.drop("event_type").filter("value < 100").write.parquet(base)
    metric = CustomMetric("jump", "drift", ("value",), "{{current_df}}.avg - {{base_df}}.avg")
    defaults = ProfileDefaults(
        "watchmill_out", profile_type="INFERENCE", prediction_column="value", timestamp_column="ts", granularity="1 week",
        model_id_column="model", slicing_exprs=("event_type",),
    )
    settings = RunSettings(
        "main",
        defaults,
        monitored_tables={"main.web.events": TableSettings(baseline_table_name="main.web.base", custom_metrics=(metric,))},
        alerting=AlertSettings(distinct_count_min=2, default_notifications=("team@example.com", "nobody"), drift_threshold=0.01),
    )
    out = new_path(spark, "run")
    report = run(spark, settings, out, paths={"main.web.events": path, "main.web.base": base}, materialized=True)
    assert report.tables == {"main.web.events": "created"} and report.without_time == {"main.web.events": 3}
    stored = spark.read.parquet(f"{out}/events_drift_metrics")
    kinds = {r["drift_type"] for r in stored.filter("jump IS NOT NULL AND column_name = 'value'").collect()}
    assert kinds == {"CONSECUTIVE", "BASELINE"}
    assert stored.filter("slice_key = 'model'").count() == 0
    assert stored.filter("drift_type = 'BASELINE' AND slice_key IS NOT NULL").count() == 0
    assert stored.filter("drift_type = 'CONSECUTIVE' AND slice_key = 'event_type'").count() > 0
    assert report.views["default"]["drift"] == "watchmill_out.unified_drift_metrics_default"
    other = spark.newSession()
    assert other.table("watchmill_out.unified_profile_metrics_default").filter("column_name = 'one' AND distinct_count = 1").count() > 0
    told = report.notifications.collect()
    assert {r["address"] for r in told} == {"team@example.com"} and all(r["state"] == "TRIGGERED" for r in told)
    just_now = spark.createDataFrame([(r["alert_name"],) for r in told], "alert_name string").withColumn("fired_at", F.current_timestamp())
    again = run(spark, settings, out, paths={"main.web.events": path, "main.web.base": base}, history=just_now)
    assert again.notifications.count() == 0
    spark.sql("DROP SCHEMA watchmill_out CASCADE")
