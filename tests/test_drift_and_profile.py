"""Statistics on tiny frames with results worked out by hand or by numpy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchmill.functions import ordering
from watchmill.operators import drift, moments
from watchmill.operators.drift import baseline_drift, consecutive_drift
from watchmill.operators.performance import performance
from watchmill.operators.profile import profile, safe_slices, slice_guard
from watchmill.operators.sketch_drift import sketch_drift
from watchmill.settings import REGRESSION, Monitor

DAY = dt.datetime(2024, 1, 1)


def _at(days):
    return DAY + dt.timedelta(days=days)


def _drift(df):
    return {(r.window.start, r.column_name): r for r in df.collect()}


def test_same_distribution_has_no_drift(spark):
    rows = [(_at(d), float(v), "ab"[v % 2]) for d in (0, 1) for v in range(10)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, x double, t string")
    found = _drift(consecutive_drift(df, Monitor("a.b.c", "TIMESERIES", "at")))
    x, t = found[_at(1), "x"], found[_at(1), "t"]
    assert (x.js_distance, x.ks_test.statistic, x.wasserstein_distance, x.population_stability_index) == (0, 0, 0, 0)
    assert (t.js_distance, t.chi_squared_test.statistic, t.ks_test.statistic, t.wasserstein_distance) == (0, 0, None, None)
    assert x.chi_squared_test.statistic is None


def test_disjoint_distributions_drift_fully(spark):
    rows = [(_at(0), 0.0, "a"), (_at(0), 1.0, "a"), (_at(1), 10.0, "b"), (_at(1), 11.0, "b")]
    df = spark.createDataFrame(rows, "at timestamp_ntz, x double, t string")
    found = _drift(consecutive_drift(df, Monitor("a.b.c", "TIMESERIES", "at")))
    x, t = found[_at(1), "x"], found[_at(1), "t"]
    assert math.isclose(x.js_distance, 1) and math.isclose(t.js_distance, 1)
    assert math.isclose(x.ks_test.statistic, 1) and math.isclose(x.wasserstein_distance, 10)
    assert math.isclose(t.chi_squared_test.statistic, 4)
    assert math.isclose(t.population_stability_index, 2 * (1 - 1e-4) * math.log(1e4))


def test_previous_window_skips_gaps_and_follows_its_slice(spark):
    rows = [(_at(0), 1.0, "u"), (_at(0), 1.0, "v"), (_at(5), 2.0, "u"), (_at(9), 3.0, "v")]
    df = spark.createDataFrame(rows, "at timestamp_ntz, x double, s string")
    rows = consecutive_drift(df, Monitor("a.b.c", "TIMESERIES", "at", slices=("s",), columns=("x",))).collect()
    windows = sorted((r.slice_value or "", r.window.start) for r in rows)
    assert windows == [("", _at(5)), ("", _at(9)), ("u", _at(5)), ("v", _at(9))]


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(_at(0), [1.0]), (_at(1), [2.0])], "at timestamp_ntz, v array<double>")
    monitor = Monitor("a.b.c", "TIMESERIES", "at")
    for rows in (consecutive_drift(df, monitor), sketch_drift(df, monitor), baseline_drift(df, df.drop("v"), monitor)):
        assert rows.count() == 0 and "js_distance" in rows.columns


def test_null_only_side_gives_null_scores(spark):
    rows = [(_at(0), None, "a"), (_at(1), 2.0, None), (_at(2), 2.0, "a")]
    df = spark.createDataFrame(rows, "at timestamp_ntz, x double, t string")
    found = _drift(consecutive_drift(df, Monitor("a.b.c", "TIMESERIES", "at")))
    assert found[_at(1), "x"].js_distance is None and found[_at(1), "t"].js_distance is None
    assert found[_at(2), "x"].js_distance == 0 and found[_at(2), "t"].js_distance is None


def test_infinite_and_missing_numbers_are_categories_of_their_own(spark):
    rows = [(_at(0), 1.0), (_at(0), float("nan")), (_at(1), 1.0), (_at(1), float("inf"))]
    df = spark.createDataFrame(rows, "at timestamp_ntz, x double")
    found = _drift(consecutive_drift(df, Monitor("a.b.c", "TIMESERIES", "at")))
    assert found[_at(1), "x"].js_distance == pytest.approx(0.5**0.5) and found[_at(1), "x"].ks_test.statistic == 0


def _wasserstein(x, y):
    points = np.sort(np.unique(np.concatenate([x, y])))
    f = np.searchsorted(np.sort(x), points, side="right") / len(x)
    g = np.searchsorted(np.sort(y), points, side="right") / len(y)
    return np.max(np.abs(f - g)), np.sum(np.abs(f - g)[:-1] * np.diff(points))


@pytest.mark.parametrize("seed", range(4))
def test_baseline_steps_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    current = [np.round(rng.normal(d, 1 + d, 30 + 20 * d), 1 if seed % 2 else 6) for d in range(3)]
    base = np.round(rng.normal(0.7, 2, 80), 1 if seed % 2 else 6)
    rows = [(_at(d), float(v)) for d, values in enumerate(current) for v in values]
    df = spark.createDataFrame(rows, "at timestamp_ntz, x double")
    known = spark.createDataFrame([(float(v),) for v in base], "x double")
    found = _drift(baseline_drift(df, known, Monitor("a.b.c", "TIMESERIES", "at", columns=("x",))))
    for d, values in enumerate(current):
        ks, wd = _wasserstein(values, base)
        row = found[_at(d), "x"]
        assert math.isclose(row.ks_test.statistic, ks, abs_tol=1e-9)
        assert math.isclose(row.wasserstein_distance, wd, abs_tol=1e-9)


def test_a_baseline_is_laid_out_once_by_plain_numbers(spark, monkeypatch):
    """Rows are sorted by numbers that stand for groups, and only crossings are written beside them, not the baseline again."""
    rng, written = np.random.default_rng(9), {}
    current = [np.round(rng.normal(d, 2, 300), 1) for d in range(2)]
    base = np.round(rng.normal(0.5, 2, 4000), 3)
    df = spark.createDataFrame([(_at(d), float(v)) for d, values in enumerate(current) for v in values], "at timestamp_ntz, x double")
    known = spark.createDataFrame([(float(v),) for v in base], "x double")

    def kept(module):
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda frame, name: written.setdefault(name, []).append(write(frame, name)) or written[name][-1])

    kept(drift)
    kept(ordering)
    monkeypatch.setattr(ordering, "PLAIN_WINDOW", 300)
    found = _drift(baseline_drift(df, known, Monitor("a.b.c", "TIMESERIES", "at", columns=("x",))))
    for d, values in enumerate(current):
        ks, wd = _wasserstein(values, base)
        assert math.isclose(found[_at(d), "x"].ks_test.statistic, ks, abs_tol=1e-9)
        assert math.isclose(found[_at(d), "x"].wasserstein_distance, wd, abs_tol=1e-9)
    (marks,) = written["marks"]
    assert "w" in marks.columns and "struct" not in {f.dataType.typeName() for f in marks.schema}
    sizes = [frame.count() for name, frames in written.items() if name not in ("counts", "baseline-counts") for frame in frames]
    assert 0 < written["crossings"][0].count() < 600
    assert max(sizes) == marks.count() < len(set(base))


def test_pairs_are_walked_by_plain_numbers(spark, monkeypatch):
    """What is shuffled, sorted and written of each value carries a number for its pair of windows, not the window's struct."""
    rng, written, write = np.random.default_rng(9), [], ordering.materialize
    days = [np.round(rng.normal(d, 2, 400), 2) for d in range(2)]
    df = spark.createDataFrame([(_at(d), float(v)) for d, values in enumerate(days) for v in values], "at timestamp_ntz, x double")
    monkeypatch.setattr(ordering, "materialize", lambda frame, name: written.append((name, write(frame, name))) or written[-1][1])
    monkeypatch.setattr(ordering, "PLAIN_WINDOW", 200)
    found = _drift(consecutive_drift(df, Monitor("a.b.c", "TIMESERIES", "at", columns=("x",))))
    ks, wd = _wasserstein(days[1], days[0])
    assert math.isclose(found[_at(1), "x"].ks_test.statistic, ks, abs_tol=1e-9)
    assert math.isclose(found[_at(1), "x"].wasserstein_distance, wd, abs_tol=1e-9)
    cells = next(frame for name, frame in written if name == "cells")
    assert "w" in cells.columns and "struct" not in {f.dataType.typeName() for f in cells.schema}


def test_sketch_drift_is_near(spark):
    rng = np.random.default_rng(5)
    rows = [(_at(d), float(v)) for d in range(3) for v in rng.normal(d, 1, 4000)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, x double")
    monitor = Monitor("a.b.c", "TIMESERIES", "at")
    exact, near = _drift(consecutive_drift(df, monitor)), _drift(sketch_drift(df, monitor))
    assert exact.keys() == near.keys()
    for key, row in exact.items():
        assert abs(row.js_distance - near[key].js_distance) < 0.03
        assert abs(row.ks_test.statistic - near[key].ks_test.statistic) < 0.02
        assert abs(row.wasserstein_distance - near[key].wasserstein_distance) < 0.05


def test_profile_counts_nulls_and_negative_zero(spark):
    rows = [(_at(0), -0.0, "x"), (_at(0), 0.0, None), (_at(0), None, "x"), (None, 5.0, "y")]
    df = spark.createDataFrame(rows, "at timestamp_ntz, v double, t string")
    found = {r.column_name: r for r in profile(df, Monitor("a.b.c", "TIMESERIES", "at"), distinct="exact").collect()}
    v, t, whole = found["v"], found["t"], found[":table"]
    assert (v["count"], v.num_nulls, v.distinct_count, v.avg, v.stddev) == (3, 1, 1, 0.0, 0.0)
    assert (t["count"], t.num_nulls, t.distinct_count, t.avg, t.stddev) == (3, 1, 1, None, None)
    assert (whole["count"], whole.num_nulls, whole.distinct_count) == (3, None, None)


def test_large_means_keep_small_spreads(spark, monkeypatch):
    """Two million seconds apart, spread of one second: merged without losing it, in one round or in two."""
    rows = [(_at(d), 1.7e9 + d * 86400 + s) for d in range(20) for s in (-1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, v double")
    monitor = Monitor("a.b.c", "TIMESERIES", "at", ("1 day", "1 year"))
    expected = np.std([v for _, v in rows], ddof=1)
    for limit in (moments.MAX_PARTS, 0):
        monkeypatch.setattr(moments, "MAX_PARTS", limit)
        found = profile(df, monitor, distinct="none").filter("column_name = 'v'").collect()
        days = [r for r in found if r.granularity == "1 day"]
        (year,) = [r for r in found if r.granularity == "1 year"]
        assert len(days) == 20 and all(math.isclose(r.stddev, 1.0, rel_tol=1e-9) for r in days)
        assert math.isclose(year.stddev, expected, rel_tol=1e-12)


def test_many_columns_are_profiled_in_passes(spark):
    df = spark.range(50).select("id", *[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(230)])
    rows = profile(df, Monitor("a.b.c", "SNAPSHOT", granularities=()), distinct="none").collect()
    assert len(rows) == 232
    assert {r.column_name: r.max for r in rows}["c229"] == 49 * 229


def test_slice_guard_keeps_order_and_drops_wide_columns(spark):
    df = spark.range(200).selectExpr("id", "id % 3 AS a", "id % 60 AS b")
    assert safe_slices(df, ("B", "a", "missing", "id")) == ("a",)
    assert {r.column_name: r.action for r in slice_guard(df, ("a", "b", "zz")).collect()} == {
        "a": "keep", "b": "skip_cardinality", "zz": "skip_missing",
    }
    assert safe_slices(df, ("b", "a"), 70) == ("b", "a")


def test_undefined_scores(spark):
    """No positive labels: no ranking, zero precision where nothing was predicted; a constant label has no r2."""
    df = spark.createDataFrame([(0.2, 0), (0.9, 0), (0.4, None)], "p double, y int")
    monitor = Monitor("a.b.c", "INFERENCE", granularities=(), prediction_column="p", label_column="y")
    (row,) = performance(df, monitor).collect()
    assert row.accuracy_score == 0.5 and row.roc_auc_score.one_vs_one.weighted is None
    assert row.precision.weighted == 1.0 and row.recall.weighted == 0.5
    constant = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "p double, y double")
    (row,) = performance(constant, Monitor("a.b.c", "INFERENCE", granularities=(), prediction_column="p", label_column="y",
                                           problem_type=REGRESSION)).collect()
    assert row.mean_squared_error == 1.0 and row.r2_score is None and row.accuracy_score is None


def test_performance_needs_prediction_and_label(spark):
    df = spark.createDataFrame([(0.2, 0)], "p double, y int")
    assert performance(df, Monitor("a.b.c", "INFERENCE", granularities=(), prediction_column="p")) is None
    assert performance(df, Monitor("a.b.c", "TIMESERIES", granularities=(), prediction_column="p", label_column="y")) is None


def test_ranking_with_ties(spark):
    rows = [(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    monitor = Monitor("a.b.c", "INFERENCE", granularities=(), prediction_column="p", label_column="y")
    (row,) = performance(df, monitor).collect()
    assert math.isclose(row.roc_auc_score.one_vs_one.weighted, 3.5 / 4)
