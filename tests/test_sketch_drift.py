"""Drift from sketches against the exact one: windows, baselines, values that are not finite, hot and empty groups."""

import datetime as dt
import math

import numpy as np
import pytest

from watchmill.operators import sketch_drift as S
from watchmill.operators.drift import baseline_drift, consecutive_drift
from watchmill.plans import run
from watchmill.settings import Monitor

ROWS = "at timestamp_ntz, kind string, x double"
BY_KIND = Monitor("a.b.c", "TIMESERIES", "at", slices=("kind",), columns=("x",))


def _at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def _by_key(df):
    return {(r.window.start, r.slice_key, r.slice_value, r.column_name): r for r in df.collect()}


def _odd(rng, day, n):
    values = rng.normal(day, 1, n)
    values[rng.random(n) < 0.05 * day] = math.nan
    values[rng.random(n) < 0.04] = math.inf
    values[rng.random(n) < 0.02 * (3 - day)] = -math.inf
    return values


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(7)
    rows = [(_at(d), kind, float(v)) for d in range(3) for kind in ("a", "b", None) for v in _odd(rng, d, 4000)]
    rows += [(_at(d), "a", None) for d in range(3)]
    rows += [(_at(3), "a", math.nan)] * 50 + [(_at(4), "b", None)] * 5
    base = [(_at(0), kind, float(v)) for kind in ("a", "b") for v in _odd(rng, 1, 6000)]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(base, ROWS)


def _near(exact, found):
    exact, found = _by_key(exact), _by_key(found)
    assert exact.keys() == found.keys()
    for key, row in exact.items():
        other = found[key]
        for a, b, most in (
            (row.js_distance, other.js_distance, 0.03),
            (row.population_stability_index, other.population_stability_index, 0.03 + 0.1 * (row.population_stability_index or 0)),
            (row.ks_test.statistic, other.ks_test.statistic, 2 * S.RANK_ERROR),
            (row.wasserstein_distance, other.wasserstein_distance, 0.05),
        ):
            assert (a is None) == (b is None), (key, row, other)
            assert a is None or abs(a - b) <= most, (key, row, other)
        assert other.chi_squared_test.statistic is None


def test_windows_with_values_that_are_not_finite(frames):
    _near(consecutive_drift(frames[0], BY_KIND), S.sketch_drift(frames[0], BY_KIND))


def test_windows_against_a_baseline(frames):
    _near(baseline_drift(*frames, BY_KIND), S.sketch_baseline_drift(*frames, BY_KIND))


def test_sketches_serve_windows_and_baseline(frames, monkeypatch):
    def never(*_, **__):
        raise AssertionError("values were counted")

    monkeypatch.setattr(run, "stored_counts", never)
    monkeypatch.setattr("watchmill.operators.drift.value_counts", never)
    whole = run.compute_metrics(frames[0], BY_KIND, frames[1], drift_mode="sketch").drift
    assert {r.drift_type for r in whole.select("drift_type").distinct().collect()} == {"CONSECUTIVE", "BASELINE"}


def test_a_side_without_finite_values_leaves_the_bins_of_the_other(spark):
    rows = [(_at(0), "a", float(v)) for v in range(100)] + [(_at(1), "a", math.nan)]
    df, one = spark.createDataFrame(rows, ROWS), Monitor("a.b.c", "TIMESERIES", "at", columns=("x",))
    for base in (df.filter("x < 50"), df.filter("isnan(x)")):
        exact, found = _by_key(baseline_drift(df, base, one)), _by_key(S.sketch_baseline_drift(df, base, one))
        for key, row in exact.items():
            assert math.isclose(row.js_distance, found[key].js_distance, abs_tol=0.01)
            assert math.isclose(row.population_stability_index, found[key].population_stability_index, abs_tol=0.1)
    # Ten equal bins of a tenth against nothing, and nothing against all.
    index = 10 * (0.1 - 1e-4) * math.log(0.1 / 1e-4) + (1 - 1e-4) * math.log(1 / 1e-4)
    assert math.isclose(exact[_at(0), None, None, "x"].population_stability_index, index, rel_tol=1e-9)


def test_baseline_of_a_snapshot_with_texts(frames):
    still = Monitor("a.b.c", "SNAPSHOT", granularities=(), columns=("x", "kind"))
    found = {r.column_name: r for r in S.sketch_baseline_drift(*frames, still).collect()}
    exact = {r.column_name: r for r in baseline_drift(*frames, still).collect()}
    assert found["kind"] == exact["kind"]
    assert abs(found["x"].js_distance - exact["x"].js_distance) < 0.03


def test_no_rows_and_no_columns(spark, frames):
    none = frames[0].limit(0)
    assert S.sketch_drift(none, BY_KIND).count() == 0
    assert S.sketch_baseline_drift(none, frames[1], BY_KIND).count() == 0
    rows = S.sketch_baseline_drift(frames[0], none, BY_KIND).collect()
    assert rows and all(r.js_distance is None for r in rows)
    assert S.sketch_baseline_drift(frames[0], frames[1].drop("x"), BY_KIND).count() == 0


def test_constants(spark):
    df = spark.createDataFrame([(_at(0), "a", 5.0), (_at(1), "a", 5.0), (_at(2), "a", 7.0)], ROWS)
    one = Monitor("a.b.c", "TIMESERIES", "at", columns=("x",))
    exact, found = _by_key(consecutive_drift(df, one)), _by_key(S.sketch_drift(df, one))
    for key, row in exact.items():
        assert math.isclose(row.js_distance, found[key].js_distance, abs_tol=1e-9)
        assert math.isclose(row.ks_test.statistic, found[key].ks_test.statistic, abs_tol=1e-9)
        assert math.isclose(row.wasserstein_distance, found[key].wasserstein_distance, abs_tol=1e-9)
