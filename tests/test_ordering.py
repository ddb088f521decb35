"""Running totals on the grids, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from watchmill.functions import ordering
from watchmill.functions.ordering import GRIDS, Sizes, grid_cell, join_facts, running_totals
from watchmill.operators import drift
from watchmill.operators.drift import baseline_drift, consecutive_drift
from watchmill.operators.frequencies import value_counts
from watchmill.settings import Monitor
from watchmill.sources import scratch


def _rows(seed):
    rng = random.Random(seed)
    values = [0.0, -1e-300, 1e-300, 1e300, -1e300, 5e-324, 1.5, 1.5 + 2**-52, -2.0, 3.0, 1e9, 1e9 + 1]
    values += [rng.uniform(-5, 5) for _ in range(200)] + [rng.lognormvariate(0, 40) for _ in range(100)]
    return [(rng.choice("ab"), v, rng.randint(1, 9)) for v in dict.fromkeys(values)]


@pytest.mark.parametrize("grids", [(), GRIDS[1:], GRIDS, (2.0**30, 2.0**10, 1.0)])
def test_totals_and_neighbours(spark, grids):
    rows = _rows(7)
    df = spark.createDataFrame(rows, "k string, v double, n bigint").withColumn("tag", F.col("n") * 10)
    got = running_totals(df, ["k"], "v", ["n"], grids, here=("n",), carry=("tag",)).collect()
    assert len(got) == len(rows)
    for row in got:
        later = sorted((v, n) for k, v, n in rows if k == row.k and v > row.v)
        assert row.n_upto == sum(n for k, v, n in rows if k == row.k and v <= row.v)
        assert row.n_here == row.n
        assert row.next_value == (later[0][0] if later else None)
        assert row.next_tag == (later[0][1] * 10 if later else None)


def test_ties_share_their_totals(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 1.0, 3), ("a", 2.0, 5)], "k string, v double, n bigint")
    for grids in ((), GRIDS):
        got = {(r.v, r.n): (r.n_upto, r.n_here) for r in running_totals(df, ["k"], "v", ["n"], grids, here=("n",)).collect()}
        assert got == {(1.0, 2): (5, 5), (1.0, 3): (5, 5), (2.0, 5): (10, 5)}


@pytest.mark.parametrize("per_octave", GRIDS)
def test_cells_never_fall(spark, per_octave):
    values = sorted(v for _, v, _ in _rows(11))
    df = spark.createDataFrame([(v,) for v in values], "v double").orderBy("v")
    cells = [r.cell for r in df.select(grid_cell(F.col("v"), per_octave).alias("cell")).collect()]
    assert cells == sorted(cells)


def test_coarse_cells_are_unions_of_fine_ones(spark):
    df = spark.createDataFrame([(v,) for _, v, _ in _rows(3)], "v double")
    both = df.select(grid_cell(F.col("v"), GRIDS[0]).alias("fine"), grid_cell(F.col("v"), GRIDS[1]).alias("coarse"))
    assert both.groupBy("fine").agg(F.count_distinct("coarse").alias("n")).filter("n > 1").count() == 0


def test_salted_join_equals_plain_join(spark):
    rows = spark.createDataFrame([("hot", float(i)) for i in range(500)] + [("cold", 1.0)], "k string, v double")
    facts = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, x int")
    plain = join_facts(rows, facts, ["k"], ["v"], Sizes(1, 1))
    salted = join_facts(rows, facts, ["k"], ["v"], Sizes(10**9, 1))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.select(plain.columns).collect()))


def _flat(df):
    return {
        (r.window.start, r.slice_value, r.column_name): (
            r.js_distance,
            r.ks_test.statistic,
            r.wasserstein_distance,
            r.chi_squared_test.statistic,
            r.population_stability_index,
        )
        for r in df.collect()
    }


@pytest.mark.parametrize("kind", ["consecutive", "baseline"])
def test_drift_of_hot_groups_equals_plain_drift(spark, sf, kind, monkeypatch):
    """The path for groups and facts of any size gives the numbers of the ordinary path."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    monitor = Monitor("m.s.events", "TIMESERIES", "ts", ("1 week",), ("event_type",), ("value", "user_id", "props"))

    def measure():
        if kind == "consecutive":
            return _flat(consecutive_drift(events, monitor))
        return _flat(baseline_drift(events, events.filter("user_id < 40"), monitor))

    plain = measure()
    monkeypatch.setattr(ordering, "PLAIN_WINDOW", 0)
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", 0)
    hot = measure()
    assert plain.keys() == hot.keys() and len(plain) > 10
    for key, scores in plain.items():
        for a, b in zip(scores, hot[key], strict=True):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), key


@pytest.mark.parametrize("kind", ["consecutive", "baseline"])
def test_one_measured_grid_does_where_values_spread(spark, sf, kind, monkeypatch):
    """Groups that a coarse grid cuts small enough need that grid alone, and give the numbers of the ordinary path."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    monitor = Monitor("m.s.events", "TIMESERIES", "ts", ("1 week",), ("event_type",), ("value", "user_id"))

    def measure():
        if kind == "consecutive":
            return _flat(consecutive_drift(events, monitor))
        return _flat(baseline_drift(events, events.filter("user_id < 40"), monitor))

    plain, chosen, choose = measure(), [], drift.choose_grids
    monkeypatch.setattr(drift, "choose_grids", lambda *args: chosen.append(choose(*args)) or chosen[-1])
    monkeypatch.setattr(ordering, "PLAIN_WINDOW", 1000)
    hot = measure()
    assert chosen and all(len(grids) == 1 for grids in chosen)
    assert plain.keys() == hot.keys() and len(plain) > 10
    for key, scores in plain.items():
        for a, b in zip(scores, hot[key], strict=True):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), key


@pytest.mark.parametrize("kind", ["consecutive", "baseline"])
def test_one_finer_grid_does_where_values_crowd(spark, kind, monkeypatch):
    """Values too dense for the coarse grids need one finer grid, not a cell for nearly every value."""
    rng = random.Random(3)
    rows = [(day, round(rng.uniform(1030, 1060), 2)) for day in range(2) for _ in range(1500)]
    df = spark.createDataFrame(rows, "day int, x double")
    df = df.select(F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.col("day") + 1, F.lit(0), F.lit(0), F.lit(0)).alias("at"), "x")
    monitor = Monitor("m.s.t", "TIMESERIES", "at", columns=("x",))

    def measure():
        return _flat(consecutive_drift(df, monitor) if kind == "consecutive" else baseline_drift(df, df.filter("x < 1050 AND day(at) = 1"), monitor))

    plain, chosen, choose = measure(), [], drift.choose_grids
    monkeypatch.setattr(drift, "choose_grids", lambda *args: chosen.append(choose(*args)) or chosen[-1])
    monkeypatch.setattr(ordering, "PLAIN_WINDOW", 110)
    hot = measure()
    assert chosen and all(len(grids) == 1 and grids[0] > GRIDS[1] for grids in chosen)
    assert plain.keys() == hot.keys() and any(scores[1] for scores in plain.values())
    for key, scores in plain.items():
        for a, b in zip(scores, hot[key], strict=True):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), key


def test_both_grids_where_a_finer_one_makes_too_many_cells(spark, monkeypatch):
    crowded = [(1030.0 + i / 1000,) for i in range(1000)]
    monkeypatch.setattr(ordering, "PLAIN_WINDOW", 200)
    one = spark.createDataFrame(crowded + [(2060.0 + i,) for i in range(100)], "v double").withColumn("k", F.lit("a"))
    many = one.unionByName(spark.createDataFrame([(2.0**i * 1.3,) for i in range(-300, 300)], "v double").withColumn("k", F.lit("a")))
    assert len(ordering.choose_grids(one, ["k"], "v", 1100)) == 1
    assert ordering.choose_grids(many, ["k"], "v", 1700) == GRIDS


def test_tasks_are_as_many_as_rows_need(spark, monkeypatch):
    """A task's memory does not grow with the table: pair counts and value counts are dealt by their number."""
    monkeypatch.setattr(ordering, "TASK_ROWS", 100)
    rows = spark.range(3000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("s"))
    monitor = Monitor("a.b.c", "SNAPSHOT", granularities=(), slices=("s",), columns=("x",))
    counts = value_counts(rows, monitor)
    assert counts.count() == 6003
    assert counts.rdd.getNumPartitions() >= 60


def test_written_tables_are_cut_into_files_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(scratch, "FILE_ROWS", 100)
    written = scratch.materialize(spark.range(0, 1000, 1, 1), "cut")
    assert len(written.inputFiles()) == 10 and written.count() == 1000
