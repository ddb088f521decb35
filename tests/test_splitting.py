"""Custom aggregates from partial ones: what is taken apart, equal results, and one aggregation of the rows."""

import datetime as dt
import math

import pytest

from watchmill.operators.custom import custom_aggregates
from watchmill.operators.splitting import split_aggregate
from watchmill.settings import CustomMetric, Monitor

MERGED = [
    "sum(x * y) / count(*)",
    "AVG(CASE WHEN x > 1.5 THEN 1.0 ELSE 0 END)",
    "coalesce(max(x), 0) - min(`y`) + count_if(x > y)",
    "CASE WHEN bool_and(x >= 0) THEN mean(y) ELSE -sum(y) END",
    "round(sqrt(abs(sum(x))), 3) + length(max(kind))",
    "avg(x) / avg(y)",
    "count(x) + any(x > 2)::INT",
]
WHOLE = [
    "count(DISTINCT kind)",
    "sum(x) FILTER (WHERE y > 1)",
    "sum(x) + stddev(x)",
    "percentile(x, 0.5)",
    "sum(x) + length(max('sum(x)'))",
    "aggregate(collect_list(x), 0D, (a, b) -> a + b) + sum(x)",
    "count(DISTINCT x) / count(*)",
]


@pytest.fixture(scope="module")
def rows(spark):
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(hours=i), "abc"[i % 3], None if i % 7 == 0 else i % 5 * 1.0, i % 4 + 0.5) for i in range(2000)]
    data += [(start, None, None, 1.0), (None, "a", 1.0, 1.0), (start + dt.timedelta(days=300), "z", None, 2.0)]
    return spark.createDataFrame(data, "at timestamp_ntz, kind string, x double, y double")


def _monitor(texts):
    metrics = tuple(CustomMetric(f"k{i}", "aggregate", (":table",), text) for i, text in enumerate(texts))
    return Monitor("a.b.c", "TIMESERIES", "at", ("1 day", "1 week", "1 month", "1 year"), ("kind", "flag"), custom_metrics=metrics)


@pytest.mark.parametrize("text", MERGED)
def test_taken_apart(rows, text):
    assert split_aggregate(rows, text, "p") is not None


@pytest.mark.parametrize("text", WHOLE)
def test_left_whole(rows, text):
    assert split_aggregate(rows, text, "p") is None


def test_equal_to_the_rows_of_each_group(spark, rows, monkeypatch):
    df = rows.selectExpr("*", "x > 2 AS flag")
    monitor = _monitor([t for t in MERGED + WHOLE if "length(max('" not in t])
    key = ("window", "granularity", "slice_key", "slice_value")

    def found():
        return {tuple(str(r[k]) for k in key): r.asDict() for r in custom_aggregates(df, monitor).collect()}

    parts = found()
    monkeypatch.setattr("watchmill.operators.custom.split_aggregate", lambda *_: None)
    whole = found()
    assert parts.keys() == whole.keys() and len(whole) > 300
    for at, row in whole.items():
        for name, value in row.items():
            other = parts[at][name]
            assert value == other or math.isclose(value, other, rel_tol=1e-9, abs_tol=1e-9), (at, name, value, other)


def test_rows_are_aggregated_once(rows):
    df = rows.selectExpr("*", "x > 2 AS flag")
    plan = custom_aggregates(df, _monitor(MERGED))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    first = next(i for i, line in reversed(list(enumerate(lines))) if "Aggregate" in line)
    # Below the first aggregation no row is copied, and the table is read in one place.
    assert not any("Generate" in line for line in lines[first:])
    assert sum("Generate" in line for line in lines[:first]) >= 2
    assert sum("LogicalRDD" in line or "Relation" in line or "LocalRelation" in line for line in lines) == 1


def test_no_rows(rows):
    df = rows.selectExpr("*", "x > 2 AS flag")
    assert custom_aggregates(df.limit(0), _monitor(MERGED + WHOLE[:1])).count() == 0
