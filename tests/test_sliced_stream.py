"""Streamed profiles from stored parts: replays, restarts, rows out of order, odd rows."""

from __future__ import annotations

import datetime

import pytest

from watchmill.operators.profile import profile
from watchmill.settings import Monitor
from watchmill.sources.scratch import new_path
from watchmill.streaming.live import touched_profile
from watchmill.streaming.sliced import SlicedStream

MONITOR = Monitor("a.b.c", "TIMESERIES", "at", ("1 hour", "1 day"), ("s",), ("v",))
SCHEMA = "at timestamp_ntz, s string, v double"
KEYS = ["granularity", "window", "slice_key", "slice_value", "column_name", "count", "num_nulls", "distinct_count", "avg", "min", "max"]


def _at(hour: float) -> datetime.datetime:
    return datetime.datetime(2024, 5, 1) + datetime.timedelta(hours=hour)


def _rows(df):
    return sorted(map(str, df.select(*KEYS).collect()))


BATCHES = [
    [(_at(0.5), "a", 1.0), (_at(1.5), "b", 2.0), (_at(30), None, 4.0)],
    # Rows of closed hours, one of them an hour and a slice never seen before; a null instant; a null value.
    [(_at(0.6), "a", 7.0), (_at(5.2), "new", 9.0), (None, "a", 5.0), (_at(30.5), "b", None), (_at(29.9), "a", 3.0)],
    [],
    [(_at(60), "a", float("nan")), (_at(60), "a", 2.0)],
]


@pytest.fixture
def fed(spark):
    stream = SlicedStream(spark, new_path(spark, "fed"), MONITOR)
    for number, rows in enumerate(BATCHES):
        stream.take_in(spark.createDataFrame(rows, SCHEMA), number)
    return stream


def _all(spark, batches=BATCHES):
    return spark.createDataFrame([row for rows in batches for row in rows], SCHEMA)


def test_all_parts_equal_the_batch(spark, fed):
    assert _rows(fed.profile()) == _rows(profile(_all(spark), MONITOR))


def test_late_rows_are_kept_and_repaired(spark, fed):
    late = fed.late_rows().orderBy("at").collect()
    assert [(r["at"], r["batch"]) for r in late] == [(_at(0.6), 1), (_at(5.2), 1)]
    # 29.9 lies in an hour that the first batch, whose latest instant is 30:00 less the delay, has not closed.
    first = {r["window"].start: r["count"] for r in fed.published().filter("column_name = ':table' AND slice_key IS NULL AND granularity = '1 hour'").collect()}
    assert first[_at(0)] == 1 and _at(5) not in first and first[_at(29)] == 1
    assert _at(60) not in first  # still open
    repaired = fed.repaired()
    assert _rows(repaired.filter("granularity = '1 hour'")) == _rows(
        touched_profile(_all(spark), fed.late_rows(), MONITOR).filter("granularity = '1 hour'")
    )
    days = {r["window"].start for r in repaired.filter("granularity = '1 day'").collect()}
    assert days == {_at(0)}


def test_a_batch_played_again_changes_nothing(spark, fed):
    before = _rows(fed.profile())
    fed.take_in(_all(spark), 1)
    assert _rows(fed.profile()) == before


def test_a_batch_without_its_ledger_row_is_invisible_and_replaced(spark, fed):
    before = _rows(fed.profile())
    broken = spark.createDataFrame([(_at(3), "x", 1.0)], SCHEMA)

    class Killed(SlicedStream):
        def _write(self, rows, name, batch_id):
            if name == "ledger":
                raise RuntimeError("killed")
            super()._write(rows, name, batch_id)

    with pytest.raises(RuntimeError):
        Killed(spark, fed.path, MONITOR).take_in(broken, 4)
    assert _rows(fed.profile()) == before
    right = [(_at(61), "y", 1.0)]
    fed.take_in(spark.createDataFrame(right, SCHEMA), 4)
    assert _rows(fed.profile()) == _rows(profile(_all(spark, [*BATCHES, right]), MONITOR))


def test_settings_that_cannot_hold(spark):
    with pytest.raises(ValueError):
        SlicedStream(spark, "unused", Monitor("a.b.c", "SNAPSHOT", granularities=()))
    with pytest.raises(ValueError):
        SlicedStream(spark, "unused", MONITOR, distinct="exact")
    with pytest.raises(ValueError):
        SlicedStream(spark, new_path(spark, "nothing"), MONITOR).profile()
