"""Checks of streaming, late labels and incremental repair (ST1-ST6, J11, S6, S8, X2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql
from checks.base import check, r, table
from checks.engine import DOUBLES_PROFILE, RATED, flat_profile, profile_sql
from watchmill.operators.drift import consecutive_drift
from watchmill.operators.profile import partial_profiles, profile, with_performance
from watchmill.operators.sketch_drift import sketch_drift
from watchmill.schemas import PROFILE_METRICS
from watchmill.settings import Monitor
from watchmill.sources.scratch import materialize, new_path
from watchmill.sources.sinks import read_written_metrics, write_metrics
from watchmill.streaming.live import (
    attach_labels,
    join_late_labels,
    new_rows,
    run_available,
    stream_profile,
    touched_profile,
)
from watchmill.streaming.sliced import SlicedStream

HOURS = Monitor("main.web.events", "TIMESERIES", "ts", ("1 hour",), (), ("value", "event_type"))


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def streamed(spark: SparkSession, result: DataFrame, name: str) -> DataFrame:
    """Run a streaming query over what is there and read its output."""
    path = new_path(spark, name)
    run_available(result, f"{path}/rows", f"{path}/state")
    return spark.read.parquet(f"{path}/rows")


for _name, _granularity in {"hours": "1 hour", "half_hours": "30 minutes", "five_minutes": "5 minutes"}.items():

    @check(
        f"stream_profile_{_name}",
        f"SELECT * FROM (SELECT {sql.start_of(_granularity, 'ts')} AS window_start, "
        f"{sql.start_of(_granularity, 'ts')} + INTERVAL '{_granularity}' AS window_end, count(*) AS \"count\", "
        f"count(*) - count(value) AS num_nulls, {r('avg(value)', 'avg')}, {r('stddev_samp(value)', 'stddev')}, "
        f"{r('min(value)', 'min')}, {r('max(value)', 'max')} FROM events GROUP BY 1, 2) "
        "WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    )
    def _stream_profile(spark, sf, granularity=_granularity):
        """ST1: windows that the watermark has closed."""
        monitor = Monitor("main.web.events", "TIMESERIES", "ts", (granularity,), (), ("value",))
        rows = streamed(spark, stream_profile(stream(spark, sf, "events"), monitor), "stream-profile")
        return rows.filter("column_name = 'value'").select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "count",
            "num_nulls",
            "avg",
            "stddev",
            "min",
            "max",
        )


@check(
    "stream_late_rows_dropped_then_repaired",
    "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS rows_now, "
    f"{r('avg(value)', 'mean_now')} FROM events WHERE event_type = 'error' GROUP BY 1",
)
def stream_repair(spark, sf):
    """ST5, ST4: error events arrive after their windows have closed, and the windows are made anew with them."""
    events = table(spark, sf, "events")
    error = F.col("event_type") == "error"
    monitor = Monitor("main.web.events", "TIMESERIES", "ts", ("1 hour",), ("event_type",), ("value",))
    fed = fed_in_parts(spark, [events.filter(~error), events.filter(error)], monitor, "late-errors")
    unaffected = fed.profile().join(fed.repaired().select("granularity", "window"), ["granularity", "window"], "left_anti")
    both = fed.repaired().unionByName(unaffected.select(*fed.repaired().columns))
    rows = flat_profile(both).filter("column_name = 'value' AND slice_value = 'error'")
    return rows.select("window_start", F.col("record_count").alias("rows_now"), F.col("mean").alias("mean_now"))


#: Quarters of the time span come one after the other; a seventh of the rows comes one or two quarters too late.
_QUARTER = "least(3, CAST(floor(4 * (epoch(ts) - epoch(lo)) / (epoch(hi) - epoch(lo))) AS INT))"
_PARTS = (
    f"(SELECT * EXCLUDE (lo, hi), {_QUARTER} + CASE WHEN event_id % 7 = 0 THEN 1 + event_id % 2 ELSE 0 END AS part "
    "FROM events, (SELECT min(ts) AS lo, max(ts) AS hi FROM events))"
)


def in_parts(spark: SparkSession, sf: str) -> list[DataFrame]:
    events = table(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ends = events.agg(F.min(seconds).alias("lo"), F.max(seconds).alias("hi")).first()
    quarter = F.least(F.lit(3), F.floor(4 * (seconds - ends.lo) / (ends.hi - ends.lo)).cast("int"))
    late = F.when(F.col("event_id") % 7 == 0, 1 + F.col("event_id") % 2).otherwise(0)
    parts = events.withColumn("part", (quarter + late).cast("int"))
    return [parts.filter(F.col("part") == i).drop("part") for i in range(6)]


def fed_in_parts(spark: SparkSession, parts: list[DataFrame], monitor: Monitor, name: str) -> SlicedStream:
    """Put one part after the other into a folder and take it in, each time by a new query that goes on from the last one."""
    fed, source = SlicedStream(spark, new_path(spark, name), monitor, distinct="none"), new_path(spark, f"{name}-rows")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        fed.run_available(spark.readStream.schema(part.schema).parquet(source))
    return fed


SLICED = Monitor("main.web.events", "TIMESERIES", "ts", ("1 hour", "1 day", "1 week"), ("event_type",), ("value", "user_id"))
_KEYS = "granularity, window_start, slice_key, slice_value, column_name"
_SLICED_SQL = (
    f"SELECT {_KEYS}, record_count, {sql.rounded_columns(DOUBLES_PROFILE)} FROM "
    f"{sql.profile('SELECT * FROM events', 'ts', list(SLICED.granularities), ['event_type'], ['value', 'user_id'])}"
)


@check("stream_sliced_many_granularities", _SLICED_SQL)
def stream_sliced(spark, sf):
    """ST1, ST6: six parts out of order; three granularities and a slice from the stored parts equal the batch."""
    fed = fed_in_parts(spark, in_parts(spark, sf), SLICED, "sliced")
    return flat_profile(fed.profile()).select(*_KEYS.split(", "), "record_count", *DOUBLES_PROFILE)


@check(
    "stream_published_then_repaired",
    f"{_SLICED_SQL} WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
)
def stream_repaired(spark, sf):
    """ST5, ST4: closed windows as they were published, those that rows came late for made anew."""
    fed = fed_in_parts(spark, in_parts(spark, sf), SLICED, "repaired")
    repaired = fed.repaired()
    published = fed.published().join(repaired.select("granularity", "window").distinct(), ["granularity", "window"], "left_anti")
    rows = flat_profile(repaired.unionByName(published.select(*repaired.columns)))
    return rows.select(*_KEYS.split(", "), "record_count", *DOUBLES_PROFILE)


@check(
    "stream_rows_behind_the_mark",
    f"WITH p AS {_PARTS}, m AS (SELECT part, max(ts) AS latest FROM p GROUP BY part), "
    "c AS (SELECT p.*, (SELECT max(latest) FROM m WHERE m.part < p.part) - INTERVAL 10 MINUTE AS closed FROM p) "
    "SELECT event_type, count(*) AS late_rows, min(event_id) AS first_id, max(event_id) AS last_id FROM c "
    "WHERE time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR <= closed GROUP BY event_type",
)
def stream_late_rows(spark, sf):
    """ST5: rows of closed hours are kept apart."""
    late = fed_in_parts(spark, in_parts(spark, sf), SLICED, "late").late_rows()
    ids = F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    return late.groupBy("event_type").agg(F.count("*").alias("late_rows"), *ids)


@check(
    "stream_windows_as_published",
    f"WITH p AS {_PARTS}, m AS (SELECT part, max(ts) AS latest FROM p GROUP BY part), "
    "c AS (SELECT p.*, date_trunc('day', ts) AS ws, (SELECT max(latest) FROM m WHERE m.part < p.part) - INTERVAL 10 MINUTE AS closed "
    "FROM p) SELECT ws AS window_start, count(*) AS record_count, "
    f"{r('avg(value)', 'mean')} FROM c WHERE (closed IS NULL OR ws + INTERVAL 1 DAY > closed) "
    "AND ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ws",
)
def stream_published(spark, sf):
    """ST1, ST5: days as they were when they closed, without the rows that came later."""
    fed = fed_in_parts(spark, in_parts(spark, sf), SLICED, "published")
    rows = flat_profile(fed.published()).filter("column_name = 'value' AND granularity = '1 day' AND slice_key IS NULL")
    return rows.select("window_start", "record_count", "mean")


@check(
    "stream_late_labels",
    "SELECT e.event_id, e.user_id, CASE WHEN o.o_orderdate BETWEEN e.at AND e.at + INTERVAL 3000 DAY THEN o.o_orderstatus END "
    "AS label FROM (SELECT event_id, user_id, ts - INTERVAL 10000 DAY AS at FROM events) e JOIN orders o ON o.o_orderkey = e.event_id "
    "WHERE o.o_orderdate BETWEEN e.at AND e.at + INTERVAL 3000 DAY",
)
def stream_labels(spark, sf):
    """ST3: predictions joined to labels that come within a time; both are streams, matched rows only."""
    log = stream(spark, sf, "events").select(
        "event_id", "user_id", (F.col("ts").cast("timestamp") - F.expr("INTERVAL 10000 DAYS")).alias("at")
    )
    labels = stream(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderstatus").alias("label"),
        F.col("o_orderdate").cast("timestamp").alias("labelled_at"),
    )
    joined = join_late_labels(log, labels, "event_id", "at", "labelled_at", "10 days", "3000 days")
    rows = streamed(spark, joined.select("event_id", "user_id", "label"), "late-labels")
    return rows.filter("label IS NOT NULL")


@check("late_labels_batch", f"SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM ({RATED})")
def late_labels(spark, sf):
    """The log keeps rows that have no label yet."""
    log = table(spark, sf, "documents").select("doc_id", "lang")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return attach_labels(log, labels, "doc_id").withColumn("quality", F.coalesce("quality", F.lit(-1)))


@check(
    "first_run_lookback",
    "SELECT count(*) AS rows, min(l_shipdate) AS first_day FROM lineitem WHERE l_shipdate >= "
    "(SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY",
)
def lookback(spark, sf):
    """ST2: a first run reads the last thirty days."""
    rows = new_rows(table(spark, sf, "lineitem"), "l_shipdate")
    return rows.agg(F.count("*").alias("rows"), F.min("l_shipdate").alias("first_day"))


@check(
    "later_run_after_mark",
    "SELECT count(*) AS rows, min(l_shipdate) AS first_day FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-06-01 00:00:00'",
)
def after_mark(spark, sf):
    """ST2: later runs read what came after the stored mark."""
    mark = F.expr("TIMESTAMP_NTZ'2001-06-01 00:00:00'")
    rows = new_rows(table(spark, sf, "lineitem"), "l_shipdate", mark)
    return rows.agg(F.count("*").alias("rows"), F.min("l_shipdate").alias("first_day"))


_TOUCHED = (
    "SELECT * FROM lineitem WHERE date_trunc('month', l_shipdate) IN (SELECT date_trunc('month', l_shipdate) FROM lineitem "
    "WHERE l_quantity = 50 AND l_discount > 0.095 AND l_tax < 0.005)"
)


@check(
    "touched_windows_recomputed",
    profile_sql(_TOUCHED, "l_shipdate", ["1 month"], ["l_returnflag"], ["l_quantity", "l_tax"], []),
)
def touched(spark, sf):
    """ST4: only the months that changed rows fall in."""
    lines = table(spark, sf, "lineitem")
    changes = lines.filter("l_quantity = 50 AND l_discount > 0.095 AND l_tax < 0.005")
    monitor = Monitor("main.sales.lineitem", "TIMESERIES", "l_shipdate", ("1 month",), ("l_returnflag",), ("l_quantity", "l_tax"))
    return flat_profile(touched_profile(lines, changes, monitor, distinct="exact"))


@check(
    "metrics_written_and_partially_replaced",
    f"SELECT granularity, window_start, record_count, {sql.rounded_columns(DOUBLES_PROFILE)} FROM "
    f"{sql.profile('SELECT * FROM events', 'ts', ['1 day', '1 week'], [], ['value'])} WHERE column_name = 'value'",
)
def written(spark, sf):
    """S6, S5, ST4: metrics of half the events are stored, then the windows of the other half are replaced."""
    events = table(spark, sf, "events")
    monitor = Monitor("main.web.events", "TIMESERIES", "ts", ("1 day", "1 week"), (), ("value",))
    path = new_path(spark, "events-profile-metrics")
    half = events.filter("event_type IN ('click', 'view', 'error')")
    write_metrics(with_performance(profile(half, monitor, distinct="none"), None), path)
    rest = events.filter("event_type NOT IN ('click', 'view', 'error')")
    write_metrics(with_performance(touched_profile(events, rest, monitor, distinct="none"), None), path)
    stored = read_written_metrics(spark, path, PROFILE_METRICS)
    rows = flat_profile(stored).filter("column_name = 'value'")
    return rows.select("granularity", "window_start", "record_count", *DOUBLES_PROFILE)


@check("drift_by_sketch_rows")
def sketch_rows(spark, sf):
    """J9 in sketch mode: estimates, so no SQL; see drift_sketch_within_bound for the distance to the exact values."""
    monitor = Monitor("main.sales.orders", "TIMESERIES", "o_orderdate", ("1 year",), ("o_orderpriority",), ("o_totalprice",))
    rows = sketch_drift(table(spark, sf, "orders"), monitor)
    return rows.select("slice_key", "slice_value", "column_name", "js_distance", "wasserstein_distance")


@check(
    "stored_partials_merge_to_any_granularity",
    f"SELECT granularity, window_start, column_name, record_count, {sql.rounded_columns(['mean', 'stddev'])} FROM "
    f"{sql.profile('SELECT * FROM events', 'ts', ['1 day', '1 week', '1 month'], [], ['value', 'user_id'])} "
    "WHERE column_name <> ':table'",
)
def stored_partials(spark, sf):
    """ST6: hourly partials are written once and serve three granularities."""
    from watchmill.operators.profile import merge_profiles, profile_columns

    columns = ("value", "user_id")
    hourly = Monitor("main.web.events", "TIMESERIES", "ts", ("1 hour",), (), columns)
    stored = materialize(partial_profiles(table(spark, sf, "events"), hourly), "partials")
    several = Monitor("main.web.events", "TIMESERIES", "ts", ("1 day", "1 week", "1 month"), (), columns)
    merged = merge_profiles(stored, several).select(*profile_columns(several, F.lit(None).cast("bigint"), "INPUT"))
    rows = flat_profile(merged).filter("column_name != ':table'")
    return rows.select("granularity", "window_start", "column_name", "record_count", "mean", "stddev")


@check(
    "model_id_as_slice",
    f"SELECT slice_key, slice_value, window_start, {r('js_distance', 'js_distance')} FROM "
    f"{sql.drift('SELECT * FROM events', 'ts', ['1 week'], ['event_type'], ['value'], [])}",
)
def model_id(spark, sf):
    """The model id is one more slice."""
    monitor = Monitor("main.ml.log", "INFERENCE", "ts", ("1 week",), (), ("value",), model_id_column="event_type")
    rows = consecutive_drift(table(spark, sf, "events"), monitor)
    return rows.select("slice_key", "slice_value", F.col("window.start").alias("window_start"), "js_distance")
