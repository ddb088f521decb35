"""Profiles over streams, late labels, and batch repair of touched windows (ST1-ST6, J11)."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchmill.functions.windows import as_instant, window_end, window_start
from watchmill.operators.grouping import as_number, is_number, profiled_columns
from watchmill.operators.profile import profile
from watchmill.schemas import TABLE_ROW
from watchmill.settings import Monitor

LOOKBACK_DAYS = 30


def stream_profile(stream: DataFrame, monitor: Monitor, delay: str = "10 minutes") -> DataFrame:
    """ST1: windowed profile of a stream, one granularity, whole table only.

    Streams refuse exact distinct counts, so these are approximate. In append mode a window comes out once, when the
    watermark has passed its end; later rows are dropped here (ST5) and repaired by ``touched_profile``.
    """
    (granularity,) = monitor.granularities
    at = monitor.timestamp_column
    fields = [f for f in profiled_columns(stream, monitor) if f.name != at]
    rows = stream.withColumn(at, F.col(f"`{at}`").cast("timestamp")).withWatermark(at, delay)
    stats = []
    for i, field in enumerate(fields):
        column = F.col(f"`{field.name}`")
        stats += [F.count(column).alias(f"values_{i}"), F.approx_count_distinct(column).alias(f"distinct_{i}")]
        if is_number(field):
            number = as_number(field)
            named = {"avg": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
            stats += [made(number).alias(f"{name}_{i}") for name, made in named.items()]
    wide = rows.groupBy(F.window(at, granularity)).agg(F.count("*").alias("count"), *stats)
    present, none = set(wide.columns), F.lit(None).cast("double")

    def entry(i: int, name: str) -> Column:
        numbers = [
            (F.col(f"{stat}_{i}") if f"{stat}_{i}" in present else none).alias(stat)
            for stat in ("avg", "stddev", "min", "max")
        ]
        return F.struct(
            F.lit(name).alias("column_name"),
            (F.col("count") - F.col(f"values_{i}")).alias("num_nulls"),
            F.col(f"distinct_{i}").alias("distinct_count"),
            *numbers,
        )

    entries = [entry(i, field.name) for i, field in enumerate(fields)]
    whole = F.struct(
        F.lit(TABLE_ROW).alias("column_name"),
        F.lit(None).cast("bigint").alias("num_nulls"),
        F.lit(None).cast("bigint").alias("distinct_count"),
        *[none.alias(stat) for stat in ("avg", "stddev", "min", "max")],
    )
    return wide.select("window", F.lit(granularity).alias("granularity"), "count", F.inline(F.array(whole, *entries)))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; rows go to Parquet files."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def join_late_labels(
    predictions: DataFrame,
    labels: DataFrame,
    key: str,
    predicted_at: str,
    labelled_at: str,
    delay: str,
    within: str = "90 days",
) -> DataFrame:
    """ST3: predictions with the label that follows inside the given time. Works on streams (both sides carry a
    watermark, so state is bounded) and on batches.

    Rows of a stream may be out of order by up to ``delay``. What comes later than that is not joined; the windows it
    falls in are recomputed from the stored rows by ``touched_profile``.
    """
    p = predictions.withWatermark(predicted_at, delay) if predictions.isStreaming else predictions
    q = labels.withWatermark(labelled_at, delay) if labels.isStreaming else labels
    q = q.withColumnRenamed(key, "__key")
    inside = (F.col(labelled_at) >= F.col(predicted_at)) & (
        F.col(labelled_at) <= F.col(predicted_at) + F.expr(f"INTERVAL {within}")
    )
    return p.join(q, (F.col(key) == F.col("__key")) & inside, "left").drop("__key")


def attach_labels(log: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The log with its labels; rows without one keep NULL."""
    return log.join(labels, key, "left")


def new_rows(df: DataFrame, at: str, high_water: Column | None = None, days: int = LOOKBACK_DAYS) -> DataFrame:
    """ST2: the last days of the data on a first run, after that everything past the stored mark."""
    if high_water is not None:
        return df.filter(F.col(at) > high_water)
    latest = df.agg(F.max(at).cast("string").alias("latest")).first().latest
    return df.filter(F.col(at) >= F.lit(latest).cast(df.schema[at].dataType) - F.expr(f"INTERVAL {days} DAYS"))


def touched_windows(changes: DataFrame, monitor: Monitor, granularity: str) -> DataFrame:
    """ST4: distinct window starts of the changed rows."""
    rows = changes.select(as_instant(changes, monitor.timestamp_column).alias("__at")).filter("__at IS NOT NULL")
    return rows.select(window_start("__at", granularity).alias("window_start")).distinct()


def rows_of_windows(df: DataFrame, windows: DataFrame, monitor: Monitor, granularity: str) -> DataFrame:
    """ST4: source rows that fall in any of the windows. The first and last of them bound the scan."""
    bounds = [fold("window_start").cast("string").alias(name) for fold, name in ((F.min, "begin"), (F.max, "last"))]
    span = windows.agg(*bounds).first()
    if span.begin is not None:
        at = as_instant(df, monitor.timestamp_column)
        begin, last = (F.lit(text).cast("timestamp_ntz") for text in (span.begin, span.last))
        df = df.filter((at >= begin) & (at < window_end(last, F.lit(granularity))))
    keyed = df.withColumn("__at", as_instant(df, monitor.timestamp_column))
    keyed = keyed.withColumn("window_start", window_start("__at", granularity))
    return keyed.join(windows, "window_start", "left_semi").drop("window_start", "__at")


def touched_profile(df: DataFrame, changes: DataFrame, monitor: Monitor, *, distinct: str = "approx") -> DataFrame:
    """ST4, ST5: fresh profile rows of just the windows that changed rows fall in, ready for a dynamic partition
    overwrite of the metric table.
    """
    parts = []
    for name in monitor.granularities:
        rows = rows_of_windows(df, touched_windows(changes, monitor, name), monitor, name)
        parts.append(profile(rows, replace(monitor, granularities=(name,)), distinct=distinct))
    return reduce(DataFrame.unionByName, parts)
