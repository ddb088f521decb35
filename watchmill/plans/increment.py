"""Runs that take in changed rows only (ST2, ST4, ST5 with J9, J10): the state a table keeps, and fresh metrics from it.

Every run adds its part to the state under its own number: value counts of the changed rows with their signs, partial profiles,
counts and sums of model quality, and the numbers of rows of each group. All of them add up, so the metrics of a window follow
from the parts of all committed runs, and only windows that changed rows touch are made anew. A changed window also renews the
drift of the window after it, and so does one that vanished or came in between.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchmill.functions.windows import as_instant, base_granularity, window_start
from watchmill.operators.custom import custom_aggregates
from watchmill.operators.drift import (
    baseline_counts,
    baseline_drift,
    compared_fields,
    consecutive_drift,
    drift_fields,
    shared_with_baseline,
)
from watchmill.operators.frequencies import ALL_ROWS, SIGN, distinct_counts, value_counts
from watchmill.operators.grouping import name_at, place_of, profiled_columns, within
from watchmill.operators.performance import labelled, partial_names, performance_of, performance_partials
from watchmill.operators.profile import merge_profiles, partial_profiles, profile_columns, with_performance
from watchmill.settings import Monitor
from watchmill.sources.scratch import materialize
from watchmill.streaming.live import rows_of_windows

#: Column of a change feed that tells what happened to a row. The kinds of change.
CHANGE = "_change_type"
CAME, WENT = ("insert", "update_postimage"), ("delete", "update_preimage")


def signed(changes: DataFrame) -> DataFrame:
    """Changed rows with a SIGN: 1 for rows that came and -1 for rows that went. Without a CHANGE column all came; a kind of
    change that is not known stops the run.
    """
    if CHANGE not in changes.columns:
        return changes.withColumn(SIGN, F.lit(1))
    kind = F.col(CHANGE)
    unknown = F.raise_error(F.concat(F.lit("not a kind of change: "), F.coalesce(kind, F.lit("null")))).cast("int")
    sign = F.when(kind.isin(*CAME), 1).when(kind.isin(*WENT), -1).otherwise(unknown)
    return changes.withColumn(SIGN, sign).drop(CHANGE)


@dataclass(frozen=True)
class State:
    """The state tables of one monitored table as a run sees them: the parts from the last full run up to its own."""

    spark: SparkSession
    folder: str
    run: int
    since: int

    def write(self, name: str, part: DataFrame) -> None:
        """The part of this run; what a run of this number left before is replaced."""
        part.write.mode("overwrite").parquet(f"{self.folder}/{name}/run={self.run}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}").filter(F.col("run").between(self.since, self.run))

    def own(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/run={self.run}")


def settings_text(df: DataFrame, monitor: Monitor, distinct: str, decided: dict) -> str:
    """All that a state depends on: if any of it changes, the parts do not add up any more and a full run is due. ``decided``
    holds what was found out by looking at the rows, so that later runs do not decide otherwise.
    """
    columns = [(f.name, f.dataType.simpleString()) for f in profiled_columns(df, monitor)]
    asked = [monitor.profile_type, monitor.timestamp_column, monitor.granularities, monitor.prediction_column, monitor.label_column, *monitor.class_scores]
    return json.dumps({"asked": [*asked, monitor.problem_type, monitor.baseline_table, distinct], "columns": columns, "decided": decided})


def counted_fields(df: DataFrame, monitor: Monitor, distinct: str) -> list[T.StructField]:
    """Columns whose values the state counts: those of drift, and all profiled ones for exact distinct counts."""
    return profiled_columns(df, monitor) if distinct == "exact" else drift_fields(df, monitor)


def take_in(state: State, df: DataFrame, changes: DataFrame, monitor: Monitor, *, distinct: str, scored: bool | None) -> None:
    """Write what the changed rows add to the state. ``df`` is the table with the changes in it; it is read only in the base
    windows that rows went from, as extremes and sketches of distinct values cannot be taken back.
    """
    rows = signed(changes)
    state.write("counts", value_counts(rows, monitor, counted_fields(df, monitor, distinct)))
    state.write("groups", state.own("counts").filter(F.col("c") == ALL_ROWS).select("g", "n"))

    base = base_granularity(monitor.granularities)
    sketch = {"distinct_sketch": distinct == "approx"}
    at = as_instant(rows, monitor.timestamp_column)
    went = rows.filter(F.col(SIGN) < 0).select(at.alias("__at")).filter("__at IS NOT NULL")
    state.write("restarts", went.select(window_start("__at", base).alias("__at")).distinct())
    parts = [partial_profiles(rows.filter(F.col(SIGN) > 0).drop(SIGN), monitor, **sketch)]
    if CHANGE in changes.columns:
        restarts = state.own("restarts")
        parts = [parts[0].join(restarts, "__at", "left_anti").select(*parts[0].columns)]
        again = rows_of_windows(df, restarts.withColumnRenamed("__at", "window_start"), monitor, base)
        parts.append(partial_profiles(again, monitor, **sketch))
    state.write("partials", reduce(DataFrame.unionByName, parts))
    if scored is not None:
        for name, part in performance_partials(labelled(rows, monitor), monitor, scored).items():
            state.write(name, part)


def touched_places(state: State) -> DataFrame:
    """Partitions (granularity, window_date) of the windows that the rows of this run fall in."""
    return state.own("groups").select(*place_of()).distinct()


def windows_in_order(state: State, touched: DataFrame) -> DataFrame:
    """Rows (g, before, renewed) of all groups that have rows: the non-empty window before (T7), and whether anything between
    it and the group was touched, both included. Only window starts are put in order.
    """
    groups = state.read("groups").groupBy("g").agg(F.sum("n").alias("n"))
    flags = touched.select(F.struct("granularity", "window_date").alias("__place"), F.lit(True).alias("here"))
    groups = groups.join(flags, F.struct(*place_of()) == F.col("__place"), "left").select("g", "n", F.coalesce("here", F.lit(False)).alias("here"))
    earlier = Window.partitionBy("g.granularity", "g.slice", "g.slice_value").orderBy("g.window_start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("n") > 0, F.col("g")), ignorenulls=True).over(earlier)
    last = F.max(F.when(F.col("here"), F.col("g.window_start"))).over(earlier)
    ordered = groups.withColumns({"before": before, "last": last}).filter("n > 0")
    between = F.col("last").isNotNull() & F.coalesce(F.col("last") >= F.col("before.window_start"), F.lit(True))
    return ordered.select("g", "before", (F.col("here") | between).alias("renewed"))


def _counts(state: State, windows: DataFrame) -> DataFrame:
    """Value counts (g, c, number, key, n) of whole windows (granularity, window_start), added up over all runs."""
    wanted = windows.select(F.struct("granularity", "window_start").alias("__window")).distinct()
    rows = state.read("counts").join(wanted, F.struct("g.granularity", "g.window_start") == F.col("__window"), "left_semi")
    return rows.groupBy("g", "c", "number", "key").agg(F.sum("n").alias("n")).filter("n <> 0")


def _of_fields(counts: DataFrame, held: list[T.StructField], wanted: list[T.StructField]) -> DataFrame:
    """Counts of some of the columns, at their positions among those."""
    if held == wanted:
        return counts
    names = [f.name for f in wanted]
    places = [names.index(f.name) if f.name in names else None for f in held]
    place = F.when(F.col("c") == ALL_ROWS, ALL_ROWS).otherwise(F.get(F.array(*[F.lit(p).cast("int") for p in places]), F.col("c")))
    return counts.withColumn("c", place).filter("c IS NOT NULL")


@dataclass
class Renewed:
    """Fresh metric rows, and the partitions (granularity, window_date) of the metric tables that they replace as a whole;
    no partitions mean all.
    """

    profile: DataFrame
    drift: DataFrame | None
    touched: DataFrame | None
    drifted: DataFrame | None

    def replaced(self, monitor: Monitor) -> DataFrame | None:
        """Rows (kind, granularity, window_date) for the ledger."""
        if self.touched is None:
            return None
        kinds = [self.touched.withColumn("kind", F.lit("profile")), self.drifted.withColumn("kind", F.lit("drift"))]
        return kinds[0].unionByName(kinds[1]).withColumn("granularity", name_at(F.col("granularity"), monitor.granularities))


def _source_rows(df: DataFrame, places: DataFrame | None, monitor: Monitor) -> list[tuple[DataFrame, Monitor]]:
    """Source rows of the windows in some partitions, granularity by granularity, for metrics that need the rows."""
    if places is None:
        return [(df, monitor)]
    found = []
    for i, name in enumerate(monitor.granularities):
        dated = df.withColumn("__at", as_instant(df, monitor.timestamp_column)).filter("__at IS NOT NULL")
        starts = dated.select(window_start("__at", name).alias("window_start")).distinct()
        dates = places.filter(F.col("granularity") == i).select("window_date")
        starts = starts.join(dates, F.to_date("window_start") == F.col("window_date"), "left_semi")
        found.append((rows_of_windows(df, starts, monitor, name), replace(monitor, granularities=(name,))))
    return found


def renewed_metrics(
    state: State, df: DataFrame, monitor: Monitor, baseline: DataFrame | None, *, distinct: str, scored: bool | None
) -> Renewed:
    """Metrics of the windows that this run touched, from the state; of all windows in a full run."""
    full = state.since == state.run
    touched = None if full else materialize(touched_places(state), "touched")
    ordered = materialize(windows_in_order(state, touched_places(state)), "windows")
    drifted = None if full else materialize(ordered.filter("renewed").select(*place_of()).unionByName(touched).distinct(), "drifted")
    now = within(ordered, drifted)

    merged = merge_profiles(_valid_partials(state), monitor, touched)
    held = counted_fields(df, monitor, distinct)
    sides = now.select("g.granularity", "g.window_start")
    asked = sides.unionByName(now.filter("before IS NOT NULL").select("before.granularity", "before.window_start"))
    counts = materialize(_counts(state, asked), "counts") if held else None
    if distinct == "exact":
        merged = merged.join(distinct_counts(within(counts, touched), held), ["g", "column_name"], "left")
        number: Column = F.coalesce("distinct_count", F.lit(0).cast("bigint"))
    elif distinct == "approx":
        number = F.coalesce(F.hll_sketch_estimate("hll"), F.lit(0).cast("bigint"))
    else:
        number = F.lit(None).cast("bigint")
    scores = None
    if scored is not None:
        names = partial_names(monitor, scored)
        scores = performance_of({name: state.read(name).drop("run") for name in names}, monitor, touched)
    profile = with_performance(merged.select(*profile_columns(monitor, number, "INPUT")), scores)

    drift = None
    fields = drift_fields(df, monitor)
    if fields:
        own = _of_fields(counts, held, fields)
        drift = consecutive_drift(df, monitor, own, now.filter("before IS NOT NULL").select("g", "before"))
        if baseline is not None:
            drift = drift.unionByName(_against_baseline(state, df, monitor, baseline, within(own, drifted), drifted))
    return Renewed(profile, drift, touched, drifted)


def _valid_partials(state: State) -> DataFrame:
    """Partial profiles of all runs; of a base window that rows went from, those since the last time it was read again."""
    restarts = state.read("restarts").groupBy("__at").agg(F.max("run").alias("restarted"))
    partials = state.read("partials").join(restarts, "__at", "left")
    return partials.filter(F.col("run") >= F.coalesce("restarted", F.lit(0))).drop("restarted", "run")


def _against_baseline(
    state: State, df: DataFrame, monitor: Monitor, baseline: DataFrame, counts: DataFrame, drifted: DataFrame | None
) -> DataFrame:
    """J10 for renewed windows. The baseline's value counts are part of the state, its rows are read by full runs only."""
    shared = shared_with_baseline(monitor, baseline)
    fields = compared_fields(df, baseline, shared)
    if drifted is None and fields:
        state.write("baseline", baseline_counts(baseline, shared, fields))
    known = state.read("baseline").drop("run") if fields else None
    if shared.slice_columns == monitor.slice_columns and fields == drift_fields(df, monitor):
        return baseline_drift(df, baseline, monitor, counts, known)
    parts = [baseline_drift(rows, baseline, one, None, known) for rows, one in _source_rows(df, drifted, shared)]
    return reduce(DataFrame.unionByName, parts)


def renewed_aggregates(df: DataFrame, monitor: Monitor, touched: DataFrame | None) -> DataFrame:
    """A14 for renewed windows: the expressions may be any aggregate, so they see all rows of those windows again."""
    return reduce(DataFrame.unionByName, [custom_aggregates(rows, one) for rows, one in _source_rows(df, touched, monitor)])
