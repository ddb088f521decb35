"""Custom metrics written as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchmill.functions.templates import quoted, render
from watchmill.operators.grouping import fan_out, group_columns, named, with_base_keys
from watchmill.operators.splitting import Split, split_aggregate
from watchmill.schemas import TABLE_ROW
from watchmill.settings import CustomMetric, Monitor, RunSettings

#: Names a derived metric may use for columns of the profile.
_ALIASES = {"null_count": "num_nulls", "record_count": "count", "mean": "avg", "null_rate": "percent_null"}
ROW_KEYS = ["window", "granularity", "slice_key", "slice_value"]


def _value(expression: Column, metric: CustomMetric) -> Column:
    return expression.cast("string" if metric.output_type == "string" else "double")


def _of_type(metrics: tuple[CustomMetric, ...], kind: str) -> list[CustomMetric]:
    return [metric for metric in metrics if metric.metric_type == kind]


def _value_of(df: DataFrame, i: int, text: str, metric: CustomMetric) -> tuple[Split | None, Column]:
    """The parts of an expression, if it has some, and its value over them, or over the rows."""
    parts = split_aggregate(df, text, f"__a{i}_")
    return parts, _value(F.expr(parts.finish if parts else text), metric).alias(f"m{i}")


def _computed(df: DataFrame, monitor: Monitor, values: list[tuple[Split | None, Column]]) -> DataFrame:
    """One row per group ``g`` with the values m0, m1, ..."""
    rows, keys = with_base_keys(df, monitor)
    partials = {name: part for split, _ in values if split for name, part in split.partials.items()}
    merged = direct = None
    if partials:
        parts = rows.groupBy(*keys).agg(*[F.expr(text).alias(name) for name, (text, _) in partials.items()])
        whole = fan_out(parts, monitor).groupBy("g").agg(*[merge(name).alias(name) for name, (_, merge) in partials.items()])
        merged = whole.select("g", *[value for split, value in values if split])
    if any(split is None for split, _ in values):
        direct = fan_out(rows, monitor).groupBy("g").agg(*[value for split, value in values if split is None])
    if merged is None or direct is None:
        return direct if merged is None else merged
    return merged.join(direct, "g")


def custom_aggregates(df: DataFrame, monitor: Monitor) -> DataFrame:
    """Rows (window, granularity, slice, column_name, one column per metric); NULL where a metric does not apply.

    Expressions of aggregates that merge read the rows once, per base window, for all windows and slices. Any other runs on
    the rows of each group directly.
    """
    metrics = _of_type(monitor.custom_metrics, "aggregate")
    values = {"prediction_col": monitor.prediction_column, "label_col": monitor.label_column}
    common = {name: quoted(column) for name, column in values.items() if column}
    computed: dict[tuple[str, str], tuple[str, CustomMetric]] = {}
    for metric in metrics:
        inputs = {name: quoted(name) for name in metric.input_columns if name != TABLE_ROW}
        for column in metric.input_columns:
            own = {} if column == TABLE_ROW else {"input_column": quoted(column)}
            text = render(metric.definition, {**common, **inputs, **own})
            computed[column, metric.name] = text, metric
    wide = _computed(df, monitor, [_value_of(df, i, text, metric) for i, (text, metric) in enumerate(computed.values())])
    position = {key: i for i, key in enumerate(computed)}
    entries = []
    for column in dict.fromkeys(column for column, _ in computed):
        cells = {
            m.name: F.col(f"m{position[column, m.name]}") if (column, m.name) in position else _value(F.lit(None), m)
            for m in metrics
        }
        entries.append(named(column_name=F.lit(column), **cells))
    return wide.select(*group_columns(monitor), F.inline(F.array(*entries)))


def with_custom_aggregates(profiles: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Profile rows with the custom aggregates of their column next to them."""
    key = F.struct(*ROW_KEYS, "column_name")
    extra = [name for name in aggregates.columns if name not in (*ROW_KEYS, "column_name")]
    right = aggregates.select(key.alias("__row"), *extra)
    return profiles.withColumn("__row", key).join(right, "__row", "left").drop("__row")


def with_derived(profiles: DataFrame, metrics: tuple[CustomMetric, ...], data_columns: list[str]) -> DataFrame:
    """Add one column per derived metric, computed from the other columns of the row."""
    known = {**{name: name for name in profiles.columns}, **_ALIASES}
    places = {name: quoted(column) for name, column in known.items()}
    added = profiles
    for metric in _of_type(metrics, "derived"):
        value = _value(F.expr(render(metric.definition, {**places, "input_column": "column_name"})), metric)
        targets = [name for name in metric.input_columns if name == TABLE_ROW or name in data_columns]
        if targets:
            value = F.when(F.col("column_name").isin(*targets), value)
        added = added.withColumn(metric.name, value)
        places[metric.name] = quoted(metric.name)
    return added


def custom_drift(current: DataFrame, metrics: tuple[CustomMetric, ...], base: DataFrame | None = None) -> DataFrame:
    """Expressions over ``current_df`` and ``base_df``, two profile rows of one column and slice.

    The base row is the one of the previous window, or of the baseline profile when one is given.
    """
    row = F.struct(*[F.col(name) for name in current.columns])
    keyed = current.select(*ROW_KEYS, "column_name", row.alias("current_df"))
    if base is None:
        # Only the windows of a series are put in order; the rows of two windows meet in a join. NULLs are equal in a struct.
        series = Window.partitionBy("granularity", "slice_key", "slice_value", "column_name").orderBy("window")
        starts = keyed.select(*ROW_KEYS, "column_name").withColumn("before", F.lag("window").over(series)).filter("before IS NOT NULL")
        place = F.struct("granularity", "slice_key", "slice_value", "column_name")
        starts = starts.select(F.struct("window", place.alias("of")).alias("__row"), F.struct(F.col("before").alias("window"), place.alias("of")).alias("__base"))
        at = F.struct("window", place.alias("of"))
        stored = keyed.select(at.alias("__base"), F.col("current_df").alias("base_df"))
        pairs = keyed.withColumn("__row", at).join(starts, "__row").join(stored, "__base").drop("__row", "__base")
        kind = "CONSECUTIVE"
    else:
        slice_key = F.struct("slice_key", "slice_value", "column_name")
        stored = base.select(slice_key.alias("__row"), F.struct(*[F.col(n) for n in base.columns]).alias("base_df"))
        pairs = keyed.withColumn("__row", slice_key).join(stored, "__row").drop("__row")
        kind = "BASELINE"
    places = {"current_df": "current_df", "base_df": "base_df"}
    values = []
    for metric in _of_type(metrics, "drift"):
        value = _value(F.expr(render(metric.definition, {**places, **{c: quoted(c) for c in metric.input_columns}})), metric)
        targets = [name for name in metric.input_columns if name]
        values.append(F.when(F.col("column_name").isin(*targets), value).alias(metric.name))
    return pairs.select(*ROW_KEYS, "column_name", F.lit(kind).alias("drift_type"), *values)


# --- metric definitions as data ----------------------------------------------------------------------------------


def resolved_metrics(layers: DataFrame) -> DataFrame:
    """A17 over rows (table, name, layer, position, ...): the highest layer wins by name (defaults 1, objectives 2,
    table 3); the metric keeps the place where its name first appeared; unknown types are dropped after that.
    """
    named = Window.partitionBy("table", "name")
    best = named.orderBy(F.desc("layer"), F.desc("position"))
    first = F.min(F.struct("layer", "position")).over(named)
    ranked = layers.withColumns({"nth": F.row_number().over(best), "first_seen": first}).filter("nth = 1")
    return ranked.filter(F.col("metric_type").isin("aggregate", "derived", "drift")).drop("nth")


def duplicate_metrics(layers: DataFrame) -> DataFrame:
    """Names used more than once inside one layer of one table."""
    return (
        layers.groupBy("table", "layer", "name")
        .agg(F.count("*").alias("uses"))
        .filter("uses > 1")
    )


def missing_functions(spark: SparkSession, run: RunSettings) -> list[tuple[str, str]]:
    """(objective, function) for each referenced function that does not exist; every name is checked once."""
    asked: dict[str, str] = {}
    for key, objective in run.objective_functions.items():
        if objective.function_name:
            asked.setdefault(objective.function_name, key)
    return [(key, name) for name, key in asked.items() if not spark.catalog.functionExists(name)]
