"""The groups every metric is computed for: granularity x window x slice.

A group is one struct column ``g``: position of the granularity, window start, position of the slice column, slice
value. Positions instead of names keep shuffled rows short. Nulls inside a struct compare as equal, so the overall
slice (no position) and a slice whose value is NULL are ordinary groups in joins as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchmill.functions.windows import all_windows, as_instant, base_granularity, window_end, window_start
from watchmill.settings import Monitor


def _no_window() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def _slices(names: tuple[str, ...]) -> Column:
    """One (slice, slice_value) struct for the whole table and one per slice column."""
    whole = F.struct(F.lit(None).cast("int").alias("slice"), F.lit(None).cast("string").alias("slice_value"))
    each = [
        F.struct(F.lit(i).alias("slice"), F.col(f"__s{i}").alias("slice_value")) for i in range(len(names))
    ]
    return F.array(whole, *each)


def with_instant(df: DataFrame, monitor: Monitor) -> DataFrame:
    """Add ``__at``, the NTZ instant; rows without one belong to no window and are left out."""
    if not monitor.granularities:
        return df.withColumn("__at", _no_window())
    at = as_instant(df, monitor.timestamp_column)
    return df.withColumn("__at", at).filter(F.col("__at").isNotNull())


def with_base_keys(df: DataFrame, monitor: Monitor) -> tuple[DataFrame, list[str]]:
    """Add ``__at`` cut to the base granularity and one text column per slice; return them with their names.

    Aggregating on these keys first reads every row once; windows and slices then fan out on the small result.
    """
    base = base_granularity(monitor.granularities)
    rows = with_instant(df, monitor)
    slices = {f"__s{i}": F.col(f"`{name}`").cast("string") for i, name in enumerate(monitor.slice_columns)}
    start = window_start("__at", base) if base else _no_window()
    rows = rows.withColumns({**slices, "__at": start})
    return rows, ["__at", *slices]


def fan_out(df: DataFrame, monitor: Monitor) -> DataFrame:
    """Replace the base keys by ``g``, one row per granularity and slice."""
    names = monitor.slice_columns
    windows = df.withColumn("__w", F.explode(all_windows("__at", monitor.granularities)))
    sliced = windows.withColumn("__s", F.explode(_slices(names)))
    group = F.struct("__w.granularity", "__w.window_start", "__s.slice", "__s.slice_value")
    return sliced.withColumn("g", group).drop("__w", "__s", "__at", *[f"__s{i}" for i in range(len(names))])


def place_of(group: str = "g") -> list[Column]:
    """The partition of the metric tables that a group belongs to: position of its granularity, and date of its window."""
    return [F.col(f"{group}.granularity").alias("granularity"), F.to_date(F.col(f"{group}.window_start")).alias("window_date")]


def within(df: DataFrame, only: DataFrame | None) -> DataFrame:
    """Rows whose group ``g`` lies in one of the partitions (granularity, window_date); all without any given."""
    if only is None:
        return df
    return df.join(only.select(F.struct("granularity", "window_date").alias("__place")), F.struct(*place_of()) == F.col("__place"), "left_semi")


def name_at(position: Column, names: tuple[str, ...]) -> Column:
    """The name at a position; NULL where there is no position."""
    if not names:
        return F.lit(None).cast("string")
    return F.get(F.array(*[F.lit(name) for name in names]), position)


def needs_fan_out(monitor: Monitor) -> bool:
    """False when the base keys already are the only group keys."""
    return len(monitor.granularities) > 1 or bool(monitor.slice_columns)


def named(**fields: Column) -> Column:
    """A struct whose field names are spelled out; aliases inside a plain struct get lost next to SQL functions."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def group_columns(monitor: Monitor, group: str = "g") -> list[Column]:
    """The public columns of a group: window, granularity, slice_key, slice_value."""
    start, granularity = F.col(f"{group}.window_start"), name_at(F.col(f"{group}.granularity"), monitor.granularities)
    end = window_end(start, granularity)
    return [
        named(start=start.cast("timestamp"), end=end.cast("timestamp")).alias("window"),
        granularity.alias("granularity"),
        name_at(F.col(f"{group}.slice"), monitor.slice_columns).alias("slice_key"),
        F.col(f"{group}.slice_value").alias("slice_value"),
    ]


def profiled_columns(df: DataFrame, monitor: Monitor) -> list[T.StructField]:
    """The columns to profile, in schema order."""
    wanted = {name.lower() for name in monitor.columns} if monitor.columns else None
    return [f for f in df.schema if wanted is None or f.name.lower() in wanted]


def is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_category(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.BooleanType))


def is_nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def as_number(field: T.StructField) -> Column:
    """The value as a double, with one zero instead of two."""
    return F.col(f"`{field.name}`").cast("double") + F.lit(0.0)


def as_key(field: T.StructField) -> Column:
    """The value as short text that is equal exactly when the value is equal.

    Long texts and nested values become a digest, so a table of value counts never carries whole documents.
    """
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.MapType):
        # Entries in order of their keys' text, so that equal maps have equal text.
        entries = F.transform(F.map_entries(column), lambda e: F.struct(e["key"].cast("string").alias("k"), F.to_json(F.struct(e["value"])).alias("v")))
        text = F.to_json(F.array_sort(entries))
    else:
        text = F.to_json(column) if is_nested(field) else column.cast("string")
    return F.when(F.length(text) <= 32, text).otherwise(F.sha2(text, 256))
