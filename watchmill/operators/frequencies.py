"""Value counts per group and column: the table behind exact distinct counts and exact drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchmill.functions.ordering import dealt
from watchmill.operators.grouping import (
    as_key,
    as_number,
    fan_out,
    is_number,
    name_at,
    needs_fan_out,
    profiled_columns,
    with_base_keys,
)
from watchmill.settings import Monitor
from watchmill.sources.scratch import materialize

#: Whole numbers beyond this are not exact as doubles, so they keep a text key as well.
_EXACT = 2**53
_WIDE = (T.LongType, T.DecimalType)


#: Column position of the rows that count all rows of a group.
ALL_ROWS = -1
#: If a table has this column, each of its rows counts that often: 1 for a row that came, -1 for one that went.
SIGN = "__sign"


def keeps_text(field: T.StructField) -> bool:
    """May several values of the column have one number, and differ by their text?"""
    return isinstance(field.dataType, _WIDE)


def _entry(i: int, field: T.StructField):
    name, column = F.lit(i).alias("c"), F.col(f"`{field.name}`")
    if not is_number(field):
        return F.struct(name, F.lit(None).cast("double").alias("number"), as_key(field).alias("key"))
    text, number = F.lit(None).cast("string"), as_number(field)
    if isinstance(field.dataType, _WIDE):
        whole = isinstance(field.dataType, T.LongType)
        text = F.when(F.abs(column.cast("double")) > _EXACT, column.cast("string")) if whole else column.cast("string")
    elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        # NaN and the infinities have no place on an axis; they are values of their own, like texts.
        finite = F.abs(number) < F.lit(float("inf"))
        number, text = F.when(finite, number), F.when(~finite, number.cast("string"))
    return F.struct(name, number.alias("number"), text.alias("key"))


def value_counts(df: DataFrame, monitor: Monitor, fields: list[T.StructField] | None = None) -> DataFrame:
    """Rows (g, c, number, key, n), where c is the position in ``fields``; the ALL_ROWS rows count every row.

    Every input row is read once and collapsed before the first shuffle; only the counts, written when this is called, fan out
    into windows and slices. Rows with a SIGN give signed counts, which add up with those of other rows.
    """
    fields = profiled_columns(df, monitor) if fields is None else fields
    rows, keys = with_base_keys(df, monitor)
    table = F.struct(
        F.lit(ALL_ROWS).alias("c"),
        F.lit(None).cast("double").alias("number"),
        F.lit("").alias("key"),
    )
    entries = F.array(table, *[_entry(i, field) for i, field in enumerate(fields)])
    signs = [SIGN] if SIGN in df.columns else []
    long = rows.select(*keys, *signs, F.inline(entries)).filter("number IS NOT NULL OR key IS NOT NULL")
    counts = long.groupBy(*keys, "c", "number", "key").agg((F.sum(SIGN) if signs else F.count("*")).cast("bigint").alias("n"))
    if not needs_fan_out(monitor):
        return fan_out(counts, monitor).select("g", "c", "number", "key", "n")
    # Written, the counts say how many tasks their copies need.
    counts = materialize(counts, "base-counts")
    copies = len(monitor.granularities or (None,)) * (1 + len(monitor.slice_columns))
    grouped = dealt(fan_out(counts, monitor), ["g", "c", "number", "key"], counts.count() * copies)
    return grouped.groupBy("g", "c", "number", "key").agg(F.sum("n").alias("n"))


def distinct_counts(counts: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Exact distinct values per group and column."""
    found = counts.filter(F.col("c") != ALL_ROWS).groupBy("g", "c").agg(F.count("*").alias("distinct_count"))
    names = tuple(f.name for f in fields)
    return found.select("g", name_at(F.col("c"), names).alias("column_name"), "distinct_count")
