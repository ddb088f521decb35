"""Column profiles (A1-A4, S4, P16) from partial profiles that merge (ST6).

Stage one reads the rows once and keeps, per base window and slice combination, one wide row of partial statistics.
Stage two works on those few rows: it fans them out into granularities and slices and merges. The shuffles carry
(groups x columns) partials, never rows x columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchmill.operators.frequencies import distinct_counts, value_counts
from watchmill.operators.grouping import (
    as_key,
    as_number,
    fan_out,
    group_columns,
    is_nested,
    is_number,
    profiled_columns,
    with_base_keys,
    within,
)
from watchmill.operators.moments import Merges, merge_moments, needs_two_rounds
from watchmill.schemas import PERFORMANCE_FIELDS, PROFILE_METRICS, TABLE_ROW
from watchmill.settings import Monitor

#: Columns per aggregation, so that generated code stays under the JVM's method size limit.
COLUMNS_PER_PASS = 100

_STATS = ["values", "mean", "m2", "low", "high"]


def _aggregates(field: T.StructField, i: int, distinct_sketch: bool, rank_sketch: bool) -> list[Column]:
    column = F.col(f"`{field.name}`")
    found = [F.count(column).alias(f"values_{i}")]
    if is_number(field):
        number = as_number(field)
        found += [
            F.avg(number).alias(f"mean_{i}"),
            (F.var_pop(number) * F.count(column)).alias(f"m2_{i}"),
            F.min(number).alias(f"low_{i}"),
            F.max(number).alias(f"high_{i}"),
        ]
        if rank_sketch:
            found.append(F.kll_sketch_agg_double(number, F.lit(RANK_SKETCH_SIZE)).alias(f"kll_{i}"))
    if distinct_sketch:
        # NULL has a hash too, and maps have none: nested values are counted by their text.
        value = as_key(field) if is_nested(field) else column
        found.append(F.hll_sketch_agg(F.when(column.isNotNull(), F.xxhash64(value))).alias(f"hll_{i}"))
    return found


#: Size of a rank sketch; its rank error is about 0.2 % at this size.
RANK_SKETCH_SIZE = 1600

_TYPES = {"values": "bigint", "hll": "binary", "kll": "binary"}


def _entry(name: str, i: int | None, present: set[str], sketches: list[str]) -> Column:
    """One column's partial statistics as a struct of the long form."""
    stats = [
        (F.col(f"{stat}_{i}") if f"{stat}_{i}" in present else F.lit(None))
        .cast(_TYPES.get(stat, "double"))
        .alias(stat)
        for stat in [*_STATS, *sketches]
    ]
    return F.struct(F.lit(name).alias("column_name"), *stats)


def partial_profiles(
    df: DataFrame, monitor: Monitor, *, distinct_sketch: bool = False, rank_sketch: bool = False
) -> DataFrame:
    """ST6: rows (base keys, column_name, rows, values, mean, m2, low, high[, hll][, kll]) to store and merge."""
    fields = profiled_columns(df, monitor)
    rows, keys = with_base_keys(df, monitor)
    sketches = [name for name, on in (("hll", distinct_sketch), ("kll", rank_sketch)) if on]
    passes = [fields[i : i + COLUMNS_PER_PASS] for i in range(0, len(fields), COLUMNS_PER_PASS)] or [[]]
    result = None
    for number, chunk in enumerate(passes):
        stats = [a for i, f in enumerate(chunk) for a in _aggregates(f, i, distinct_sketch, rank_sketch)]
        wide = rows.groupBy(*keys).agg(F.count("*").alias("rows"), *stats)
        entries = [_entry(f.name, i, set(wide.columns), sketches) for i, f in enumerate(chunk)]
        if number == 0:
            entries.insert(0, _entry(TABLE_ROW, None, set(), sketches))
        part = wide.select(*keys, "rows", F.inline(F.array(*entries)))
        result = part if result is None else result.unionByName(part)
    return result


def merge_profiles(partials: DataFrame, monitor: Monitor, only: DataFrame | None = None) -> DataFrame:
    """Merge partial profiles into rows per group ``g`` and column: rows, values, mean, stddev, low, high, sketches. With
    ``only``, those of the groups that ``within`` keeps.
    """
    return merge_parts(within(fan_out(partials, monitor), only), monitor)


def merge_parts(spread: DataFrame, monitor: Monitor) -> DataFrame:
    """Merge partial profiles that are already spread over the groups ``g``."""
    merges: Merges = {"rows": F.sum, "low": F.min, "high": F.max}
    if "hll" in spread.columns:
        merges["hll"] = F.hll_union_agg
    if "kll" in spread.columns:
        merges["kll"] = lambda name: F.kll_merge_agg_double(name, F.lit(RANK_SKETCH_SIZE))
    merged = merge_moments(spread, ["g", "column_name"], merges, two_rounds=needs_two_rounds(monitor))
    deviation = F.sqrt(F.col("m2") / (F.col("values") - 1))
    return merged.withColumn("stddev", F.when(F.col("values") > 1, deviation)).drop("m2")


def profile_columns(monitor: Monitor, distinct: Column, log_type: str) -> list[Column]:
    """The public columns of a merged profile."""
    nulls = F.when(F.col("column_name") != TABLE_ROW, F.col("rows") - F.col("values"))
    return [
        *group_columns(monitor),
        F.lit(log_type).alias("log_type"),
        "column_name",
        F.col("rows").alias("count"),
        nulls.alias("num_nulls"),
        F.try_divide(nulls.cast("double"), F.col("rows")).alias("percent_null"),
        F.when(F.col("column_name") != TABLE_ROW, distinct).alias("distinct_count"),
        F.col("mean").alias("avg"),
        "stddev",
        F.col("low").alias("min"),
        F.col("high").alias("max"),
    ]


def profile(df: DataFrame, monitor: Monitor, *, log_type: str = "INPUT", distinct: str = "approx") -> DataFrame:
    """A1, A2: one row per window, slice and column, plus the ``:table`` rows.

    ``distinct`` is 'approx' (mergeable sketches, one pass), 'exact' (value counts, a shuffle the size of the distinct
    values) or 'none'.
    """
    merged = merge_profiles(partial_profiles(df, monitor, distinct_sketch=distinct == "approx"), monitor)
    if distinct == "exact":
        exact = distinct_counts(value_counts(df, monitor), profiled_columns(df, monitor))
        merged = merged.join(exact, ["g", "column_name"], "left")
        number = F.coalesce("distinct_count", F.lit(0).cast("bigint"))
    elif distinct == "approx":
        number = F.coalesce(F.hll_sketch_estimate("hll"), F.lit(0).cast("bigint"))
    else:
        number = F.lit(None).cast("bigint")
    return merged.select(*profile_columns(monitor, number, log_type))


def with_performance(profiles: DataFrame, performance: DataFrame | None) -> DataFrame:
    """Put the performance scores on the ``:table`` rows and bring the result to the metric table's schema."""
    names = [f.name for f in PERFORMANCE_FIELDS]
    if performance is None:
        filled = profiles.withColumns({f.name: F.lit(None).cast(f.dataType) for f in PERFORMANCE_FIELDS})
    else:
        keyed = F.struct("window", "granularity", "slice_key", "slice_value")
        scores = performance.select(keyed.alias("g"), F.lit(TABLE_ROW).alias("column_name"), *names)
        filled = profiles.withColumn("g", keyed).join(scores, ["g", "column_name"], "left").drop("g")
    return filled.select(*[f.name for f in PROFILE_METRICS])


def approximate_cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """A4: approximate distinct count of several columns in one pass; rows (column_name, cardinality)."""
    wide = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("cardinality"))
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*pairs)))


def slice_guard(df: DataFrame, candidates: tuple[str, ...], max_cardinality: int = 50) -> DataFrame:
    """Which slice candidates may be used; rows (column_name, cardinality, action, safe)."""
    present = {name.lower(): name for name in df.columns}
    found = [present[name.lower()] for name in candidates if name.lower() in present]
    missing = [name for name in candidates if name.lower() not in present]
    measured = approximate_cardinality(df, found) if found else None
    rows = None
    if measured is not None:
        small = F.col("cardinality") <= max_cardinality
        rows = measured.select(
            "column_name",
            "cardinality",
            F.when(small, "keep").otherwise("skip_cardinality").alias("action"),
            small.alias("safe"),
        )
    if missing:
        absent = df.sparkSession.createDataFrame(
            [(name, None, "skip_missing", False) for name in missing],
            "column_name string, cardinality bigint, action string, safe boolean",
        )
        rows = absent if rows is None else rows.unionByName(absent)
    return rows


def safe_slices(df: DataFrame, candidates: tuple[str, ...], max_cardinality: int = 50) -> tuple[str, ...]:
    """The usable slice columns in their given order; one small row per candidate reaches the driver."""
    if not candidates:
        return ()
    verdicts = {r.column_name.lower(): r.safe for r in slice_guard(df, candidates, max_cardinality).collect()}
    return tuple(name for name in candidates if verdicts.get(name.lower()))
