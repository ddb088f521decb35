"""Drift of numeric columns from rank sketches: one pass over the rows, and only group-sized tables after it.

For columns whose values hardly repeat the exact path shuffles every value. Here each base window keeps one mergeable
rank sketch per column, its range, and how many NaN and infinite values it has; windows and slices merge these, and the two
sides of a pair (a window and the one before, or a window and the baseline) are compared by their quantiles. The results are
estimates: see RANK_ERROR.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchmill.operators.drift import (
    BINS,
    baseline_drift,
    bin_edge,
    compared_fields,
    consecutive_drift,
    distance,
    drift_fields,
    js_term,
    metric_rows,
    previous_windows,
    psi_term,
    shared_with_baseline,
)
from watchmill.operators.frequencies import ALL_ROWS
from watchmill.operators.grouping import as_number, fan_out, is_number, with_base_keys
from watchmill.operators.profile import COLUMNS_PER_PASS, RANK_SKETCH_SIZE
from watchmill.schemas import DRIFT_METRICS, empty
from watchmill.settings import Monitor
from watchmill.sources.scratch import materialize

#: Quantiles that stand for one side, each with the same share of its rows.
POINTS = 500
#: What a share below some value may be off by on one side: the sketch's own error (0.3 % at 99 % confidence), and half a point.
#: The Kolmogorov-Smirnov statistic is off by twice that at most, so is the share of a bin.
RANK_ERROR = 0.004
#: Values that are no place on an axis, each a category of its own beside the bins.
_ODD = ("nan", "above", "below")


def _quantiles(sketch: str) -> Column:
    # Spark wants the levels as a constant array.
    levels = F.array(*[F.lit((i + 0.5) / POINTS) for i in range(POINTS)])
    return F.kll_sketch_get_quantile_double(F.col(sketch), levels)


def _shares_below(side: str, edges: list[Column]) -> Column:
    """Share of the points below each edge, from zero to one."""

    def below(edge: Column) -> Column:
        return F.size(F.filter(side, lambda v: v < edge)) / F.lit(float(POINTS))

    return F.array(F.lit(0.0), *[below(edge) for edge in edges], F.lit(1.0))


def _largest_gap(left: str, right: str) -> Column:
    """Largest difference of the two step functions: one walk over the merged points, judged after the last of equals."""

    def tagged(side: str, step: float) -> Column:
        return F.transform(side, lambda v: F.struct(v.alias("v"), F.lit(step).alias("step")))

    merged = F.array_sort(F.concat(tagged(left, 1.0 / POINTS), tagged(right, -1.0 / POINTS)))
    after = F.slice(F.transform(merged, lambda e: e["v"]), F.lit(2), F.lit(2 * POINTS))
    walk = F.zip_with(merged, after, lambda e, nxt: F.struct(e["step"].alias("step"), F.coalesce(e["v"] < nxt, F.lit(True)).alias("last")))
    start = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("most"))

    def step(so_far: Column, e: Column) -> Column:
        gap = so_far["gap"] + e["step"]
        most = F.when(e["last"], F.greatest(so_far["most"], F.abs(gap))).otherwise(so_far["most"])
        return F.struct(gap.alias("gap"), most.alias("most"))

    return F.aggregate(walk, start, step)["most"]


def number_sketches(df: DataFrame, monitor: Monitor, fields: list[T.StructField]) -> DataFrame:
    """Rows (g, c, size, finite, nan, above, below, low, high, kll): what is kept of each numeric column in every group. The
    ALL_ROWS rows say which groups there are. ``c`` is the position in ``fields``.
    """
    rows, keys = with_base_keys(df, monitor)
    infinite = F.lit(float("inf"))
    kinds = {"c": "int", "finite": "bigint", **dict.fromkeys(_ODD, "bigint"), "low": "double", "high": "double", "kll": "binary"}

    def entry(**values: Column) -> Column:
        return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])

    result = None
    for at in range(0, len(fields), COLUMNS_PER_PASS):
        kept, entries = [], [entry(c=F.lit(ALL_ROWS))] if at == 0 else []
        for i, field in enumerate(fields[at : at + COLUMNS_PER_PASS], at):
            value = as_number(field)
            finite = F.when(F.abs(value) < infinite, value)
            found = {
                "finite": F.count(finite),
                "nan": F.count_if(F.isnan(value)),
                "above": F.count_if(value == infinite),
                "below": F.count_if(value == -infinite),
                "low": F.min(finite),
                "high": F.max(finite),
                "kll": F.kll_sketch_agg_double(finite, F.lit(RANK_SKETCH_SIZE)),
            }
            kept += [value.alias(f"{name}_{i}") for name, value in found.items()]
            entries.append(entry(c=F.lit(i), **{name: F.col(f"{name}_{i}") for name in found}))
        part = rows.groupBy(*keys).agg(*kept).select(*keys, F.inline(F.array(*entries)))
        result = part if result is None else result.unionByName(part)
    counts = [F.sum(name).alias(name) for name in ("finite", *_ODD)]
    whole = F.kll_merge_agg_double("kll", F.lit(RANK_SKETCH_SIZE)).alias("kll")
    merged = fan_out(result, monitor).groupBy("g", "c").agg(*counts, F.min("low").alias("low"), F.max("high").alias("high"), whole)
    return merged.withColumn("size", F.col("finite") + F.col("nan") + F.col("above") + F.col("below"))


_SIDE = ["size", "finite", *_ODD, "low", "high", "kll"]


def _paired(pairs: DataFrame, now: DataFrame, then: DataFrame, key: list[str]) -> DataFrame:
    """Rows (g, c) of ``pairs`` with the sketches of both sides, where both have values."""
    now = now.select("g", "c", *[F.col(name).alias(f"{name}_p") for name in _SIDE])
    then = then.select(*key, "c", *[F.col(name).alias(f"{name}_q") for name in _SIDE])
    return pairs.join(now, ["g", "c"]).join(then, [*key, "c"]).filter("size_p > 0 AND size_q > 0")


def _scores(sides: DataFrame) -> DataFrame:
    """M1, M2, M3, M5 from the sketches of both sides; NULL for M2 and M3 where a side has no finite value."""

    def points(side: str) -> Column:
        return F.when(F.col(f"finite_{side}") > 0, _quantiles(f"kll_{side}")).otherwise(F.array().cast("array<double>"))

    rows = sides.withColumns({"at_p": points("p"), "at_q": points("q"), "least": F.least("low_p", "low_q"), "most": F.greatest("high_p", "high_q")})
    edges = [bin_edge(F.col("least"), F.col("most"), k) for k in range(1, BINS)]
    rows = rows.withColumns({"upto_p": _shares_below("at_p", edges), "upto_q": _shares_below("at_q", edges)})

    def shares(side: str) -> list[Column]:
        """Shares of the bins and of the odd values in all values."""
        size, below = F.col(f"size_{side}"), F.col(f"upto_{side}")
        finite = F.col(f"finite_{side}") / size
        bins = [(F.get(below, F.lit(k + 1)) - F.get(below, F.lit(k))) * finite for k in range(BINS)]
        return [*bins, *[F.col(f"{name}_{side}") / size for name in _ODD]]

    cells = F.array(*[F.struct(p.alias("p"), q.alias("q")) for p, q in zip(shares("p"), shares("q"))])
    rows = rows.withColumn("cells", cells)

    def summed(term: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda so_far, cell: so_far + term(cell["p"], cell["q"]))

    moves = F.zip_with("at_p", "at_q", lambda p, q: F.abs(p - q) / POINTS)
    both = (F.col("finite_p") > 0) & (F.col("finite_q") > 0)
    return rows.select(
        "g",
        "c",
        distance(summed(js_term)).alias("js"),
        summed(psi_term).alias("psi"),
        F.when(both, _largest_gap("at_p", "at_q")).alias("ks"),
        F.when(both, F.aggregate(moves, F.lit(0.0), lambda so_far, move: so_far + move)).alias("wd"),
        F.lit(None).cast("double").alias("chi"),
    )


def _each_column(groups: DataFrame, fields: list[T.StructField]) -> DataFrame:
    return groups.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(len(fields) - 1))))


def stored_sketches(df: DataFrame, monitor: Monitor, fields: list[T.StructField]) -> DataFrame:
    """The sketches of the given numeric columns, written once for all comparisons of a table."""
    return materialize(number_sketches(df, monitor, fields), "sketches")


def _split(fields: list[T.StructField], monitor: Monitor) -> tuple[list[T.StructField], Monitor | None]:
    """The numeric columns, and the monitor of the others, if there are any."""
    others = tuple(f.name for f in fields if not is_number(f))
    return [f for f in fields if is_number(f)], replace(monitor, columns=others) if others else None


def _together(parts: list[DataFrame], df: DataFrame) -> DataFrame:
    if not parts:
        return empty(df.sparkSession, DRIFT_METRICS)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def sketch_drift(df: DataFrame, monitor: Monitor, sketches: DataFrame | None = None) -> DataFrame:
    """J9 with M1, M2, M3, M5 of the numeric columns from sketches; the other columns are compared exactly.

    Only the starts of the windows are put in order; the sketches of two windows meet in a join. ``sketches`` are those that
    ``stored_sketches`` made of the numeric columns.
    """
    numbers, others = _split(drift_fields(df, monitor), monitor)
    parts = []
    if numbers:
        kept = sketches if sketches is not None else stored_sketches(df, monitor, numbers)
        pairs = _each_column(previous_windows(kept), numbers)
        before = kept.withColumnRenamed("g", "before")
        parts.append(metric_rows(pairs.select("g", "c"), _scores(_paired(pairs, kept, before, ["before"])), monitor, numbers, "CONSECUTIVE"))
    if others:
        parts.append(consecutive_drift(df, others))
    return _together(parts, df)


def sketch_baseline_drift(df: DataFrame, baseline: DataFrame, monitor: Monitor, sketches: DataFrame | None = None) -> DataFrame:
    """J10 with M1, M2, M3, M5 of the numeric columns from sketches of the windows and of the baseline; the other columns are
    compared exactly. ``sketches`` are those of the windows, if slices and columns are the ones that both tables have.
    """
    monitor = shared_with_baseline(monitor, baseline)
    numbers, others = _split(compared_fields(df, baseline, monitor), monitor)
    parts = []
    if numbers:
        kept = sketches if sketches is not None else stored_sketches(df, monitor, numbers)
        by_name = {f.name.lower(): f for f in baseline.schema}
        still = Monitor(monitor.table, "SNAPSHOT", granularities=(), slices=monitor.slice_columns)
        known = number_sketches(baseline, still, [by_name[f.name.lower()] for f in numbers])
        # Slices that are NULL are equal inside a struct.
        at = F.struct("g.slice", "g.slice_value").alias("s")
        every = _each_column(kept.filter(F.col("c") == ALL_ROWS).select("g"), numbers)
        sides = _paired(every.select("*", at), kept, known.select("*", at), ["s"])
        parts.append(metric_rows(every, _scores(sides), monitor, numbers, "BASELINE"))
    if others:
        parts.append(baseline_drift(df, baseline, others))
    return _together(parts, df)
