"""Merging partial statistics: counts, means and squared deviations of parts into those of the whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchmill.functions.windows import widest_ratio
from watchmill.settings import Monitor

#: Parts of one group that may meet in one task.
MAX_PARTS = 1_000_000
#: Values a slice column may have (the slice guard's default limit).
SLICE_VALUES = 50
_SALTS = 64
#: What is left of squared deviations that rows took back counts as nothing below this share of all that was added.
_RESIDUE = 1e-12

#: How further columns merge: name -> aggregate. Each must give the same result when applied to its own results.
Merges = dict[str, Callable[[str], Column]]


def needs_two_rounds(monitor: Monitor) -> bool:
    """Could one group have more parts than a task should hold? Decided by the settings: base windows per window times
    the combinations of slice values.
    """
    parts = widest_ratio(monitor.granularities) * SLICE_VALUES ** len(monitor.slice_columns)
    return parts > MAX_PARTS


def _merge(rows: DataFrame, keys: list[str], merges: Merges) -> DataFrame:
    # Deviations are taken around a centre of the group itself, or large means would swallow small spreads. Window and
    # aggregation share one shuffle.
    centred = rows.withColumn("centre", F.avg("mean").over(Window.partitionBy(*keys)))
    off = F.col("mean") - F.col("centre")
    merged = centred.groupBy(*keys).agg(
        F.sum("values").alias("values"),
        F.sum(F.col("values") * off).alias("shift"),
        F.sum(F.col("m2") + F.col("values") * off * off).alias("spread"),
        F.sum(F.abs("m2") + F.abs("values") * off * off).alias("added"),
        F.max("centre").alias("centre"),
        *[merge(name).alias(name) for name, merge in merges.items()],
    )
    shift = F.try_divide(F.col("shift"), F.col("values"))
    m2 = F.col("spread") - F.col("values") * shift * shift
    return merged.withColumns(
        {"mean": F.col("centre") + shift, "m2": F.when(m2 > F.col("added") * _RESIDUE, m2).when(m2.isNotNull(), 0.0)}
    ).drop("shift", "spread", "centre", "added")


def merge_moments(rows: DataFrame, keys: list[str], merges: Merges, *, two_rounds: bool = False) -> DataFrame:
    """Merge rows (keys, values, mean, m2, further columns) to one row per key. With ``two_rounds`` the parts of a group
    are first merged in 64 shares, so that no task sees all of them.
    """
    if two_rounds:
        share = F.pmod(F.xxhash64("values", "mean", "m2", *merges), F.lit(_SALTS))
        rows = _merge(rows.withColumn("share", share), [*keys, "share"], merges).drop("share")
    return _merge(rows, keys, merges)
