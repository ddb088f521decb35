"""Time windows (T1-T4): the start of the window an instant falls in, and the end that belongs to a start.

Starts are computed with plain arithmetic on ``timestamp_ntz``: several granularities fit in one projection (one
``F.window`` per query is all Spark allows), months and years work, and the session time zone plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_MICROS = 1_000_000

# Widths in seconds. Weeks are counted from the epoch, a Thursday.
FIXED_WIDTHS = {
    "5 minutes": 300,
    "30 minutes": 1800,
    "1 hour": 3600,
    "1 day": 86400,
    "1 week": 604800,
    "2 weeks": 1209600,
    "3 weeks": 1814400,
    "4 weeks": 2419200,
}
CALENDAR_STARTS = {
    "1 month": "make_timestamp_ntz(year({0}), month({0}), 1, 0, 0, 0)",
    "1 year": "make_timestamp_ntz(year({0}), 1, 1, 0, 0, 0)",
}
_BY_WIDTH = [*FIXED_WIDTHS, *CALENDAR_STARTS]


def window_start(instant: str, granularity: str) -> Column:
    """Start of the window that holds the (NTZ) column ``instant``."""
    if granularity in CALENDAR_STARTS:
        return F.expr(CALENDAR_STARTS[granularity].format(f"`{instant}`"))
    micros = f"timestampdiff(MICROSECOND, {_EPOCH}, `{instant}`)"
    width = f"{FIXED_WIDTHS[granularity] * _MICROS}L"
    return F.expr(f"timestampadd(MICROSECOND, {micros} - pmod({micros}, {width}), {_EPOCH})")


def window_end(start: Column, granularity: Column) -> Column:
    """End of the window that begins at ``start``; NULL where there is no window."""
    end = F.lit(None).cast("timestamp_ntz")
    for name in _BY_WIDTH:
        unit = F.expr(f"INTERVAL {name}")
        end = F.when(granularity == name, start + unit).otherwise(end)
    return end


def base_granularity(granularities: tuple[str, ...]) -> str | None:
    """The granularity every requested one can be built from: the finest, at most one day."""
    if not granularities:
        return None
    if len(granularities) == 1:
        return granularities[0]
    finest = min(granularities, key=_BY_WIDTH.index)
    return min(finest, "1 day", key=_BY_WIDTH.index)


def widest_ratio(granularities: tuple[str, ...]) -> int:
    """How many base windows the widest granularity holds at most."""
    base = base_granularity(granularities)
    if base is None:
        return 1
    seconds = {**FIXED_WIDTHS, "1 month": 31 * 86400, "1 year": 366 * 86400}
    return max(seconds[name] for name in granularities) // seconds[base]


def as_instant(df: DataFrame, column: str) -> Column:
    """The time column as NTZ, whatever it was."""
    return F.col(f"`{column}`").cast("timestamp_ntz")


def all_windows(instant: str, granularities: tuple[str, ...]) -> Column:
    """One (granularity position, window_start) struct per granularity; one empty struct for snapshots."""
    if not granularities:
        return F.array(
            F.struct(
                F.lit(None).cast("int").alias("granularity"),
                F.lit(None).cast("timestamp_ntz").alias("window_start"),
            )
        )
    return F.array(
        *[
            F.struct(F.lit(i).alias("granularity"), window_start(instant, name).alias("window_start"))
            for i, name in enumerate(granularities)
        ]
    )
