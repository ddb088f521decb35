"""Exact drift between a window and the window before it (J9), or a baseline table.

Everything starts from value counts (see ``frequencies``). Facts about a whole group - totals, smallest and largest
value, the window before - form small tables that are joined to the counts with a salt; statistics over ordered values
use ``running_totals``. No group is ever sorted, collected or joined in a single task.

Numeric columns get js_distance and population_stability_index over ten equal bins between the smallest and the largest
value of both sides (M6), the Kolmogorov-Smirnov statistic and the Wasserstein distance. Text and boolean columns get
js_distance, population_stability_index and the chi-squared statistic over their values. NULL is no category. NaN and the
infinities of a numeric column are three categories beside its bins; the Kolmogorov-Smirnov statistic and the Wasserstein
distance compare the finite values, and are NULL where a side has none.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchmill.functions.ordering import (
    Sizes,
    cell_name,
    cells_before,
    cells_reached,
    choose_grids,
    dealt,
    few,
    join_facts,
    placed,
    running_totals,
    total,
    with_cells,
)
from watchmill.operators.frequencies import ALL_ROWS, keeps_text, value_counts
from watchmill.operators.grouping import group_columns, is_category, is_number, name_at, profiled_columns
from watchmill.schemas import DRIFT_METRICS, empty
from watchmill.settings import Monitor
from watchmill.sources.scratch import materialize

BINS = 10
#: Share that stands in for an empty bin in the population stability index.
SHARE_FLOOR = 1e-4
_SCORES = ["js", "psi", "chi", "ks", "wd"]


def drift_fields(df: DataFrame, monitor: Monitor) -> list[T.StructField]:
    """The columns drift is defined for: numbers, texts and booleans other than the time column."""
    at = (monitor.timestamp_column or "").lower()
    return [f for f in profiled_columns(df, monitor) if (is_number(f) or is_category(f)) and f.name.lower() != at]


# --- statistics over shares -------------------------------------------------------------------------------------


def js_term(p: Column, q: Column) -> Column:
    """M1: part of one value in the Jensen-Shannon divergence (base 2)."""
    middle = (p + q) / 2

    def half(share: Column) -> Column:
        return F.when(share > 0, share * F.log2(share / middle)).otherwise(0.0) / 2

    return half(p) + half(q)


def psi_term(p: Column, q: Column) -> Column:
    """M5: part of one value in the population stability index."""
    a, b = F.greatest(p, F.lit(SHARE_FLOOR)), F.greatest(q, F.lit(SHARE_FLOOR))
    return (a - b) * F.ln(a / b)


def distance(divergence: Column) -> Column:
    """Root of the divergence, held inside [0, 1]."""
    return F.sqrt(F.least(F.greatest(divergence, F.lit(0.0)), F.lit(1.0)))


def bin_edge(low: Column, high: Column, k: int) -> Column:
    """M6: lower edge of bin k."""
    return low + (high - low) * F.lit(float(k)) / F.lit(float(BINS))


def bin_of(value: Column, low: Column, high: Column) -> Column:
    """M6: number of inner edges at or below the value; a constant column has one bin."""
    above = total([(value >= bin_edge(low, high, k)).cast("int") for k in range(1, BINS)])
    return F.when(low < high, above).otherwise(0)


# --- facts per group ----------------------------------------------------------------------------------------------

_FACTS = ["size", "finite", "values", "low", "high"]


def group_facts(counts: DataFrame) -> DataFrame:
    """Rows (g, c, size, finite, values, low, high): counted rows, those with a finite number, distinct values and range per
    column of every group.
    """
    return counts.groupBy("g", "c").agg(
        F.sum("n").alias("size"),
        F.sum(F.when(F.col("number").isNotNull(), F.col("n")).otherwise(0)).alias("finite"),
        F.count("*").alias("values"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
    )


def _usable(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("c") != ALL_ROWS)


# --- consecutive windows ------------------------------------------------------------------------------------------


def previous_windows(facts: DataFrame) -> DataFrame:
    """Rows (g, before) per group; ``before`` is the earlier non-empty window of the slice. Only the starts of the
    windows are put in order, without the facts of their columns.
    """
    slices = Window.partitionBy("g.granularity", "g.slice", "g.slice_value").orderBy("g.window_start")
    starts = facts.filter(F.col("c") == ALL_ROWS).select("g")
    return starts.withColumn("before", F.lag("g").over(slices)).filter("before IS NOT NULL")


def _sides(facts: DataFrame, columns: int, pairs: DataFrame) -> DataFrame:
    """One row per (pair, column): sizes of both windows and the common range. ``g`` is the later window, ``w`` a plain number
    that stands for pair and column where rows are shuffled and sorted.
    """
    pairs = pairs.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    side = F.struct(*_FACTS)
    now = facts.select("g", "c", side.alias("p"))
    then = facts.select(F.col("g").alias("before"), "c", side.alias("q"))
    return pairs.join(now, ["g", "c"], "left").join(then, ["before", "c"], "left").select(
        F.monotonically_increasing_id().alias("w"),
        "g",
        "before",
        "c",
        F.col("p.size").alias("size_p"),
        F.col("q.size").alias("size_q"),
        F.col("p.finite").alias("finite_p"),
        F.col("q.finite").alias("finite_q"),
        (F.col("p.values") + F.col("q.values")).alias("values"),
        F.least("p.low", "q.low").alias("low"),
        F.greatest("p.high", "q.high").alias("high"),
    )


_SIDES = ["size_p", "size_q", "finite_p", "finite_q", "low", "high"]


def _pair_counts(counts: DataFrame, sides: DataFrame, sizes: Sizes, grids: tuple[float, ...]) -> DataFrame:
    """Rows (w, cell, number, key, p, q): each value with its count in the window and in the one before (J12). One shuffle
    by pair and cell serves the running totals too; values without a number are spread by their keys.
    """
    roles = F.array(
        F.struct(F.col("g"), F.lit(True).alias("is_p")), F.struct(F.col("before").alias("g"), F.lit(False).alias("is_p"))
    )
    full = sides.filter("size_p > 0 AND size_q > 0")
    roled = full.select("w", "c", F.inline(roles))
    rows = join_facts(_usable(counts), roled, ["g", "c"], ["number", "key"], sizes)
    rows, keys = rows.drop("g", "c"), ["w"]
    if grids:
        spread = F.pmod(F.xxhash64("key"), F.lit(1024)).cast("bigint")
        cell = cell_name(grids)
        rows = with_cells(rows, "number", grids).withColumn(cell, F.when(F.col("number").isNull(), spread).otherwise(F.col(cell)))
        keys.append(cell)
    # A value counts twice in ``sizes`` and here: in its window and in the one after it.
    return dealt(rows, keys, sizes.rows).groupBy(*keys, "number", "key").agg(
        F.sum(F.when(F.col("is_p"), F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("is_p"), 0).otherwise(F.col("n"))).alias("q"),
    )


_PART = ["p", "q", "size_p", "size_q"]


def _cell_parts() -> list[Column]:
    """Counts of a bin or value, both sizes."""
    return [(F.sum(name) if name in ("p", "q") else F.max(name)).alias(name) for name in _PART]


def _share_scores() -> list[Column]:
    """M1, M4, M5 from one row per value or bin with p, q, size_p, size_q, is_number."""
    p, q = F.col("p") / F.col("size_p"), F.col("q") / F.col("size_q")
    pooled = (F.col("p") + F.col("q")) / (F.col("size_p") + F.col("size_q"))
    chi = F.col("size_p") * _square(p - pooled) / pooled + F.col("size_q") * _square(q - pooled) / pooled
    return [
        distance(F.sum(js_term(p, q))).alias("js"),
        F.sum(psi_term(p, q)).alias("psi"),
        F.sum(F.when(~F.col("is_number"), chi)).alias("chi"),
    ]


def _square(value: Column) -> Column:
    return value * value


def _walked(rows: DataFrame, grids: tuple[float, ...]) -> DataFrame:
    """Add the counts of both sides up to each number, and the following number."""
    numbers = running_totals(rows.filter("number IS NOT NULL"), ["w"], "number", ["p", "q"], grids)
    absent = {name: F.lit(None).cast("bigint") for name in ("p_upto", "q_upto")}
    others = rows.filter("number IS NULL").withColumns({**absent, "next_value": F.lit(None).cast("double")})
    return numbers.unionByName(others.select(*numbers.columns))


def _consecutive_scores(counts: DataFrame, columns: int, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs and columns to report, and their scores. Without ``pairs`` (g, before) those of all windows counted."""
    facts = group_facts(counts)
    sides = materialize(_sides(facts, columns, previous_windows(facts) if pairs is None else pairs), "sides")
    sizes = Sizes.of(sides)
    grids = choose_grids(_usable(counts).filter("number IS NOT NULL"), ["g", "c"], "number", sizes.largest)
    rows = _walked(_pair_counts(counts, sides, sizes, grids), grids)
    rows = join_facts(rows, sides.select("w", *_SIDES), ["w"], ["number", "key"], sizes)
    is_number, number = F.col("number").isNotNull(), F.col("number")
    cell = F.when(is_number, bin_of(number, F.col("low"), F.col("high")).cast("string")).otherwise(F.col("key"))
    gap = F.abs(F.try_divide("p_upto", "finite_p") - F.try_divide("q_upto", "finite_q"))
    apart = F.when(is_number & (F.col("finite_p") > 0) & (F.col("finite_q") > 0), gap)
    cells = rows.groupBy("w", cell.alias("cell"), is_number.alias("is_number")).agg(
        *_cell_parts(),
        F.max(apart).alias("ks"),
        F.sum(apart * F.coalesce(F.col("next_value") - number, F.lit(0.0))).alias("wd"),
    )
    scores = cells.groupBy("w").agg(*_share_scores(), F.max("ks").alias("ks"), F.sum("wd").alias("wd"))
    return sides.select("g", "c"), sides.select("w", "g", "c").join(scores, "w").drop("w")


# --- baseline -----------------------------------------------------------------------------------------------------

#: Groups of a baseline have no window; they match by slice.
_SLICE = "struct(g.slice, g.slice_value)"


def _category_baseline_scores(counts: DataFrame, baseline: DataFrame, sides: DataFrame, sizes: Sizes) -> DataFrame:
    """M1, M4, M5 against baseline categories.

    Values of the window are looked up in the baseline. Baseline values the window lacks are not listed per window:
    their parts depend on the baseline alone, so the sum over all baseline values minus the sum over the matched ones
    gives them.
    """
    size_p, size_q = F.col("size_p"), F.col("size_q")
    known = baseline.select("s", "c", "key", F.col("n").alias("q"))
    facts = sides.select("s", "c", F.col("size_q")).distinct()
    lost = join_facts(known, facts, ["s", "c"], ["key"], sizes)
    lost_psi = lost.groupBy("s", "c").agg(F.sum(psi_term(F.lit(0.0), F.col("q") / size_q)).alias("psi_all"))

    now = counts.select("g", "s", "c", "key", F.col("n").alias("p")).join(known, ["s", "c", "key"], "left")
    rows = join_facts(now, sides.select("g", "c", "size_p", "size_q"), ["g", "c"], ["key"], sizes)
    rows = rows.withColumn("q", F.coalesce("q", F.lit(0)))
    p, q = F.col("p") / size_p, F.col("q") / size_q
    pooled = (F.col("p") + F.col("q")) / (size_p + size_q)
    chi = size_p * _square(p - pooled) / pooled + size_q * _square(q - pooled) / pooled
    matched = rows.groupBy("g", "c").agg(
        F.sum(js_term(p, q)).alias("js"),
        F.sum(psi_term(p, q)).alias("psi"),
        F.sum(chi).alias("chi"),
        F.sum("q").alias("q"),
        F.sum(F.when(F.col("q") > 0, psi_term(F.lit(0.0), q)).otherwise(0.0)).alias("psi_matched"),
        F.max(size_p).alias("size_p"),
        F.max(size_q).alias("size_q"),
    )
    rest = (size_q - F.col("q")) / size_q
    joined = matched.withColumn("s", F.expr(_SLICE)).join(lost_psi, ["s", "c"], "left")
    return joined.select(
        "g",
        "c",
        distance(F.col("js") + rest / 2).alias("js"),
        (F.col("psi") + F.when(rest > 0, F.col("psi_all") - F.col("psi_matched")).otherwise(0.0)).alias("psi"),
        # An absent value adds size_p * pooled + size_q * (q - pooled)**2 / pooled, which is size_p * q.
        (F.col("chi") + size_p * rest).alias("chi"),
    )


def _axis(counts: DataFrame, baseline: DataFrame, pair: DataFrame) -> DataFrame:
    """Values of all windows (w), their inner bin edges and the baseline values, on one axis (a) per slice and column. Plain
    numbers stand for the groups here, because rows are sorted by them.
    """
    zero = F.lit(0).cast("bigint")
    no_window, no_edge = F.lit(None).cast("bigint").alias("w"), F.lit(None).cast("int").alias("edge")
    windows = counts.select("w", "a", "number", F.col("n").alias("p"), zero.alias("q"), no_edge)
    known = baseline.select(no_window, "a", "number", zero.alias("p"), F.col("n").alias("q"), no_edge)
    inner = F.array(
        *[
            F.struct(F.lit(k).alias("edge"), bin_edge(F.col("low"), F.col("high"), k).alias("number"))
            for k in range(1, BINS)
        ]
    )
    edges = pair.filter("low < high").select("w", "a", F.inline(inner), zero.alias("p"), zero.alias("q"))
    return windows.unionByName(known).unionByName(edges)


#: Parts of the Wasserstein distance that add up over the values of a window.
_WALK = ["inside", "first_area", "last", "last_area"]


def _cells_off_the_axis(
    counts: DataFrame, baseline: DataFrame, odd: DataFrame, odd_baseline: DataFrame, sides: DataFrame, sizes: Sizes
) -> DataFrame:
    """Cells of NaN and both infinities, which no bin holds, and where only one side has finite values the bins of that side."""
    cell = F.when(F.col("key") == "NaN", -1).when(F.col("key") == "Infinity", -2).otherwise(-3).alias("cell")
    now = odd.select("g", "c", cell, F.col("n").alias("p"))
    then = odd_baseline.select("s", "c", "key", "n").join(sides.select("g", "s", "c"), ["s", "c"]).select("g", "c", cell, F.col("n").alias("q"))
    bin_number = bin_of(F.col("number"), F.col("low"), F.col("high")).alias("cell")
    alone = sides.filter("finite_p > 0 AND finite_q = 0").select("g", "c", "low", "high")
    alone = join_facts(counts, alone, ["g", "c"], ["number"], sizes).groupBy("g", "c", bin_number).agg(F.sum("n").alias("p"))
    # The range is the baseline's own there, so its bins are counted once for all such windows.
    own = baseline.groupBy("s", "c").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    bins = join_facts(baseline, own, ["s", "c"], ["number"], sizes).groupBy("s", "c", bin_number).agg(F.sum("n").alias("q"))
    known = sides.filter("finite_p = 0 AND finite_q > 0").select("g", "s", "c").join(bins, ["s", "c"]).select("g", "c", "cell", "q")
    parts = [now, then, alone, known]
    return reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)


def _number_baseline_scores(
    counts: DataFrame, baseline: DataFrame, sides: DataFrame, sizes: Sizes, odd: DataFrame, odd_baseline: DataFrame
) -> DataFrame:
    """M1, M2, M3, M5 against a numeric baseline, without copying the baseline to every window. The last two frames hold
    the values that are not finite.

    Running totals of the baseline along the common axis give, at each value, its share G and the integral of G up to
    there; running totals inside the window give the window's share F.
    """
    pair = sides.filter("finite_p > 0 AND finite_q > 0").select(
        "w", "a", "g", "s", "c", F.col("finite_p").alias("size_p"), F.col("finite_q").alias("size_q"), "low", "high"
    )
    values = join_facts(counts, pair.select("w", "a", "g", "c"), ["g", "c"], ["number"], sizes).select("w", "a", "number", "n")
    axes = pair.select("a", "s", "c").distinct()
    known = join_facts(baseline, axes, ["s", "c"], ["number"], sizes).select("a", "number", "n")
    axis = _axis(values, known, pair)
    grids = choose_grids(axis.filter("edge IS NULL"), ["a"], "number", sizes.largest)
    known = with_cells(known, "number", grids)
    held = _held(known, grids) if grids else None
    marks = join_facts(_marks(axis, held, sizes, grids), pair.select("w", "size_p", "size_q", "low", "high"), ["w"], ["number"], sizes)
    steps = _steps(marks.filter("edge IS NULL"))
    crossing = (F.col("share") < F.col("f")) & (F.col("f") < F.col("share_end"))
    width, rise = F.col("next_value") - F.col("number"), F.col("area_end") - F.col("area")
    inside = F.when(F.col("next_value").isNotNull() & ~F.coalesce(crossing, F.lit(False)), F.abs(F.col("f") * width - rise))
    crossed = _crossed_areas(materialize(steps.filter(crossing), "crossings"), known, held, sizes, grids)
    binned = steps.groupBy("w", bin_of(F.col("number"), F.col("low"), F.col("high")).alias("cell")).agg(
        F.sum("p").alias("p"),
        F.max("apart").alias("ks"),
        F.sum(inside).alias("inside"),
        # One row is first and one is last; plain sums keep the aggregation on hashes.
        F.sum(F.when(F.col("is_first"), F.col("area"))).alias("first_area"),
        F.sum(F.when(F.col("next_value").isNull(), F.col("number"))).alias("last"),
        F.sum(F.when(F.col("next_value").isNull(), F.col("area"))).alias("last_area"),
    )
    parts = binned.unionByName(_baseline_bins(marks, pair), allowMissingColumns=True).unionByName(crossed, allowMissingColumns=True)
    parts = parts.join(pair.select("w", "g", "c"), "w").drop("w")
    parts = parts.unionByName(_cells_off_the_axis(counts, baseline, odd, odd_baseline, sides, sizes), allowMissingColumns=True)
    cells = parts.groupBy("g", "c", "cell").agg(
        F.sum(F.coalesce("p", F.lit(0))).alias("p"),
        F.sum(F.coalesce("q", F.lit(0))).alias("q"),
        F.max("ks").alias("ks"),
        *[F.sum(name).alias(name) for name in _WALK],
    )
    moments = baseline.groupBy("s", "c").agg(F.sum(F.col("number") * F.col("n")).alias("moment"))
    facts = sides.join(moments, ["s", "c"], "left").select("g", "c", "size_p", "size_q", "finite_q", "moment")
    whole = cells.join(facts, ["g", "c"]).withColumn("is_number", F.lit(True))
    used = (F.col("p") > 0) | (F.col("q") > 0)
    scores = whole.filter(used).groupBy("g", "c").agg(
        *_share_scores(),
        F.max("ks").alias("ks"),
        *[F.sum(F.coalesce(name, F.lit(0.0)) if name == "inside" else F.col(name)).alias(name) for name in _WALK],
        F.max(F.try_divide("moment", "finite_q")).alias("mean_q"),
    )
    # Left of the first value F is zero, right of the last one it is one: there the areas below and above G remain.
    right = F.greatest(F.col("mean_q") - F.col("last") + F.col("last_area"), F.lit(0.0))
    return scores.withColumn("wd", F.col("inside") + F.col("first_area") + right)


_AT_BASELINE = ("q_upto", "q_here", "m_upto")


def _held(known: DataFrame, grids: tuple[float, ...]) -> DataFrame:
    """What the baseline holds in each cell of an axis, written once."""
    return materialize(
        known.groupBy("a", cell_name(grids)).agg(
            F.sum("n").alias("q"), F.sum(F.col("n") * F.col("number")).alias("m"), F.min("number").alias("number")
        ),
        "held",
    )


def _marks(axis: DataFrame, held: DataFrame | None, sizes: Sizes, grids: tuple[float, ...]) -> DataFrame:
    """Rows (w, a, number, p, edge, p_upto, next_value, and the totals of the baseline at both): the values of the windows
    and the inner bin edges. One shuffle by cells of the axis serves the totals along it and inside each window.
    """
    cell = cell_name(grids)
    spread = dealt(with_cells(axis, "number", grids), ["a", cell], sizes.rows)
    # The baseline has a value once, and no window number: it comes before the windows' rows of that value.
    upto = Window.partitionBy("a", cell).orderBy("number", "w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_known = F.col("w").isNull()
    line = spread.select(
        "w",
        "a",
        cell,
        "number",
        "p",
        "edge",
        F.col("edge").isNotNull().alias("is_edge"),
        F.sum("q").over(upto).alias("q_upto"),
        F.sum(F.col("q") * F.col("number")).over(upto).alias("m_upto"),
        F.max(F.when(of_known, F.col("number"))).over(upto).alias("__at"),
        F.last(F.when(of_known, F.col("q")), True).over(upto).alias("__there"),
    )
    here = F.when(F.col("__at") == F.col("number"), F.col("__there")).otherwise(F.lit(0)).alias("q_here")
    line = line.filter("w IS NOT NULL").select("*", here).drop("__at", "__there")
    own = ["a", cell, "w", "is_edge"]
    local = running_totals(line, own, "number", ["p"], (), carry=_AT_BASELINE)
    order = Window.partitionBy(*own).orderBy("number")
    local = materialize(local.withColumn("__first", F.lag("number").over(order).isNull()), "marks")
    if not grids:
        return local.drop(cell, "__first")

    # What the baseline holds before a cell is asked for in cells of windows too.
    nothing = [F.lit(0).cast("bigint").alias("q"), F.lit(0.0).alias("m"), F.min("number").alias("number")]
    asked = local.groupBy("a", cell).agg(*nothing)
    before, count = cells_before(held.unionByName(asked), ["a"], "number", ["q", "m"], grids)
    before = before.drop("__next_value")
    whole = local.join(few(before, count), ["a", cell])
    far = {"q_upto": F.col("__q_before"), "m_upto": F.col("__m_before")}
    whole = whole.withColumns(
        {
            **{name: F.col(name) + by for name, by in far.items()},
            **{f"next_{name}": F.col(f"next_{name}") + by for name, by in far.items()},
        }
    ).drop(*[name for name in before.columns if name.startswith("__") and name != cell])
    values = whole.filter("edge IS NULL")
    behind, count = cells_before(values, ["w"], "number", ["p"], grids, _AT_BASELINE)
    last = F.col("next_value").isNull()
    joined = values.join(few(behind, count), ["w", cell]).withColumns(
        {
            "p_upto": F.col("p_upto") + F.col("__p_before"),
            **{f"next_{n}": F.when(last, F.col(f"__next_{n}")).otherwise(F.col(f"next_{n}")) for n in ("value", *_AT_BASELINE)},
        }
    )
    return joined.select(*whole.columns).unionByName(whole.filter("edge IS NOT NULL")).drop(cell, "__first")


def _steps(values: DataFrame) -> DataFrame:
    """Both shares at each value of a window, and what the baseline does up to the next value of the window.

    Both step functions meet at the window's values: F is flat between two of them, G can only rise.
    """
    size_p, size_q = F.col("size_p"), F.col("size_q")

    def area(at: str, count: str, moment: str) -> Column:
        return (F.col(at) * F.col(count) - F.col(moment)) / size_q

    f, share = F.col("p_upto") / size_p, F.col("q_upto") / size_q
    f_before = (F.col("p_upto") - F.col("p")) / size_p
    share_before = (F.col("q_upto") - F.col("q_here")) / size_q
    return values.select(
        "w",
        "a",
        "number",
        "next_value",
        "low",
        "high",
        "p",
        "size_q",
        (F.col("p_upto") == F.col("p")).alias("is_first"),
        f.alias("f"),
        share.alias("share"),
        ((F.col("next_q_upto") - F.col("next_q_here")) / size_q).alias("share_end"),
        area("number", "q_upto", "m_upto").alias("area"),
        area("next_value", "next_q_upto", "next_m_upto").alias("area_end"),
        F.greatest(F.abs(f - share), F.abs(f_before - share_before)).alias("apart"),
    )


def _baseline_bins(marks: DataFrame, pair: DataFrame) -> DataFrame:
    """Baseline counts per bin: the count below an inner edge closes one bin and opens the next."""
    below = F.col("q_upto") - F.col("q_here")
    closes = F.struct((F.col("edge") - 1).alias("cell"), below.alias("q"))
    opens = F.struct(F.col("edge").alias("cell"), (-below).alias("q"))
    moved = marks.filter("edge IS NOT NULL").select("w", F.inline(F.array(closes, opens)))
    last = F.when(F.col("low") < F.col("high"), BINS - 1).otherwise(0)
    return moved.unionByName(pair.select("w", last.alias("cell"), F.col("size_q").alias("q")))


def _crossed_areas(steps: DataFrame, known: DataFrame, held: DataFrame | None, sizes: Sizes, grids: tuple[float, ...]) -> DataFrame:
    """Rows (w, cell, inside): the area between both shares from values of a window to the next one, where the baseline
    starts below the window's share and ends above it. It is cut where the baseline first reaches the level f.

    Levels meet the baseline's running counts in the cell of the axis that holds the crossing. A cell gets a level per value of a
    window in it, and one more per window at most.
    """
    bin_number = bin_of(F.col("number"), F.col("low"), F.col("high")).alias("bin")
    level = (F.col("f") * F.col("size_q")).alias("level")
    asked = steps.select("w", "a", level, "number", F.col("next_value").alias("until"), "size_q", "f", "area", "area_end", bin_number)
    cell = cell_name(grids)
    if grids:
        asked = cells_reached(asked, held, ["a"], "level", "number", ["q", "m"], grids)
    else:
        asked = asked.withColumns({cell: F.lit(0).cast("bigint"), "__q_before": F.lit(0).cast("bigint"), "__m_before": F.lit(0.0)})
    asked = asked.withColumn("level", F.col("level") - F.col("__q_before"))
    line = known.select("a", cell, F.col("number").alias("at"), "n").unionByName(asked, allowMissingColumns=True)
    line = dealt(line, ["a", cell], sizes.rows)
    upto = Window.partitionBy("a", cell).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = line.withColumns({"n_upto": F.sum("n").over(upto), "m_upto": F.sum(F.col("n") * F.col("at")).over(upto)})
    counted = counted.withColumn("level", F.coalesce("level", F.col("n_upto").cast("double")))
    # From above, so that the last value met by a level is the first one that reaches it.
    above = Window.partitionBy("a", cell).orderBy(F.desc("level"), F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.struct(
        "at", (F.col("n_upto") - F.col("n")).alias("n_before"), (F.col("m_upto") - F.col("n") * F.col("at")).alias("m_before")
    )
    hit = counted.withColumn("met", F.last(F.when(F.col("at").isNotNull(), reached), True).over(above)).filter("w IS NOT NULL")
    cross_at = F.col("met.at")
    held_before, moment = F.col("__q_before") + F.col("met.n_before"), F.col("__m_before") + F.col("met.m_before")
    cross_area = (cross_at * held_before - moment) / F.col("size_q")
    before, after = cross_at - F.col("number"), F.col("until") - cross_at
    split = (
        F.col("f") * before - (cross_area - F.col("area")) + (F.col("area_end") - cross_area) - F.col("f") * after
    )
    return hit.groupBy("w", F.col("bin").alias("cell")).agg(F.sum(split).alias("inside"))


def _baseline_scores(counts: DataFrame, baseline: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, DataFrame]:
    """All groups and columns to report, and their scores."""
    known = _usable(baseline).withColumn("s", F.expr(_SLICE))
    values = _usable(counts).withColumn("s", F.expr(_SLICE))
    facts = materialize(group_facts(counts), "facts")
    base_facts = group_facts(baseline)
    every = facts.filter(F.col("c") == ALL_ROWS).select("g")
    every = every.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(len(fields) - 1))))
    now = facts.select("g", F.expr(_SLICE).alias("s"), "c", *[F.col(name).alias(f"{name}_p") for name in _FACTS])
    then = base_facts.select(F.expr(_SLICE).alias("s"), "c", *[F.col(name).alias(f"{name}_q") for name in _FACTS])
    sides = now.filter(F.col("c") != ALL_ROWS).join(then, ["s", "c"]).filter("size_p > 0 AND size_q > 0")
    full = materialize(
        sides.select(
            F.monotonically_increasing_id().alias("w"),
            "g",
            "s",
            "c",
            "size_p",
            "size_q",
            "finite_p",
            "finite_q",
            "values_p",
            "values_q",
            F.least("low_p", "low_q").alias("low"),
            F.greatest("high_p", "high_q").alias("high"),
        ),
        "sides",
    )
    # One axis per slice and column carries the values of all its windows and of the baseline.
    values_of_axis = (F.sum("values_p") + F.max("values_q")).alias("values")
    axes = full.groupBy("s", "c").agg(F.min("w").alias("a"), values_of_axis, F.count("*").alias("pairs"))
    axes = materialize(axes, "axes")
    measured = axes.agg(F.sum("pairs").alias("groups"), F.max("values").alias("largest"), F.sum("values").alias("rows")).first()
    sizes = Sizes(measured.groups or 0, measured.largest or 0, measured.rows or 0)
    full = full.join(few(axes.select("s", "c", "a"), sizes.groups), ["s", "c"])

    def numbers(df: DataFrame, *keys: str) -> DataFrame:
        found = df.filter("number IS NOT NULL").select(*keys, "c", "number", "n")
        if not any(keeps_text(f) for f in fields):
            return found
        return found.groupBy(*keys, "c", "number").agg(F.sum("n").alias("n"))

    scores = None
    # By the column's type: two sides of NaN alone have no range, but are alike.
    of_numbers = F.col("c").isin([i for i, field in enumerate(fields) if is_number(field)])
    if any(is_category(f) for f in fields):
        texts = full.filter(~of_numbers)
        found = _category_baseline_scores(values.filter("number IS NULL"), known.filter("number IS NULL"), texts, sizes)
        scores = _complete(found)
    if any(is_number(f) for f in fields):
        figures = full.filter(of_numbers)
        odd, odd_baseline = (side.filter("number IS NULL").filter(of_numbers) for side in (values, known))
        found = _complete(
            _number_baseline_scores(numbers(values, "g"), numbers(known, "s"), figures, sizes, odd, odd_baseline)
        )
        scores = found if scores is None else scores.unionByName(found)
    return every, scores


def _complete(scores: DataFrame) -> DataFrame:
    absent = {name: F.lit(None).cast("double") for name in _SCORES if name not in scores.columns}
    return scores.withColumns(absent).select("g", "c", *_SCORES)


# --- public -------------------------------------------------------------------------------------------------------


def metric_rows(
    every: DataFrame, scores: DataFrame, monitor: Monitor, fields: list[T.StructField], drift_type: str
) -> DataFrame:
    of_categories = F.col("c").isin([i for i, field in enumerate(fields) if is_category(field)])
    rows = every.join(scores, ["g", "c"], "left").withColumn("chi", F.when(of_categories, F.col("chi")))
    return rows.select(
        *group_columns(monitor),
        F.lit(drift_type).alias("drift_type"),
        name_at(F.col("c"), tuple(f.name for f in fields)).alias("column_name"),
        F.col("js").alias("js_distance"),
        F.struct(F.col("ks").alias("statistic")).alias("ks_test"),
        F.col("wd").alias("wasserstein_distance"),
        F.struct(F.col("chi").alias("statistic")).alias("chi_squared_test"),
        F.col("psi").alias("population_stability_index"),
    ).select(*[f.name for f in DRIFT_METRICS])


def stored_counts(df: DataFrame, monitor: Monitor, fields: list[T.StructField]) -> DataFrame:
    """The value counts of the given columns, written once for all comparisons of a table."""
    return materialize(value_counts(df, monitor, fields), "counts")


def consecutive_drift(
    df: DataFrame, monitor: Monitor, counts: DataFrame | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Every window against the previous non-empty window of its granularity and slice. ``counts`` are those that
    ``stored_counts`` made of the same columns; ``pairs`` (g, before) compares just these windows.
    """
    fields = drift_fields(df, monitor)
    if not fields:
        return empty(df.sparkSession, DRIFT_METRICS)
    counts = counts or stored_counts(df, monitor, fields)
    every, scores = _consecutive_scores(counts, len(fields), pairs)
    return metric_rows(every, scores, monitor, fields, "CONSECUTIVE")


def shared_with_baseline(monitor: Monitor, baseline: DataFrame) -> Monitor:
    """The monitor with the slices that the baseline has too."""
    present = {name.lower() for name in baseline.columns}
    model = monitor.model_id_column
    return replace(
        monitor,
        slices=tuple(name for name in monitor.slices if name.lower() in present),
        model_id_column=model if model and model.lower() in present else None,
    )


def compared_fields(df: DataFrame, baseline: DataFrame, monitor: Monitor) -> list[T.StructField]:
    """The columns of a baseline comparison: those both tables have."""
    present = {name.lower() for name in baseline.columns}
    return [f for f in drift_fields(df, monitor) if f.name.lower() in present]


def baseline_counts(baseline: DataFrame, monitor: Monitor, fields: list[T.StructField]) -> DataFrame:
    """The value counts of a baseline in the given columns of the monitored table, by slice."""
    by_name = {f.name.lower(): f for f in baseline.schema}
    still = Monitor(monitor.table, "SNAPSHOT", granularities=(), slices=monitor.slice_columns)
    return value_counts(baseline, still, [by_name[f.name.lower()] for f in fields])


def baseline_drift(
    df: DataFrame, baseline: DataFrame, monitor: Monitor, counts: DataFrame | None = None, known: DataFrame | None = None
) -> DataFrame:
    """Every window against the whole baseline table, slice by slice, in the columns and slices both have.

    ``counts`` are those that ``stored_counts`` made of the same columns and slices, ``known`` those of ``baseline_counts``.
    """
    monitor = shared_with_baseline(monitor, baseline)
    fields = compared_fields(df, baseline, monitor)
    if not fields:
        return empty(df.sparkSession, DRIFT_METRICS)
    counts = counts or stored_counts(df, monitor, fields)
    known = known or materialize(baseline_counts(baseline, monitor, fields), "baseline-counts")
    every, scores = _baseline_scores(counts, known, fields)
    return metric_rows(every, scores, monitor, fields, "BASELINE")


def counted_drift(counts: DataFrame, known: DataFrame, monitor: Monitor, fields: list[T.StructField]) -> DataFrame:
    """D4 without the old rows: value counts of a snapshot against those kept of the snapshot before it, in ``fields``."""
    every, scores = _baseline_scores(counts, known, fields)
    return metric_rows(every, scores, monitor, fields, "CONSECUTIVE")


def snapshot_drift(df: DataFrame, previous: DataFrame, monitor: Monitor) -> DataFrame:
    """A snapshot against the snapshot before it, handed in as a second frame."""
    rows = baseline_drift(df, previous, monitor)
    return rows.withColumn("drift_type", F.lit("CONSECUTIVE"))
