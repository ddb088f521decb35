"""Running totals over ordered values, without ever sorting one group in one task.

A window partitioned by the group alone would put a group that holds a third of all rows on one executor. Here the
value axis is cut into cells on a logarithmic grid that does not depend on the data: a cell of the fine grid holds at
most 2**26 different doubles, a cell of the coarse grid at most 2**18 fine cells, and there are about a million coarse
cells in all. Totals run inside each cell, then over the cells of a coarser cell, then over the coarse cells, so every
window partition has a fixed bound and a re-run task sees the same cells. Where a measured grid cuts all groups into
cells of an ordinary size, that one grid does, and rows are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from watchmill.sources.scratch import materialize

#: Cells per octave, finest first.
GRIDS = (2.0**26, 2.0**8)
#: Grids that may do alone, from the coarsest to the coarser one of the two above; each cell is made of whole finer cells.
_ALONE = (1.0, 2.0**2, 2.0**4, 2.0**6, 2.0**8)
#: Finer ones that may do alone where those do not, if a group has an ordinary number of cells too.
_FINER = (2.0**10, 2.0**12)
#: Up to this many values one window partition is an ordinary size, and the grids are not needed.
PLAIN_WINDOW = 100_000
#: Rows that one task is meant to sort. Shuffles of many rows get as many tasks as that takes, so a task's memory does not
#: grow with the table.
TASK_ROWS = 150_000
#: Up to this many rows (about 200 bytes each) the facts per group are broadcast.
BROADCAST_ROWS = 200_000
#: Keeps the logarithm of the smallest subnormal double (2**-1074) positive.
_SHIFT = 1100.0


def grid_cell(value: Column, per_octave: float) -> Column:
    """Number of the cell; never decreases when the value grows."""
    scaled = F.floor((F.log2(F.abs(value)) + F.lit(_SHIFT)) * F.lit(per_octave))
    return F.when(value > 0, scaled).when(value < 0, -scaled).otherwise(F.lit(0).cast("bigint"))


def choose_grids(rows: DataFrame, keys: list[str], value: str, largest: int) -> tuple[float, ...]:
    """The grids that cut groups of up to ``largest`` rows into cells of an ordinary size: none, one that is measured to do so,
    or both of GRIDS where values crowd. A handful of numbers reaches the driver.
    """
    if largest <= PLAIN_WINDOW:
        return ()
    for tried in (_ALONE, _FINER):
        found = _measured_cells(rows, keys, value, tried)
        # The coarser ones make no more cells than GRIDS have coarse cells.
        fits = [r.grid for r in found if r.most <= PLAIN_WINDOW and (tried is _ALONE or r.cells <= PLAIN_WINDOW)]
        if fits:
            return (min(fits),)
    return GRIDS


def _measured_cells(rows: DataFrame, keys: list[str], value: str, grids: tuple[float, ...]) -> list[Row]:
    """The most rows of a cell and the most cells of a group, a row per grid."""
    fine = rows.groupBy(*keys, grid_cell(F.col(value), grids[-1]).alias("cell")).agg(F.count("*").alias("n"))
    places = [
        F.struct(F.lit(grid).alias("grid"), (F.signum("cell") * F.floor(F.abs("cell") / F.lit(grids[-1] / grid))).alias("at"))
        for grid in grids
    ]
    cells = fine.select(*keys, "n", F.inline(F.array(*places))).groupBy(*keys, "grid", "at").agg(F.sum("n").alias("n"))
    groups = cells.groupBy(*keys, "grid").agg(F.max("n").alias("most"), F.count("*").alias("cells"))
    return groups.groupBy("grid").agg(F.max("most").alias("most"), F.max("cells").alias("cells")).collect()


def cell_name(grids: tuple[float, ...]) -> str:
    return f"__cell{len(grids)}"


def with_cells(df: DataFrame, value: str, grids: tuple[float, ...]) -> DataFrame:
    """Add the cell of the finest grid; without grids all rows are in cell 0."""
    return df.withColumn(cell_name(grids), grid_cell(F.col(value), grids[0]) if grids else F.lit(0).cast("bigint"))


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Shuffle ``rows`` rows by keys into tasks of an ordinary size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-rows // TASK_ROWS), min(cores, -(-rows // 10_000)), 1), *keys)


def placed(df: DataFrame, keys: list[str], value: str, grids: tuple[float, ...], rows: int) -> DataFrame:
    """Shuffle ``rows`` rows to where ``running_totals`` needs them."""
    return dealt(with_cells(df, value, grids), [*keys, cell_name(grids)], rows) if grids else dealt(df, keys, rows)


def few(df: DataFrame, count: int) -> DataFrame:
    """The frame, marked for a broadcast if its measured number of rows is small."""
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def running_totals(
    df: DataFrame,
    keys: list[str],
    value: str,
    sums: list[str],
    grids: tuple[float, ...] = GRIDS,
    *,
    here: tuple[str, ...] = (),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Add running facts of each group, ordered by ``value``:

    ``<sum>_upto``, the total over all rows with a value <= this one; ``<name>_here`` for the names in ``here``, the
    total over the rows with exactly this value; ``next_value``, the following value, and ``next_<name>`` for the names
    in ``carry``, all NULL at the end (meant for rows that are unique by value).

    With grids the totals inside the cells are written once; a frame that was ``placed`` is not shuffled again.
    """
    followed = F.struct(F.col(value).alias("value"), *carry)
    if not grids:
        order = Window.partitionBy(*keys).orderBy(value)
        upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        equal = order.rangeBetween(Window.currentRow, Window.currentRow)
        found = df.select(
            "*",
            *[F.sum(name).over(upto).alias(f"{name}_upto") for name in sums],
            *[F.sum(name).over(equal).alias(f"{name}_here") for name in here],
            F.lead(followed).over(order).alias("__next"),
        )
        return _unpack_next(found, carry)

    cell = cell_name(grids)
    rows = df if cell in df.columns else with_cells(df, value, grids)
    order = Window.partitionBy(*keys, cell).orderBy(value)
    inside = running_totals(rows, [*keys, cell], value, sums, (), here=here, carry=carry)
    inside = materialize(inside.withColumn("__first", F.lag(value).over(order).isNull()), "cells")
    before, count = cells_before(inside, keys, value, sums, grids, carry)
    joined = inside.join(few(before, count), [*keys, cell])
    added = {f"{name}_upto": F.col(f"{name}_upto") + F.col(f"__{name}_before") for name in sums}
    # The last value of a cell is followed by the first one of the next cell.
    last = F.col("next_value").isNull()
    for name in ("value", *carry):
        added[f"next_{name}"] = F.when(last, F.col(f"__next_{name}")).otherwise(F.col(f"next_{name}"))
    return joined.withColumns(added).drop(cell, "__first", *before.columns[len(keys) + 1 :])


def cells_before(
    inside: DataFrame, keys: list[str], value: str, sums: list[str], grids: tuple[float, ...], carry: tuple[str, ...] = ()
) -> tuple[DataFrame, int]:
    """Rows (keys, cell, __<sum>_before, __next_value, __next_<carry>) and their number: totals of the cells before each cell,
    and the first row after it. ``__first`` marks the first row of a cell.
    """
    cell = cell_name(grids)
    first = [F.max(F.when(F.col("__first"), F.col(name))).alias(f"__of_{name}") for name in carry]
    cells = inside.groupBy(*keys, cell).agg(F.min(value).alias("__at"), *first, *[F.sum(name).alias(name) for name in sums])
    cells = materialize(cells, "cell-totals")
    totals = running_totals(cells, keys, "__at", sums, grids[1:], carry=tuple(f"__of_{name}" for name in carry))
    before = totals.select(
        *keys,
        cell,
        *[(F.col(f"{name}_upto") - F.col(name)).alias(f"__{name}_before") for name in sums],
        F.col("next_value").alias("__next_value"),
        *[F.col(f"next___of_{name}").alias(f"__next_{name}") for name in carry],
    )
    return before, cells.count()


def cells_reached(
    asked: DataFrame, held: DataFrame, keys: list[str], level: str, value: str, sums: list[str], grids: tuple[float, ...]
) -> DataFrame:
    """Add to the rows of ``asked`` the cell in which the running total of the first of ``sums`` first reaches their level, and
    __<sum>_before, the totals of the cells before that one. ``held`` has the totals of the cells, all of them above zero.

    Cells are laid out by the totals before them; the number of cells strictly below a level names the one that reaches it.
    """
    cell = cell_name(grids)
    before, count = cells_before(held, keys, value, sums, grids)
    kept = [f"__{name}_before" for name in sums]
    place, one = F.struct(F.col(cell).alias(cell), *kept).alias("__place"), F.lit(1).cast("bigint").alias("__one")
    starts = before.select(*keys, F.col(kept[0]).cast("double").alias(level), place, one)
    line = starts.unionByName(asked.withColumn("__one", F.lit(0).cast("bigint")), allowMissingColumns=True)
    rows = count + asked.count()
    levels = choose_grids(line, keys, level, rows)
    line = running_totals(placed(line, keys, level, levels, rows), keys, level, ["__one"], levels, here=("__one",))
    is_cell = F.col("__place").isNotNull()
    cells = line.filter(is_cell).select(*keys, F.col("__one_upto").alias("__rank"), "__place")
    ranked = line.filter(~is_cell).select(*asked.columns, (F.col("__one_upto") - F.col("__one_here")).alias("__rank"))
    return ranked.join(few(cells, count), [*keys, "__rank"]).select(*asked.columns, "__place.*")


def _unpack_next(df: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    fields = {"next_value": F.col("__next.value"), **{f"next_{name}": F.col(f"__next.{name}") for name in carry}}
    return df.withColumns(fields).drop("__next")


@dataclass(frozen=True)
class Sizes:
    """Measured sizes that choose the physical form of the next steps."""

    groups: int
    largest: int
    rows: int = 0

    @classmethod
    def of(cls, facts: DataFrame, values: str = "values") -> "Sizes":
        """Number of rows of a facts table, the largest ``values`` in it and their sum; one row reaches the driver."""
        sums = [F.count("*").alias("groups"), F.max(values).alias("largest"), F.sum(values).alias("rows")]
        row = facts.agg(*sums).first()
        return cls(row.groups, row.largest or 0, row.rows or 0)


def join_facts(
    rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], sizes: Sizes, salts: int = 64
) -> DataFrame:
    """Inner join of many rows to a few facts per group.

    A facts table of measured, small size is broadcast, so the rows are not shuffled at all. Beyond that the facts are
    copied once per salt, which spreads the rows of a hot group over as many tasks.
    """
    if sizes.groups <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), keys)
    salt = "__salt"
    copies = facts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, salt]).drop(salt)


def total(columns: list[Column]) -> Column:
    """Sum of several columns."""
    return reduce(lambda left, right: left + right, columns)
