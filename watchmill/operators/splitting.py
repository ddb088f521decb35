"""Aggregate expressions taken apart into partial aggregates, their merges and a finishing expression.

``sum(a * b) / count(*)`` becomes sum(a * b) and count(1) per base window; merged by sums, they give any wider window or slice,
and the division is done last. Spark's own parser reads the text; an expression that holds anything else is left whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[str], Column]


def _sum_or_zero(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


#: Aggregates that merge by themselves: how their partial results are put together.
_MERGES: dict[str, Merge] = {
    "sum": F.sum,
    "count": _sum_or_zero,
    "count_if": _sum_or_zero,
    "min": F.min,
    "max": F.max,
    "bool_and": F.bool_and,
    "every": F.bool_and,
    "bool_or": F.bool_or,
    "some": F.bool_or,
    "any": F.bool_or,
}
_MEANS = ("avg", "mean")


@dataclass(frozen=True)
class Split:
    """Partial aggregates by name, with their merges, and the expression over the merged ones."""

    partials: dict[str, tuple[str, Merge]]
    finish: str


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _children(node) -> list:
    found = node.children()
    return [found.apply(i) for i in range(found.size())]


def _nodes(node) -> Iterator:
    yield node
    for child in _children(node):
        yield from _nodes(child)


def _called(node) -> str | None:
    """The name of a plainly called function; of anything else nothing."""
    if _kind(node) != "UnresolvedFunction" or node.nameParts().size() != 1:
        return None
    return node.nameParts().apply(0).lower()


def _outermost(node) -> Iterator:
    if _called(node) in (*_MERGES, *_MEANS):
        yield node
        return
    for child in _children(node):
        yield from _outermost(child)


def _left_whole(tree) -> bool:
    """DISTINCT, FILTER and orders inside a group are lost when the tree is written as text again."""
    calls = [node for node in _nodes(tree) if _kind(node) == "UnresolvedFunction"]
    return any(c.isDistinct() or c.filter().isDefined() or c.ignoreNulls() or c.orderingWithinGroup().size() for c in calls)


def split_aggregate(df: DataFrame, text: str, prefix: str) -> Split | None:
    """Take an aggregate expression over the columns of ``df`` apart; None if it does not consist of aggregates that merge.

    ``prefix`` starts the names of the partial aggregates.
    """
    parser = df.sparkSession._jsparkSession.sessionState().sqlParser()
    tree = parser.parseExpression(text)
    written = tree.sql()
    if _left_whole(tree) or any("Subquery" in _kind(n) or "Window" in _kind(n) for n in _nodes(tree)):
        return None
    found = {node.sql(): node for node in _outermost(tree)}
    literals = [node.sql() for node in _nodes(tree) if _kind(node) == "Literal"]
    if not found or any(call in literal for call in found for literal in literals):
        return None
    try:
        if parser.parseExpression(written).sql() != written:
            return None
        partials, finish = {}, written
        for i, call in enumerate(sorted(found, key=len, reverse=True)):
            name, node = f"{prefix}{i}", found[call]
            called, place = _called(node), f"`{prefix}{i}`"
            if any(_called(inner) in (*_MERGES, *_MEANS) for child in _children(node) for inner in _nodes(child)):
                return None
            if called in _MEANS:
                value = _children(node)[0].sql()
                kind = df.select(F.expr(value)).schema[0].dataType
                if not isinstance(kind, T.NumericType):
                    return None
                exact = isinstance(kind, T.DecimalType)
                partials[f"{name}s"] = (f"sum({value})" if exact else f"sum(CAST({value} AS DOUBLE))", F.sum)
                partials[f"{name}n"] = (f"count({value})", _sum_or_zero)
                place = f"try_divide(`{name}s`, `{name}n`)"
                if exact:
                    # The mean of decimals has four digits more than they have.
                    place = f"CAST({place} AS DECIMAL({min(kind.precision + 4, 38)}, {min(kind.scale + 4, 38)}))"
            else:
                partials[name] = (call, _MERGES[called])
            finish = finish.replace(call, place)
        names = {n.sql().strip("`") for n in _nodes(parser.parseExpression(finish)) if _kind(n) == "UnresolvedAttribute"}
    except Exception as error:
        # What the parser writes for some expressions it cannot read again.
        if "PARSE" not in str(error).upper():
            raise
        return None
    return Split(partials, finish) if names <= partials.keys() else None
