"""Templated SQL expressions of custom metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchmill.settings import CustomMetric, RunSettings, resolve

# Variables a template may use besides its own input columns.
KNOWN_VARIABLES = ("input_column", "prediction_col", "label_col", "current_df", "base_df")
#: Variables that only make sense for logged predictions, and the setting each one needs.
INFERENCE_VARIABLES = {"prediction_col": "prediction_column", "label_col": "label_column"}

VARIABLE = r"\{\{\s*(\w+)\s*\}\}"


def variables_used(definition: Column) -> Column:
    """distinct variables of a definition, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(definition, F.lit(VARIABLE), F.lit(1))))


def unknown_variables(definition: Column, input_columns: Column) -> Column:
    """variables that are neither known nor input columns."""
    known = F.array(*[F.lit(name) for name in KNOWN_VARIABLES])
    return F.array_except(variables_used(definition), F.array_union(known, input_columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def render(definition: str, values: dict[str, str]) -> str:
    """Fill in the variables; an unknown one is an error."""

    def fill(match: re.Match) -> str:
        name = match.group(1)
        if name not in values:
            raise ValueError(f"template variable '{name}' is not available in: {definition}")
        return values[name]

    return re.sub(VARIABLE, fill, definition)


def template_problems(run: RunSettings) -> list[tuple[str, str, str]]:
    """(table, objective, reason) where an objective needs an inference log or a column that is not set."""
    found = []
    for table, own in run.monitored_tables.items():
        kind = own.profile_type or run.profile_defaults.profile_type
        for key in own.objective_function_ids or ():
            metric: CustomMetric = run.objective_functions[key].metric
            used = set(re.findall(VARIABLE, metric.definition)) & set(INFERENCE_VARIABLES)
            if used and kind != "INFERENCE":
                found.append((table, key, "needs_inference"))
                continue
            found += [
                (table, key, f"needs_{INFERENCE_VARIABLES[name]}")
                for name in sorted(used)
                if resolve(run, table, INFERENCE_VARIABLES[name]) is None
            ]
    return found
