"""Desired against existing monitors, quota, and what a run did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchmill.functions.naming import settings_hash

MAX_MONITORS = 100
# Settings that make up a monitor, and labels of the granularities.
CONTROLLED = (
    "baseline_table_name",
    "custom_metrics",
    "granularities",
    "label_column",
    "model_id_column",
    "output_schema_name",
    "prediction_column",
    "problem_type",
    "profile_type",
    "slicing_exprs",
    "timestamp_column",
)
GRANULARITY_LABELS = {
    "AGGREGATION_GRANULARITY_5_MINUTES": "5 minutes",
    "AGGREGATION_GRANULARITY_30_MINUTES": "30 minutes",
    "AGGREGATION_GRANULARITY_1_HOUR": "1 hour",
    "AGGREGATION_GRANULARITY_1_DAY": "1 day",
    "AGGREGATION_GRANULARITY_1_WEEK": "1 week",
    "AGGREGATION_GRANULARITY_2_WEEKS": "2 weeks",
    "AGGREGATION_GRANULARITY_3_WEEKS": "3 weeks",
    "AGGREGATION_GRANULARITY_4_WEEKS": "4 weeks",
    "AGGREGATION_GRANULARITY_1_MONTH": "1 month",
    "AGGREGATION_GRANULARITY_1_YEAR": "1 year",
}
SUCCESS = ("created", "updated", "no_change")


def granularity_labels(names: Column) -> Column:
    """F8: labels of enum names or labels, sorted; unknown names drop out, an empty list is NULL."""
    by_name = {**GRANULARITY_LABELS, **{label: label for label in GRANULARITY_LABELS.values()}}
    lookup = F.create_map(*[F.lit(part) for pair in by_name.items() for part in pair])
    labels = F.array_sort(F.array_compact(F.transform(names, lambda name: F.try_element_at(lookup, name))))
    return F.when(F.size(labels) > 0, labels)


def slice_names(names: Column) -> Column:
    """Slice columns without quotes; an empty list is NULL."""
    plain = F.transform(names, lambda name: F.regexp_replace(name, "^`|`$", ""))
    return F.when(F.size(plain) > 0, plain)


def monitor_hash(df: DataFrame) -> Column:
    """hash of the controlled settings a frame has, in alphabetical order."""
    return settings_hash(F.struct(*[F.col(name) for name in CONTROLLED if name in df.columns]))


def planned_actions(desired: DataFrame, existing: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Create, update or no_change per desired table, with the fields that differ (old, new).

    Both frames hold full_name and the fields, normalised by ``granularity_labels`` and ``slice_names``.
    """
    old = existing.select("full_name", F.lit(True).alias("known"), *[F.col(f).alias(f"old_{f}") for f in fields])
    joined = desired.join(old, "full_name", "left")

    def text(column: str) -> Column:
        return F.to_json(F.struct(F.col(column).alias("v")), {"ignoreNullFields": "false"})

    changes = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f).eqNullSafe(F.col(f"old_{f}")),
                    F.struct(F.lit(f).alias("field"), text(f"old_{f}").alias("existing"), text(f).alias("desired")),
                )
                for f in fields
            ]
        )
    )
    known = F.coalesce("known", F.lit(False))
    action = F.when(~known, "create").when(F.size("changes") > 0, "update").otherwise("no_change")
    return joined.withColumn("changes", F.when(known, changes).otherwise(F.slice(changes, 1, 0))).select(
        "full_name", action.alias("action"), "changes"
    )


def within_quota(tables: DataFrame, existing_monitors: int, order: list, limit: int = MAX_MONITORS) -> DataFrame:
    """The first tables in order up to the free quota; the others are marked skip_quota.

    The quota is a small number, so the first tables are found with a top-k and joined back; no window over all tables.
    """
    free = max(0, limit - existing_monitors)
    first = tables.orderBy(*order).limit(free).select("full_name", F.lit(True).alias("inside"))
    joined = tables.join(F.broadcast(first), "full_name", "left")
    return joined.withColumn("quota", F.when(F.col("inside"), "within").otherwise("skip_quota")).drop("inside")


def impact_summary(actions: DataFrame) -> DataFrame:
    """How many tables each planned action concerns."""
    names = ("create", "update", "no_change", "skip_quota", "skip_column_missing", "skip_cardinality")
    return actions.agg(*[F.count_if(F.col("action") == name).alias(name) for name in names], F.count("*").alias("total"))


def run_summary(results: DataFrame) -> DataFrame:
    """What a run did."""
    action = F.col("action")
    return results.agg(
        F.count("*").alias("tables_discovered"),
        F.count_if(action == "created").alias("monitors_created"),
        F.count_if(action == "updated").alias("monitors_updated"),
        F.count_if(action == "no_change").alias("monitors_unchanged"),
        F.count_if(F.contains(action, F.lit("skipped"))).alias("monitors_skipped"),
        F.count_if(action == "failed").alias("monitors_failed"),
    )


def usable_tables(tables: DataFrame, results: DataFrame) -> DataFrame:
    """Tables whose monitor exists after the run."""
    done = results.filter(F.col("action").isin(*SUCCESS)).select("full_name")
    return tables.join(done, "full_name", "left_semi")


def active_groups(plan: DataFrame, usable: DataFrame) -> DataFrame:
    """Groups that have a usable table, with the number of those."""
    kept = plan.join(usable.select("full_name"), "full_name", "left_semi")
    return kept.groupBy("group_name", "group_slug").agg(F.count("*").alias("tables"))


def report_rows(actions: DataFrame, limit: int | None = None) -> DataFrame:
    """Report lines by table; ``limit`` gives the short list for display."""
    ordered = actions.orderBy("full_name")
    return ordered if limit is None else ordered.limit(limit)
