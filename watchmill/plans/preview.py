"""What a run would do, without doing it (J7 with T10, P15 and slice warnings)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchmill.operators.policy import missing_columns
from watchmill.operators.provisioning import MAX_MONITORS, planned_actions, within_quota


def preview(
    settings: DataFrame,
    inventory: DataFrame,
    desired: DataFrame,
    existing: DataFrame,
    fields: tuple[str, ...],
    profile_type: str,
    existing_monitors: int,
    order: list,
    limit: int = MAX_MONITORS,
) -> DataFrame:
    """Rows (full_name, action, reason): first the quota, then the configured columns, then the comparison."""
    quota = within_quota(settings.select("full_name", *_new(order)), existing_monitors, order, limit)
    absent = missing_columns(settings, inventory, profile_type).select(
        "full_name",
        F.concat("setting", F.lit(" names a missing column: "), "column_name").alias("missing"),
    )
    plan = planned_actions(desired, existing, fields).select("full_name", F.col("action").alias("planned"))
    rows = quota.select("full_name", "quota").join(absent, "full_name", "left").join(plan, "full_name", "left")
    over, lacks = F.col("quota") == "skip_quota", F.col("missing").isNotNull()
    reasons = {"update": "settings differ", "no_change": "settings agree"}
    reason = F.when(over, "over quota").when(lacks, F.col("missing"))
    for name, text in reasons.items():
        reason = reason.when(F.col("planned") == name, text)
    return rows.select(
        "full_name",
        F.when(over, "skip_quota").when(lacks, "skip_column_missing").otherwise(F.col("planned")).alias("action"),
        reason.otherwise("").alias("reason"),
    )


def _new(order: list) -> list:
    return [name for name in order if isinstance(name, str) and name != "full_name"]


def slice_warnings(settings: DataFrame, inventory: DataFrame) -> DataFrame:
    """Configured slice columns that a table does not have; rows (full_name, warning)."""
    wanted = settings.select("full_name", F.explode("slicing_exprs").alias("slice"))
    lower = F.transform("columns", lambda c: F.lower(c["name"]))
    joined = wanted.join(inventory.select("full_name", lower.alias("names")), "full_name")
    absent = joined.filter(~F.array_contains("names", F.lower(F.regexp_replace("slice", "^`|`$", ""))))
    return absent.select(
        "full_name", F.concat(F.lit("no such slice column: "), "slice").alias("warning")
    )
