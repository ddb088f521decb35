"""Rule checks that report violations as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchmill.functions.naming import anchored
from watchmill.settings import GRANULARITIES, PolicySettings

_NO_TABLE = ""


def _violations(rows: DataFrame, check: str, message: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.col("full_name").alias("table"), message.alias("message"))


def naming_violations(tables: DataFrame, policy: PolicySettings) -> list[DataFrame]:
    """Names that miss a required pattern or match a forbidden one; patterns apply from the start of the name."""
    name = F.col("full_name")
    missed = [
        _violations(
            tables.filter(~name.rlike(anchored(pattern))),
            "naming_pattern",
            F.lit(f"name misses the asked form: {pattern}"),
        )
        for pattern in policy.naming_patterns
    ]
    forbidden = [
        _violations(
            tables.filter(name.rlike(anchored(pattern))),
            "forbidden_pattern",
            F.lit(f"name has a banned form: {pattern}"),
        )
        for pattern in policy.forbidden_patterns
    ]
    return missed + forbidden


def requirement_violations(
    settings: DataFrame, policy: PolicySettings, profile_type: str, default_slices: tuple[str, ...]
) -> list[DataFrame]:
    """Missing baselines (inference only), missing slices, too many tables."""
    found = []
    if policy.require_baseline and profile_type == "INFERENCE":
        without = settings.filter(F.coalesce("baseline_table_name", F.lit("")) == "")
        found.append(
            _violations(without, "require_baseline", F.lit("no baseline is set"))
        )
    if policy.require_slicing and not default_slices:
        without = settings.filter(F.coalesce(F.size("slicing_exprs"), F.lit(0)) <= 0)
        found.append(_violations(without, "require_slicing", F.lit("no slice is set")))
    if policy.max_tables_per_config is not None:
        limit = policy.max_tables_per_config
        counted = settings.agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        message = F.format_string(f"tables: %d, limit: {limit}", "n")
        found.append(
            _violations(counted.withColumn("full_name", F.lit(_NO_TABLE)), "max_tables_per_config", message)
        )
    return found


def policy_violations(
    settings: DataFrame, policy: PolicySettings, profile_type: str, default_slices: tuple[str, ...] = ()
) -> DataFrame:
    """All violations of the configured tables."""
    parts = naming_violations(settings, policy) + requirement_violations(settings, policy, profile_type, default_slices)
    if not parts:
        return _violations(settings.filter(F.lit(False)), "", F.lit(""))
    return reduce(DataFrame.unionByName, parts)


def tag_violations(settings: DataFrame, tags: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """P25: required tags that are blank or missing in the tags and in the setting of the same name."""
    known = [name for name in required if name in settings.columns]
    pairs = [part for name in known for part in (F.lit(name), F.col(name).cast("string"))]
    own = F.create_map(*pairs) if known else F.create_map().cast("map<string,string>")
    asked = settings.select("full_name", own.alias("own"), F.explode(F.array(*[F.lit(n) for n in required])).alias("tag"))
    joined = asked.join(tags.select("full_name", "tags"), "full_name", "left")

    def filled(values: str) -> Column:
        return F.coalesce(F.length(F.btrim(F.col(values).getItem(F.col("tag")))) > 0, F.lit(False))

    missing = joined.filter(~filled("own") & ~filled("tags"))
    message = F.concat(F.lit("tag without a value: "), "tag")
    return _violations(missing, "required_tags", message)


#: Settings that name a column, by profile type.
CHECKED_COLUMNS = {
    "INFERENCE": ("prediction_column", "timestamp_column", "label_column", "model_id_column"),
    "TIMESERIES": ("timestamp_column",),
    "SNAPSHOT": (),
}


def missing_columns(settings: DataFrame, inventory: DataFrame, profile_type: str) -> DataFrame:
    """The first configured column of each table that its schema lacks, with the columns it has."""
    names = CHECKED_COLUMNS[profile_type]
    if not names:
        return settings.select(
            "full_name",
            F.lit("").alias("setting"),
            F.lit("").alias("column_name"),
            F.array().cast("array<string>").alias("available"),
        ).filter(F.lit(False))
    asked = F.array(*[F.struct(F.lit(n).alias("setting"), F.col(n).alias("column_name")) for n in names])
    wanted = settings.select("full_name", F.filter(asked, lambda a: a["column_name"].isNotNull()).alias("asked"))
    lower = F.transform("columns", lambda c: F.lower(c["name"]))
    joined = wanted.join(inventory.select("full_name", F.array_sort(lower).alias("available")), "full_name")
    absent = F.filter("asked", lambda a: ~F.array_contains(F.col("available"), F.lower(a["column_name"])))
    first = joined.withColumn("missing", F.get(absent, F.lit(0))).filter("missing IS NOT NULL")
    return first.select(
        "full_name",
        F.col("missing.setting").alias("setting"),
        F.col("missing.column_name").alias("column_name"),
        "available",
    )


def settings_violations(settings: DataFrame, catalog: str) -> DataFrame:
    """P27 over rows (full_name, profile_type, output_schema_name, granularity, prediction_column, timestamp_column)."""
    parts = F.split("full_name", r"\.")
    kind = F.col("profile_type")
    rules = {
        "output_schema_name": F.contains("output_schema_name", F.lit(".")),
        "timeseries_timestamp": (kind == "TIMESERIES") & F.col("timestamp_column").isNull(),
        "inference_prediction": (kind == "INFERENCE") & F.col("prediction_column").isNull(),
        "inference_timestamp": (kind == "INFERENCE") & F.col("timestamp_column").isNull(),
        "three_level_name": F.size(parts) != 3,
        "catalog": (F.size(parts) == 3) & (F.get(parts, F.lit(0)) != catalog),
        "granularity": ~F.col("granularity").isin(*GRANULARITIES),
    }
    broken = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return settings.select("full_name", F.explode(F.array_compact(broken)).alias("rule"))
