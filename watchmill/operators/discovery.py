"""Which tables to monitor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchmill.functions.naming import (
    DEFAULT_GROUP,
    full_name_slug,
    glob_match,
    group_slug,
    leaf_name,
)
from watchmill.settings import DiscoverySettings
from watchmill.sources.sinks import VIEW_PREFIXES

# Table types that can be monitored, and names that mark a key column.
SUPPORTED_TYPES = ("MANAGED", "EXTERNAL", "VIEW", "MATERIALIZED_VIEW", "STREAMING_TABLE")
KEY_NAMES = ("id", "pk", "primary_key", "row_id", "observation_id")
NOT_KEYS = ("model_id", "request_id")


def schema_selected(schema: Column, settings: DiscoverySettings) -> Column:
    """On the include list (if there is one) and not on the exclude list."""
    included = glob_match(schema, settings.include_schemas) if settings.include_schemas else F.lit(True)
    return included & ~glob_match(schema, settings.exclude_schemas)


def tags_match(tags: Column, required: dict[str, str]) -> Column:
    """P10: every required tag is there with its value."""
    match = F.lit(True)
    for key, value in required.items():
        match = match & F.coalesce(tags.getItem(key) == value, F.lit(False))
    return match


def supported_type(table_type: Column) -> Column:
    """P12"""
    return F.coalesce(table_type.isin(*SUPPORTED_TYPES), F.lit(False))


def has_key_column(columns: Column) -> Column:
    """A declared primary key, a usual key name, or a name that ends in _id."""

    def is_key(column: Column) -> Column:
        name = F.lower(column["name"])
        usual = name.isin(*KEY_NAMES) | (F.endswith(name, F.lit("_id")) & ~name.isin(*NOT_KEYS))
        return F.contains(F.lower(F.coalesce(column["constraint"], F.lit(""))), F.lit("primary")) | usual

    return F.exists(columns, is_key)


def discover(inventory: DataFrame, settings: DiscoverySettings) -> DataFrame:
    """The tables to monitor, most important first."""
    chosen = inventory.filter(
        schema_selected(F.col("schema_name"), settings)
        & tags_match(F.col("tags"), settings.include_tags)
        & supported_type(F.col("table_type"))
    )
    return chosen.orderBy("priority", "full_name")


def table_list(discovered: DataFrame, configured: DataFrame) -> DataFrame:
    """Discovered tables that are not configured, then all configured ones; ``origin`` tells which."""
    tagged = discovered.join(configured.select("full_name"), "full_name", "left_anti")
    return tagged.withColumn("origin", F.lit("tag")).unionByName(
        configured.withColumn("origin", F.lit("config")), allowMissingColumns=True
    )


def enrich(tables: DataFrame, settings: DataFrame) -> DataFrame:
    """P6 over rows: owner, runbook and lineage from the settings, else from the tags; department from the tags."""
    links = ["owner", "runbook_url", "lineage_url"]
    own = settings.select("full_name", *[F.col(name).alias(f"set_{name}") for name in links])
    joined = tables.join(own, "full_name", "left")

    def first(name: str, *rest: Column) -> Column:
        return F.coalesce(F.nullif(f"set_{name}", F.lit("")), F.col("tags").getItem(name), *rest)

    return joined.withColumns(
        {
            "owner": first("owner", F.lit("unknown")),
            "runbook_url": first("runbook_url"),
            "lineage_url": first("lineage_url"),
            "department": F.coalesce(F.col("tags").getItem("department"), F.lit("unknown")),
        }
    ).drop(*[f"set_{name}" for name in links])


def resolve_settings(tables: DataFrame, settings: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """J3 over rows: each setting of a table, else its default."""
    own = settings.select("full_name", *[F.col(name).alias(f"set_{name}") for name in defaults])
    joined = tables.join(own, "full_name", "left")
    return joined.withColumns(
        {name: F.coalesce(F.col(f"set_{name}"), default) for name, default in defaults.items()}
    ).drop(*[f"set_{name}" for name in defaults])


def execution_plan(tables: DataFrame, output_schema: str, group_tag: str = "monitor_group") -> DataFrame:
    """Group, slugs and artifact names of each table."""
    group = F.coalesce(F.col("tags").getItem(group_tag), F.lit(DEFAULT_GROUP))
    planned = tables.select(
        "full_name",
        leaf_name(F.col("full_name")).alias("leaf_name"),
        group.alias("group_name"),
        group_slug(group).alias("group_slug"),
        full_name_slug(F.col("full_name")).alias("assets_suffix"),
    )
    views = {
        f"{kind}_view": F.concat(F.lit(f"{output_schema}.{prefix}"), F.col("group_slug"))
        for kind, prefix in VIEW_PREFIXES.items()
    }
    return planned.withColumns(views)


def leaf_collisions(tables: DataFrame) -> DataFrame:
    """Tables whose leaf name another table has too; rows (leaf_name, full_name)."""
    names = tables.select("full_name", leaf_name(F.col("full_name")).alias("leaf_name"))
    return _collisions(names, "leaf_name")


def slug_collisions(groups: DataFrame) -> DataFrame:
    """Group names whose slug another name leads to as well; rows (group_slug, group_name)."""
    names = groups.select("group_name", group_slug(F.col("group_name")).alias("group_slug"))
    return _collisions(names, "group_slug")


def _collisions(rows: DataFrame, key: str) -> DataFrame:
    # One row per name: a key that everything shares never becomes one long list in one task.
    unique = rows.distinct()
    shared = unique.groupBy(key).agg(F.count("*").alias("uses")).filter("uses > 1")
    return unique.join(shared.select(key), key, "left_semi")
