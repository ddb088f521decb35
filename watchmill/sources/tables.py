"""Reading monitored tables, their inventory and tags, and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.functions.naming import priority


def read_table(spark: SparkSession, name: str, paths: dict[str, str] | None = None) -> DataFrame:
    """A table of the catalog, or the Parquet files registered for its name."""
    if paths and name in paths:
        return spark.read.parquet(paths[name])
    return spark.table(name)


def inventory_row(df: DataFrame, full_name: str, table_type: str = "MANAGED") -> DataFrame:
    """Name, schema, type and columns of a table, read from its schema."""
    columns = F.array(
        *[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type_text")) for f in df.schema]
    )
    return df.sparkSession.range(1).select(
        F.lit(full_name).alias("full_name"),
        F.lit(full_name.split(".")[1]).alias("schema_name"),
        F.lit(table_type).alias("table_type"),
        columns.alias("columns"),
    )


def fold_tags(tag_rows: DataFrame, order: str = "tag_value") -> DataFrame:
    """One map of tags per table; on a repeated tag the row last in ``order`` wins, by default the largest value."""
    full_name = F.concat_ws(".", "catalog_name", "schema_name", "table_name").alias("full_name")
    latest = tag_rows.groupBy(full_name, "tag_name").agg(F.max_by("tag_value", order).alias("tag_value"))
    return latest.groupBy("full_name").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag_name", "tag_value")))).alias("tags")
    )


def tags_of_schemas(tag_rows: DataFrame, schemas: list[str], order: str = "tag_value") -> DataFrame:
    """Tags of the tables in the chosen schemas."""
    return fold_tags(tag_rows.filter(F.col("schema_name").isin(schemas)), order)


def with_tags(inventory: DataFrame, tags: DataFrame) -> DataFrame:
    """Inventory rows with their tags (an empty map where there are none) and their priority."""
    none = F.create_map().cast("map<string,string>")
    joined = inventory.join(tags, "full_name", "left").withColumn("tags", F.coalesce("tags", none))
    return joined.withColumn("priority", priority(F.col("tags").getItem("monitor_priority")))


def column_names(inventory: DataFrame) -> DataFrame:
    """S3: one row per table and column, with its position."""
    return inventory.select("full_name", F.posexplode("columns").alias("position", "column")).select(
        "full_name", "position", F.col("column.name").alias("column_name"), F.col("column.type_text").alias("type_text")
    )


def find_column(inventory: DataFrame, name) -> DataFrame:
    """S3: the first column of each table whose name matches without regard to case, with its type; NULL if none.

    ``name`` is a column expression, so every table may look for another name.
    """
    found = F.get(F.filter("columns", lambda c: F.lower(c["name"]) == F.lower(name)), F.lit(0))
    return inventory.select(
        "full_name", found["name"].alias("column_name"), found["type_text"].alias("type_text")
    )


def metric_table(output_schema: str, leaf: str, kind: str) -> str:
    """Name of a table's metric table; ``kind`` is 'profile' or 'drift'."""
    return f"{output_schema}.{leaf}_{kind}_metrics"


def read_metrics(spark: SparkSession, output_schema: str, leaf: str, kind: str) -> DataFrame:
    return spark.table(metric_table(output_schema, leaf, kind))
