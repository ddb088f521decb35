"""Checks of discovery, policy, coverage and provisioning over an estate derived from the sales tables.

Every customer stands for a catalog table: its nation is the schema, its market segment the table type, its balance
decides on tags and settings. Orders are refreshes of the table's monitor, order lines are routing entries, events are
alert firings. The estate grows with the data, and so does the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import check, table
from watchmill.functions.naming import (
    anchored,
    duration_text,
    full_name_slug,
    group_slug,
    identifier_slug,
    leaf_name,
    priority,
    whole_days_between,
)
from watchmill.functions.templates import unknown_variables, variables_used
from watchmill.operators import alerts as A
from watchmill.operators import coverage as C
from watchmill.operators import discovery as D
from watchmill.operators import policy as P
from watchmill.operators import provisioning as V
from watchmill.operators.custom import duplicate_metrics, resolved_metrics
from watchmill.plans.preview import preview, slice_warnings
from watchmill.settings import DiscoverySettings, PolicySettings
from watchmill.sources.sinks import stale_views
from watchmill.sources.tables import column_names, find_column, fold_tags, tags_of_schemas, with_tags

NOW = "2001-08-15 12:00:00"

# --- the estate in SQL --------------------------------------------------------------------------------------------

_SCHEMA = "CASE WHEN c_acctbal < 0 THEN 'tmp_' ELSE '' END || lower(n_name)"
_LEAF = "replace(lower(c_name), '#', '_')"
_TYPES = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'MANAGED' WHEN 'BUILDING' THEN 'EXTERNAL' WHEN 'FURNITURE' THEN 'VIEW' "
    "WHEN 'HOUSEHOLD' THEN 'FOREIGN' ELSE 'STREAMING_TABLE' END"
)
_ESTATE = f"""SELECT c_custkey AS table_id, 'main.' || {_SCHEMA} || '.' || {_LEAF} AS full_name, {_SCHEMA} AS schema_name,
  {_TYPES} AS table_type, c_acctbal, c_nationkey, c_mktsegment,
  CASE WHEN c_acctbal > 2000 THEN 'true' WHEN c_acctbal > 0 THEN 'false' END AS monitor_enabled,
  CASE WHEN c_acctbal > 1000 THEN 'team_' || c_nationkey WHEN c_acctbal > 0 THEN ' ' END AS owner,
  CASE WHEN c_nationkey < 20 THEN lower(c_mktsegment) END AS department,
  CASE WHEN c_acctbal > 9000 THEN 'high' WHEN c_acctbal > 0 THEN CAST(CAST(floor(c_acctbal / 1000) AS INT) AS VARCHAR) END AS prio,
  CASE WHEN c_nationkey < 15 THEN 'Team ' || c_mktsegment || ' & Co.' END AS monitor_group
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_CTE = f"WITH e AS ({_ESTATE})"

# --- the estate in Spark ------------------------------------------------------------------------------------------

TAGS = {"monitor_enabled": "monitor_enabled", "owner": "owner", "department": "department", "monitor_priority": "prio",
        "monitor_group": "monitor_group"}


def estate(spark: SparkSession, sf: str) -> DataFrame:
    """The raw estate: one row per table with its tag values as columns."""
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    balance = F.col("c_acctbal")
    schema = F.concat(F.when(balance < 0, "tmp_").otherwise(""), F.lower("n_name"))
    segment = F.col("c_mktsegment")
    kind = (
        F.when(segment == "AUTOMOBILE", "MANAGED")
        .when(segment == "BUILDING", "EXTERNAL")
        .when(segment == "FURNITURE", "VIEW")
        .when(segment == "HOUSEHOLD", "FOREIGN")
        .otherwise("STREAMING_TABLE")
    )
    thousands = F.floor(balance / 1000).cast("int").cast("string")
    return rows.select(
        F.col("c_custkey").alias("table_id"),
        F.concat(F.lit("main."), schema, F.lit("."), F.replace(F.lower("c_name"), F.lit("#"), F.lit("_"))).alias("full_name"),
        schema.alias("schema_name"),
        kind.alias("table_type"),
        "c_acctbal",
        "c_nationkey",
        "c_mktsegment",
        F.when(balance > 2000, "true").when(balance > 0, "false").alias("monitor_enabled"),
        F.when(balance > 1000, F.concat(F.lit("team_"), "c_nationkey")).when(balance > 0, " ").alias("owner"),
        F.when(F.col("c_nationkey") < 20, F.lower("c_mktsegment")).alias("department"),
        F.when(balance > 9000, "high").when(balance > 0, thousands).alias("prio"),
        F.when(F.col("c_nationkey") < 15, F.concat(F.lit("Team "), segment, F.lit(" & Co."))).alias("monitor_group"),
    )


def tag_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Tag assignments of the estate as rows."""
    parts = F.split("full_name", r"\.")
    pairs = F.array(
        *[F.struct(F.lit(tag).alias("tag_name"), F.col(column).alias("tag_value")) for tag, column in TAGS.items()]
    )
    rows = estate(spark, sf).select(
        parts[0].alias("catalog_name"), parts[1].alias("schema_name"), parts[2].alias("table_name"), F.inline(pairs)
    )
    return rows.filter("tag_value IS NOT NULL")


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog tables with columns, tags and priority. The columns depend on segment and balance."""
    balance = F.col("c_acctbal")

    def column(name, kind: str, constraint: str | None = None):
        return F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("type_text"), F.lit(constraint).cast("string").alias("constraint")
        )

    columns = F.array_compact(
        F.array(
            column("Event_Time", "timestamp"),
            F.when(balance > 1000, column("Prediction", "double")),
            F.when(F.col("c_mktsegment") != "BUILDING", column("label", "int")),
            column("model_id", "string"),
            F.when(F.col("c_nationkey") < 5, column("customer_id", "bigint")),
            F.when(F.col("c_nationkey") == 7, column("code", "string", "PRIMARY KEY")),
        )
    )
    plain = estate(spark, sf).withColumn("columns", columns).select(
        "table_id", "full_name", "schema_name", "table_type", "columns", "c_acctbal", "c_nationkey", "c_mktsegment"
    )
    return with_tags(plain, fold_tags(tag_rows(spark, sf)))


def settings(spark: SparkSession, sf: str) -> DataFrame:
    """Per-table settings of the tables with a balance above 5000."""
    balance, nation = F.col("c_acctbal"), F.col("c_nationkey")
    return estate(spark, sf).filter(balance > 5000).select(
        "full_name",
        "table_id",
        F.when(nation < 3, F.concat(F.lit("lead_"), nation)).alias("owner"),
        F.when(nation < 10, F.lit("https://runbooks.example.com")).alias("runbook_url"),
        F.lit(None).cast("string").alias("lineage_url"),
        F.when(balance > 8000, F.round(balance / 20000, 3)).alias("drift_threshold"),
        F.when(nation > 5, F.lit("main.base.line")).alias("baseline_table_name"),
        F.when(nation > 12, F.array(F.lit("region"))).alias("slicing_exprs"),
        F.when(nation == 4, "prediction").when(nation == 6, "score").alias("prediction_column"),
        F.when(nation < 20, "event_time").alias("timestamp_column"),
        F.when(nation < 8, "LABEL").alias("label_column"),
        F.lit(None).cast("string").alias("model_id_column"),
        F.when(nation == 9, "7 days").when(nation == 11, "1 hour").alias("granularity"),
        F.when(nation == 2, "SNAPSHOT").when(nation < 6, "TIMESERIES").otherwise("INFERENCE").alias("profile_type"),
        F.when(nation == 13, "a.b").otherwise("monitoring").alias("output_schema_name"),
    )


_SETTINGS = f"""s AS (SELECT full_name, table_id, c_nationkey, c_acctbal,
  CASE WHEN c_nationkey < 3 THEN 'lead_' || c_nationkey END AS set_owner,
  CASE WHEN c_nationkey < 10 THEN 'https://runbooks.example.com' END AS set_runbook,
  CASE WHEN c_acctbal > 8000 THEN round(c_acctbal / 20000, 3) END AS set_threshold FROM e WHERE c_acctbal > 5000)"""


def monitors(spark: SparkSession, sf: str) -> DataFrame:
    """Monitors: one per table that ever had a large order, and one per table of one segment."""
    large = table(spark, sf, "orders").filter("o_totalprice > 450000")
    ordered = large.select(F.col("o_custkey").alias("object_id")).distinct()
    started = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("object_id"))
    ids = ordered.union(started).distinct()
    status = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("object_id"),
        F.when(F.col("c_acctbal") > 3000, "ACTIVE").otherwise("PENDING").alias("status"),
        (F.col("c_nationkey") == 21).alias("lookup_failed"),
    )
    return ids.join(status, "object_id").withColumn("monitor_id", F.concat(F.lit("m"), "object_id"))


_MONITORS = """m AS (SELECT c_custkey AS object_id, 'm' || c_custkey AS monitor_id,
  CASE WHEN c_acctbal > 3000 THEN 'ACTIVE' ELSE 'PENDING' END AS status, c_nationkey = 21 AS lookup_failed
  FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) OR c_mktsegment = 'BUILDING'),
mt AS (SELECT m.*, e.full_name FROM m JOIN e ON m.object_id = e.table_id WHERE e.full_name LIKE 'main.%')"""
_KNOWN = "k AS (SELECT full_name FROM e WHERE c_acctbal > 5000 UNION SELECT full_name FROM disc)"


def monitored(spark: SparkSession, sf: str) -> DataFrame:
    return C.monitored_tables(monitors(spark, sf), inventory(spark, sf), "main")


def refreshes(spark: SparkSession, sf: str) -> DataFrame:
    """Refreshes of the tables of the nations above nine: their orders."""
    chosen = table(spark, sf, "customer").filter("c_nationkey > 9").select("c_custkey")
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("object_id"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    return orders.join(chosen, F.col("object_id") == F.col("c_custkey"), "left_semi")


_NOW_SPARK = f"TIMESTAMP'{NOW}'"


def attention(spark: SparkSession, sf: str) -> DataFrame:
    return C.refresh_states(monitored(spark, sf), refreshes(spark, sf), F.expr(_NOW_SPARK), 30)


_ATTENTION = f"""rf AS (SELECT o_custkey AS object_id, max(o_orderdate) AS last_refresh FROM orders
  JOIN customer ON o_custkey = c_custkey WHERE c_nationkey > 9 GROUP BY 1),
at0 AS (SELECT mt.*, rf.last_refresh, CASE WHEN lookup_failed THEN 'refresh_history_unavailable'
  WHEN last_refresh IS NULL AND status = 'ACTIVE' THEN NULL WHEN last_refresh IS NULL THEN 'never_refreshed'
  WHEN last_refresh < TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'stale' END AS refresh_state
  FROM mt LEFT JOIN rf USING (object_id)),
att AS (SELECT * FROM at0 WHERE refresh_state IS NOT NULL)"""

# --- tags, columns, discovery -------------------------------------------------------------------------------------


def _pairs(tags) -> F.Column:
    entries = F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(entries), ",")


_TAG_TEXT = (
    "concat_ws(',', 'department=' || department, 'monitor_enabled=' || monitor_enabled, 'monitor_group=' || monitor_group, "
    "'monitor_priority=' || prio, 'owner=' || owner)"
)


@check("tags_folded", f"{_CTE} SELECT full_name, {_TAG_TEXT} AS tags FROM e WHERE {_TAG_TEXT} <> ''")
def tags_folded(spark, sf):
    """Tag rows to one map per table."""
    return fold_tags(tag_rows(spark, sf)).select("full_name", _pairs("tags").alias("tags"))


@check(
    "tags_last_value_wins",
    "WITH t AS (SELECT 'main.orders.c' || o_custkey AS full_name, 'status_' || o_orderstatus AS tag, o_orderpriority AS v, "
    "o_orderdate, o_orderkey FROM orders), l AS (SELECT full_name, tag, arg_max(v, (o_orderdate, o_orderkey)) AS v FROM t "
    "GROUP BY 1, 2) SELECT full_name, string_agg(tag || '=' || v, ',' ORDER BY tag) AS tags FROM l GROUP BY 1",
)
def tags_repeated(spark, sf):
    """Of repeated tags the last one counts."""
    rows = table(spark, sf, "orders").select(
        F.lit("main").alias("catalog_name"),
        F.lit("orders").alias("schema_name"),
        F.concat(F.lit("c"), "o_custkey").alias("table_name"),
        F.concat(F.lit("status_"), "o_orderstatus").alias("tag_name"),
        F.col("o_orderpriority").alias("tag_value"),
        F.struct("o_orderdate", "o_orderkey").alias("assigned"),
    )
    return fold_tags(rows, "assigned").select("full_name", _pairs("tags").alias("tags"))


@check(
    "tags_of_schemas",
    f"{_CTE} SELECT full_name, {_TAG_TEXT} AS tags FROM e WHERE schema_name IN ('nation_1', 'nation_2', 'tmp_nation_3') "
    f"AND {_TAG_TEXT} <> ''",
)
def schema_tags(spark, sf):
    """S2 for chosen schemas."""
    found = tags_of_schemas(tag_rows(spark, sf), ["nation_1", "nation_2", "tmp_nation_3"])
    return found.select("full_name", _pairs("tags").alias("tags"))


_COLUMNS = """c AS (SELECT full_name, table_type, c_acctbal, c_nationkey, list_filter(['Event_Time',
  CASE WHEN c_acctbal > 1000 THEN 'Prediction' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'label' END, 'model_id',
  CASE WHEN c_nationkey < 5 THEN 'customer_id' END, CASE WHEN c_nationkey = 7 THEN 'code' END], lambda x: x IS NOT NULL)
  AS names FROM e)"""


@check(
    "column_inventory",
    f"{_CTE}, {_COLUMNS} SELECT full_name, unnest(names) AS column_name, generate_subscripts(names, 1) - 1 AS position FROM c",
)
def columns_listed(spark, sf):
    """S1, S3"""
    return column_names(inventory(spark, sf)).select("full_name", "column_name", "position")


@check(
    "find_column_ignoring_case",
    f"{_CTE} SELECT full_name, CASE WHEN c_acctbal > 1000 THEN 'Prediction' END AS column_name, "
    "CASE WHEN c_acctbal > 1000 THEN 'double' END AS type_text FROM e",
)
def column_found(spark, sf):
    """S3"""
    return find_column(inventory(spark, sf), F.lit("PREDICTION"))


@check(
    "priority_tag",
    f"{_CTE} SELECT full_name, CASE WHEN prio IS NULL OR prio = 'high' THEN 99 ELSE CAST(prio AS INT) END AS priority FROM e",
)
def priorities(spark, sf):
    """P7"""
    return inventory(spark, sf).select("full_name", "priority")


@check("tags_required", f"{_CTE} SELECT full_name FROM e WHERE monitor_enabled = 'true' AND department = 'building'")
def tags_required(spark, sf):
    """P10: both tags, exact values."""
    match = D.tags_match(F.col("tags"), {"monitor_enabled": "true", "department": "building"})
    return inventory(spark, sf).filter(match).select("full_name")


_SELECTED = "(schema_name GLOB 'nation_1*' OR schema_name GLOB 'tmp_nation_?') AND NOT schema_name GLOB '*_[34]'"


@check("schemas_by_glob", f"{_CTE} SELECT DISTINCT schema_name FROM e WHERE {_SELECTED}")
def schemas(spark, sf):
    """Include globs, then exclude globs."""
    chosen = DiscoverySettings(include_schemas=("nation_1*", "tmp_nation_?"), exclude_schemas=("*_[34]",))
    return inventory(spark, sf).select("schema_name").distinct().filter(D.schema_selected(F.col("schema_name"), chosen))


@check("table_types", f"{_CTE} SELECT table_type, count(*) AS n FROM e WHERE table_type <> 'FOREIGN' GROUP BY 1")
def types(spark, sf):
    """P12"""
    return inventory(spark, sf).filter(D.supported_type(F.col("table_type"))).groupBy("table_type").agg(F.count("*").alias("n"))


_DISCOVERED = (
    "disc AS (SELECT *, CASE WHEN prio IS NULL OR prio = 'high' THEN 99 ELSE CAST(prio AS INT) END AS priority FROM e "
    "WHERE NOT schema_name GLOB 'tmp_*' AND monitor_enabled = 'true' AND table_type <> 'FOREIGN')"
)


def discovered(spark: SparkSession, sf: str) -> DataFrame:
    return D.discover(inventory(spark, sf), DiscoverySettings())


@check("discovery", f"{_CTE}, {_DISCOVERED} SELECT full_name, priority FROM disc")
def discovery(spark, sf):
    """P13, O5"""
    return discovered(spark, sf).select("full_name", "priority")


@check("key_columns", f"{_CTE} SELECT full_name, c_nationkey < 5 OR c_nationkey = 7 AS has_key FROM e")
def keys(spark, sf):
    """A key by name or by constraint; model_id is none."""
    return inventory(spark, sf).select("full_name", D.has_key_column(F.col("columns")).alias("has_key"))


def tables(spark: SparkSession, sf: str) -> DataFrame:
    configured = inventory(spark, sf).join(settings(spark, sf).select("full_name"), "full_name", "left_semi")
    return D.table_list(discovered(spark, sf), configured)


_TABLES = (
    f"{_CTE}, {_SETTINGS}, {_DISCOVERED}, tl AS (SELECT full_name, 'tag' AS origin FROM disc WHERE full_name NOT IN "
    "(SELECT full_name FROM s) UNION ALL SELECT full_name, 'config' FROM s)"
)


@check("table_list", f"{_TABLES} SELECT * FROM tl")
def table_list(spark, sf):
    """Settings beat discovery."""
    return tables(spark, sf).select("full_name", "origin")


@check(
    "enrichment",
    f"{_TABLES} SELECT tl.full_name, coalesce(set_owner, e.owner, 'unknown') AS owner, set_runbook AS runbook_url, "
    "coalesce(e.department, 'unknown') AS department FROM tl JOIN e USING (full_name) LEFT JOIN s USING (full_name)",
)
def enrichment(spark, sf):
    """P6 over rows."""
    return D.enrich(tables(spark, sf), settings(spark, sf)).select("full_name", "owner", "runbook_url", "department")


@check(
    "settings_resolved",
    f"{_TABLES} SELECT tl.full_name, coalesce(set_threshold, 0.2) AS drift_threshold FROM tl LEFT JOIN s USING (full_name)",
)
def resolved(spark, sf):
    """J3, P8"""
    return D.resolve_settings(tables(spark, sf), settings(spark, sf), {"drift_threshold": F.lit(0.2)}).select(
        "full_name", "drift_threshold"
    )


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
_GROUP = "coalesce(monitor_group, 'default')"


@check(
    "execution_plan",
    f"{_CTE} SELECT full_name, split_part(full_name, '.', 3) AS leaf_name, {_GROUP} AS group_name, "
    f"{_SLUG.format(_GROUP)} AS group_slug, replace(full_name, '.', '_') AS assets_suffix, "
    f"'main.monitoring.unified_drift_metrics_' || {_SLUG.format(_GROUP)} AS drift_view FROM e",
)
def planned(spark, sf):
    """A13, F1, F2"""
    return D.execution_plan(inventory(spark, sf), "main.monitoring").drop("profile_view", "performance_view")


_TITLE_SLUG = (
    "CASE WHEN {0} = '' THEN 'unnamed' ELSE rtrim(substr({0}, 1, 64), '_') END"
).format("trim(regexp_replace(lower(regexp_replace({0}, '[^a-zA-Z0-9]+', '_', 'g')), '_+', '_', 'g'), '_')")


@check(
    "slugs_of_urls_and_texts",
    f"SELECT 'page' AS kind, page_id AS id, {_TITLE_SLUG.format('url')} AS slug FROM pages UNION ALL "
    f"SELECT 'document', doc_id, {_TITLE_SLUG.format('text')} FROM documents",
)
def slugs(spark, sf):
    """F1 on long and odd texts."""
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("t"))
    texts = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return pages.union(texts).select("kind", "id", identifier_slug(F.col("t")).alias("slug"))


@check(
    "names_and_slugs",
    f"{_CTE} SELECT full_name, split_part(full_name, '.', 3) AS leaf, replace(full_name, '.', '_') AS slug, "
    f"{_SLUG.format(_GROUP)} AS group_slug FROM e",
)
def names(spark, sf):
    """F2"""
    rows = estate(spark, sf)
    name = F.col("full_name")
    return rows.select(
        name, leaf_name(name).alias("leaf"), full_name_slug(name).alias("slug"), group_slug(F.col("monitor_group")).alias("group_slug")
    )


@check(
    "priority_of_any_text",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size WHEN p_size > 10 THEN -p_size ELSE 99 END AS priority FROM part",
)
def priority_text(spark, sf):
    """Blanks and signs are fine, words and fractions are not."""
    size = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_size") > 25, F.concat(F.lit(" "), size, F.lit(" ")))
        .when(F.col("p_size") > 10, F.concat(F.lit("-"), size))
        .when(F.col("p_size") > 5, F.concat(size, F.lit(".5")))
        .when(F.col("p_size") > 2, F.lit("urgent"))
    )
    return table(spark, sf, "part").select("p_partkey", priority(text).alias("priority"))


# --- collisions, policy -------------------------------------------------------------------------------------------


@check(
    "leaf_name_collisions",
    "SELECT leaf_name, full_name FROM (SELECT *, count(*) OVER (PARTITION BY leaf_name) AS uses FROM (SELECT DISTINCT "
    "'main.' || p_brand || '.' || replace(p_name, ' ', '_') AS full_name, replace(p_name, ' ', '_') AS leaf_name FROM part)) "
    "WHERE uses > 1",
)
def leafs(spark, sf):
    """Parts of the same name under several brands."""
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("main."), "p_brand", F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("full_name")
    )
    return D.leaf_collisions(parts)


@check(
    "group_slug_collisions",
    "WITH n AS (SELECT DISTINCT g FROM (SELECT lower(p_type) AS g FROM part UNION ALL SELECT p_type || '!' FROM part "
    "UNION ALL SELECT p_brand FROM part)), x AS (SELECT g, trim(regexp_replace(lower(g), '[^a-z0-9]+', '_', 'g'), '_') AS slug "
    "FROM n) SELECT slug AS group_slug, g AS group_name FROM (SELECT *, count(*) OVER (PARTITION BY slug) AS uses FROM x) WHERE uses > 1",
)
def group_collisions(spark, sf):
    """Names that differ only in case and signs."""
    parts = table(spark, sf, "part")
    groups = parts.select(F.lower("p_type").alias("group_name")).union(
        parts.select(F.concat("p_type", F.lit("!")))
    ).union(parts.select("p_brand"))
    return D.slug_collisions(groups)


_POLICY = PolicySettings(
    naming_patterns=(r"main\.nation_1", r"main\."),
    forbidden_patterns=(r".*_0000000\d[13]$", r"nation"),
    required_tags=("owner", "department"),
    require_baseline=True,
    require_slicing=True,
    max_tables_per_config=10,
)


@check(
    "policy_violations",
    f"{_CTE}, {_SETTINGS} SELECT 'naming_pattern' AS \"check\", full_name AS \"table\", "
    "'name misses the asked form: main\\.nation_1' AS message FROM s WHERE NOT starts_with(full_name, 'main.nation_1') "
    "UNION ALL SELECT 'forbidden_pattern', full_name, 'name has a banned form: .*_0000000\\d[13]$' FROM s "
    "WHERE regexp_full_match(full_name, '.*_0000000[0-9][13]') "
    "UNION ALL SELECT 'require_baseline', full_name, 'no baseline is set' FROM s WHERE c_nationkey <= 5 "
    "UNION ALL SELECT 'require_slicing', full_name, 'no slice is set' FROM s WHERE c_nationkey <= 12 "
    "UNION ALL SELECT 'max_tables_per_config', '', 'tables: ' || count(*) || ', limit: 10' FROM s HAVING count(*) > 10",
)
def policy(spark, sf):
    """P23, P24"""
    return P.policy_violations(settings(spark, sf), _POLICY, "INFERENCE")


@check(
    "required_tag_violations",
    f"{_CTE}, {_SETTINGS} SELECT 'required_tags' AS \"check\", s.full_name AS \"table\", "
    "'tag without a value: ' || t.tag AS message FROM s JOIN e USING (full_name) "
    "CROSS JOIN (VALUES ('owner'), ('department')) t(tag) WHERE CASE t.tag WHEN 'owner' THEN set_owner IS NULL AND "
    "coalesce(trim(e.owner), '') = '' ELSE coalesce(trim(e.department), '') = '' END",
)
def required_tags(spark, sf):
    """P25: a tag or a setting of the same name will do."""
    return P.tag_violations(settings(spark, sf), inventory(spark, sf), _POLICY.required_tags)


@check(
    "required_tags_on_estate",
    f"{_CTE} SELECT full_name AS \"table\", 'owner' AS tag FROM e WHERE coalesce(trim(owner), '') = ''",
)
def required_tags_estate(spark, sf):
    """P25: blank tags count as missing."""
    bare = inventory(spark, sf).select("full_name")
    rows = P.tag_violations(bare, inventory(spark, sf), ("owner",))
    return rows.select("table", F.regexp_extract("message", ": (.*)$", 1).alias("tag"))


@check(
    "missing_columns",
    f"{_CTE}, {_SETTINGS}, {_COLUMNS} SELECT full_name, CASE WHEN s.c_nationkey = 6 THEN 'prediction_column' ELSE 'label_column' "
    "END AS setting, CASE WHEN s.c_nationkey = 6 THEN 'score' ELSE 'LABEL' END AS column_name, "
    "array_to_string(list_sort(list_transform(names, lambda x: lower(x))), ',') AS available FROM s JOIN c USING (full_name) "
    "WHERE s.c_nationkey = 6 OR (s.c_nationkey < 8 AND NOT list_contains(names, 'label'))",
)
def columns_missing(spark, sf):
    """Names match without regard to case; the first missing one is reported."""
    found = P.missing_columns(settings(spark, sf), inventory(spark, sf), "INFERENCE")
    return found.withColumn("available", F.array_join("available", ","))


@check(
    "settings_violations",
    f"{_CTE}, {_SETTINGS} SELECT full_name, rule FROM s CROSS JOIN (VALUES (9, 'granularity'), (13, 'output_schema_name')) v(n, rule) "
    "WHERE c_nationkey = n UNION ALL SELECT full_name, 'inference_timestamp' FROM s WHERE c_nationkey >= 20 "
    "UNION ALL SELECT full_name, 'inference_prediction' FROM s WHERE c_nationkey >= 7 "
    "UNION ALL SELECT full_name, 'catalog' FROM s WHERE false",
)
def settings_broken(spark, sf):
    """P27"""
    return P.settings_violations(settings(spark, sf), "main")


@check(
    "names_matching_patterns",
    "SELECT p_partkey, regexp_matches(p_name, '^(red|blue)') AS starts, regexp_full_match(p_name, '.*t') AS ends FROM part",
)
def patterns(spark, sf):
    """A pattern applies from the start of the name."""
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", name.rlike(anchored("red|blue")).alias("starts"), name.rlike(anchored(".*t$")).alias("ends")
    )


# --- coverage -----------------------------------------------------------------------------------------------------


@check("monitored_tables", f"{_CTE}, {_MONITORS} SELECT object_id, monitor_id, full_name, status FROM mt")
def watched(spark, sf):
    """J4"""
    return monitored(spark, sf).select("object_id", "monitor_id", "full_name", "status")


@check(
    "unmonitored_tables",
    f"{_CTE}, {_MONITORS} SELECT full_name, schema_name, owner, department, 'no_monitor' AS reason FROM e "
    "WHERE full_name NOT IN (SELECT full_name FROM mt)",
)
def unwatched(spark, sf):
    """J5"""
    return C.unmonitored_tables(inventory(spark, sf), monitored(spark, sf))


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return C.orphan_monitors(monitored(spark, sf), tables(spark, sf))


_ORPHANS = f"{_DISCOVERED}, {_KNOWN}, o AS (SELECT full_name, monitor_id, 'not_in_config' AS reason FROM mt WHERE full_name NOT IN (SELECT full_name FROM k))"


@check("orphan_monitors", f"{_CTE}, {_MONITORS}, {_ORPHANS} SELECT * FROM o")
def orphaned(spark, sf):
    """J6"""
    return orphans(spark, sf)


@check(
    "refresh_states",
    f"{_CTE}, {_MONITORS}, {_ATTENTION} SELECT full_name, monitor_id, refresh_state, status, "
    f"CASE WHEN refresh_state = 'stale' THEN last_refresh END AS last_refresh, CASE WHEN refresh_state = 'stale' THEN "
    f"CAST(floor(epoch(TIMESTAMP '{NOW}' - last_refresh) / 86400) AS INT) ELSE -1 END AS days_since_refresh FROM att",
)
def states(spark, sf):
    """A9, F7"""
    return attention(spark, sf).withColumn("days_since_refresh", F.coalesce("days_since_refresh", F.lit(-1)))


@check(
    "coverage_summary",
    f"{_CTE}, {_MONITORS}, {_ATTENTION}, {_ORPHANS} SELECT (SELECT count(*) FROM e) AS total_catalog_tables, "
    "(SELECT count(*) FROM mt) AS total_monitored, (SELECT count(*) FROM e WHERE full_name NOT IN (SELECT full_name FROM mt)) "
    "AS unmonitored_count, (SELECT count(*) FROM att) AS refresh_attention_count, "
    "(SELECT count(*) FROM att WHERE refresh_state = 'stale') AS stale_count, "
    "(SELECT count(*) FROM att WHERE refresh_state = 'never_refreshed') AS never_refreshed_count, "
    "(SELECT count(*) FROM att WHERE refresh_state = 'refresh_history_unavailable') AS refresh_history_unavailable_count, "
    "(SELECT count(*) FROM o) AS orphan_count, "
    "round((SELECT count(*) FROM mt) * 100.0 / (SELECT count(*) FROM e), 2)::DOUBLE AS coverage_pct",
)
def summary(spark, sf):
    """A10"""
    return C.coverage_summary(inventory(spark, sf), monitored(spark, sf), attention(spark, sf), orphans(spark, sf))


@check(
    "epoch_milliseconds_and_days",
    "SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-03-01 00:00:00' - ts) / 86400) AS INT) AS days FROM events",
)
def days(spark, sf):
    """a time kept as milliseconds, and whole days since."""
    at = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")))
    return table(spark, sf, "events").select(
        "event_id", whole_days_between(at, F.expr("TIMESTAMP'2024-03-01 00:00:00'")).alias("days")
    )


# --- provisioning -------------------------------------------------------------------------------------------------


def _desired(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of the wanted monitors, normalised."""
    rows = settings(spark, sf)
    kinds = F.array(F.lit("1 week"), F.coalesce("granularity", F.lit("1 day")))
    return rows.select(
        "full_name",
        V.granularity_labels(kinds).alias("granularities"),
        V.slice_names(F.coalesce("slicing_exprs", F.array().cast("array<string>"))).alias("slicing_exprs"),
        "baseline_table_name",
    )


def _existing(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of the monitors there are: quoted slices, enum names, a few differences."""
    rows = estate(spark, sf).filter("c_acctbal > 6000")
    nation = F.col("c_nationkey")
    day, hour, week = (F.lit(f"AGGREGATION_GRANULARITY_1_{n}") for n in ("DAY", "HOUR", "WEEK"))
    return rows.select(
        "full_name",
        V.granularity_labels(F.when(nation == 11, F.array(hour, week)).otherwise(F.array(week, day))).alias("granularities"),
        V.slice_names(F.when(nation > 14, F.array(F.lit("`region`"))).otherwise(F.array().cast("array<string>"))).alias("slicing_exprs"),
        F.when(nation > 7, F.lit("main.base.line")).alias("baseline_table_name"),
    )


_FIELDS = ("baseline_table_name", "granularities", "slicing_exprs")
# Nation 9 asks for an unknown granularity, which drops out and leaves one week alone.
_CHANGES = (
    "CASE WHEN c_acctbal > 6000 THEN concat_ws(',', CASE WHEN c_nationkey IN (6, 7) THEN 'baseline_table_name' END, "
    "CASE WHEN c_nationkey = 9 THEN 'granularities' END, CASE WHEN c_nationkey IN (13, 14) THEN 'slicing_exprs' END) ELSE '' END"
)
_ACTIONS = (
    f"SELECT full_name, CASE WHEN c_acctbal <= 6000 THEN 'create' WHEN {_CHANGES} <> '' THEN 'update' ELSE 'no_change' END "
    f"AS action, {_CHANGES} AS changed FROM s"
)


@check("planned_actions", f"{_CTE}, {_SETTINGS} {_ACTIONS}")
def actions(spark, sf):
    """J7, F8"""
    plan = V.planned_actions(_desired(spark, sf), _existing(spark, sf), _FIELDS)
    changed = F.array_join(F.transform("changes", lambda c: c["field"]), ",")
    return plan.select("full_name", "action", changed.alias("changed"))


@check(
    "planned_action_details",
    f"{_CTE}, {_SETTINGS} SELECT full_name, 'baseline_table_name' AS field, '{{\"v\":null}}' AS existing, "
    "'{\"v\":\"main.base.line\"}' AS desired FROM s WHERE c_acctbal > 6000 AND c_nationkey IN (6, 7) "
    "UNION ALL SELECT full_name, 'granularities', '{\"v\":[\"1 day\",\"1 week\"]}', '{\"v\":[\"1 week\"]}' FROM s "
    "WHERE c_acctbal > 6000 AND c_nationkey = 9 "
    "UNION ALL SELECT full_name, 'slicing_exprs', '{\"v\":null}', '{\"v\":[\"region\"]}' FROM s "
    "WHERE c_acctbal > 6000 AND c_nationkey IN (13, 14)",
)
def action_details(spark, sf):
    """Which setting changes from what to what."""
    plan = V.planned_actions(_desired(spark, sf), _existing(spark, sf), _FIELDS)
    return plan.select("full_name", F.inline("changes"))


@check(
    "impact_summary",
    f"{_CTE}, {_SETTINGS}, a AS ({_ACTIONS}) SELECT count(*) FILTER (action = 'create') AS \"create\", "
    "count(*) FILTER (action = 'update') AS \"update\", count(*) FILTER (action = 'no_change') AS no_change, "
    "0::BIGINT AS skip_quota, 0::BIGINT AS skip_column_missing, 0::BIGINT AS skip_cardinality, count(*) AS total FROM a",
)
def impact(spark, sf):
    """A11"""
    return V.impact_summary(V.planned_actions(_desired(spark, sf), _existing(spark, sf), _FIELDS))


@check(
    "quota_split",
    f"{_CTE}, {_SETTINGS}, t AS (SELECT full_name, row_number() OVER (ORDER BY full_name) AS nth FROM s) "
    "SELECT full_name, CASE WHEN nth <= 60 THEN 'within' ELSE 'skip_quota' END AS quota FROM t",
)
def quota(spark, sf):
    """Forty monitors exist, so sixty more fit."""
    return V.within_quota(settings(spark, sf), 40, ["full_name"]).select("full_name", "quota")


@check(
    "dry_run_actions",
    f"{_CTE}, {_SETTINGS}, {_COLUMNS}, a AS ({_ACTIONS}), q AS (SELECT s.full_name, s.c_nationkey, a.action, c.names, "
    "row_number() OVER (ORDER BY s.full_name) AS nth FROM s JOIN a USING (full_name) JOIN c USING (full_name)) "
    "SELECT full_name, CASE WHEN nth > 90 THEN 'skip_quota' WHEN c_nationkey = 6 OR (c_nationkey < 8 AND NOT "
    "list_contains(names, 'label')) THEN 'skip_column_missing' ELSE action END AS action, CASE WHEN nth > 90 THEN "
    "'over quota' WHEN c_nationkey = 6 THEN 'prediction_column names a missing column: score' "
    "WHEN c_nationkey < 8 AND NOT list_contains(names, 'label') THEN 'label_column names a missing column: LABEL' "
    "WHEN action = 'update' THEN 'settings differ' WHEN action = 'no_change' THEN 'settings agree' "
    "ELSE '' END AS reason FROM q",
)
def dry_run(spark, sf):
    """Ten monitors exist, ninety more fit."""
    return preview(
        settings(spark, sf), inventory(spark, sf), _desired(spark, sf), _existing(spark, sf), _FIELDS, "INFERENCE", 10, ["full_name"]
    )


@check(
    "slice_columns_missing",
    f"{_CTE}, {_SETTINGS} SELECT full_name, 'no such slice column: region' AS warning FROM s WHERE c_nationkey > 12",
)
def slices_missing(spark, sf):
    """Configured slices that no column stands for."""
    return slice_warnings(settings(spark, sf), inventory(spark, sf))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """What a run did, by nation."""
    nation = F.col("c_nationkey")
    action = (
        F.when(nation < 8, "created")
        .when(nation < 14, "updated")
        .when(nation < 18, "no_change")
        .when(nation < 20, "skipped_quota")
        .when(nation < 22, "skipped_column_missing")
        .otherwise("failed")
    )
    return estate(spark, sf).select("full_name", action.alias("action"))


@check(
    "run_summary",
    f"{_CTE} SELECT count(*) AS tables_discovered, count(*) FILTER (c_nationkey < 8) AS monitors_created, "
    "count(*) FILTER (c_nationkey BETWEEN 8 AND 13) AS monitors_updated, count(*) FILTER (c_nationkey BETWEEN 14 AND 17) AS "
    "monitors_unchanged, count(*) FILTER (c_nationkey BETWEEN 18 AND 21) AS monitors_skipped, "
    "count(*) FILTER (c_nationkey > 21) AS monitors_failed FROM e",
)
def run_summary(spark, sf):
    """A11"""
    return V.run_summary(_results(spark, sf))


@check("usable_tables", f"{_CTE} SELECT full_name FROM e WHERE c_nationkey < 18")
def usable(spark, sf):
    """P26"""
    return V.usable_tables(inventory(spark, sf), _results(spark, sf)).select("full_name")


@check(
    "active_groups",
    f"{_CTE} SELECT {_GROUP} AS group_name, {_SLUG.format(_GROUP)} AS group_slug, count(*) AS tables FROM e "
    "WHERE c_nationkey < 18 GROUP BY 1, 2",
)
def groups(spark, sf):
    """J8"""
    plan = D.execution_plan(inventory(spark, sf), "main.monitoring")
    return V.active_groups(plan, V.usable_tables(inventory(spark, sf), _results(spark, sf)))


@check(
    "report_first_lines",
    f"{_CTE}, {_SETTINGS}, a AS ({_ACTIONS}) SELECT full_name, action FROM a ORDER BY full_name LIMIT 20",
)
def report(spark, sf):
    """The short list of a report."""
    plan = V.planned_actions(_desired(spark, sf), _existing(spark, sf), _FIELDS)
    return V.report_rows(plan.select("full_name", "action"), 20)


_HASHED = (
    "'{\"baseline_table_name\":' || CASE WHEN c_nationkey > 5 THEN '\"main.base.line\"' ELSE 'null' END || "
    "',\"granularities\":' || CASE c_nationkey WHEN 9 THEN '[\"1 week\"]' WHEN 11 THEN '[\"1 hour\",\"1 week\"]' "
    "ELSE '[\"1 day\",\"1 week\"]' END || ',\"slicing_exprs\":' || CASE WHEN c_nationkey > 12 THEN '[\"region\"]' ELSE 'null' END || '}'"
)


@check("settings_hash", f"{_CTE}, {_SETTINGS} SELECT full_name, substr(sha256({_HASHED}), 1, 16) AS hash FROM s")
def hashes(spark, sf):
    """F3"""
    rows = _desired(spark, sf)
    return rows.select("full_name", V.monitor_hash(rows).alias("hash"))


@check(
    "stale_views",
    "WITH v AS (SELECT DISTINCT k.prefix || lower(c_mktsegment) || '_' || c_nationkey AS view_name, "
    "lower(c_mktsegment) || '_' || c_nationkey AS slug, k.ours FROM customer CROSS JOIN (VALUES ('unified_drift_metrics_', true), "
    "('unified_profile_metrics_', true), ('unified_performance_metrics_', true), ('other_', false)) k(prefix, ours)), "
    "active AS (SELECT DISTINCT lower(c_mktsegment) || '_' || c_nationkey AS slug FROM customer WHERE c_nationkey < 12) "
    "SELECT view_name, slug FROM v WHERE ours AND slug NOT IN (SELECT slug FROM active)",
)
def views_gone(spark, sf):
    """Views of groups that are gone; views of others are left alone."""
    slug = F.concat_ws("_", F.lower("c_mktsegment"), "c_nationkey")
    prefixes = F.array(*[F.lit(p) for p in ("unified_drift_metrics_", "unified_profile_metrics_", "unified_performance_metrics_", "other_")])
    customers = table(spark, sf, "customer")
    views = customers.select(slug.alias("slug")).distinct().select(
        F.explode(F.transform(prefixes, lambda p: F.concat(p, "slug"))).alias("view_name")
    )
    active = customers.filter("c_nationkey < 12").select(slug.alias("slug")).distinct()
    return stale_views(views, active)


@check(
    "durations",
    "SELECT l_orderkey, l_linenumber, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) "
    "ELSE printf('%.1fh', s / 3600) END AS text FROM (SELECT l_orderkey, l_linenumber, l_quantity * l_linenumber * 16 AS s FROM lineitem)",
)
def durations(spark, sf):
    """F9"""
    seconds = F.col("l_quantity") * F.col("l_linenumber") * 16
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", duration_text(seconds).alias("text"))


# --- metric definitions as rows -----------------------------------------------------------------------------------


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    """Metric definitions of three layers: part types as tables, brands as metric names."""
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_type").alias("table"),
        F.col("p_brand").alias("name"),
        F.when(size < 20, 1).when(size < 40, 2).otherwise(3).alias("layer"),
        F.col("p_partkey").alias("position"),
        F.when(size == 49, "unknown").when(size == 50, "drift").otherwise("aggregate").alias("metric_type"),
        F.col("p_name").alias("definition"),
    )


_LAYER_ROWS = (
    "l AS (SELECT p_type AS \"table\", p_brand AS name, CASE WHEN p_size < 20 THEN 1 WHEN p_size < 40 THEN 2 ELSE 3 END AS layer, "
    "p_partkey AS position, CASE p_size WHEN 49 THEN 'unknown' WHEN 50 THEN 'drift' ELSE 'aggregate' END AS metric_type, "
    "p_name AS definition FROM part)"
)


@check(
    "metrics_resolved_by_layer",
    f"WITH {_LAYER_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY \"table\", name ORDER BY layer DESC, position DESC) AS nth FROM l) "
    "SELECT \"table\", name, layer, position, metric_type, definition FROM n WHERE nth = 1 AND metric_type <> 'unknown'",
)
def metric_layers(spark, sf):
    """A17"""
    return resolved_metrics(_layers(spark, sf)).drop("first_seen")


@check(
    "metric_names_used_twice",
    f"WITH {_LAYER_ROWS} SELECT \"table\", layer, name, count(*) AS uses FROM l GROUP BY ALL HAVING count(*) > 1",
)
def metric_duplicates(spark, sf):
    """A18"""
    return duplicate_metrics(_layers(spark, sf))


@check(
    "template_variables",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'input_column,widget' ELSE 'count,label_col' END AS used, "
    "CASE WHEN p_size > 25 THEN 'widget' ELSE '' END AS unknown FROM part",
)
def template_variables(spark, sf):
    """variables a definition uses, and those nobody knows."""
    definition = F.when(F.col("p_size") > 25, "SUM({{ input_column }}) + {{widget}} * {{input_column}}").otherwise(
        "AVG({{label_col}}) / {{ count }}"
    )
    inputs = F.array(F.lit("count"), F.col("p_brand"))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(variables_used(definition), ",").alias("used"),
        F.array_join(unknown_variables(definition, inputs), ",").alias("unknown"),
    )


# --- routing ------------------------------------------------------------------------------------------------------


def _routing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Groups are suppliers; nations below ten route to their own list, nation three to nobody."""
    suppliers = table(spark, sf, "supplier")
    nation = F.col("s_nationkey")
    own = F.array(
        F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@example.com")),
        F.concat(F.lit("channel-"), nation),
        F.lit("01234567-89ab-cdef-0123-456789abcdef"),
    )
    lists = F.when(nation == 3, F.array().cast("array<string>")).otherwise(own)
    groups = suppliers.select(F.col("s_name").alias("monitor_group"))
    return groups, suppliers.filter(nation < 10).select(F.col("s_name").alias("monitor_group"), lists.alias("destinations"))


_ROUTED = (
    "r AS (SELECT s_name AS monitor_group, unnest(CASE WHEN s_nationkey = 3 THEN [] WHEN s_nationkey < 10 THEN "
    "[lower(replace(s_name, '#', '.')) || '@example.com', 'channel-' || s_nationkey, '01234567-89ab-cdef-0123-456789abcdef'] "
    "ELSE ['oncall@example.com', 'pager'] END) AS destination FROM supplier)"
)


@check("alert_routes", f"WITH {_ROUTED} SELECT * FROM r")
def routes(spark, sf):
    """Own list, else the default list; an empty list reaches nobody."""
    groups, routing = _routing(spark, sf)
    return A.routes(groups, routing, ("oncall@example.com", "pager"))


@check(
    "alert_destinations",
    f"WITH {_ROUTED} SELECT monitor_group, destination, CASE WHEN destination LIKE '%@%' THEN 'email' ELSE 'destination' END AS kind, "
    "CASE WHEN destination LIKE 'channel-%' THEN 'id-' || n_name ELSE destination END AS address FROM r "
    "LEFT JOIN nation ON destination = 'channel-' || n_nationkey AND n_regionkey < 3 "
    "WHERE destination LIKE '%@%' OR destination LIKE '0%' OR n_name IS NOT NULL",
)
def destinations(spark, sf):
    """addresses, ids, names to look up, and names nobody knows."""
    groups, routing = _routing(spark, sf)
    known = table(spark, sf, "nation").filter("n_regionkey < 3").select(
        F.concat(F.lit("channel-"), "n_nationkey").alias("name"), F.concat(F.lit("id-"), "n_name").alias("id")
    )
    return A.resolve_destinations(A.routes(groups, routing, ("oncall@example.com", "pager")), known)


@check(
    "alerts_due",
    "WITH st AS (SELECT 'user ' || user_id AS alert_name, count(*) AS rows, CASE WHEN count(*) FILTER (event_type = 'error') > 0 "
    "THEN 'TRIGGERED' ELSE 'OK' END AS state FROM events GROUP BY 1), h AS (SELECT 'user ' || user_id AS alert_name, max(ts) AS "
    "last_fired FROM events WHERE event_type = 'click' GROUP BY 1) SELECT alert_name, rows, state FROM st LEFT JOIN h USING (alert_name) "
    "WHERE state = 'TRIGGERED' AND (last_fired IS NULL OR last_fired <= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 3600 SECOND)",
)
def due(spark, sf):
    """Firing alerts that have been silent for an hour."""
    events = table(spark, sf, "events").withColumn("alert_name", F.concat(F.lit("user "), "user_id"))
    state = F.when(F.count_if(F.col("event_type") == "error") > 0, "TRIGGERED").otherwise("OK")
    current = events.groupBy("alert_name").agg(F.count("*").alias("rows"), state.alias("state"))
    history = events.filter("event_type = 'click'").select("alert_name", F.col("ts").cast("timestamp").alias("fired_at"))
    found = A.due_notifications(current, history, F.expr("TIMESTAMP'2024-01-30 00:00:00'"))
    return found.select("alert_name", "rows", "state")
