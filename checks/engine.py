"""Checks of the measuring half: profiles, drift, model quality, custom metrics, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql
from checks.base import check, r, table
from watchmill.operators.custom import (
    custom_aggregates,
    custom_drift,
    with_custom_aggregates,
    with_derived,
)
from watchmill.operators.drift import baseline_drift, consecutive_drift, snapshot_drift
from watchmill.operators.frequencies import value_counts
from watchmill.operators.performance import confusion, confusion_counts, performance
from watchmill.operators.profile import (
    approximate_cardinality,
    merge_profiles,
    partial_profiles,
    profile,
    profile_columns,
    slice_guard,
    with_performance,
)
from watchmill.operators.sketch_drift import RANK_ERROR, sketch_baseline_drift, sketch_drift
from watchmill.operators.unify import drift_projection, performance_projection, profile_projection
from watchmill.settings import REGRESSION, CustomMetric, Monitor

DOUBLES_PROFILE = ["null_rate", "mean", "stddev", "min_value", "max_value"]
DOUBLES_DRIFT = ["js_distance", "ks_statistic", "wasserstein_distance", "chi_square_statistic", "psi"]
KEYS = "window_start, window_end, granularity, slice_key, slice_value"


def flat_profile(profiles: DataFrame) -> DataFrame:
    """Table rows have no null or distinct count; -1 stands for that, so that the columns stay whole numbers."""
    counts = {name: F.coalesce(name, F.lit(-1)) for name in ("null_count", "distinct_count")}
    return profiles.select(*profile_projection(), "log_type").withColumns(counts)


def flat_drift(metrics: DataFrame) -> DataFrame:
    return metrics.select(*drift_projection())


def profile_sql(*args, **kwargs) -> str:
    return (
        f"SELECT {KEYS}, log_type, column_name, record_count, "
        "coalesce(null_count, -1) AS null_count, coalesce(distinct_count, -1) AS distinct_count, "
        f"{sql.rounded_columns(DOUBLES_PROFILE)} FROM {sql.profile(*args, **kwargs)}"
    )


def drift_sql(*args, **kwargs) -> str:
    return f"SELECT {KEYS}, drift_type, column_name, {sql.rounded_columns(DOUBLES_DRIFT)} FROM {sql.drift(*args, **kwargs)}"


# --- sources ------------------------------------------------------------------------------------------------------

SEGMENTED = "SELECT c_custkey, c_acctbal, c_nationkey, nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer"
RETURNS = (
    "SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, (l_discount + 0.0) * 10 AS chance FROM lineitem"
)
PRICED = (
    "SELECT o.*, o.o_totalprice / 1097 AS total, p.predicted FROM orders o LEFT JOIN "
    "(SELECT l_orderkey, sum(l_extendedprice) / 1097 AS predicted FROM lineitem GROUP BY l_orderkey) p "
    "ON p.l_orderkey = o.o_orderkey"
)
RATED = (
    "SELECT d.doc_id, d.lang, d.n_chars, l.quality, least(d.n_chars / 5000.0, 1.0) AS score "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
)


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer")
    return customers.select(
        "c_custkey", "c_acctbal", "c_nationkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment")
    )


def returns(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.withColumns(
        {"returned": (F.col("l_returnflag") == "R").cast("int"), "chance": (F.col("l_discount") + F.lit(0.0)) * 10}
    )


def priced(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the sum of their line prices as a prediction of their total, both in another currency."""
    price = (F.sum("l_extendedprice") / 1097).alias("predicted")
    sums = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(price)
    orders = table(spark, sf, "orders").withColumn("total", F.col("o_totalprice") / 1097)
    return orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def rated(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a made-up quality score, and the label where there is one."""
    documents = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    score = F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0))
    return documents.join(labels, "doc_id", "left").withColumn("score", score)


# --- profiles -----------------------------------------------------------------------------------------------------

_LINES = Monitor("main.sales.lineitem", timestamp_column="l_shipdate", granularities=("1 month",))


@check(
    "profile_timeseries_sliced",
    profile_sql(
        "SELECT * FROM lineitem",
        "l_shipdate",
        ["1 month"],
        ["l_returnflag", "l_linestatus"],
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"],
        ["l_returnflag", "l_linestatus", "l_shipdate"],
    ),
)
def profile_timeseries_sliced(spark, sf):
    """A1, A2, A3, T2"""
    columns = (
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    monitor = Monitor(_LINES.table, "TIMESERIES", "l_shipdate", ("1 month",), ("l_returnflag", "l_linestatus"), columns)
    return flat_profile(profile(table(spark, sf, "lineitem"), monitor, distinct="exact"))


@check(
    "profile_snapshot_with_nulls",
    profile_sql(SEGMENTED, None, [], ["segment"], ["c_custkey", "c_acctbal", "c_nationkey"], ["segment"]),
)
def profile_snapshot(spark, sf):
    """A1, T4: one window for the whole table; NULL is a slice of its own."""
    monitor = Monitor("main.sales.customer", "SNAPSHOT", granularities=(), slices=("segment",))
    return flat_profile(profile(segmented(spark, sf), monitor, distinct="exact"))


@check(
    "profile_many_granularities",
    profile_sql("SELECT * FROM events", "ts", ["1 hour", "1 day", "1 week", "1 month"], [], ["value", "user_id"], ["event_type"]),
)
def profile_many_granularities(spark, sf):
    """Four granularities from one pass."""
    monitor = Monitor(
        "main.web.events", "TIMESERIES", "ts", ("1 hour", "1 day", "1 week", "1 month"), (), ("value", "user_id", "event_type")
    )
    return flat_profile(profile(table(spark, sf, "events"), monitor, distinct="exact"))


for _name, _granularity in {
    "5m": "5 minutes", "30m": "30 minutes", "1h": "1 hour", "1d": "1 day", "1w": "1 week", "2w": "2 weeks",
    "3w": "3 weeks", "4w": "4 weeks", "1mo": "1 month", "1y": "1 year",
}.items():

    @check(
        f"window_{_name}",
        f"SELECT {sql.start_of(_granularity, 'ts')} AS window_start, "
        f"{sql.start_of(_granularity, 'ts')} + INTERVAL '{_granularity}' AS window_end, "
        f"count(*) AS record_count, {r('avg(value)', 'mean')} FROM events GROUP BY 1, 2",
    )
    def _window(spark, sf, granularity=_granularity):
        """One granularity of the events."""
        monitor = Monitor("main.web.events", "TIMESERIES", "ts", (granularity,), (), ("value",))
        rows = flat_profile(profile(table(spark, sf, "events"), monitor, distinct="none"))
        return rows.filter("column_name = 'value'").select("window_start", "window_end", "record_count", "mean")


@check(
    "profile_nested_and_text",
    "SELECT 'embedding' AS column_name, count(*) AS record_count, count(DISTINCT embedding) AS distinct_count, "
    "CAST(NULL AS DOUBLE) AS mean FROM embeddings UNION ALL SELECT 'label', count(*), count(DISTINCT label), "
    f"{r('avg(label)', 'mean')} FROM embeddings UNION ALL "
    "SELECT 'text', count(*), count(DISTINCT text), NULL FROM documents",
)
def profile_nested_and_text(spark, sf):
    """A1: arrays and long texts are counted by digest and have no numeric statistics."""
    still = {"profile_type": "SNAPSHOT", "granularities": ()}
    vectors = Monitor("main.ml.embeddings", columns=("embedding", "label"), **still)
    texts = Monitor("main.ml.documents", columns=("text",), **still)
    rows = profile(table(spark, sf, "embeddings"), vectors, distinct="exact").unionByName(
        profile(table(spark, sf, "documents"), texts, distinct="exact")
    )
    return flat_profile(rows).filter("column_name != ':table'").select(
        "column_name", "record_count", "distinct_count", "mean"
    )


@check("profile_default_with_nulls", profile_sql(SEGMENTED, None, [], [], ["c_nationkey"], ["segment"]))
def profile_default_nulls(spark, sf):
    """A1 as it is by default: NULL is no value in the approximate distinct counts, which are exact at this size."""
    monitor = Monitor("main.sales.customer", "SNAPSHOT", granularities=(), columns=("c_nationkey", "segment"))
    return flat_profile(profile(segmented(spark, sf), monitor))


@check(
    "profile_map_column",
    "SELECT 'props' AS column_name, count(*) AS record_count, count(*) FILTER (WHERE user_id % 5 = 0) AS null_count, "
    "count(DISTINCT event_type || (user_id % 3)) FILTER (WHERE user_id % 5 <> 0) AS distinct_count FROM events",
)
def profile_maps(spark, sf):
    """A1: a map column, by default; maps that differ in the order of their entries are equal."""
    kind, rest = (F.lit("kind"), F.col("event_type")), (F.lit("rest"), (F.col("user_id") % 3).cast("string"))
    props = F.when(F.col("event_id") % 2 == 0, F.create_map(*kind, *rest)).otherwise(F.create_map(*rest, *kind))
    events = table(spark, sf, "events").select(F.when(F.col("user_id") % 5 != 0, props).alias("props"))
    monitor = Monitor("main.web.props", "SNAPSHOT", granularities=())
    rows = flat_profile(profile(events, monitor)).filter("column_name = 'props'")
    return rows.select("column_name", "record_count", "null_count", "distinct_count")


@check(
    "profile_baseline_log",
    profile_sql(
        "SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'", None, [], ["l_returnflag"], ["l_quantity"],
        ["l_linestatus"], "BASELINE",
    ),
)
def profile_baseline_log(spark, sf):
    """The profile of a baseline table."""
    rows = table(spark, sf, "lineitem").filter("l_shipdate < TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    monitor = Monitor(_LINES.table, "SNAPSHOT", granularities=(), slices=("l_returnflag",), columns=("l_quantity", "l_linestatus"))
    return flat_profile(profile(rows, monitor, log_type="BASELINE", distinct="exact"))


@check(
    "profile_sketch_within_bound",
    "SELECT column_name, true AS close FROM (VALUES ('l_orderkey'), ('l_partkey'), ('l_suppkey'), ('l_quantity'), "
    "('l_extendedprice'), ('l_returnflag')) t(column_name)",
)
def profile_sketch(spark, sf):
    """A1 with mergeable sketches: distinct counts within 10 % of the exact ones in every window."""
    columns = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    monitor = Monitor(_LINES.table, "TIMESERIES", "l_shipdate", ("1 year",), (), columns)
    lines = table(spark, sf, "lineitem")
    near = flat_profile(profile(lines, monitor)).select("window_start", "column_name", F.col("distinct_count").alias("near"))
    true = flat_profile(profile(lines, monitor, distinct="exact"))
    both = true.join(near, ["window_start", "column_name"], "full").filter("column_name != ':table'")
    close = F.abs(F.col("near") - F.col("distinct_count")) <= F.greatest(F.col("distinct_count") * 0.1, F.lit(1))
    return both.groupBy("column_name").agg(F.bool_and(F.coalesce(close, F.lit(False))).alias("close"))


@check(
    "partial_profiles_merge_hour_to_day",
    profile_sql("SELECT * FROM events", "ts", ["1 day"], [], ["value", "user_id"], []).replace(
        "coalesce(distinct_count, -1)", "CAST(-1 AS BIGINT)"
    ),
)
def partial_merge(spark, sf):
    """ST6: hourly partial profiles, stored, then merged to days without reading the events again."""
    columns = ("value", "user_id")
    hourly = Monitor("main.web.events", "TIMESERIES", "ts", ("1 hour",), (), columns)
    daily = Monitor("main.web.events", "TIMESERIES", "ts", ("1 day",), (), columns)
    merged = merge_profiles(partial_profiles(table(spark, sf, "events"), hourly), daily)
    return flat_profile(merged.select(*profile_columns(daily, F.lit(None).cast("bigint"), "INPUT")))


@check(
    "slice_guard",
    "SELECT * FROM (SELECT 'event_type' AS column_name, count(DISTINCT event_type) <= 50 AS safe FROM events "
    "UNION ALL SELECT 'user_id', count(DISTINCT user_id) <= 50 FROM events UNION ALL SELECT 'nope', false)",
)
def guard(spark, sf):
    """The type column may slice, the user column has too many values, one column is missing."""
    return slice_guard(table(spark, sf, "events"), ("event_type", "user_id", "nope")).select("column_name", "safe")


@check(
    "approximate_cardinality_within_bound",
    "SELECT column_name, true AS close FROM (VALUES ('o_custkey'), ('o_orderstatus'), ('o_orderpriority')) t(column_name)",
)
def cardinality(spark, sf):
    """A4: approximate distinct counts are within 15 % of the exact ones."""
    orders = table(spark, sf, "orders")
    names = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    near = approximate_cardinality(orders, names)
    exact = orders.agg(*[F.count_distinct(n).alias(n) for n in names])
    true = exact.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("n")) for n in names])))
    close = F.abs(F.col("cardinality") - F.col("n")) <= F.col("n") * 0.15
    return near.join(true, "column_name").select("column_name", close.alias("close"))


@check(
    "value_frequencies",
    "SELECT date_trunc('month', o_orderdate) AS window_start, o_orderpriority AS value, count(*) AS n "
    "FROM orders GROUP BY 1, 2",
)
def frequencies(spark, sf):
    """Value counts per window."""
    orders = table(spark, sf, "orders")
    monitor = Monitor("main.sales.orders", "TIMESERIES", "o_orderdate", ("1 month",), (), ("o_orderpriority",))
    counts = value_counts(orders, monitor).filter("c = 0")
    return counts.select(F.col("g.window_start").alias("window_start"), F.col("key").alias("value"), "n")


# --- drift --------------------------------------------------------------------------------------------------------


#: Prices in thousands keep the sixth digit of a distance clear of the rounding of large sums.
_LINES_K = "SELECT *, l_extendedprice / 1000 AS price FROM lineitem"
_ORDERS_K = "SELECT *, o_totalprice / 1000 AS price FROM orders"


def in_thousands(spark: SparkSession, sf: str, name: str, column: str) -> DataFrame:
    return table(spark, sf, name).withColumn("price", F.col(column) / 1000)


@check(
    "drift_consecutive_sliced",
    drift_sql(
        _LINES_K, "l_shipdate", ["1 month"], ["l_returnflag"], ["l_quantity", "price", "l_discount"], ["l_linestatus"],
    ),
)
def drift_consecutive(spark, sf):
    """J9, J12, T7, T8, M1-M6"""
    columns = ("l_quantity", "price", "l_discount", "l_linestatus")
    monitor = Monitor(_LINES.table, "TIMESERIES", "l_shipdate", ("1 month",), ("l_returnflag",), columns)
    return flat_drift(consecutive_drift(in_thousands(spark, sf, "lineitem", "l_extendedprice"), monitor))


@check(
    "drift_many_granularities",
    drift_sql("SELECT * FROM events", "ts", ["1 day", "1 week"], ["event_type"], ["value", "user_id"], []),
)
def drift_granularities(spark, sf):
    """Each granularity looks back in its own series."""
    monitor = Monitor("main.web.events", "TIMESERIES", "ts", ("1 day", "1 week"), ("event_type",), ("value", "user_id"))
    return flat_drift(consecutive_drift(table(spark, sf, "events"), monitor))


_EARLY = f"SELECT * FROM ({_LINES_K}) WHERE l_shipdate < TIMESTAMP '1998-01-01'"


@check(
    "drift_baseline",
    drift_sql(
        _LINES_K, "l_shipdate", ["1 year"], ["l_returnflag"], ["l_quantity", "price", "l_tax"], ["l_linestatus"],
        baseline=_EARLY,
    ),
)
def drift_baseline(spark, sf):
    """Every year against the lines shipped before 1998."""
    lines = in_thousands(spark, sf, "lineitem", "l_extendedprice")
    early = lines.filter("l_shipdate < TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    columns = ("l_quantity", "price", "l_tax", "l_linestatus")
    monitor = Monitor(_LINES.table, "TIMESERIES", "l_shipdate", ("1 year",), ("l_returnflag",), columns)
    return flat_drift(baseline_drift(lines, early, monitor))


@check(
    "drift_baseline_missing_categories",
    drift_sql(
        _ORDERS_K, "o_orderdate", ["1 month"], [], ["price"], ["o_orderpriority", "o_orderstatus"],
        baseline=f"SELECT * FROM ({_ORDERS_K}) WHERE o_orderpriority <> '1-URGENT' AND o_totalprice > 100000",
    ),
)
def drift_baseline_missing(spark, sf):
    """Categories on one side only."""
    orders = in_thousands(spark, sf, "orders", "o_totalprice")
    known = orders.filter("o_orderpriority <> '1-URGENT' AND o_totalprice > 100000")
    columns = ("price", "o_orderpriority", "o_orderstatus")
    monitor = Monitor("main.sales.orders", "TIMESERIES", "o_orderdate", ("1 month",), (), columns)
    return flat_drift(baseline_drift(orders, known, monitor))


@check(
    "drift_snapshot_against_previous",
    drift_sql(
        "SELECT * FROM customer", None, [], [], ["c_acctbal"], ["c_mktsegment"],
        baseline="SELECT * FROM customer WHERE c_acctbal > 1000",
    ).replace("'BASELINE'", "'CONSECUTIVE'"),
)
def drift_snapshot(spark, sf):
    """A snapshot against the one before."""
    customers = table(spark, sf, "customer")
    monitor = Monitor("main.sales.customer", "SNAPSHOT", granularities=(), columns=("c_acctbal", "c_mktsegment"))
    return flat_drift(snapshot_drift(customers, customers.filter("c_acctbal > 1000"), monitor))


@check(
    "drift_sketch_within_bound",
    "SELECT column_name, true AS js_close, true AS ks_close, true AS wd_close "
    "FROM (VALUES ('l_quantity'), ('l_extendedprice')) t(column_name)",
)
def drift_sketch(spark, sf):
    """J9 from sketches: distances stay near the exact ones in every window."""
    monitor = Monitor(_LINES.table, "TIMESERIES", "l_shipdate", ("1 year",), (), ("l_quantity", "l_extendedprice"))
    lines = table(spark, sf, "lineitem")
    exact = flat_drift(consecutive_drift(lines, monitor))
    spread = lines.agg(
        (F.max("l_quantity") - F.min("l_quantity")).alias("l_quantity"),
        (F.max("l_extendedprice") - F.min("l_extendedprice")).alias("l_extendedprice"),
    )
    widths = spread.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("column_name"), F.col(n).alias("width"))
                    for n in ("l_quantity", "l_extendedprice")
                ]
            )
        )
    )
    near = flat_drift(sketch_drift(lines, monitor)).select(
        "window_start",
        "column_name",
        F.col("js_distance").alias("js"),
        F.col("ks_statistic").alias("ks"),
        F.col("wasserstein_distance").alias("wd"),
    )
    both = exact.join(near, ["window_start", "column_name"], "full").join(widths, "column_name")

    def always(close) -> F.Column:
        return F.bool_and(F.coalesce(close, F.lit(False)))

    return both.groupBy("column_name").agg(
        always(F.abs(F.col("js") - F.col("js_distance")) < 0.02).alias("js_close"),
        always(F.abs(F.col("ks") - F.col("ks_statistic")) < 0.02).alias("ks_close"),
        always(F.abs(F.col("wd") - F.col("wasserstein_distance")) < 0.02 * F.col("width")).alias("wd_close"),
    )


@check(
    "drift_baseline_sketch_within_bound",
    "SELECT extract(year FROM l_shipdate)::INT AS year, c.column_name, true AS js_close, true AS ks_close "
    "FROM lineitem, (VALUES ('l_extendedprice'), ('l_quantity')) c(column_name) WHERE l_shipdate IS NOT NULL GROUP BY 1, 2",
)
def drift_baseline_sketch(spark, sf):
    """J10 from sketches: in every window the estimate stays within its bound of the exact row."""
    monitor = Monitor(_LINES.table, "TIMESERIES", "l_shipdate", ("1 year",), (), ("l_quantity", "l_extendedprice"))
    lines = table(spark, sf, "lineitem")
    known = lines.filter("l_discount < 0.05")
    exact = flat_drift(baseline_drift(lines, known, monitor))
    near = flat_drift(sketch_baseline_drift(lines, known, monitor)).select(
        "window_start", "column_name", F.col("js_distance").alias("js"), F.col("ks_statistic").alias("ks")
    )
    both = exact.join(near, ["window_start", "column_name"], "full")
    return both.select(
        F.year("window_start").alias("year"),
        "column_name",
        F.coalesce(F.abs(F.col("js") - F.col("js_distance")) < 0.02, F.lit(False)).alias("js_close"),
        F.coalesce(F.abs(F.col("ks") - F.col("ks_statistic")) < 2 * RANK_ERROR, F.lit(False)).alias("ks_close"),
    )


#: Quantities with NaN and both infinities; in the first month there is nothing else.
_ODD = (
    "SELECT *, CASE WHEN l_shipdate < TIMESTAMP '1995-02-01' OR l_linenumber = 7 THEN 'NaN'::DOUBLE "
    "WHEN l_linenumber = 6 AND l_discount > 0.05 THEN 'Infinity'::DOUBLE WHEN l_tax > 0.075 THEN '-Infinity'::DOUBLE "
    "ELSE l_quantity END AS amount FROM lineitem"
)


def not_finite(spark: SparkSession, sf: str) -> DataFrame:
    amount = (
        F.when((F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ'1995-02-01 00:00:00'")) | (F.col("l_linenumber") == 7), float("nan"))
        .when((F.col("l_linenumber") == 6) & (F.col("l_discount") > 0.05), float("inf"))
        .when(F.col("l_tax") > 0.075, float("-inf"))
        .otherwise(F.col("l_quantity"))
    )
    return table(spark, sf, "lineitem").withColumn("amount", amount)


@check(
    "drift_consecutive_not_finite",
    drift_sql(_ODD, "l_shipdate", ["1 month"], ["l_returnflag"], ["amount", "l_tax"], ["l_linestatus"]),
)
def drift_odd(spark, sf):
    """NaN and the infinities count as categories beside the bins."""
    columns = ("amount", "l_tax", "l_linestatus")
    monitor = Monitor(_LINES.table, "TIMESERIES", "l_shipdate", ("1 month",), ("l_returnflag",), columns)
    return flat_drift(consecutive_drift(not_finite(spark, sf), monitor))


@check(
    "drift_baseline_not_finite",
    drift_sql(
        _ODD, "l_shipdate", ["1 year"], ["l_returnflag"], ["amount", "l_tax"], ["l_linestatus"],
        baseline=f"SELECT * FROM ({_ODD}) WHERE l_quantity < 30",
    ),
)
def drift_baseline_odd(spark, sf):
    """The same against a baseline."""
    lines = not_finite(spark, sf)
    columns = ("amount", "l_tax", "l_linestatus")
    monitor = Monitor(_LINES.table, "TIMESERIES", "l_shipdate", ("1 year",), ("l_returnflag",), columns)
    return flat_drift(baseline_drift(lines, lines.filter("l_quantity < 30"), monitor))


# --- model quality ------------------------------------------------------------------------------------------------

_CHANCE = Monitor(
    "main.ml.returns", "INFERENCE", "l_shipdate", ("1 year",), ("l_linestatus",), ("l_quantity", "l_tax"), "chance", "returned"
)
_PRICE = Monitor(
    "main.ml.prices", "INFERENCE", "o_orderdate", ("1 month",), ("o_orderpriority",), ("o_totalprice", "o_orderstatus"),
    "predicted", "total", problem_type=REGRESSION,
)


def scores_sql(inner: str) -> str:
    doubles = sql.rounded_columns(sql.CLASSIFICATION + sql.REGRESSION)
    return f"SELECT window_start, window_end, granularity, column_name, {doubles}, slice_key, slice_value FROM {inner}"


def flat_scores(df: DataFrame, monitor: Monitor) -> DataFrame:
    rows = performance(df, monitor).withColumn("column_name", F.lit(":table"))
    return rows.select(*performance_projection(monitor.problem_type))


@check(
    "model_binary_scores",
    scores_sql(sql.classification(RETURNS, "l_shipdate", ["1 year"], ["l_linestatus"], "chance", "returned")),
)
def model_binary(spark, sf):
    """M7-M16, T9 with a probability."""
    return flat_scores(returns(spark, sf), _CHANCE)


_CLASSES = {"A": "chance_a", "N": "chance_n", "R": "chance_r"}
_THREE = (
    "SELECT *, CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END AS guess, CAST(l_discount AS DOUBLE) AS chance_a, "
    "CAST(l_tax AS DOUBLE) AS chance_n, CAST(l_quantity AS DOUBLE) / 50 AS chance_r FROM lineitem"
)


@check(
    "model_class_scores",
    f"SELECT window_start, granularity, slice_key, slice_value, {r('roc_auc_weighted', 'roc_auc_weighted')} FROM "
    f"{sql.one_vs_one(_THREE, 'l_shipdate', ['1 month', '1 year'], ['l_linestatus'], _CLASSES, 'l_returnflag')}",
)
def model_classes(spark, sf):
    """Three classes with a score each."""
    scores = {"chance_a": "l_discount", "chance_n": "l_tax", "chance_r": "l_quantity"}
    made = {name: F.col(column).cast("double") for name, column in scores.items()}
    lines = table(spark, sf, "lineitem").withColumns({**made, "chance_r": made["chance_r"] / 50})
    lines = lines.withColumn("guess", F.when(F.col("l_linestatus") == "F", "R").otherwise("N"))
    monitor = Monitor(
        "main.ml.flags", "INFERENCE", "l_shipdate", ("1 month", "1 year"), ("l_linestatus",), (), "guess", "l_returnflag",
        class_scores=tuple(_CLASSES.items()),
    )
    keys = [F.col("window.start").alias("window_start"), "granularity", "slice_key", "slice_value"]
    return performance(lines, monitor).select(*keys, F.col("roc_auc_score.one_vs_one.weighted").alias("roc_auc_weighted"))


@check(
    "model_regression_scores",
    scores_sql(sql.regression(PRICED, "o_orderdate", ["1 month"], ["o_orderpriority"], "predicted", "total")),
)
def model_regression(spark, sf):
    """M17-M21; orders without lines have no prediction."""
    return flat_scores(priced(spark, sf), _PRICE)


@check(
    "model_document_quality",
    scores_sql(sql.classification(RATED, None, [], ["lang"], "score", "quality")),
)
def model_documents(spark, sf):
    """Labelled documents only, sliced by language, no time column."""
    monitor = Monitor("main.ml.quality", "INFERENCE", None, (), ("lang",), (), "score", "quality")
    return flat_scores(rated(spark, sf), monitor)


@check(
    "model_multiclass_confusion",
    "SELECT year(o_orderdate) AS y, o_orderstatus AS label, "
    "CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' ELSE 'P' END AS guess, count(*) AS n "
    "FROM orders GROUP BY ALL",
)
def model_confusion(spark, sf):
    """The confusion table of a three-class model."""
    table = confusion(confusion_counts(_guessed(spark, sf), _STATUS, False), _STATUS, None)
    return table.select(F.year("g.window_start").alias("y"), "label", "guess", "n")


_KINDS = {"whole_and_double": ("truth", "said"), "flag_and_whole": ("flag", "said_flag")}


@check(
    "model_classes_of_different_types",
    "SELECT 'whole_and_double' AS kind, year(l_shipdate) AS y, round(avg(CASE WHEN l_quantity > 25 OR l_linenumber % 3 = 1 "
    "THEN 1.0 ELSE 0.0 END) + 0.0000000234, 6) AS accuracy_score, true AS no_loss, true AS no_area FROM lineitem GROUP BY 2 UNION ALL "
    "SELECT 'flag_and_whole', year(l_shipdate), round(avg(CASE WHEN (l_returnflag = 'R') = (l_quantity > 25) THEN 1.0 "
    "ELSE 0.0 END) + 0.0000000234, 6), true, true FROM lineitem GROUP BY 2",
)
def model_types(spark, sf):
    """Classes are compared by value whatever their types; without probabilities no log loss and no area."""
    lines = table(spark, sf, "lineitem").withColumns(
        {
            "truth": F.col("l_linenumber") % 3,
            "said": F.when(F.col("l_quantity") > 25, F.col("l_linenumber") % 3).otherwise(1).cast("double"),
            "flag": F.col("l_returnflag") == "R",
            "said_flag": (F.col("l_quantity") > 25).cast("int"),
        }
    )
    parts = []
    for kind, (label, said) in _KINDS.items():
        monitor = Monitor("main.ml.kinds", "INFERENCE", "l_shipdate", ("1 year",), (), (), said, label)
        parts.append(
            performance(lines, monitor).select(
                F.lit(kind).alias("kind"),
                F.year("window.start").cast("bigint").alias("y"),
                "accuracy_score",
                F.col("log_loss").isNull().alias("no_loss"),
                F.col("roc_auc_score").isNull().alias("no_area"),
            )
        )
    return parts[0].unionByName(parts[1])


_STATUS = Monitor("main.ml.status", "INFERENCE", "o_orderdate", ("1 year",), (), (), "guess", "o_orderstatus")


def _guessed(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    guess = F.when(price > 300000, "F").when(price > 150000, "O").otherwise("P")
    return table(spark, sf, "orders").withColumn("guess", guess)


_MULTI = """WITH t AS (SELECT date_trunc('year', o_orderdate) AS ws, o_orderstatus AS label,
  CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' ELSE 'P' END AS guess FROM orders),
c AS (SELECT ws, k.class, sum(CASE WHEN label = k.class THEN 1 ELSE 0 END)::DOUBLE AS support,
  sum(CASE WHEN guess = k.class THEN 1 ELSE 0 END)::DOUBLE AS guessed,
  sum(CASE WHEN label = k.class AND guess = k.class THEN 1 ELSE 0 END)::DOUBLE AS hits
  FROM t CROSS JOIN (VALUES ('F'), ('O'), ('P')) k(class) GROUP BY ws, k.class),
s AS (SELECT *, coalesce(hits / nullif(guessed, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS rc FROM c)
SELECT ws AS window_start, round(sum(hits) / sum(support), 6) AS accuracy_score,
  round(sum(p * support) / sum(support), 6) AS precision_weighted,
  round(sum(rc * support) / sum(support), 6) AS recall_weighted,
  round(sum(coalesce(2 * p * rc / nullif(p + rc, 0), 0) * support) / sum(support), 6) AS f1_weighted,
  CAST(NULL AS DOUBLE) AS roc_auc_weighted FROM s GROUP BY ws"""


@check("model_multiclass_scores", _MULTI)
def model_multiclass(spark, sf):
    """M7, M9-M11 with class predictions; no probability, so no area under the curve."""
    names = ["window_start", "accuracy_score", "precision_weighted", "recall_weighted", "f1_weighted", "roc_auc_weighted"]
    return flat_scores(_guessed(spark, sf), _STATUS).select(*names)


# --- custom metrics -----------------------------------------------------------------------------------------------

_CUSTOM = (
    CustomMetric("revenue", "aggregate", (":table",), "SUM(l_extendedprice * (1 - l_discount))"),
    CustomMetric(
        "high_share", "aggregate", ("l_quantity", "l_tax"),
        "AVG(CASE WHEN {{input_column}} > 0.05 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)",
    ),
    CustomMetric("top_flag", "aggregate", (":table",), "MAX(l_returnflag)", "string"),
    CustomMetric("null_ratio", "derived", ("null_count", "count"), "{{null_count}} / NULLIF({{count}}, 0)"),
    CustomMetric("revenue_per_row", "derived", (":table",), "{{revenue}} / NULLIF({{count}}, 0)"),
    CustomMetric("mean_change", "drift", ("l_quantity",), "{{current_df}}.avg - {{base_df}}.avg"),
)
_MEASURED = Monitor(
    _LINES.table, "TIMESERIES", "l_shipdate", ("1 year",), ("l_linestatus",), ("l_quantity", "l_tax"), custom_metrics=_CUSTOM
)
_YEARS = sql.windowed("SELECT * FROM lineitem", "l_shipdate", ["1 year"], ["l_linestatus"])


def _custom_rows(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    rows = with_custom_aggregates(profile(lines, _MEASURED, distinct="none"), custom_aggregates(lines, _MEASURED))
    return with_derived(rows, _CUSTOM, lines.columns)


@check(
    "custom_aggregate_and_derived_metrics",
    f"WITH w AS ({_YEARS}), t AS (SELECT ws, slice_key, slice_value, count(*) AS n, "
    "sum(l_extendedprice * (1 - l_discount)) AS revenue, "
    "avg(CASE WHEN l_quantity > 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS q, "
    "avg(CASE WHEN l_tax > 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS x, max(l_returnflag) AS top_flag FROM w GROUP BY 1, 2, 3) "
    "SELECT ws AS window_start, slice_key, slice_value, ':table' AS column_name, round(revenue, 2) AS revenue, "
    "CAST(NULL AS DOUBLE) AS high_share, top_flag, CAST(NULL AS DOUBLE) AS null_ratio, "
    "round(revenue / n, 6) AS revenue_per_row FROM t "
    "UNION ALL SELECT ws, slice_key, slice_value, 'l_quantity', NULL, round(q, 6), NULL, 0.0, NULL FROM t "
    "UNION ALL SELECT ws, slice_key, slice_value, 'l_tax', NULL, round(x, 6), NULL, 0.0, NULL FROM t",
)
def custom_values(spark, sf):
    """A14, A15, F4"""
    return _custom_rows(spark, sf).select(
        F.col("window.start").alias("window_start"), "slice_key", "slice_value", "column_name",
        F.round("revenue", 2).alias("revenue"), "high_share", "top_flag", "null_ratio", "revenue_per_row",
    )


@check(
    "custom_drift_metric",
    f"WITH w AS ({_YEARS}), t AS (SELECT ws, slice_key, slice_value, avg(l_quantity) AS mean FROM w GROUP BY 1, 2, 3) "
    "SELECT * FROM (SELECT ws AS window_start, slice_key, slice_value, "
    "round(mean - lag(mean) OVER (PARTITION BY slice_key, slice_value ORDER BY ws), 6) AS mean_change FROM t) "
    "WHERE mean_change IS NOT NULL",
)
def custom_change(spark, sf):
    """A16 against the window before."""
    rows = custom_drift(_custom_rows(spark, sf), _CUSTOM).filter("column_name = 'l_quantity'")
    return rows.select(F.col("window.start").alias("window_start"), "slice_key", "slice_value", "mean_change")


@check(
    "custom_drift_metric_baseline",
    f"WITH w AS ({_YEARS}), t AS (SELECT ws, slice_key, slice_value, avg(l_quantity) AS mean FROM w GROUP BY 1, 2, 3), "
    f"b AS (SELECT slice_key, slice_value, avg(l_quantity) AS mean FROM ({sql.windowed(_EARLY, None, [], ['l_linestatus'])}) "
    "GROUP BY 1, 2) SELECT t.ws AS window_start, t.slice_key, t.slice_value, round(t.mean - b.mean, 6) AS mean_change "
    "FROM t JOIN b ON t.slice_key IS NOT DISTINCT FROM b.slice_key AND t.slice_value IS NOT DISTINCT FROM b.slice_value",
)
def custom_change_baseline(spark, sf):
    """A16 against a baseline profile."""
    early = table(spark, sf, "lineitem").filter("l_shipdate < TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    still = Monitor(_LINES.table, "SNAPSHOT", granularities=(), slices=("l_linestatus",), columns=("l_quantity", "l_tax"))
    base = profile(early, still, log_type="BASELINE", distinct="none")
    current = profile(table(spark, sf, "lineitem"), _MEASURED, distinct="none")
    rows = custom_drift(current, _CUSTOM, base).filter("column_name = 'l_quantity'")
    return rows.select(F.col("window.start").alias("window_start"), "slice_key", "slice_value", "mean_change")


@check(
    "custom_metric_with_sql_function",
    f"WITH w AS ({sql.windowed(PRICED, 'o_orderdate', ['1 year'], ['o_orderstatus'])}) SELECT ws AS window_start, slice_key, "
    "slice_value, round(avg(abs(predicted - total) / (abs(predicted) + abs(total))), 6) AS smape FROM w GROUP BY 1, 2, 3",
)
def custom_function(spark, sf):
    """A metric built on a function the user created."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION relative_gap(a DOUBLE, b DOUBLE) RETURNS DOUBLE "
        "RETURN abs(a - b) / (abs(a) + abs(b))"
    )
    metric = CustomMetric("smape", "aggregate", (":table",), "AVG(relative_gap({{prediction_col}}, {{label_col}}))")
    monitor = Monitor(
        "main.ml.prices", "INFERENCE", "o_orderdate", ("1 year",), ("o_orderstatus",), (), "predicted", "total",
        problem_type=REGRESSION, custom_metrics=(metric,),
    )
    rows = custom_aggregates(priced(spark, sf), monitor)
    return rows.select(F.col("window.start").alias("window_start"), "slice_key", "slice_value", "smape")


@check(
    "metric_table_contract",
    f"SELECT granularity, column_name, count(*) AS n, sum(record_count)::BIGINT AS record_count, "
    f"count(accuracy_score) AS scored, {r('max(accuracy_score)', 'best')} FROM (SELECT p.*, s.accuracy_score FROM "
    f"{sql.profile(RETURNS, 'l_shipdate', ['1 year'], ['l_linestatus'], ['l_quantity', 'l_tax'])} p LEFT JOIN "
    f"{sql.classification(RETURNS, 'l_shipdate', ['1 year'], ['l_linestatus'], 'chance', 'returned')} s "
    "ON p.column_name = s.column_name AND p.window_start = s.window_start "
    "AND p.slice_key IS NOT DISTINCT FROM s.slice_key AND p.slice_value IS NOT DISTINCT FROM s.slice_value) "
    "GROUP BY 1, 2",
)
def contract(spark, sf):
    """A2: scores sit on the table rows of the profile."""
    rows = with_performance(profile(returns(spark, sf), _CHANCE), performance(returns(spark, sf), _CHANCE))
    return rows.groupBy("granularity", "column_name").agg(
        F.count("*").alias("n"),
        F.sum("count").alias("record_count"),
        F.count("accuracy_score").alias("scored"),
        F.max("accuracy_score").alias("best"),
    )


