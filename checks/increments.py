"""Checks of incremental runs, versions and snapshot history (ST2, ST4 with J9 and M7-M16, S6, T4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql
from checks.base import check, table
from checks.engine import RETURNS, drift_sql, flat_drift, flat_profile, profile_sql, returns, scores_sql
from watchmill.operators.unify import performance_projection
from watchmill.plans.increment import CHANGE
from watchmill.plans.run import run
from watchmill.schemas import DRIFT_METRICS, PROFILE_METRICS
from watchmill.settings import CLASSIFICATION, ProfileDefaults, RunSettings, TableSettings
from watchmill.sources.ledger import read_version
from watchmill.sources.scratch import new_path

NAME = "main.checked.log"


def _run(out: str, rows: DataFrame, defaults: dict, own: dict, changes: DataFrame | None = None) -> None:
    """One incremental run over a table that holds these rows."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "log")
    rows.write.parquet(path)
    settings = RunSettings("main", ProfileDefaults("monitoring", **defaults), monitored_tables={NAME: TableSettings(**own)})
    fed = {NAME: changes} if changes is not None else None
    report = run(spark, settings, out, {}, {NAME: path}, distinct="exact", incremental=True, changes=fed)
    if report.tables[NAME] != "created":
        raise RuntimeError(report.tables[NAME])


def _stored(spark: SparkSession, out: str, kind: str) -> DataFrame:
    schema = PROFILE_METRICS if kind == "profile" else DRIFT_METRICS
    return read_version(spark, f"{out}/log_{kind}_metrics", f"{out}/log_ledger", schema, kind)


def _timed(at: str) -> dict:
    return {"profile_type": "TIMESERIES", "timeseries_timestamp_column": at}


@check(
    "incremental_drift",
    drift_sql("SELECT * FROM events", "ts", ["1 day", "1 week"], ["event_type"], ["value", "user_id"], []),
)
def incremental_drift(spark, sf):
    """ST4, J9: two thirds of the events come first; the others are late rows of every window, and of windows not seen yet."""
    events = table(spark, sf, "events").select("ts", "event_type", "value", "user_id", "event_id")
    late = (F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0) | (F.dayofweek("ts") == 4)
    out, own = new_path(spark, "run"), {"granularities": ("1 day", "1 week"), "slicing_exprs": ("event_type",)}
    kept = events.drop("event_id")
    _run(out, events.filter(~late).drop("event_id"), _timed("ts"), own)
    _run(out, kept, _timed("ts"), own, events.filter(late).drop("event_id"))
    return flat_drift(_stored(spark, out, "drift")).filter("column_name IN ('value', 'user_id')")


@check(
    "incremental_profile_of_updated_rows",
    profile_sql("SELECT * FROM events", "ts", ["1 day", "1 month"], ["event_type"], ["value", "user_id"], []),
)
def incremental_profile(spark, sf):
    """ST4, ST2: a fifth of the rows is stored wrongly at first, some of them in windows that vanish; a change feed mends that."""
    events = table(spark, sf, "events").select("ts", "event_type", "value", "user_id", "event_id")
    wrong = F.pmod(F.xxhash64("event_id"), F.lit(5)) == 0
    first = events.withColumns(
        {"value": F.when(wrong, F.col("value") * 1000 + 7).otherwise(F.col("value")), "ts": F.when(wrong, F.col("ts") + F.expr("INTERVAL 400 DAYS")).otherwise(F.col("ts"))}
    )
    before = first.filter(wrong).withColumn(CHANGE, F.lit("update_preimage"))
    feed = before.unionByName(events.filter(wrong).withColumn(CHANGE, F.lit("update_postimage")))
    out, own = new_path(spark, "run"), {"granularities": ("1 day", "1 month"), "slicing_exprs": ("event_type",)}
    _run(out, first.drop("event_id"), _timed("ts"), own)
    _run(out, events.drop("event_id"), _timed("ts"), own, feed.drop("event_id"))
    return flat_profile(_stored(spark, out, "profile")).filter("column_name IN (':table', 'value', 'user_id')")


@check(
    "incremental_model_scores",
    scores_sql(sql.classification(RETURNS, "l_shipdate", ["1 year"], ["l_linestatus"], "chance", "returned")),
)
def incremental_scores(spark, sf):
    """ST4, M7-M16: labels of a third of the rows come later, as updates of rows without one."""
    lines = returns(spark, sf).select("l_shipdate", "l_linestatus", "chance", "returned", "l_orderkey")
    late = F.pmod(F.xxhash64("l_orderkey"), F.lit(3)) == 0
    first = lines.withColumn("returned", F.when(~late, F.col("returned")))
    before = first.filter(late).withColumn(CHANGE, F.lit("update_preimage"))
    feed = before.unionByName(lines.filter(late).withColumn(CHANGE, F.lit("update_postimage")))
    defaults = {"timestamp_column": "l_shipdate", "prediction_column": "chance", "label_column": "returned"}
    out, own = new_path(spark, "run"), {"granularities": ("1 year",), "slicing_exprs": ("l_linestatus",)}
    _run(out, first.drop("l_orderkey"), defaults, own)
    _run(out, lines.drop("l_orderkey"), defaults, own, feed.drop("l_orderkey"))
    scores = _stored(spark, out, "profile").filter("column_name = ':table' AND log_type = 'INPUT'")
    return scores.select(*performance_projection(CLASSIFICATION))


@check(
    "snapshot_history_drift",
    drift_sql(
        "SELECT * FROM customer", None, [], [], ["c_acctbal"], ["c_mktsegment"],
        baseline="SELECT * FROM customer WHERE c_acctbal > 1000",
    ).replace("'BASELINE'", "'CONSECUTIVE'"),
)
def snapshot_history(spark, sf):
    """Two runs of a snapshot; the second is compared with the value counts that the first one kept."""
    customers = table(spark, sf, "customer").select("c_acctbal", "c_mktsegment")
    out, own = new_path(spark, "run"), {"profile_type": "SNAPSHOT"}
    _run(out, customers.filter("c_acctbal > 1000"), _timed("unused"), own)
    _run(out, customers, _timed("unused"), own)
    return flat_drift(_stored(spark, out, "drift"))
