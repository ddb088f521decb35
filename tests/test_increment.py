"""Incremental runs against full ones, killed runs, and snapshots that are compared with stored ones."""

import math

import pytest
from pyspark.sql import functions as F

from watchmill.plans import run as plan
from watchmill.plans.increment import CHANGE, signed
from watchmill.plans.run import run
from watchmill.schemas import DRIFT_METRICS, PROFILE_METRICS
from watchmill.settings import REGRESSION, CustomMetric, ProfileDefaults, RunSettings, TableSettings
from watchmill.sources.ledger import committed, ledger, read_version
from watchmill.sources.scratch import materialize, new_path

TABLE = "main.ml.log"
COLUMNS = ["at", "kind", "shop", "amount", "score", "label", "day"]


def settings(**own):
    asked = {"profile_type": "INFERENCE", "granularities": ("1 day", "1 month"), "slicing_exprs": ("kind",)} | own
    return RunSettings(
        "main",
        ProfileDefaults("monitoring", timestamp_column="at", prediction_column="score", label_column="label"),
        monitored_tables={TABLE: TableSettings(**asked)},
    )


def rows_of(spark, n=400, start=0):
    """Rows over some weeks with gaps, null instants, nulls, values that are not finite, ties and repeats."""
    i = F.col("id")
    day = F.when(i % 7 == 0, i % 11).otherwise((i * 37) % 70)
    amount = F.when(i % 13 == 0, F.lit(float("nan"))).when(i % 29 == 0, F.lit(float("inf"))).when(i % 5 == 0, None).otherwise((i * 31) % 17 * 1.25)
    return spark.range(start, start + n).select(
        F.when(i % 97 != 0, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(F.when(day.between(20, 30), 5).otherwise(day), i % 24)).alias("at"),
        F.when(i % 3 > 0, F.concat(F.lit("k"), (i % 3).cast("string"))).alias("kind"),
        (i % 4).cast("string").alias("shop"),
        amount.alias("amount"),
        ((i * 53) % 101 / 101.0).alias("score"),
        F.when(i % 11 != 0, (i % 2).cast("int")).alias("label"),
        F.to_date(F.expr("DATE'2024-01-01'")).alias("day"),
    )


def stored(spark, out, kind):
    leaf = f"{out}/log"
    schema = PROFILE_METRICS if kind == "profile" else DRIFT_METRICS
    return read_version(spark, f"{leaf}_{kind}_metrics", f"{leaf}_ledger", schema, kind)


def flat(row):
    for value in row:
        if isinstance(value, tuple):
            yield from flat(value)
        else:
            yield value


def alike(left, right):
    """Equal rows in any order, doubles to nine digits."""

    def key(row):
        return tuple((value is None, str(value)) for value in flat(row) if not isinstance(value, float))

    a, b = sorted(left.collect(), key=key), sorted(right.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b]
    for one, other in zip(a, b):
        for x, y in zip(flat(one), flat(other)):
            assert (x == y) or (isinstance(x, float) and (math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))), (one, other)
    return len(a)


def written(df):
    path = new_path(df.sparkSession, "log")
    df.write.parquet(path)
    return path


def step(spark, out, df, asked, changes=None, incremental=True, distinct="exact", base=None, **more):
    paths = {TABLE: written(df)} | ({"main.base.log": base} if base else {})
    report = run(spark, asked, out, {}, paths, incremental=incremental, changes={TABLE: changes} if changes is not None else None, distinct=distinct, **more)
    assert report.tables == {TABLE: "created"}, report.tables
    return report


METRICS = (
    CustomMetric("total", "aggregate", (":table", "amount"), "SUM(nanvl(amount, 0))"),
    CustomMetric("moved", "drift", ("score",), "{{current_df}}.avg - {{base_df}}.avg"),
)


def test_half_and_increments_equal_a_full_run(spark):
    asked = settings(baseline_table_name="main.base.log", custom_metrics=METRICS)
    base = written(rows_of(spark, 150, 5000).drop("shop"))
    whole = materialize(rows_of(spark), "whole")
    keyed = F.xxhash64("at", "score", "amount") % 3
    first, second, third = (materialize(whole.filter(keyed == i), "part") for i in (-1, 0, 1))
    rest = materialize(whole.filter(~keyed.isin(-1, 0, 1)), "part")
    out, plain = new_path(spark, "run"), new_path(spark, "run")
    step(spark, out, first, asked, base=base)
    step(spark, out, first.unionByName(second), asked, second, base=base)
    third = third.unionByName(rest)
    report = step(spark, out, whole, asked, third.withColumn(CHANGE, F.lit("insert")).withColumn("_commit_version", F.lit(3)), base=base)
    assert report.without_time == {TABLE: third.filter("at IS NULL").count()}
    assert committed(spark, f"{out}/log_ledger").full == 1 and committed(spark, f"{out}/log_ledger").run == 3
    step(spark, plain, whole, asked, incremental=False, base=base)
    for kind in ("profile", "drift"):
        assert alike(stored(spark, out, kind), stored(spark, plain, kind)) > 50
    extra = ["window", "granularity", "slice_key", "slice_value", "column_name", "total"]
    schema = spark.read.parquet(f"{plain}/log_profile_metrics").select(*extra).schema
    alike(*(read_version(spark, f"{o}/log_profile_metrics", f"{o}/log_ledger", schema, "profile").filter("total IS NOT NULL") for o in (out, plain)))
    schema = spark.read.parquet(f"{plain}/log_drift_metrics").select(*extra[:-1], "drift_type", "moved").schema
    alike(*(read_version(spark, f"{o}/log_drift_metrics", f"{o}/log_ledger", schema, "drift") for o in (out, plain)))


@pytest.mark.parametrize("distinct, own", [("exact", {}), ("approx", {"problem_type": REGRESSION, "granularities": ("1 week",)})])
def test_rows_that_went_or_changed(spark, distinct, own):
    """Deleted windows vanish with their drift, their successors are compared with what is left before them."""
    asked = settings(**own)
    whole = materialize(rows_of(spark), "whole")
    out, plain = new_path(spark, "run"), new_path(spark, "run")
    step(spark, out, whole, asked, distinct=distinct)
    gone = F.coalesce(F.col("at").between("2024-01-10", "2024-01-14") | (F.col("at") < F.lit("2024-01-03")) | (F.col("shop") == "3"), F.lit(False))
    changed = F.coalesce(~gone & (F.dayofmonth("at") == 20), F.lit(False))
    updated = whole.filter(changed).withColumns({"amount": F.col("score") * 100, "label": 1 - F.col("label")})
    feed = whole.filter(gone).withColumn(CHANGE, F.lit("delete"))
    feed = feed.unionByName(whole.filter(changed).withColumn(CHANGE, F.lit("update_preimage")))
    feed = materialize(feed.unionByName(updated.withColumn(CHANGE, F.lit("update_postimage"))), "feed")
    left = materialize(whole.filter(~gone & ~changed).unionByName(updated), "left")
    step(spark, out, left, asked, feed, distinct=distinct)
    step(spark, plain, left, asked, incremental=False, distinct=distinct)
    for kind in ("profile", "drift"):
        alike(stored(spark, out, kind), stored(spark, plain, kind))
    # Rows come back to windows that had vanished.
    back = materialize(whole.filter(gone).filter(F.col("shop") != "3"), "back")
    again = left.unionByName(back)
    step(spark, out, again, asked, back, distinct=distinct)
    second = new_path(spark, "run")
    step(spark, second, again, asked, incremental=False, distinct=distinct)
    for kind in ("profile", "drift"):
        alike(stored(spark, out, kind), stored(spark, second, kind))


def test_rows_past_the_mark_are_taken_in(spark):
    asked = settings(granularities=("1 day",))
    whole = materialize(rows_of(spark).filter("at IS NOT NULL"), "whole")
    early = whole.filter("at <= '2024-02-01 05:00:00'")
    out, plain = new_path(spark, "run"), new_path(spark, "run")
    step(spark, out, early, asked)
    first = committed(spark, f"{out}/log_ledger")
    step(spark, out, whole, asked)
    second = committed(spark, f"{out}/log_ledger")
    assert (first.run, second.run, second.full) == (1, 2, 1) and first.mark < second.mark
    # Only what lies past the mark was read into the state, and windows that were not touched were not written again.
    counted = spark.read.parquet(f"{out}/log_state/groups").filter("run = 2 AND g.slice IS NULL").agg(F.sum("n")).first()[0]
    assert counted == whole.filter("at > '2024-02-01 05:00:00'").count()
    assert ledger(spark, f"{out}/log_ledger").filter("kind = 'profile' AND window_date < '2024-02-01'").count() == 0
    step(spark, plain, whole, asked, incremental=False)
    for kind in ("profile", "drift"):
        alike(stored(spark, out, kind), stored(spark, plain, kind))
    # Nothing new: nothing changes.
    step(spark, out, whole, asked)
    assert committed(spark, f"{out}/log_ledger").mark == second.mark
    alike(stored(spark, out, "drift"), stored(spark, plain, "drift"))
    # Other settings make a full run due.
    step(spark, out, whole, settings(granularities=("1 week",)))
    assert committed(spark, f"{out}/log_ledger").full == 4
    assert {r.granularity for r in stored(spark, out, "profile").select("granularity").distinct().collect()} == {"1 week"}


def test_a_first_run_may_look_back_some_days(spark):
    out = new_path(spark, "run")
    rows = rows_of(spark).filter("at IS NOT NULL")
    step(spark, out, rows, settings(granularities=("1 day",)), lookback_days=7)
    latest = rows.agg(F.max("at")).first()[0]
    first = stored(spark, out, "profile").agg(F.min("window.start")).first()[0]
    assert (latest - first).days <= 7


def test_a_killed_run_leaves_the_old_version(spark, monkeypatch):
    asked = settings(granularities=("1 day",))
    whole = materialize(rows_of(spark), "whole")
    half = whole.filter("shop < '2'")
    rest = materialize(whole.filter("shop >= '2'"), "rest")
    out, plain = new_path(spark, "run"), new_path(spark, "run")
    step(spark, out, half, asked)
    before = {kind: materialize(stored(spark, out, kind), "before") for kind in ("profile", "drift")}

    def killed(*args, **kwargs):
        raise RuntimeError("killed")

    with monkeypatch.context() as broken:
        broken.setattr(plan, "commit", killed)
        report = run(spark, asked, out, {}, {TABLE: written(whole)}, incremental=True, changes={TABLE: rest}, distinct="exact")
        assert report.tables[TABLE].startswith("failed")
    for kind in ("profile", "drift"):
        alike(stored(spark, out, kind), before[kind])
    # The next run uses the number again, and what the killed one left counts once.
    step(spark, out, whole, asked, rest)
    step(spark, plain, whole, asked, incremental=False)
    for kind in ("profile", "drift"):
        alike(stored(spark, out, kind), stored(spark, plain, kind))


def test_windows_vanish_with_a_full_run(spark):
    out = new_path(spark, "run")
    whole = materialize(rows_of(spark), "whole")
    step(spark, out, whole, settings(), incremental=False)
    step(spark, out, whole.filter("at < '2024-01-20'"), settings(granularities=("1 day",)), incremental=False)
    assert {r.granularity for r in stored(spark, out, "profile").select("granularity").distinct().collect()} == {"1 day"}
    assert stored(spark, out, "drift").filter("window.start >= '2024-01-20'").count() == 0


def test_two_runs_of_a_snapshot_give_drift(spark):
    asked = settings(profile_type="SNAPSHOT", granularities=None)
    first, second = rows_of(spark, 200), rows_of(spark, 300, 100).withColumn("fresh", F.lit("x")).withColumn("shop", F.lit(1))
    out = new_path(spark, "run")
    step(spark, out, first, asked)
    assert stored(spark, out, "drift").count() == 0
    step(spark, out, second, asked)
    rows = stored(spark, out, "drift")
    names = {r.column_name for r in rows.collect()}
    # A column that is new, or has another type, has no drift.
    assert names == {"kind", "amount", "score", "label"} and {r.drift_type for r in rows.collect()} == {"CONSECUTIVE"}
    from watchmill.operators.drift import snapshot_drift
    from watchmill.settings import Monitor

    monitor = Monitor(TABLE, "SNAPSHOT", granularities=(), slices=("kind",), columns=("kind", "amount", "score", "label"))
    alike(rows, snapshot_drift(second, first, monitor))


def test_kinds_of_change(spark):
    feed = spark.createDataFrame([(1, "insert"), (2, "delete"), (3, "update_preimage"), (4, "update_postimage")], f"x int, {CHANGE} string")
    assert [(r.x, r["__sign"]) for r in signed(feed).collect()] == [(1, 1), (2, -1), (3, -1), (4, 1)]
    with pytest.raises(Exception, match="not a kind of change"):
        signed(spark.createDataFrame([(1, "moved")], f"x int, {CHANGE} string")).collect()
