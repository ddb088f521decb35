"""Area under the curve of several classes: against pairs counted one by one, odd rows, signed counts, settings."""

from __future__ import annotations

import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import checks.engine  # noqa: F401
from checks.base import QUERIES
from watchmill.operators.frequencies import SIGN
from watchmill.operators.performance import labelled, performance, performance_of, performance_partials
from watchmill.settings import Monitor, ProfileDefaults, RunSettings, TableSettings, resolve_monitor, settings_problems

CLASSES = (("a", "pa"), ("b", "pb"), ("c", "pc"))
MONITOR = Monitor("a.b.c", "INFERENCE", None, (), (), (), "p", "y", class_scores=CLASSES)
SCHEMA = "p string, y string, pa double, pb double, pc double"


def plain(rows):
    """Every pair of rows of two classes, ties half."""
    top = bottom = 0.0
    for k, j in itertools.permutations(range(3), 2):
        mine = [r[2 + k] for r in rows if r[1] == CLASSES[k][0]]
        other = [r[2 + k] for r in rows if r[1] == CLASSES[j][0]]
        if mine and other:
            won = sum((x > y) + (x == y) / 2 for x in mine for y in other)
            top += won / (len(mine) * len(other)) * (len(mine) + len(other))
            bottom += len(mine) + len(other)
    return top / bottom if bottom else None


def area(frame):
    row = frame.first()
    return row.roc_auc_score.one_vs_one.weighted if row.roc_auc_score else None


def some(seed, n=60, classes="abc"):
    rng = random.Random(seed)
    return [("a", rng.choice(classes), *(rng.randrange(6) / 5 for _ in range(3))) for _ in range(n)]


@pytest.mark.parametrize("rows", [some(1), some(2, classes="aaab"), some(3, 5), some(4, 30, "bc"), some(5, 9, "a")])
def test_equals_all_pairs(spark, rows):
    found, wanted = area(performance(spark.createDataFrame(rows, SCHEMA), MONITOR)), plain(rows)
    assert found == (None if wanted is None else pytest.approx(wanted))


def test_rows_that_cannot_be_ranked(spark):
    rows = some(6)
    odd = [("a", "other", 1.0, 1.0, 1.0), ("a", None, 1.0, 0.0, 0.0), ("a", "b", None, 0.5, 0.1), ("a", "c", 0.1, float("nan"), 0.9), (None, "a", 0.0, 0.0, 0.0)]
    assert area(performance(spark.createDataFrame(rows + odd, SCHEMA), MONITOR)) == pytest.approx(plain(rows))


def test_rows_that_went(spark):
    rows, gone = some(7), some(8, 20)
    signed = spark.createDataFrame([(*r, 1) for r in rows + gone] + [(*r, -1) for r in gone], f"{SCHEMA}, {SIGN} int")
    assert area(performance_of(performance_partials(labelled(signed, MONITOR), MONITOR, False), MONITOR)) == pytest.approx(plain(rows))


def test_slices(spark):
    rows = [(*r, s) for s, seed in (("x", 9), ("y", 10)) for r in some(seed)]
    found = performance(spark.createDataFrame(rows, f"{SCHEMA}, s string"), replace(MONITOR, slices=("s",)))
    by_slice = {r.slice_value: r.roc_auc_score.one_vs_one.weighted for r in found.collect()}
    assert by_slice["x"] == pytest.approx(plain([r for r in rows if r[-1] == "x"])) and by_slice[None] == pytest.approx(plain(rows))


def test_two_classes_are_the_binary_area(spark):
    rows = [(i % 8 / 8, i % 3 % 2) for i in range(40)]  # eighths, so that 1 - q keeps ties and order
    df = spark.createDataFrame(rows, "q double, y int").withColumn("none", 1 - F.col("q"))
    binary = Monitor("a.b.c", "INFERENCE", None, (), (), (), "q", "y")
    assert area(performance(df, replace(binary, class_scores=(("1", "q"), ("0", "none"))))) == pytest.approx(area(performance(df, binary)))


def test_settings():
    def run(own):
        return RunSettings("main", ProfileDefaults("out", timestamp_column="t", label_column="y"), {"main.a.b": own})

    assert resolve_monitor(run(TableSettings(class_scores=dict(CLASSES))), "main.a.b").class_scores == CLASSES
    assert ("class_scores", "main.a.b") in settings_problems(run(TableSettings(class_scores={"a": "pa"})))


def test_confusion_query_counts_every_row(spark, tmp_path):
    spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:00:00', 'F', 400000.0D), (TIMESTAMP_NTZ'2024-05-01 00:00:00', 'F', 400000.0D), "
        "(TIMESTAMP_NTZ'2025-01-01 00:00:00', 'O', 1.0D) AS t(o_orderdate, o_orderstatus, o_totalprice)"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    rows = QUERIES["model_multiclass_confusion"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [(2024, "F", "F", 2), (2025, "O", "P", 1)]
