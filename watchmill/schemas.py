"""Fixed schemas of the metric tables, the unified frames and the small control frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Column name that marks a row about the whole table.
TABLE_ROW = ":table"

_window = T.StructField(
    "window",
    T.StructType([T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType())]),
)
_weighted = T.StructType([T.StructField("weighted", T.DoubleType())])
_statistic = T.StructType([T.StructField("statistic", T.DoubleType())])


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


_text, _real, _big = T.StringType(), T.DoubleType(), T.LongType()

PERFORMANCE_FIELDS = [
    *_fields(_real, "accuracy_score", "log_loss"),
    *_fields(_weighted, "precision", "recall", "f1_score"),
    T.StructField("roc_auc_score", T.StructType([T.StructField("one_vs_one", _weighted)])),
    *_fields(_real, "predictive_parity", "predictive_equality", "equal_opportunity", "statistical_parity"),
    *_fields(
        _real,
        "mean_squared_error",
        "root_mean_squared_error",
        "mean_average_error",
        "mean_absolute_percentage_error",
        "r2_score",
    ),
]

#: One row per window, slice, column and log type.
PROFILE_METRICS = T.StructType(
    [
        _window,
        *_fields(_text, "granularity", "log_type", "slice_key", "slice_value", "column_name"),
        *_fields(_big, "count", "num_nulls"),
        *_fields(_real, "percent_null"),
        *_fields(_big, "distinct_count"),
        *_fields(_real, "avg", "stddev", "min", "max"),
        *PERFORMANCE_FIELDS,
    ]
)

#: One row per window, slice, column and drift type.
DRIFT_METRICS = T.StructType(
    [
        _window,
        *_fields(_text, "granularity", "drift_type", "slice_key", "slice_value", "column_name"),
        *_fields(_real, "js_distance"),
        T.StructField("ks_test", _statistic),
        *_fields(_real, "wasserstein_distance"),
        T.StructField("chi_squared_test", _statistic),
        *_fields(_real, "population_stability_index"),
    ]
)

_unified_window = _fields(T.TimestampType(), "window_start", "window_end")
_context = [
    *_fields(_text, "source_table_name", "owner", "department"),
    T.StructField("priority", T.IntegerType()),
    *_fields(_text, "runbook_url", "lineage_url"),
]

UNIFIED_DRIFT = T.StructType(
    [
        *_unified_window,
        *_fields(_text, "column_name"),
        *_fields(_real, "js_distance", "ks_statistic", "wasserstein_distance", "chi_square_statistic", "psi"),
        *_fields(_text, "drift_type", "granularity", "slice_key", "slice_value"),
        *_context,
        *_fields(_real, "drift_threshold"),
    ]
)

UNIFIED_PROFILE = T.StructType(
    [
        *_unified_window,
        *_fields(_text, "column_name"),
        *_fields(_big, "record_count", "null_count"),
        *_fields(_real, "null_rate"),
        *_fields(_big, "distinct_count"),
        *_fields(_real, "mean", "stddev", "min_value", "max_value"),
        *_fields(_text, "granularity", "slice_key", "slice_value"),
        *_context,
    ]
)

CLASSIFICATION_SCORES = [
    "accuracy_score",
    "log_loss",
    "precision_weighted",
    "recall_weighted",
    "f1_weighted",
    "roc_auc_weighted",
    "predictive_parity",
    "predictive_equality",
    "equal_opportunity",
    "statistical_parity",
]
REGRESSION_SCORES = [
    "mean_squared_error",
    "root_mean_squared_error",
    "mean_average_error",
    "mean_absolute_percentage_error",
    "r2_score",
]

UNIFIED_PERFORMANCE = T.StructType(
    [
        *_unified_window,
        *_fields(_text, "granularity", "column_name"),
        *_fields(_real, *CLASSIFICATION_SCORES, *REGRESSION_SCORES),
        *_fields(_text, "slice_key", "slice_value", "source_table_name", "owner"),
    ]
)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """U4: a typed relation without rows."""
    return spark.createDataFrame([], schema)
