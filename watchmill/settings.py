"""What to monitor and how: light dataclasses plus the rules that resolve one setting from several places."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Allowed granularities.
GRANULARITIES = (
    "5 minutes",
    "30 minutes",
    "1 hour",
    "1 day",
    "1 week",
    "2 weeks",
    "3 weeks",
    "4 weeks",
    "1 month",
    "1 year",
)
DEFAULT_GRANULARITY = "1 day"
PROFILE_TYPES = ("INFERENCE", "SNAPSHOT", "TIMESERIES")
CLASSIFICATION = "PROBLEM_TYPE_CLASSIFICATION"
REGRESSION = "PROBLEM_TYPE_REGRESSION"
METRIC_TYPES = ("aggregate", "derived", "drift")


@dataclass(frozen=True)
class CustomMetric:
    """A metric written as a templated SQL expression."""

    name: str
    metric_type: str
    input_columns: tuple[str, ...]
    definition: str
    output_type: str = "double"


@dataclass(frozen=True)
class Objective:
    """A named, versioned, reusable metric."""

    metric: CustomMetric
    version: str = "1.0"
    owner: str | None = None
    description: str | None = None
    function_name: str | None = None


@dataclass(frozen=True)
class TableSettings:
    """Settings of one table; None means 'use the default'."""

    profile_type: str | None = None
    baseline_table_name: str | None = None
    slicing_exprs: tuple[str, ...] | None = None
    granularity: str | None = None
    granularities: tuple[str, ...] | None = None
    problem_type: str | None = None
    prediction_column: str | None = None
    label_column: str | None = None
    timestamp_column: str | None = None
    model_id_column: str | None = None
    owner: str | None = None
    runbook_url: str | None = None
    lineage_url: str | None = None
    drift_threshold: float | None = None
    objective_function_ids: tuple[str, ...] | None = None
    custom_metrics: tuple[CustomMetric, ...] | None = None
    #: The column with the score of each class, by class.
    class_scores: dict[str, str] | None = None


@dataclass(frozen=True)
class ProfileDefaults:
    output_schema_name: str
    profile_type: str = "INFERENCE"
    granularity: str = DEFAULT_GRANULARITY
    granularities: tuple[str, ...] | None = None
    slicing_exprs: tuple[str, ...] = ()
    max_slicing_cardinality: int = 50
    problem_type: str | None = CLASSIFICATION
    prediction_column: str | None = "prediction"
    label_column: str | None = None
    timestamp_column: str | None = None
    model_id_column: str | None = None
    timeseries_timestamp_column: str | None = None
    custom_metrics: tuple[CustomMetric, ...] = ()


@dataclass(frozen=True)
class DiscoverySettings:
    include_tags: dict[str, str] = field(default_factory=lambda: {"monitor_enabled": "true"})
    exclude_schemas: tuple[str, ...] = ("information_schema", "tmp_*", "dev_*")
    include_schemas: tuple[str, ...] | None = None


@dataclass(frozen=True)
class PolicySettings:
    naming_patterns: tuple[str, ...] = ()
    required_tags: tuple[str, ...] = ()
    forbidden_patterns: tuple[str, ...] = ()
    require_baseline: bool = False
    require_slicing: bool = False
    max_tables_per_config: int | None = None


@dataclass(frozen=True)
class AlertSettings:
    drift_threshold: float = 0.2
    null_rate_threshold: float | None = None
    row_count_min: int | None = None
    distinct_count_min: int | None = None
    default_notifications: tuple[str, ...] = ()
    group_notifications: dict[str, tuple[str, ...]] = field(default_factory=dict)
    repeat_seconds: int = 3600


@dataclass(frozen=True)
class RunSettings:
    """Everything one monitoring run needs."""

    catalog_name: str
    profile_defaults: ProfileDefaults
    monitored_tables: dict[str, TableSettings] = field(default_factory=dict)
    include_tagged_tables: bool = False
    discovery: DiscoverySettings | None = None
    monitor_group_tag: str = "monitor_group"
    alerting: AlertSettings = field(default_factory=AlertSettings)
    policy: PolicySettings | None = None
    stale_monitor_days: int = 30
    objective_functions: dict[str, Objective] = field(default_factory=dict)


@dataclass(frozen=True)
class Monitor:
    """The resolved settings of one table, ready for the operators."""

    table: str
    profile_type: str = "TIMESERIES"
    timestamp_column: str | None = None
    granularities: tuple[str, ...] = (DEFAULT_GRANULARITY,)
    slices: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None
    prediction_column: str | None = None
    label_column: str | None = None
    model_id_column: str | None = None
    problem_type: str = CLASSIFICATION
    baseline_table: str | None = None
    custom_metrics: tuple[CustomMetric, ...] = ()
    class_scores: tuple[tuple[str, str], ...] = ()

    @property
    def slice_columns(self) -> tuple[str, ...]:
        """The model id is one more slice key."""
        model = (self.model_id_column,) if self.model_id_column else ()
        return tuple(dict.fromkeys(self.slices + model))

    @property
    def leaf_name(self) -> str:
        return self.table.split(".")[-1]

    def with_slices(self, slices: tuple[str, ...]) -> "Monitor":
        return replace(self, slices=slices)


def resolve(run: RunSettings, table: str, setting: str):
    """The table's own value, else the default one."""
    own = run.monitored_tables.get(table)
    value = getattr(own, setting, None) if own else None
    return value if value is not None else getattr(run.profile_defaults, setting, None)


def resolve_granularities(run: RunSettings, table: str) -> tuple[str, ...]:
    """The list beats the single value; unknown names mean one day."""
    chosen = resolve(run, table, "granularities") or (resolve(run, table, "granularity"),)
    known = [name if name in GRANULARITIES else DEFAULT_GRANULARITY for name in chosen]
    return tuple(dict.fromkeys(known))


def resolve_timestamp(run: RunSettings, table: str) -> str | None:
    """T5: the table's timestamp column, else the time-series default."""
    return resolve(run, table, "timestamp_column") or run.profile_defaults.timeseries_timestamp_column


def _family(text: str) -> str:
    return REGRESSION if "REGRESSION" in text.upper() else CLASSIFICATION


def resolve_problem_type(
    run: RunSettings, table: str, tags: dict[str, str], schema: T.StructType | None = None
) -> str:
    """Table setting, then tag, then default, then the label's type."""
    own = run.monitored_tables.get(table)
    for text in (
        own.problem_type if own else None,
        tags.get("monitor_problem_type"),
        run.profile_defaults.problem_type,
    ):
        if text:
            return _family(text)
    label = resolve(run, table, "label_column")
    for column in schema or ():
        if label and column.name.lower() == label.lower():
            return REGRESSION if isinstance(column.dataType, T.NumericType) else CLASSIFICATION
    return CLASSIFICATION


def resolve_metrics(run: RunSettings, table: str) -> tuple[CustomMetric, ...]:
    """Defaults, then objectives, then the table's own metrics; a later layer wins by name."""
    own = run.monitored_tables.get(table) or TableSettings()
    by_objective = [run.objective_functions[key].metric for key in own.objective_function_ids or ()]
    layers = [*run.profile_defaults.custom_metrics, *by_objective, *(own.custom_metrics or ())]
    merged = {metric.name: metric for metric in layers}
    return tuple(metric for metric in merged.values() if metric.metric_type in METRIC_TYPES)


def resolve_monitor(
    run: RunSettings, table: str, tags: dict[str, str] | None = None, schema: T.StructType | None = None
) -> Monitor:
    """All settings of one table, resolved."""
    own = run.monitored_tables.get(table)
    kind = (own.profile_type if own else None) or run.profile_defaults.profile_type
    inference = kind == "INFERENCE"
    return Monitor(
        table=table,
        profile_type=kind,
        timestamp_column=None if kind == "SNAPSHOT" else resolve_timestamp(run, table),
        granularities=() if kind == "SNAPSHOT" else resolve_granularities(run, table),
        slices=tuple(name.strip("`") for name in resolve(run, table, "slicing_exprs") or ()),
        prediction_column=resolve(run, table, "prediction_column") if inference else None,
        label_column=resolve(run, table, "label_column") if inference else None,
        model_id_column=resolve(run, table, "model_id_column") if inference else None,
        problem_type=resolve_problem_type(run, table, tags or {}, schema),
        baseline_table=own.baseline_table_name if own else None,
        custom_metrics=resolve_metrics(run, table),
        class_scores=tuple(own.class_scores.items()) if inference and own and own.class_scores else (),
    )


def settings_problems(run: RunSettings) -> list[tuple[str, str]]:
    """(rule, subject) for every rule the settings break."""
    defaults, found = run.profile_defaults, []
    if "." in defaults.output_schema_name:
        found.append(("output_schema_name", defaults.output_schema_name))
    if defaults.profile_type == "TIMESERIES" and defaults.timeseries_timestamp_column is None:
        found.append(("timeseries_timestamp_column", defaults.profile_type))
    if defaults.profile_type == "INFERENCE":
        found += [
            (needed, defaults.profile_type)
            for needed in ("prediction_column", "timestamp_column")
            if getattr(defaults, needed) is None
        ]
    if run.include_tagged_tables and run.discovery is None:
        found.append(("discovery", "include_tagged_tables"))
    if not run.include_tagged_tables and not run.monitored_tables:
        found.append(("monitored_tables", "empty"))
    for table, own in run.monitored_tables.items():
        parts = table.split(".")
        if len(parts) != 3:
            found.append(("three_level_name", table))
        elif parts[0] != run.catalog_name:
            found.append(("catalog", table))
        names = (own.granularity, *(own.granularities or ()))
        found += [("granularity", table) for name in names if name and name not in GRANULARITIES]
        if own.drift_threshold is not None and not 0 <= own.drift_threshold <= 1:
            found.append(("drift_threshold", table))
        if own.class_scores is not None and len(own.class_scores) < 2:
            found.append(("class_scores", table))
        found += [
            ("objective_function", key)
            for key in own.objective_function_ids or ()
            if key not in run.objective_functions
        ]
    return found
