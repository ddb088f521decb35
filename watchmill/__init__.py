"""watchmill: table profiling, drift and model-quality monitoring as Spark jobs."""

from watchmill.settings import (
    AlertSettings,
    CustomMetric,
    DiscoverySettings,
    Monitor,
    Objective,
    PolicySettings,
    ProfileDefaults,
    RunSettings,
    TableSettings,
)

__all__ = [
    "AlertSettings",
    "CustomMetric",
    "DiscoverySettings",
    "Monitor",
    "Objective",
    "PolicySettings",
    "ProfileDefaults",
    "RunSettings",
    "TableSettings",
]
