"""Imports every module that registers queries."""

from workload import (  # noqa: F401
    aggregates,
    captures,
    devices,
    functions,
    incremental,
    jobs,
    joins,
    loans,
    projections,
    scans,
    scores,
    sinks,
    windows,
)
