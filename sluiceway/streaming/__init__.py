"""The governance path on Structured Streaming."""

from .jobs import (
    controller_stream,
    decision_dedup,
    exposure_by_step,
    govern_stream,
    governance_state_stream,
    impression_stream,
    read_events,
    roots_stream,
    run_to_latest,
    run_to_table,
)
from .lifecycle import lifecycle_stream

__all__ = [
    "controller_stream",
    "decision_dedup",
    "exposure_by_step",
    "govern_stream",
    "governance_state_stream",
    "impression_stream",
    "lifecycle_stream",
    "read_events",
    "roots_stream",
    "run_to_latest",
    "run_to_table",
]
