"""Views over the driver tables and the registered queries."""

from __future__ import annotations

import importlib

MODULES = (
    "q_exposure", "q_scalar", "q_text", "q_graph", "q_choices", "q_governance", "q_audit", "q_stats", "q_dataset", "q_sources", "q_streaming",
)


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
