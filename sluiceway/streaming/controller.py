"""The stateful controller, the one place with row-wise Python.

Its code travels to the workers with the query: they need not have this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..operators.governance import BETWEEN_INTERVALS, BUDGET_EXHAUSTED, LATE_STEP, RULE_UPDATE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTROLLER_OUTPUT = StructType(
    [
        StructField("run_id", StringType()),
        StructField("timestep", LongType()),
        StructField("omega_intra", DoubleType()),
        StructField("omega_inter", DoubleType()),
        StructField("cumulative_cost", DoubleType()),
        StructField("reason", StringType()),
    ]
)


def clip(value: float) -> float:
    return min(1.0, max(0.0, value))


class Controller(StatefulProcessor):
    """Omegas and spent budget of one run, carried from step to step.

    One small state row per run; input is one row per run and step, already aggregated.
    Steps arrive in order over the batches, as closed steps do. One that comes after a later step
    changes nothing any more; it is reported with a reason of its own. (A batch that is replayed
    after a failure finds the state from before it, so it is no late step.) ``late`` rows carry no
    state and never move the run.
    """

    def __init__(self, config: dict):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("intra", DoubleType()), StructField("inter", DoubleType()), StructField("cost", DoubleType()), StructField("last", LongType())])
        self.state = handle.getValueState("controller", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        c = self.config
        if self.state.exists():
            intra, inter, cost, last = self.state.get()
        else:
            intra, inter, last = clip(c["omega_intra"]), clip(c["omega_inter"]), -1
            cost = (1.0 - intra) + (1.0 - inter)
        most = min(1.0, float(c["step"]))  # as in the batch recommendation
        steps = pd.concat(list(rows)).sort_values("timestep", kind="stable")
        out = []
        for row in steps.itertuples(index=False):
            if row.timestep <= last or getattr(row, "late", False):
                out.append((key[0], int(row.timestep), float(intra), float(inter), float(cost), LATE_STEP))
                continue
            last = int(row.timestep)
            left = max(0.0, c["budget"] - cost)
            if last % c["interval"]:
                reason = BETWEEN_INTERVALS
            elif left <= 0:
                reason = BUDGET_EXHAUSTED
            else:
                reason = RULE_UPDATE
                pressure = max(row.risk_adoption_rate - c["risk_target"], row.report_rate - c["report_target"], 0.0)
                cross = max(row.cross_community_exposure_ratio - c["cross_target"], 0.0)
                spread = min(1.0, row.recent_reposts / 10.0)
                relax = most if row.benign_exposure_loss > c["loss_limit"] else 0.0
                a = clip(intra - most * min(1.0, pressure + 0.5 * spread) + relax)
                b = clip(inter - most * min(1.0, pressure + cross + 0.5 * row.community_coverage_ratio) + relax)
                spend = (intra - a) + (inter - b)
                if spend > left:
                    a, b, spend = clip(intra + (a - intra) * left / spend), clip(inter + (b - inter) * left / spend), left
                intra, inter, cost = a, b, cost + max(0.0, spend)
            out.append((key[0], last, float(intra), float(inter), float(cost), reason))
        self.state.update((float(intra), float(inter), float(cost), last))
        yield pd.DataFrame(out, columns=CONTROLLER_OUTPUT.fieldNames())

    def close(self) -> None:
        pass
