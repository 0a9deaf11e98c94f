"""Governance state on the stream: one pane per run and step, merged over the trailing window.

Exposures and actions are added up where they arrive, so state sees a few rows per run, step
and task. A pane holds counts and a bitmap of the communities reached; communities get
their number in the run's own dictionary when they first appear, so their set is open. A
step is closed by an event-time timer once the watermark has passed its end; until then
events may arrive in any order. What comes after that is reported as late.

The code travels to the workers with the query: they need not have this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP_MS = 86_400_000
COUNTS = ("shown", "risky_shown", "cross_shown", "benign", "benign_hidden", "traces", "reposts", "reports")
PARTIAL = "run_id string, timestep bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", communities array<string>, omega_at bigint, omega_intra double, omega_inter double"
STATE_OUTPUT = (
    "run_id string, timestep bigint, late boolean, risk_adoption_rate double, recent_reposts bigint, community_coverage_ratio double, "
    "cross_community_exposure_ratio double, report_rate double, benign_exposure_loss double, cumulative_cost double, remaining_budget double"
)


def partial_panes(impressions: DataFrame, actions: DataFrame, origin: str) -> DataFrame:
    """Both streams as partial panes: a row for each run and step of an Arrow batch.

    ``impressions`` and ``actions`` (ts, run_id, action) carry their watermarks; the next
    stateful operator takes the smaller one.
    """
    both = impressions.unionByName(actions.select("ts", "run_id", "action"), allowMissingColumns=True)
    risky = F.col("shown") & (F.col("risk_score") > 0)
    benign = F.col("risk_score") == 0
    flags = {
        "shown": F.col("shown"),
        "risky_shown": risky,
        "cross_shown": F.col("shown") & (F.col("user_community") != F.col("author_community")),
        "benign": benign,
        "benign_hidden": benign & ~F.col("shown"),
        "traces": F.col("action").isNotNull(),
        "reposts": F.col("action").isin("repost", "quote_post"),
        "reports": F.col("action") == "report_post",
    }
    rows = both.select(
        "run_id",
        F.datediff(F.to_date("ts"), F.lit(origin).cast("date")).cast("long").alias("timestep"),
        *[F.coalesce(f, F.lit(False)).cast("long").alias(n) for n, f in flags.items()],
        F.when(F.coalesce(risky, F.lit(False)), F.col("user_community")).alias("community"),
        F.when(F.col("omega_intra").isNotNull(), F.unix_millis("ts")).alias("omega_at"),
        "omega_intra",
        "omega_inter",
    )

    def combine(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["run_id", "timestep"]
        for batch in batches:
            if batch.empty:
                continue
            out = batch.groupby(keys)[list(COUNTS)].sum()
            # a boolean mask leaves no communities at all for steps without risky exposure
            reached = batch[batch["community"].notna()].groupby(keys)["community"].unique().map(list).rename("communities")
            moved = batch[batch["omega_at"].notna()].sort_values("omega_at").groupby(keys)[["omega_at", "omega_intra", "omega_inter"]].last()
            out = out.join(reached).join(moved).reset_index()
            out["communities"] = out["communities"].map(lambda v: v if isinstance(v, list) else [])
            out["omega_at"] = out["omega_at"].astype("Int64")
            yield out

    return rows.mapInPandas(combine, PARTIAL)


class StepStates(StatefulProcessor):
    """Closed steps of one run: their state over the trailing window, and the budget left.

    Keeps ``window`` panes, open ones besides, the run's dictionary of communities, and the
    omegas and cost so far. Every step from ``origin`` on gets its row, steps without an event too.
    """

    def __init__(self, origin_ms: int, window: int, communities: int, budget: float):
        self.origin, self.window, self.communities, self.budget = origin_ms, window, max(1, communities), budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "next bigint, level double, cost double")
        self.panes = handle.getMapState("panes", "timestep bigint", ", ".join(f"{c} bigint" for c in COUNTS) + ", reached binary, omega_at bigint, omega_intra double, omega_inter double")
        self.codes = handle.getMapState("codes", "community string", "code int")

    def end_of(self, step: int) -> int:
        return self.origin + (step + 1) * STEP_MS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            self.run.update((0, None, 0.0))
            self.handle.registerTimer(self.end_of(0))
        first_open = self.run.get()[0]
        known = {name: code for (name,), (code,) in self.codes.iterator()}
        late = []
        for step, part in pd.concat(list(rows)).groupby("timestep"):
            if step < first_open:
                late.append((key[0], int(step), True, *[None] * 8))
            else:
                self.merge(int(step), part, known)
        yield self.frame(late)

    def merge(self, step: int, part: pd.DataFrame, known: dict[str, int]) -> None:
        names = {c for found in part["communities"] for c in found}
        bits = 0
        for name in sorted(names):
            if name not in known:
                known[name] = len(known)
                self.codes.updateValue((name,), (known[name],))
            bits |= 1 << known[name]
        sums = [int(part[c].sum()) for c in COUNTS]
        moved = part[part["omega_at"].notna()]
        omega = (None, None, None)
        if len(moved):
            last = moved.sort_values("omega_at").iloc[-1]
            omega = (int(last["omega_at"]), float(last["omega_intra"]), float(last["omega_inter"]))
        if self.panes.containsKey((step,)):
            old = self.panes.getValue((step,))
            sums = [a + b for a, b in zip(sums, old[: len(COUNTS)])]
            bits |= int.from_bytes(bytes(old[len(COUNTS)]), "little")
            before = tuple(old[len(COUNTS) + 1 :])
            if omega[0] is None or (before[0] is not None and before[0] > omega[0]):
                omega = before
        self.panes.updateValue((step,), (*sums, bits.to_bytes((bits.bit_length() + 7) // 8, "little"), *omega))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step, level, cost = self.run.get()
        passed = timerValues.getCurrentWatermarkInMs()
        out = []
        while self.end_of(step) <= passed:
            held = [self.panes.getValue((s,)) for s in range(step - self.window + 1, step + 1) if s >= 0 and self.panes.containsKey((s,))]
            n = {c: sum(p[i] for p in held) for i, c in enumerate(COUNTS)}
            reached = 0
            for p in held:
                reached |= int.from_bytes(bytes(p[len(COUNTS)]), "little")
            if self.panes.containsKey((step,)):
                _, intra, inter = self.panes.getValue((step,))[len(COUNTS) + 1 :]
                if intra is not None:
                    now = intra + inter
                    cost += (1.0 - intra) + (1.0 - inter) if level is None else max(0.0, level - now)
                    level = now
            rate = lambda a, b: n[a] / n[b] if n[b] else 0.0
            out.append(
                (
                    key[0], step, False, rate("risky_shown", "shown"), n["reposts"], min(1.0, reached.bit_count() / self.communities), rate("cross_shown", "shown"),
                    rate("reports", "traces"), rate("benign_hidden", "benign"), cost, max(0.0, self.budget - cost),
                )
            )
            if self.panes.containsKey((step - self.window + 1,)):
                self.panes.removeKey((step - self.window + 1,))
            step += 1
        self.run.update((step, level, cost))
        self.handle.registerTimer(self.end_of(step))
        yield self.frame(out)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        names = [f.strip().split(" ")[0] for f in STATE_OUTPUT.split(",")]
        types = {"timestep": "int64", "late": "bool", "recent_reposts": "Int64"}
        return pd.DataFrame(rows, columns=names).astype({n: types.get(n, "object" if n == "run_id" else "float64") for n in names})

    def close(self) -> None:
        pass
