"""Lifecycle of decisions on the stream: pending until an outcome, a trace and the rules agree.

Two stateful steps in one job. The first meets outcomes with the action trace they name, by
the row of the trace; the second meets them with the pending decision. A decision leaves the pending
state once; it also ends when an event-time timer finds it pending at its deadline.

The code travels to the workers with the query: they need not have this package.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import ACTION_MAP
from ..operators.dataset import FAILURE_PATTERN, NO_LONGER_PENDING, REJECTS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTCOME = "decision_id string, at bigint, outcome string, choice string, failure_category string"
BOUND = OUTCOME + ", trace_user bigint, trace_action string"
#: State keys of each step. A fixed number, as the state outlives a job; rows of one bucket are handled together.
BUCKETS = 256
TRANSITIONS = "decision_id string, user_id bigint, status string, reject_reason string, final boolean"


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(",")]


class _Bucket(StatefulProcessor):
    """Many keys in one state key: a call into Python and a few reads and writes of state serve all rows of a bucket.

    State, timers and rules are still per key; a bucket registers the earliest of its keys' timers only.
    """

    def rows(self, parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for part in parts:
            columns = [part[n] for n in self.columns]
            yield from zip(*[c.astype(object).where(c.notna(), None) for c in columns])

    def by_key(self, state) -> dict[object, list[tuple]]:
        """Rows of a list state by the key in their first cell."""
        out: dict[object, list[tuple]] = {}
        for row in state.get():
            out.setdefault(row[0], []).append(tuple(row))
        return out

    @staticmethod
    def keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()

    def wake(self, times: Iterable[int]) -> None:
        first = min(times, default=None)
        if first is not None:
            self.handle.registerTimer(first)

    def close(self) -> None:
        pass


class TraceBinding(_Bucket):
    """Outcomes that name one trace row, with its user and action, or without if there was none by then.

    An outcome waits until the watermark has passed it, as its trace may still come; a trace
    is kept for ``horizon`` after its time.
    """

    columns = ("rowid", *_names(OUTCOME), "user_id", "action")

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trace = handle.getListState("trace", "rowid bigint, user_id bigint, action string, at bigint")
        self.held = handle.getListState("held", "rowid bigint, " + OUTCOME)

    def store(self, trace: dict, held: dict) -> None:
        self.keep(self.trace, [(k, *v) for k, v in trace.items()])
        self.keep(self.held, [o for rows in held.values() for o in rows])
        self.wake([v[2] + self.horizon for v in trace.values()] + [o[2] + 1 for rows in held.values() for o in rows])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        trace = {r[0]: r[1:] for r in self.trace.get()}
        held = self.by_key(self.held)
        touched = set()
        for rowid, decision, at, outcome, choice, category, user, action in self.rows(rows):
            touched.add(rowid)
            if outcome is None:
                trace[rowid] = (int(user), action, int(at))
            else:
                held.setdefault(rowid, []).append((rowid, decision, int(at), outcome, choice, category))
        out = []
        passed = timerValues.getCurrentWatermarkInMs()
        for rowid in touched:
            seen, open_ = trace.get(rowid), []
            for o in held.pop(rowid, []):
                if seen is not None:
                    known = seen[2] <= o[2] <= seen[2] + self.horizon
                    out.append((*o[1:], seen[0] if known else None, seen[1] if known else None))
                elif o[2] < passed:
                    out.append((*o[1:], None, None))
                else:
                    open_.append(o)
            if open_:
                held[rowid] = open_
        self.store(trace, held)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held, out = {}, []
        for rowid, rows in self.by_key(self.held).items():
            out += [(*o[1:], None, None) for o in rows if o[2] < passed]
            held[rowid] = [o for o in rows if o[2] >= passed]
        self.store({r[0]: r[1:] for r in self.trace.get() if r[3] + self.horizon > passed}, held)
        yield self.frame(out)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_names(BOUND)).astype({"at": "Int64", "trace_user": "Int64"})


class Lifecycle(_Bucket):
    """Transitions of decisions. Outcomes that come before their decision wait for it."""

    columns = (*_names(BOUND), "user_id", "legal")

    def __init__(self, timeout_ms: int, actions: dict[str, str], pattern: str, rejects: tuple[str, ...], gone: str):
        self.timeout, self.actions, self.pattern, self.rejects, self.gone = timeout_ms, actions, re.compile(pattern), rejects, gone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.decision = handle.getListState("decision", "decision_id string, user_id bigint, legal array<string>, deadline bigint, status string, reject string")
        self.held = handle.getListState("held", BOUND)

    def store(self, decisions: dict, held: dict) -> None:
        self.keep(self.decision, [(k, *v) for k, v in decisions.items()])
        self.keep(self.held, [o for rows in held.values() for o in rows])
        self.wake([v[2] for v in decisions.values()] + [o[1] + self.timeout for rows in held.values() for o in rows])

    def reject(self, user: int, legal, o: tuple) -> str | None:
        _, _, outcome, choice, category, trace_user, trace_action = o
        illegal, missing, mismatch, unstable = self.rejects
        if outcome == "failed":
            return None if category is not None and self.pattern.search(category) else unstable
        if choice is None or choice not in legal:
            return illegal
        if trace_user is None:
            return missing
        return None if trace_user == user and self.actions.get(trace_action) == choice.partition(":")[0] else mismatch

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        decisions = {d[0]: d[1:] for d in self.decision.get()}
        held = self.by_key(self.held)
        touched = set()
        for decision, at, outcome, choice, category, trace_user, trace_action, user, legal in self.rows(rows):
            touched.add(decision)
            if outcome is not None:
                seen_by = None if trace_user is None else int(trace_user)
                held.setdefault(decision, []).append((decision, int(at), outcome, choice, category, seen_by, trace_action))
            elif decision not in decisions:  # a decision that is announced again changes nothing
                decisions[decision] = (int(user), list(legal), int(at) + self.timeout, "pending", None)
        out = []
        for decision in touched:
            if decision not in decisions or decision not in held:
                continue
            user, legal, deadline, status, last = decisions[decision]
            for o in sorted(held.pop(decision), key=lambda o: (o[1], str(o[2:]))):
                if status != "pending" or o[1] > deadline:
                    out.append((decision, user, status, self.gone, False))
                    continue
                reason = self.reject(user, legal, o)
                if reason is None:
                    status, last = o[2], None
                    out.append((decision, user, status, None, True))
                else:
                    last = reason
                    out.append((decision, user, status, reason, False))
            decisions[decision] = (user, list(legal), deadline, status, last)
        self.store(decisions, held)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        decisions, out = {}, []
        for decision, user, legal, deadline, status, last in self.decision.get():
            if deadline > passed:
                decisions[decision] = (user, list(legal), deadline, status, last)
            elif status == "pending":
                out.append((decision, user, status, last, True))
        held = {}
        for decision, rows in self.by_key(self.held).items():
            if min(o[1] for o in rows) + self.timeout > passed:
                held[decision] = rows
            else:  # outcomes of a decision that nobody announced
                out += [(decision, None, None, self.gone, False) for _ in rows]
        self.store(decisions, held)
        yield self.frame(out)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_names(TRANSITIONS)).astype({"user_id": "Int64", "final": "bool"})


def lifecycle_stream(pending: DataFrame, outcomes: DataFrame, trace: DataFrame, *, timeout_ms: int, horizon_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """Transitions of decisions: (decision_id, user_id, status, reject_reason, final).

    Each stream carries a watermark on ``ts``. ``pending``: ts, decision_id, user_id, legal.
    ``outcomes``: ts, decision_id, outcome, choice, action_trace_rowid, failure_category.
    ``trace``: ts, rowid, user_id, action. The rules are those of dataset.resolve_lifecycle, but that a
    trace must be no later than the outcome and no older than ``horizon_ms``, and that the first
    outcome without a fault decides. ``final`` rows, one for each decision, are the result; the
    others tell which outcomes were rejected, and why. ``buckets`` must stay as it is for the life of a checkpoint.
    """

    def bucketed(df: DataFrame, key: str):
        return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("bucket")

    at = F.unix_millis("ts").alias("at")
    # an outcome that names no row has nothing to wait for
    named = F.col("action_trace_rowid").isNotNull()
    told = ["decision_id", at, "outcome", "choice", "failure_category"]
    asked = outcomes.where(named).select(F.col("action_trace_rowid").alias("rowid"), *told, F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("action"))
    seen = trace.where(F.col("rowid").isNotNull()).select("rowid", at, *[F.lit(None).cast("string").alias(n) for n in ("decision_id", "outcome", "choice", "failure_category")], "user_id", "action")
    bound = bucketed(asked.unionByName(seen), "rowid").transformWithStateInPandas(
        statefulProcessor=TraceBinding(horizon_ms), outputStructType=BOUND, outputMode="append", timeMode="eventTime"
    )
    none = {"trace_user": "bigint", "trace_action": "string"}
    unnamed = outcomes.where(~named).select(*told, *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    events = bound.unionByName(unnamed).withColumns({"user_id": F.lit(None).cast("bigint"), "legal": F.lit(None).cast("array<string>")})
    started = pending.select(
        "decision_id", at, *[F.lit(None).cast("string").alias(n) for n in ("outcome", "choice", "failure_category")],
        *[F.lit(None).cast(t).alias(n) for n, t in none.items()], "user_id", "legal",
    )
    return bucketed(started.unionByName(events), "decision_id").transformWithStateInPandas(
        statefulProcessor=Lifecycle(timeout_ms, dict(ACTION_MAP), FAILURE_PATTERN, REJECTS, NO_LONGER_PENDING), outputStructType=TRANSITIONS, outputMode="append", timeMode="eventTime"
    )
