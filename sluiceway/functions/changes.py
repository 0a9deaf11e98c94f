"""Change-point tables: running counts of a key, each valid from one step until the next change.

The state of a key at any step is the row whose interval holds the step, so nothing is
written for steps at which nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def change_points(events: DataFrame, keys: list[str], counts: list[str], step: str = "step") -> DataFrame:
    """(keys, step, until, counts): running sums of the events, ``until`` null for the last state.

    ``events`` holds signed changes per step. They are added up per (key, step) before the
    shuffle, so the window over a key has a row for each step at most; steps whose changes
    cancel out make no row.
    """
    net = events.groupBy(*keys, step).agg(*[F.sum(c).alias(c) for c in counts])
    net = net.where(F.greatest(*[F.abs(c) for c in counts], F.lit(0)) > 0)
    order = W.partitionBy(*keys).orderBy(step)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return net.select(*keys, step, F.lead(step).over(order).alias("until"), *[F.sum(c).over(upto).alias(c) for c in counts])


def valid_at(step: Column, start: Column, until: Column) -> Column:
    """Is ``step`` inside the interval of a state?"""
    return (start <= step) & (until.isNull() | (step < until))


def as_changes(states: DataFrame, keys: list[str], counts: dict[str, Column], step: str = "step") -> DataFrame:
    """The states as signed changes again, for sums over other keys: gained at ``step``, given back at ``until``."""
    rows = states.select(*keys, step, "until", *[c.cast("long").alias(n) for n, c in counts.items()])
    gained = rows.drop("until")
    back = rows.where(F.col("until").isNotNull()).select(*keys, F.col("until").alias(step), *[(-F.col(n)).alias(n) for n in counts])
    return gained.unionByName(back)
