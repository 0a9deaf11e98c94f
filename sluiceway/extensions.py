"""Extension points by name: candidate generators, controllers and cascade metrics.

An extension is a function from DataFrames to a DataFrame with the columns its kind declares,
or a table function: a handler class that sees the rows of one partition key in order, for
what columns cannot express. Both are called alike and checked against the declared schema
before anything runs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from .operators import exposure, governance, hierarchy

# handlers travel to the workers with the query: they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMAS = {
    "generator": "user_id bigint, position bigint, post_id bigint, base_score double, source string",
    "controller": "run_id string, timestep bigint, next_omega_intra double, next_omega_inter double, expected_cost double, reason string",
    "metric": "root_post_id bigint, value double",
}
_KNOWN: dict[tuple[str, str], Callable[..., DataFrame]] = {}


def register(kind: str, name: str, fn: Callable[..., DataFrame]) -> None:
    """Make ``fn`` known as the ``kind`` called ``name``; a later one of the same name takes its place."""
    if kind not in SCHEMAS:
        raise ValueError(f"no such kind of extension: {kind}; there are {sorted(SCHEMAS)}")
    _KNOWN[kind, name] = fn


def register_table_function(kind: str, name: str, handler: type, rows: Callable[..., DataFrame], partition_by: list[str], order_by: list[str]) -> None:
    """Make a handler class known as an extension.

    ``rows`` prepares the input from the inputs of the kind; the handler gets ``eval(row)`` for each
    row of a partition key in order and may yield tuples there and in ``terminate()``. A key is
    seen by one task, so ``rows`` must bound the rows of a key, as a top-k does.
    """

    def fn(**inputs) -> DataFrame:
        function = F.udtf(handler, returnType=SCHEMAS[kind])
        return function(rows(**inputs).asTable().partitionBy(*partition_by).orderBy(*order_by))

    register(kind, name, fn)


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _KNOWN if k == kind)


def call(kind: str, name: str, **inputs) -> DataFrame:
    """The result of an extension, with the columns of its kind in their order.

    Columns beyond the declared ones are dropped; one that is missing, or of another type, is an error.
    """
    if (kind, name) not in _KNOWN:
        raise ValueError(f"no {kind} called {name}; there are {names(kind)}")
    out = _KNOWN[kind, name](**inputs)
    declared = T.StructType.fromDDL(SCHEMAS[kind])
    found = {f.name: f.dataType for f in out.schema}
    wrong = [f"{f.name} is {found[f.name].simpleString() if f.name in found else 'missing'}, not {f.dataType.simpleString()}" for f in declared if found.get(f.name) != f.dataType]
    if wrong:
        raise TypeError(f"{kind} {name}: {'; '.join(wrong)}")
    return out.select(*declared.names)


# ---- built-in generators: recommended, follow, posts, k, seed


def merged(*, rec: DataFrame, follow: DataFrame, posts: DataFrame, k: int, seed: int) -> DataFrame:
    return exposure.merge_candidates(exposure.recommendation_sample(rec, k, seed), exposure.following_topk(follow, posts, k))


def ranked_pool(*, rec: DataFrame, follow: DataFrame, posts: DataFrame, k: int, seed: int) -> DataFrame:
    """What a row-wise generator chooses from: at most ``2 * k`` rows of a user, recommendations first."""
    recommended = exposure.recommendation_sample(rec, k, seed).select("user_id", F.lit(0).alias("part"), "rank", "post_id", "base_score", F.lit("recommendation").alias("source"))
    score = F.col("num_likes").cast("double") + F.lit(1.0) / (F.col("rank") + 1)
    followed = exposure.following_topk(follow, posts, k).select("user_id", F.lit(1).alias("part"), "rank", "post_id", score.alias("base_score"), F.lit("following").alias("source"))
    return recommended.unionByName(followed)


class FirstOccurrence:
    """A generator by rows: each post of the pool once, where it comes first."""

    def __init__(self):
        self.seen: set[int] = set()

    def eval(self, row):
        if row["post_id"] not in self.seen:
            self.seen.add(row["post_id"])
            yield row["user_id"], len(self.seen) - 1, row["post_id"], row["base_score"], row["source"]


def rule_based(*, state: DataFrame, **settings) -> DataFrame:
    return governance.control_recommendation(state, **settings)


def unchanged(*, state: DataFrame, **settings) -> DataFrame:
    """A controller that leaves the omegas as they are."""
    return state.select("run_id", "timestep", F.col("omega_intra").alias("next_omega_intra"), F.col("omega_inter").alias("next_omega_inter"), F.lit(0.0).alias("expected_cost"), F.lit("unchanged").alias("reason"))


def _metric(column: str) -> Callable[..., DataFrame]:
    return lambda *, posts, roots: hierarchy.cascade_full(posts, roots).select("root_post_id", F.col(column).cast("double").alias("value"))


register("generator", "merged", merged)
register_table_function("generator", "merged_by_rows", FirstOccurrence, ranked_pool, ["user_id"], ["part", "rank"])
register("controller", "rule_based", rule_based)
register("controller", "unchanged", unchanged)
register("metric", "size_direct", lambda *, posts, roots: hierarchy.cascade_direct(posts).select("root_post_id", F.col("cascade_size").cast("double").alias("value")))
for _name, _column in (("size", "cascade_size"), ("depth", "max_depth"), ("authors", "authors")):
    register("metric", _name, _metric(_column))
