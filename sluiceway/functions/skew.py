"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def leaf_bytes(df: DataFrame) -> int | None:
    """Bytes of all scans below ``df`` after pruning.

    For a table built by row-preserving steps (projections, filters, N:1 joins)
    this tells how large it can get, without the product estimate of joins.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    except (AttributeError, NotImplementedError):  # Spark Connect has no plan statistics: treat as large
        return None


def broadcast_limit(df: DataFrame) -> int:
    raw = str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    raw = raw.removesuffix("b")
    return int(raw[:-1]) * units[raw[-1]] if raw and raw[-1] in units else int(raw)


# compressed columns on disk against rows in memory
EXPANSION = 4


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """May ``df`` be broadcast? Only for tables no larger than what they are read from."""
    size = leaf_bytes(df)
    limit = broadcast_limit(df) if limit is None else limit
    return size is not None and size * EXPANSION <= limit


def hot_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys holding more than ``share`` of the rows: at most 1/share of them."""
    return _hot_counts(df, keys, share).select(*keys)


def _hot_counts(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__t")).scalar()
    return counts.where(F.col("__n") > total * F.lit(share))


def lookup(
    big: DataFrame, dim: DataFrame, on: list[str] | str, how: str = "left", *, limit: int | None = None
) -> DataFrame:
    """N:1 join of ``big`` to ``dim`` (unique on ``on``).

    A small ``dim`` (size checked) is broadcast. Otherwise it is a shuffle join whose hot
    partitions adaptive execution splits on the side of ``big`` (see session.RUNTIME_CONF);
    the few dim rows of such a partition are read once per split. Chained lookups keep one
    plan: nothing of ``big`` is computed twice.
    """
    on = [on] if isinstance(on, str) else list(on)
    return big.join(F.broadcast(dim) if is_small(dim, limit) else dim, on, how)


def hot_salts(big: DataFrame, on: list[str], share: float = 0.005, rows_per_salt: int = 1_000_000) -> DataFrame:
    """Hot keys of ``big`` with the number of copies each is dealt to (``__hot``)."""
    salts = F.greatest(F.lit(2), F.ceil(F.col("__n") / rows_per_salt)).cast("int")
    return _hot_counts(big, on, share).select(*on, salts.alias("__hot"))


def salted_join(
    big: DataFrame, other: DataFrame, on: list[str] | str, how: str = "inner", *, share: float = 0.005, rows_per_salt: int = 1_000_000,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join with the hot keys of ``big`` salted. ``how``: inner, left, left_semi, left_anti.

    For joins that fan out on both sides, where splitting one side's partition is not
    enough: each copy of a hot key meets every match, in as many tasks as the key has
    ``rows_per_salt`` rows in ``big`` (two at least). ``big`` is read three times, so it should be a stored or checkpointed table;
    who joins it again and again counts its hot keys once and hands them in (``hot``, of ``hot_salts``).
    """
    on = [on] if isinstance(on, str) else list(on)
    rest = [c for c in big.columns if c not in on]
    hot = F.broadcast(hot_salts(big, on, share, rows_per_salt) if hot is None else hot)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in (rest or on)]), F.col("__hot")).cast("int")
    left = big.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), spread).otherwise(0)).drop("__hot")
    every = F.sequence(F.lit(0), F.col("__hot") - 1)
    right = (
        other.join(hot, on, "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot").isNotNull(), every).otherwise(F.array(F.lit(0)))))
        .drop("__hot")
    )
    out = left.join(right, [*on, "__salt"], how).drop("__salt")
    return out
