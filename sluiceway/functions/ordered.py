"""Ordered operators (running values, as-of, trailing lists) without one task per key.

A window partitioned by a key alone puts all rows of that key into one task. Here the
table is range-partitioned by key and order, so a hot key spans many partitions, whatever
its ids look like. Each (key, partition) is reduced to one row, the carry over partitions
is a window over those few rows, and the rows themselves are only windowed inside their
partition. The partitioned table is stored once, which fixes the partition of each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut

SEGMENT = 100_000


def _div(name: str, n: int) -> Column:
    """Integer division; a float would lose the low digits of large numbers."""
    return F.expr(f"`{name}` div {n}")


def _blocked(df: DataFrame, keys: list[str], order: str, blocks: int | None) -> DataFrame:
    ranges = [*([blocks] if blocks else []), *keys, order]
    return cut(df.repartitionByRange(*ranges).withColumn("__blk", F.spark_partition_id()))


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    *,
    trails: dict[str, tuple[Column, int]] | None = None,
    inclusive: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """Per row, the sum / latest non-null value of the rows before it in its key.

    ``order`` is a column of any orderable type, unique within a key. ``lasts`` takes
    any value; the latest row (by ``order``) where it is not null wins. ``trails``: (item, n), the
    non-null items of the n rows before this one, oldest first, as trailing_list gives them, in the same pass.
    """
    sums, lasts, trails = sums or {}, lasts or {}, trails or {}
    d = df
    for name, expr in sums.items():
        d = d.withColumn(f"__s_{name}", F.coalesce(expr, F.lit(0)))
    for name, expr in lasts.items():
        # the greatest (order, value) struct is the latest one
        d = d.withColumn(f"__l_{name}", F.when(expr.isNotNull(), F.struct(F.col(order).alias("o"), expr.alias("v"))))
    for name, (item, _) in trails.items():
        # in a struct, so that a null takes its place among the n rows
        d = d.withColumn(f"__t_{name}", F.struct(item.alias("v")))
    d = _blocked(d, keys, order, blocks)
    part = [*keys, "__blk"]
    ends = {name: _ends(d, keys, order, f"__t_{name}", n) for name, (_, n) in trails.items()}
    blocks = d.groupBy(*part).agg(
        *[F.sum(f"__s_{n}").alias(f"__c_{n}") for n in sums],
        *[F.max(f"__l_{n}").alias(f"__d_{n}") for n in lasts],
    )
    before = W.partitionBy(*keys).orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.select(
        *part,
        *[F.sum(f"__c_{n}").over(before).alias(f"__c_{n}") for n in sums],
        *[F.max(f"__d_{n}").over(before).alias(f"__d_{n}") for n in lasts],
    )
    here = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    for n in sums:
        d = d.withColumn(f"__s_{n}", F.sum(f"__s_{n}").over(here))
    for n in lasts:
        d = d.withColumn(f"__l_{n}", F.max(f"__l_{n}").over(here))
    for name, (_, n) in trails.items():
        d = d.withColumn(f"__t_{name}", F.collect_list(f"__t_{name}").over(W.partitionBy(*part).orderBy(order).rowsBetween(-n, -1)))
    out = d.join(carry, part, "left") if sums or lasts else d
    for name, (_, n) in trails.items():
        same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(part)]
        out = out.join(F.broadcast(ends[name]), same, "left").drop(*[f"__k{i}" for i in range(len(part))])
        both = F.concat(F.coalesce("__e", F.slice(f"__t_{name}", 1, 0)), F.col(f"__t_{name}"))
        kept = F.filter(F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), n), lambda x: x["v"].isNotNull())
        out = out.withColumn(name, F.transform(kept, lambda x: x["v"])).drop("__e", f"__t_{name}")
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(f"__s_{n}"), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)))
    for n in lasts:
        out = out.withColumn(n, F.coalesce(F.col(f"__l_{n}"), F.col(f"__d_{n}"))["v"])
    scratch = ["__blk", *[f"__{t}_{n}" for t in "sc" for n in sums], *[f"__{t}_{n}" for t in "ld" for n in lasts]]
    return out.drop(*scratch)


def _ends(d: DataFrame, keys: list[str], order: str, item: str, n: int) -> DataFrame:
    """Per (key, partition) of a key in several partitions, its last ``n`` items of the partitions before.

    Ranges leave at most two such keys in a partition, so this has about as many rows as there are partitions.
    """
    part = [*keys, "__blk"]
    pairs = d.select(*part).distinct().withColumn("__many", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    spans = pairs.where("__many > 1").select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(part)])
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(part)]
    near = d.select(*part, order, item).join(F.broadcast(spans), same)
    names = [f"__k{i}" for i in range(len(part))]
    last = near.withColumn("__r", F.row_number().over(W.partitionBy(*names).orderBy(F.desc(order)))).where(F.col("__r") <= n)
    tails = last.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct((-F.col("__r")).alias("r"), F.col(item).alias("i")))).alias("__a"))
    before = W.partitionBy(*names[:-1]).orderBy(names[-1]).rowsBetween(-n, -1)
    return tails.select(*names, F.transform(F.flatten(F.collect_list("__a").over(before)), lambda x: x["i"]).alias("__e"))


def next_value(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, *, blocks: int | None = None
) -> DataFrame:
    """Per row, the nearest following non-null ``value`` within its key."""
    d = df.withColumn("__v", F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v"))))
    d = _blocked(d, keys, order, blocks)
    part = [*keys, "__blk"]
    blocks = d.groupBy(*part).agg(F.min("__v").alias("__m"))
    after = W.partitionBy(*keys).orderBy("__blk").rowsBetween(1, W.unboundedFollowing)
    carry = blocks.select(*part, F.min("__m").over(after).alias("__m"))
    here = W.partitionBy(*part).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    d = d.withColumn("__v", F.min("__v").over(here))
    return (
        d.join(carry, part, "left").withColumn(name, F.coalesce("__v", "__m")["v"]).drop("__blk", "__v", "__m")
    )


def trailing_list(
    df: DataFrame,
    keys: list[str],
    order: str,
    item: Column,
    name: str,
    n: int,
    *,
    blocks: int | None = None,
    segment: int = SEGMENT,
) -> DataFrame:
    """The last ``n`` items before each row, oldest first.

    Rows get their position in the key, are cut into segments of equal length, and the
    last ``n`` rows of a segment are repeated in the next one.
    """
    if segment < n:
        raise ValueError("segment must be at least n")
    d = prefix_scan(df, keys, order, sums={"__pos": F.lit(1)}, blocks=blocks).withColumn("__item", item)
    seg = _div("__pos", segment)
    edge = F.col("__pos") % F.lit(segment) >= segment - n
    d = d.withColumn("__seg", F.explode(F.when(edge, F.array(seg, seg + 1)).otherwise(F.array(seg))))
    w = W.partitionBy(*keys, "__seg").orderBy(order).rowsBetween(-n, -1)
    d = d.withColumn(name, F.collect_list("__item").over(w))
    return d.where(F.col("__seg") == seg).drop("__pos", "__item", "__seg")


def first_items(df: DataFrame, keys: list[str], order: str, item: Column, name: str, n: int) -> DataFrame:
    """Per key, the array of its first ``n`` items (bounded by the per-key top-k)."""
    w = W.partitionBy(*keys).orderBy(order)
    top = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    packed = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", item.alias("i")))).alias("__a"))
    return packed.select(*keys, F.transform("__a", lambda x: x["i"]).alias(name))
