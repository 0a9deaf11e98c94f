"""Repost chains: roots, errors and cascade sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.skew import is_small, lookup
from ..session import cut

CYCLE = "cycle"


def _pointers(posts: DataFrame) -> DataFrame:
    """(post_id, user_id, ptr, hops, done, error): each post points at its parent, a root at itself."""
    parent = F.col("original_post_id")
    return posts.select(
        "post_id",
        "user_id",
        F.coalesce(parent, "post_id").alias("ptr"),
        F.when(parent.isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
        parent.isNull().alias("done"),
        F.lit(None).cast("string").alias("error"),
    )


def _double(jump: DataFrame, limit: int | None) -> DataFrame:
    """Pointer doubling: (post_id, user_id, ptr, hops, error), ``ptr`` the root or the absent post a chain ends at.

    Every round halves the remaining distance, so log2(depth) rounds suffice; rows already at
    a root leave the working set. A chain of any depth has ancestors at every smaller depth, so while
    a chain is open each round resolves some row: a round that resolves none leaves
    only rows on, or leading into, a cycle.
    """
    jump = cut(jump)
    finished = jump.where("done")
    open_rows = jump.where("not done")
    while True:
        asked = open_rows.select(F.col("ptr").alias("post_id")).distinct()
        table = finished.unionByName(open_rows).join(asked, "post_id", "left_semi").select(
            F.col("post_id").alias("ptr"),
            F.col("ptr").alias("next"),
            F.col("hops").alias("more"),
            F.col("done").alias("at_root"),
            F.col("error").alias("next_error"),
        )
        stepped = lookup(open_rows, table, "ptr", "left", limit=limit)
        missing = F.col("next").isNull()
        stepped = cut(
            stepped.select(
                "post_id",
                "user_id",
                F.coalesce("next", "ptr").alias("ptr"),
                (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                (missing | F.col("at_root")).alias("done"),
                F.when(missing, F.concat(F.lit("absent post "), F.col("ptr").cast("string")))
                .otherwise(F.col("next_error"))
                .alias("error"),
            )
        )
        resolved = stepped.where("done")
        finished = finished.unionByName(resolved)
        open_rows = stepped.where("not done")
        if open_rows.isEmpty() or resolved.isEmpty():
            break
    return finished.unionByName(open_rows.withColumn("error", F.lit(CYCLE))).drop("done")


def resolve_chains(posts: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Pointer doubling over parent links: (post_id, user_id, root_post_id, depth, error)."""
    sound = F.col("error").isNull()
    return _double(_pointers(posts), limit).select(
        "post_id", "user_id", F.when(sound, F.col("ptr")).alias("root_post_id"), F.when(sound, F.col("hops")).alias("depth"), "error"
    )


def _asked(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of a large table with one of a few keys."""
    wanted = ids.select(F.col("ptr").alias(key)).distinct()
    return table.join(F.broadcast(wanted) if is_small(wanted) else wanted, key, "left_semi")


def extend_forest(rooted: DataFrame, waiting: DataFrame, batch: DataFrame, *, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """New posts against the roots known so far: (newly rooted, all that wait now).

    ``rooted``: post_id, user_id, root_post_id, root_author_id, depth; a row never changes.
    ``waiting``: post_id, user_id, ptr, hops, error; posts whose chain ends at an absent post ``ptr``,
    ``hops`` above them, or in a cycle. ``batch``: post_id, user_id, original_post_id, none of
    them known before.

    Posts that wait for one of the batch are opened again, from where their chain ended; all
    other rows are left alone. Of ``rooted`` only the rows that the batch points at are looked up.
    """
    here = cut(_pointers(batch))
    arrived = here.select(F.col("post_id").alias("ptr"))
    again = waiting.where(f"error <> '{CYCLE}'").join(arrived, "ptr", "left_semi").select(
        "post_id", "user_id", "ptr", "hops", F.lit(False).alias("done"), F.lit(None).cast("string").alias("error")
    )
    met = cut(_double(here.unionByName(again), limit))
    inside = with_root_author(
        met.where("error is null").select("post_id", "user_id", F.col("ptr").alias("root_post_id"), F.col("hops").alias("depth")), met.where("hops = 0"), limit=limit
    )
    # chains that leave the batch end at a post known before, or at one that is still absent
    leaving = met.where(F.col("error").isNotNull() & (F.col("error") != CYCLE))
    known = _asked(rooted, leaving, "post_id").select(F.col("post_id").alias("ptr"), "root_post_id", "root_author_id", F.col("depth").alias("more"))
    halted = _asked(waiting, leaving, "post_id").select(F.col("post_id").alias("ptr"), F.col("ptr").alias("next"), F.col("hops").alias("next_hops"), F.col("error").alias("next_error"))
    ended = cut(leaving.join(known, "ptr", "left").join(halted, "ptr", "left"))
    through = ended.where("root_post_id is not null").select("post_id", "user_id", "root_post_id", "root_author_id", (F.col("hops") + F.col("more")).alias("depth"))
    still = ended.where("root_post_id is null").select(
        "post_id", "user_id", F.coalesce("next", "ptr").alias("ptr"), (F.col("hops") + F.coalesce("next_hops", F.lit(0))).alias("hops"), F.coalesce("next_error", "error").alias("error")
    )
    untouched = waiting.join(again.select("post_id"), "post_id", "left_anti")
    circles = met.where(f"error = '{CYCLE}'")
    columns = ["post_id", "user_id", "root_post_id", "root_author_id", "depth"]
    return inside.select(*columns).unionByName(through.select(*columns)), untouched.unionByName(still).unionByName(circles.select(*untouched.columns))


def post_roots(posts: DataFrame, *, limit: int | None = None) -> DataFrame:
    """(post_id, user_id, root_post_id, root_author_id, depth); rows with an error are left out."""
    chains = resolve_chains(posts, limit=limit).where("error is null").drop("error")
    return with_root_author(chains, posts, limit=limit)


def with_root_author(chains: DataFrame, posts: DataFrame, *, limit: int | None = None) -> DataFrame:
    authors = chains.where("depth = 0").select(
        F.col("post_id").alias("root_post_id"), F.col("user_id").alias("root_author_id")
    )
    return lookup(chains, authors, "root_post_id", "left", limit=limit)


def cascade_direct(posts: DataFrame) -> DataFrame:
    """Posts that are the root or point straight at it; one level only."""
    rooted = posts.select(F.coalesce("original_post_id", "post_id").alias("root_post_id"))
    sizes = rooted.groupBy("root_post_id").agg(F.count(F.lit(1)).alias("cascade_size"))
    roots = posts.where("original_post_id is null").select(F.col("post_id").alias("root_post_id"))
    return sizes.join(roots, "root_post_id", "left_semi")


def cascade_full(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """All descendants per root: size, maximum depth, distinct authors, reposts, quotes."""
    kind = posts.select(
        "post_id",
        (F.col("original_post_id").isNotNull() & F.col("quote_content").isNull()).alias("is_repost"),
        (F.col("original_post_id").isNotNull() & F.col("quote_content").isNotNull()).alias("is_quote"),
    )
    rows = roots.select("post_id", "root_post_id", "user_id", "depth").join(kind, "post_id")
    # distinct authors are counted over (root, author) partials, so a viral root is spread
    by_author = rows.groupBy("root_post_id", "user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("depth").alias("d"),
        F.count_if("is_repost").alias("r"),
        F.count_if("is_quote").alias("q"),
    )
    return by_author.groupBy("root_post_id").agg(
        F.sum("n").alias("cascade_size"),
        F.max("d").alias("max_depth"),
        F.count(F.lit(1)).alias("authors"),
        F.sum("r").alias("reposts"),
        F.sum("q").alias("quotes"),
    )


def root_adopters(roots: DataFrame, users: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Distinct authors per root with the community of the root author."""
    pairs = roots.select("root_post_id", "user_id", "root_author_id").distinct()
    dim = users.select(F.col("user_id").alias("root_author_id"), F.col("community").alias("root_community"))
    return lookup(pairs, dim, "root_author_id", "left", limit=limit).select(
        "root_post_id", "user_id", "root_community"
    )
