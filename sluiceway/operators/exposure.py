"""Candidate generation, exposure policies and governed feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.draw import uniform
from ..functions.scalar import keep_probability
from ..functions.skew import is_small, lookup, salted_join
from ..session import cut

# ---- fixed values -------------------------------------------------------
EMPTY_FEED_MESSAGE = "No posts passed exposure policy."
# -------------------------------------------------------------------------


def following_topk(follow: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """Per follower the k best posts of followees (likes, then post id, descending).

    Only an author's own best k posts can ever be among a follower's best k, so posts
    are cut per author before the join and the join fans out by k at most. Repeated
    arcs repeat posts, as in a plain join.
    """
    best = W.partitionBy("user_id").orderBy(F.desc("num_likes"), F.desc("post_id"))
    tops = (
        posts.select("user_id", "post_id", "num_likes")
        .withColumn("r", F.row_number().over(best))
        .where(F.col("r") <= k)
        .groupBy(F.col("user_id").alias("followee_id"))
        .agg(F.collect_list(F.struct("num_likes", "post_id")).alias("tops"))
    )
    arcs = lookup(follow.select("follower_id", "followee_id"), tops, "followee_id", "inner")
    w = W.partitionBy("user_id").orderBy(F.desc("num_likes"), F.desc("post_id"))
    return (
        arcs.select(F.col("follower_id").alias("user_id"), F.inline("tops"))
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= k)
        .select("user_id", (F.col("r").cast("bigint") - 1).alias("rank"), "post_id", "num_likes")
    )


def recommendation_sample(rec: DataFrame, k: int, seed: int) -> DataFrame:
    """All recommendations in id order when at most k, else k of them in draw order.

    One bounded pass per user: ranks are only followed to k+1, so users with long
    lists are cut map-side.
    """
    counts = rec.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    drawn = rec.withColumn("u", uniform(seed, "user_id", "post_id"))
    w = W.partitionBy("user_id").orderBy("u", "post_id")
    picked = drawn.withColumn("draw_rank", F.row_number().over(w)).where(F.col("draw_rank") <= k)
    ordered = picked.join(counts, "user_id").withColumn(
        "key", F.when(F.col("n") > k, F.col("draw_rank").cast("bigint")).otherwise(F.col("post_id"))
    )
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("key")).cast("bigint") - 1
    return ordered.withColumn("rank", rank).select(
        "user_id", "rank", "post_id", (F.lit(1.0) / (F.col("rank") + 1)).alias("base_score")
    )


def merge_candidates(recommended: DataFrame, following: DataFrame) -> DataFrame:
    """Recommendations first, then followed posts; the first occurrence of a post wins.

    A followed post keeps the rank it has in the full following list, also when
    earlier entries turn out to be recommendations already.
    """
    both = recommended.select(
        "user_id", "post_id", F.lit(0).alias("part"), "rank", "base_score", F.lit("recommendation").alias("source")
    ).unionByName(
        following.select(
            "user_id",
            "post_id",
            F.lit(1).alias("part"),
            "rank",
            (F.col("num_likes").cast("double") + F.lit(1.0) / (F.col("rank") + 1)).alias("base_score"),
            F.lit("following").alias("source"),
        )
    )
    first = both.groupBy("user_id", "post_id").agg(F.min(F.struct("part", "rank", "base_score", "source")).alias("c"))
    w = W.partitionBy("user_id").orderBy(F.col("c")["part"], F.col("c")["rank"])
    return first.select(
        "user_id",
        (F.row_number().over(w).cast("bigint") - 1).alias("position"),
        "post_id",
        F.col("c")["base_score"].alias("base_score"),
        F.col("c")["source"].alias("source"),
    )


def joint_candidates(users: DataFrame, follow: DataFrame, posts: DataFrame, limit: int) -> DataFrame:
    """Others' posts, followed authors first, newest first, ``limit`` per user.

    An author's posts beyond the newest ``limit`` can never be chosen. A user short of
    followed posts has fewer than ``limit`` of them and at most ``limit`` own ones, so
    the globally newest 3*limit of the capped list hold enough others.
    """
    newest = W.partitionBy("user_id").orderBy(F.desc("post_id"))
    capped = (
        posts.select("user_id", "post_id")
        .withColumn("r", F.row_number().over(newest))
        .where(F.col("r") <= limit)
        .drop("r")
    )
    packed = capped.groupBy(F.col("user_id").alias("followee_id")).agg(F.collect_list("post_id").alias("ids"))
    arcs = follow.where("follower_id != followee_id").select("follower_id", "followee_id").distinct()
    followed = lookup(arcs, packed, "followee_id", "inner").select(
        F.col("follower_id").alias("user_id"), F.explode("ids").alias("post_id"), F.lit(0).alias("part")
    )
    top = W.partitionBy("user_id").orderBy(F.desc("post_id"))
    followed = followed.withColumn("r", F.row_number().over(top)).where(F.col("r") <= limit).drop("r")
    have = followed.groupBy("user_id").agg(F.count(F.lit(1)).alias("have"))
    short = users.select("user_id").join(have, "user_id", "left").where(F.coalesce("have", F.lit(0)) < limit)
    pool = (
        capped.orderBy(F.desc("post_id"))
        .limit(3 * limit)
        .agg(F.collect_list(F.struct(F.col("user_id").alias("author"), "post_id")))
        .scalar()
    )
    offered = short.select("user_id", F.inline(pool)).where("author != user_id")
    known = arcs.select(F.col("follower_id").alias("user_id"), F.col("followee_id").alias("author"))
    extra = offered.join(known, ["user_id", "author"], "left_anti").select("user_id", "post_id", F.lit(1).alias("part"))
    w = W.partitionBy("user_id").orderBy("part", F.desc("post_id"))
    return (
        followed.unionByName(extra)
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= limit)
        .withColumn("position", F.col("r").cast("bigint") - 1)
        .select(
            "user_id",
            "position",
            "post_id",
            (F.lit(1.0) / (F.col("position") + 1)).alias("base_score"),
            F.when(F.col("part") == 0, "following").otherwise("recommendation").alias("source"),
        )
    )


def policy_array(policies: list[tuple[str, str, float, float]]) -> Column:
    """Literal array of (policy, kind, omega_intra, omega_inter); kind: weighted or uniform."""
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("policy"), F.lit(k).alias("kind"), F.lit(a).alias("omega_intra"), F.lit(b).alias("omega_inter")
            )
            for n, k, a, b in policies
        ]
    )


def policy_variants(rows: DataFrame, policies: list[tuple[str, str, float, float]]) -> DataFrame:
    """Every candidate under every policy; a uniform policy ignores the risk."""
    each = rows.select("*", F.inline(policy_array(policies)))
    return each.withColumn(
        "keep_probability",
        F.when(F.col("kind") == "uniform", F.col("omega_intra")).otherwise(
            keep_probability("user_community", "author_community", "risk_score", "omega_intra", "omega_inter")
        ),
    )


def resolve_candidates(
    candidates: DataFrame, roots: DataFrame, users: DataFrame, risk: DataFrame, *, limit: int | None = None
) -> DataFrame:
    """Attach root, author community and risk (the root's, else the post's own)."""
    known = roots.select("post_id", "root_post_id", "root_author_id")
    out = lookup(candidates, known, "post_id", limit=limit)
    out = lookup(out, users.select("user_id", F.col("community").alias("user_community")), "user_id", limit=limit)
    out = lookup(
        out,
        users.select(F.col("user_id").alias("root_author_id"), F.col("community").alias("author_community")),
        "root_author_id",
        limit=limit,
    )
    out = lookup(
        out,
        risk.select(F.col("post_id").alias("root_post_id"), F.col("risk_score").alias("root_risk")),
        "root_post_id",
        limit=limit,
    )
    own = risk.select("post_id", F.col("risk_score").alias("own_risk"))
    out = lookup(out, own, "post_id", limit=limit)
    return out.withColumn("risk_score", F.coalesce("root_risk", "own_risk")).drop("root_risk", "own_risk")


def govern(
    candidates: DataFrame,
    roots: DataFrame,
    users: DataFrame,
    risk: DataFrame,
    omega_intra: Column,
    omega_inter: Column,
    *,
    seed: int,
    limit: int | None = None,
) -> DataFrame:
    """Impression rows of every refresh whose candidates are all complete.

    A refresh with a single unresolved root, community or risk emits nothing.
    """
    rows = resolve_candidates(candidates, roots, users, risk, limit=limit)
    missing = (
        F.col("root_post_id").isNull()
        | F.col("user_community").isNull()
        | F.col("author_community").isNull()
        | F.col("risk_score").isNull()
    )
    # candidates of one refresh are few (its feed size), so the flag is a narrow group
    failed = F.max(missing).over(W.partitionBy("refresh_id"))
    rows = rows.withColumn("refresh_failed", failed).where(~F.col("refresh_failed")).drop("refresh_failed")
    keep = keep_probability("user_community", "author_community", "risk_score", omega_intra, omega_inter)
    return (
        rows.withColumn("omega_intra", omega_intra)
        .withColumn("omega_inter", omega_inter)
        .withColumn("keep_probability", keep)
        .withColumn("shown", uniform(seed, "timestep", "user_id", "root_post_id") < F.col("keep_probability"))
    )


def governed_feed(impressions: DataFrame, refreshes: DataFrame) -> DataFrame:
    """Shown posts per refresh in candidate order, with a message when none is left."""
    shown = (
        impressions.where("shown")
        .groupBy("refresh_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "post_id"))).alias("s"))
        .select("refresh_id", F.transform("s", lambda x: x["post_id"]).alias("posts"))
    )
    return refreshes.join(shown, "refresh_id", "left").select(
        *refreshes.columns,
        F.coalesce("posts", F.array().cast("array<bigint>")).alias("posts"),
        F.when(F.col("posts").isNull(), EMPTY_FEED_MESSAGE).alias("message"),
    )


def format_feed(
    shown: DataFrame, posts: DataFrame, roots: DataFrame, comments: DataFrame, *, report_threshold: int, show_score: bool = True
) -> DataFrame:
    """Feed entry of every shown post.

    A repost shows content and counters of its root, a quote its own; posts whose
    parent or root is gone are dropped; much reported posts carry a warning.
    """
    p = posts.select(
        "post_id", F.col("user_id").alias("author_id"), "original_post_id", "quote_content", "content", "created_at",
        "num_likes", "num_dislikes", "num_shares", "num_reports",
    )
    rows = lookup(shown, p, "post_id", "inner")
    rows = lookup(rows, roots.select("post_id", "root_post_id"), "post_id", "left")
    parents = posts.select(F.col("post_id").alias("original_post_id"), F.col("user_id").alias("parent_author"))
    rows = lookup(rows, parents, "original_post_id", "left")
    counters = ("content", "created_at", "num_likes", "num_dislikes", "num_shares", "num_reports")
    root_post = posts.select(F.col("post_id").alias("root_post_id"), *[F.col(c).alias(f"root_{c}") for c in counters])
    rows = lookup(rows, root_post, "root_post_id", "left")
    is_repost = F.col("original_post_id").isNotNull() & F.col("quote_content").isNull()
    is_quote = F.col("original_post_id").isNotNull() & F.col("quote_content").isNotNull()
    for c in counters:
        rows = rows.withColumn(c, F.when(is_repost, F.col(f"root_{c}")).otherwise(F.col(c)))
    rows = rows.where(F.col("original_post_id").isNull() | F.col("parent_author").isNotNull())
    who, whose = F.col("author_id").cast("string"), F.col("parent_author").cast("string")
    text = (
        F.when(is_repost, F.concat(F.lit("User "), who, F.lit(" reposted a post from User "), whose,
                                   F.lit(". Repost content: "), F.col("content"), F.lit(". ")))
        .when(is_quote, F.concat(F.lit("User "), who, F.lit(" quoted a post from User "), whose,
                                 F.lit(". Quote content: "), F.col("quote_content"),
                                 F.lit(". Original Content: "), F.col("content")))
        .otherwise(F.col("content"))
    )
    warn = F.concat(F.lit("[Warning: This post has been reported "), F.col("num_reports").cast("string"), F.lit(" times]\n"))
    text = F.when(F.col("num_reports") >= report_threshold, F.concat(warn, text)).otherwise(text)
    rows = rows.select(
        *shown.columns,
        F.when(is_repost, F.col("root_post_id")).otherwise(F.col("post_id")).alias("comments_post_id"),
        F.col("author_id"),
        text.alias("feed_content"),
        "created_at",
        "num_shares",
        "num_reports",
        *([(F.col("num_likes") - F.col("num_dislikes")).alias("score")] if show_score else [F.col("num_likes"), F.col("num_dislikes")]),
    )
    # comments stay in rows of their own, keyed by the post they belong to: a busy
    # post may hold any number of them
    counts = comments.groupBy(F.col("post_id").alias("comments_post_id")).agg(F.count(F.lit(1)).alias("comment_count"))
    return lookup(rows, counts, "comments_post_id", "left").withColumn(
        "comment_count", F.coalesce("comment_count", F.lit(0))
    )


def feed_comments(feed: DataFrame, comments: DataFrame, *, show_score: bool = True) -> DataFrame:
    """Comments of every feed entry, one row for each entry and comment.

    ``feed``: the formatted entries (comments_post_id is the root for a repost).
    ``comments``: comment_id, post_id, user_id, content, created_at, num_likes,
    num_dislikes. A busy post may hold any number of comments and be shown to anybody,
    so they are neither packed into arrays nor matched in a single task.
    """
    counters = [(F.col("num_likes") - F.col("num_dislikes")).alias("score")] if show_score else [F.col("num_likes"), F.col("num_dislikes")]
    rows = comments.select(
        F.col("post_id").alias("comments_post_id"), "comment_id", F.col("user_id").alias("commenter_id"), "content", "created_at", *counters
    )
    entries = feed.select("impression_id", "comments_post_id")
    if is_small(rows):
        return entries.join(F.broadcast(rows), "comments_post_id")
    return salted_join(cut(entries), rows, "comments_post_id")
