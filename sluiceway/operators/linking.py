"""As-of links between traces, feeds, impressions and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import first_items, next_value, prefix_scan, trailing_list
from ..functions.scalar import canonical_text
from ..functions.skew import is_small, lookup
from ..session import cut

REFRESH = "refresh"
#: Samples that may be broadcast, in bytes of memory.
SAMPLE_BYTES = 64 << 20


def token(rowid: str = "rowid", action: str = "action") -> Column:
    return F.concat(F.lit("trace-"), F.col(rowid).cast("string"), F.lit(":"), F.col(action))


def asof_last_feed(trace: DataFrame, **size) -> DataFrame:
    """Latest refresh row before each action of the same user (NULL when none)."""
    mark = F.when(F.col("action") == REFRESH, F.col("rowid"))
    return prefix_scan(trace, ["user_id"], "rowid", lasts={"refresh_id": mark}, **size).where(F.col("action") != REFRESH)


def unique_refresh_match(trace: DataFrame, **size) -> DataFrame:
    """The refresh between a user's previous action and this one, in the same timestep.

    Actions are numbered per user; all refreshes since the previous action share the
    number of the action they lead to, so matching is a grouping and needs no range
    join. The gaps of a user do not overlap: no refresh can serve two actions.
    """
    is_refresh = F.col("action") == REFRESH
    numbered = prefix_scan(
        trace.select("rowid", "user_id", "timestep", "action"), ["user_id"], "rowid",
        sums={"gap": (~is_refresh).cast("bigint")}, **size,
    )
    acts = numbered.where(~is_refresh).select("user_id", "gap", "timestep", "rowid", "action")
    found = numbered.where(is_refresh).groupBy("user_id", "gap", "timestep").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("rowid").alias("only")
    )
    out = acts.join(found, ["user_id", "gap", "timestep"], "left")
    n = F.coalesce("candidates", F.lit(0))
    return out.select(
        "rowid", "user_id", "timestep", "action", n.alias("candidates"),
        F.when(n == 1, F.col("only")).alias("refresh_id"),
        F.when(n != 1, "refresh match is not unique").alias("reason"),
    )


def behavior_history(trace: DataFrame, n: int, **size) -> DataFrame:
    """Last ``n`` tokens before each row, oldest first."""
    return trailing_list(trace, ["user_id"], "rowid", token(), "history", n, **size)


def first_history(trace: DataFrame, n: int) -> DataFrame:
    """The first ``n`` tokens of each user."""
    return first_items(trace.select("user_id", "rowid", "action"), ["user_id"], "rowid", token(), "history", n)


def bind_trace(decisions: DataFrame, trace: DataFrame, **size) -> DataFrame:
    """Smallest later trace of the same user with the expected trace action.

    ``decisions``: rowid (position of the decision), user_id, expected.
    """
    asks = decisions.select("user_id", F.col("expected").alias("act"), "rowid", F.lit(True).alias("ask"))
    marks = trace.select("user_id", F.col("action").alias("act"), "rowid", F.lit(False).alias("ask"))
    both = asks.unionByName(marks)
    value = F.when(~F.col("ask"), F.col("rowid"))
    # a trace with the decision's own row number is not later than it
    both = both.withColumn("pos", F.col("rowid") * 2 + F.when(F.col("ask"), 1).otherwise(0))
    out = next_value(both, ["user_id", "act"], "pos", value, "trace_rowid", **size)
    return out.where("ask").select("rowid", "user_id", F.col("act").alias("expected"), "trace_rowid")


def impression_index(impressions: DataFrame) -> DataFrame:
    """One row per (timestep, user, post): matches and the row itself when unique."""
    one = F.min(F.struct("impression_id", "shown", "risk_score", "author_community", "user_community"))
    return impressions.groupBy("timestep", "user_id", "post_id").agg(F.count(F.lit(1)).alias("matches"), one.alias("i"))


def feed_impression_link(actions: DataFrame, impressions: DataFrame) -> DataFrame:
    """Every visible post of every action with its impression, or the reason it has none."""
    posts = actions.select("rowid", "user_id", "timestep", F.posexplode("visible").alias("pos", "post_id"))
    rows = lookup(posts, impression_index(impressions), ["timestep", "user_id", "post_id"], "left")
    n = F.coalesce("matches", F.lit(0))
    pid = F.col("post_id").cast("string")
    one = n == 1
    return rows.select(
        "rowid",
        "pos",
        "post_id",
        n.alias("matches"),
        *[F.when(one, F.col("i")[c]).alias(c) for c in ("impression_id", "shown", "risk_score", "author_community")],
        F.when(~one, F.concat(F.lit("post "), pid, F.lit(" has "), n.cast("string"), F.lit(" matching impression rows")))
        .when(~F.col("i")["shown"], F.concat(F.lit("visible post "), pid, F.lit(" has an impression marked shown=0")))
        .alias("error"),
    )


def trace_label_diff(actions: DataFrame, labels: DataFrame) -> DataFrame:
    """Per sample id: trace only, label only, duplicate label, or label mismatch.

    ``actions``: sample_id, action. ``labels``: sample_id, action.
    """
    per = labels.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.min("action").alias("label"))
    both = actions.join(per, "sample_id", "full_outer")
    issue = F.filter(
        F.array(
            F.when(F.col("n").isNull(), F.lit("trace_only")),
            F.when(F.col("action").isNull(), F.lit("label_only")),
            F.when(F.col("n") > 1, F.lit("duplicate_label")),
            F.when(F.col("action").isNotNull() & F.col("label").isNotNull() & (F.col("action") != F.col("label")), F.lit("label_mismatch")),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select("sample_id", F.explode(issue).alias("issue"))


def duplicate_actions(trace: DataFrame) -> DataFrame:
    """Identical (user, time, action, info) rows: one row per group, of any size.

    Two infos are the same if their JSON says the same, in whatever order and spacing; the canonical text is returned.
    """
    return (
        trace.where(F.col("action") != REFRESH)
        .withColumn("info", canonical_text("info"))
        .groupBy("user_id", "timestep", "action", "info")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("rowid").alias("first_rowid"), F.max("rowid").alias("last_rowid"))
        .where("copies > 1")
    )


def repost_continuation(samples: DataFrame, impressions: DataFrame) -> DataFrame:
    """High-risk reposts whose created post is a candidate again at a later step.

    ``samples``: rowid, timestep, created_post_id. Candidates are first counted per
    (post, timestep), so a post shown to everybody is a few rows. Samples are few beside the
    impressions: stored, they are broadcast up to a checked size, and only candidates that one
    of them created are counted.
    """
    samples = cut(samples)
    made = samples.select(F.col("created_post_id").alias("post_id")).distinct()
    if is_small(samples, SAMPLE_BYTES):
        impressions = impressions.join(F.broadcast(made), "post_id", "left_semi")
    steps = impressions.groupBy(F.col("post_id").alias("created_post_id"), F.col("timestep").alias("seen_at")).agg(
        F.count(F.lit(1)).alias("n"), F.min("impression_id").alias("first")
    )
    later = samples.join(steps, "created_post_id").where(F.col("seen_at") > F.col("timestep"))
    return later.groupBy("rowid", "created_post_id").agg(
        F.sum("n").alias("later_impressions"), F.min("first").alias("first_impression_id")
    )


def decision_subset(decisions: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Only the listed decisions."""
    return decisions.join(wanted.select(*keys).distinct(), keys, "left_semi")
