"""Queries J1-J6, B2, B15: candidates, policies, exposure, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import extensions
from ..operators import exposure
from .registry import query
from .views import OMEGA_INTER, OMEGA_INTRA, SEED, Logs

K = 5
POLICIES = [
    ("none", "weighted", 1.0, 1.0),
    ("global", "weighted", 0.6, 0.6),
    ("static", "weighted", 0.65, 0.3),
    ("uniform", "uniform", 0.6, 0.6),
]

FOLLOWING = f"""SELECT * FROM (SELECT f.follower_id AS user_id, row_number() OVER (PARTITION BY f.follower_id
    ORDER BY p.num_likes DESC, p.post_id DESC) - 1 AS rank, p.post_id, p.num_likes
    FROM follow f JOIN post p ON p.user_id = f.followee_id) WHERE rank < {K}"""
SAMPLED = f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY
      CASE WHEN n > {K} THEN d ELSE post_id END) - 1 AS rank, post_id,
      1.0::DOUBLE / row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN n > {K} THEN d ELSE post_id END) AS base_score
    FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY
      ('0x' || substr(md5('{SEED}|' || user_id || '|' || post_id), 1, 8))::BIGINT, post_id) AS d FROM rec) WHERE d <= {K}"""


@query("following_topk", "SELECT user_id, rank::BIGINT AS rank, post_id, num_likes FROM following", following=FOLLOWING)
def _(t: Logs):
    return exposure.following_topk(t.follow, t.post, K)


@query("recommendation_sample", "SELECT user_id, rank::BIGINT AS rank, post_id, base_score FROM sampled", sampled=SAMPLED)
def _(t: Logs):
    return exposure.recommendation_sample(t.rec, K, SEED)


MERGED = """SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY part, rank) - 1)::BIGINT AS position, post_id,
         base_score, source
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id, post_id ORDER BY part, rank) AS o FROM (
         SELECT user_id, post_id, 0 AS part, rank, base_score, 'recommendation' AS source FROM sampled
         UNION ALL SELECT user_id, post_id, 1, rank, num_likes::DOUBLE + 1.0::DOUBLE / (rank + 1), 'following' FROM following))
       WHERE o = 1"""


@query("candidate_merge", MERGED, following=FOLLOWING, sampled=SAMPLED)
def _(t: Logs):
    return exposure.merge_candidates(
        exposure.recommendation_sample(t.rec, K, SEED), exposure.following_topk(t.follow, t.post, K)
    )


@query("generator_by_rows", MERGED, following=FOLLOWING, sampled=SAMPLED)
def _(t: Logs):
    """The same candidates from a table function, swapped in by its name."""
    return extensions.call("generator", "merged_by_rows", rec=t.rec, follow=t.follow, posts=t.post, k=K, seed=SEED)


@query(
    "metrics_by_name",
    """SELECT 'size' AS metric, root_post_id, count(*)::DOUBLE AS value FROM roots GROUP BY 2
       UNION ALL SELECT 'depth', root_post_id, max(depth)::DOUBLE FROM roots GROUP BY 2
       UNION ALL SELECT 'authors', root_post_id, count(DISTINCT user_id)::DOUBLE FROM roots GROUP BY 2""",
)
def _(t: Logs):
    parts = [extensions.call("metric", n, posts=t.post, roots=t.roots).select(F.lit(n).alias("metric"), "root_post_id", "value") for n in ("size", "depth", "authors")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "joint_candidates",
    f"""SELECT user_id, position, post_id, 1.0::DOUBLE / (position + 1) AS base_score, source FROM (
         SELECT u.user_id, p.post_id, CASE WHEN f.a IS NULL THEN 'recommendation' ELSE 'following' END AS source,
           (row_number() OVER (PARTITION BY u.user_id ORDER BY f.a IS NULL, p.post_id DESC) - 1)::BIGINT AS position
         FROM users u JOIN post p ON p.user_id <> u.user_id
         LEFT JOIN (SELECT DISTINCT follower_id AS u, followee_id AS a FROM follow) f ON f.u = u.user_id AND f.a = p.user_id)
       WHERE position < {2 * K}""",
)
def _(t: Logs):
    return exposure.joint_candidates(t.users, t.follow, t.post, 2 * K)


IMPRESSION_COLUMNS = """impression_id, run_id, timestep, user_id, post_id, root_post_id, user_community, author_community,
    base_score, risk_score, omega_intra, omega_inter, round(keep_probability, 9) AS keep_probability, shown, source"""


@query("govern_exposure", f"SELECT {IMPRESSION_COLUMNS} FROM impressions")
def _(t: Logs):
    governed = exposure.govern(
        t.candidates, t.roots, t.users, t.post_risk, F.lit(OMEGA_INTRA), F.lit(OMEGA_INTER), seed=SEED
    )
    return governed.select(
        (F.col("refresh_id") * 2 + F.col("rank")).alias("impression_id"),
        "run_id", "timestep", "user_id", "post_id", "root_post_id", "user_community", "author_community", "base_score",
        "risk_score", "omega_intra", "omega_inter", F.round("keep_probability", 9).alias("keep_probability"), "shown", "source",
    )


@query(
    "govern_fail_closed",
    """SELECT c.refresh_id, c.post_id, r.root_post_id, coalesce(k1.risk_score, k2.risk_score) AS risk_score
       FROM candidates c JOIN roots r ON c.post_id = r.post_id
       LEFT JOIN labelled_risk k1 ON r.root_post_id = k1.post_id LEFT JOIN labelled_risk k2 ON c.post_id = k2.post_id
       WHERE c.refresh_id NOT IN (SELECT c.refresh_id FROM candidates c JOIN roots r ON c.post_id = r.post_id
         LEFT JOIN labelled_risk k1 ON r.root_post_id = k1.post_id LEFT JOIN labelled_risk k2 ON c.post_id = k2.post_id
         WHERE k1.risk_score IS NULL AND k2.risk_score IS NULL)""",
)
def _(t: Logs):
    governed = exposure.govern(
        t.candidates, t.roots, t.users, t.labelled_risk, F.lit(OMEGA_INTRA), F.lit(OMEGA_INTER), seed=SEED
    )
    return governed.select("refresh_id", "post_id", "root_post_id", "risk_score")


@query(
    "governed_feed",
    """SELECT rowid AS refresh_id, user_id, timestep, coalesce(s.posts, '') AS posts,
         CASE WHEN s.posts IS NULL THEN 'No posts passed exposure policy.' END AS message
       FROM trace0 LEFT JOIN (SELECT refresh_id, string_agg(post_id::VARCHAR, ',' ORDER BY rank) AS posts FROM impressions
         WHERE shown GROUP BY refresh_id) s ON rowid = s.refresh_id WHERE action = 'refresh'""",
)
def _(t: Logs):
    refreshes = t.trace.where("action = 'refresh'").select(F.col("rowid").alias("refresh_id"), "user_id", "timestep")
    return exposure.governed_feed(t.impressions, refreshes).withColumn(
        "posts", F.array_join(F.transform("posts", lambda x: x.cast("string")), ",")
    )


@query(
    "policy_variants",
    """SELECT impression_id, policy, round(CASE WHEN kind = 'uniform' THEN a ELSE 1.0::DOUBLE - risk_score * (1.0::DOUBLE -
           CASE WHEN user_community = author_community THEN a ELSE b END) END, 9) AS keep_probability
       FROM impressions, (VALUES ('none', 'weighted', 1.0::DOUBLE, 1.0::DOUBLE), ('global', 'weighted', 0.6, 0.6),
         ('static', 'weighted', 0.65, 0.3), ('uniform', 'uniform', 0.6, 0.6)) p(policy, kind, a, b)""",
)
def _(t: Logs):
    rows = t.impressions.select("impression_id", "user_community", "author_community", "risk_score")
    return exposure.policy_variants(rows, POLICIES).select("impression_id", "policy", F.round("keep_probability", 9).alias("keep_probability"))


@query(
    "feed_format",
    """SELECT impression_id, author_id, sha256(feed_content) AS content_hash, created_at, num_shares, num_reports, score,
         coalesce(m.c, 0)::BIGINT AS comment_count FROM (
       SELECT impression_id, author_id, CASE WHEN num_reports >= 3 THEN '[Warning: This post has been reported ' || num_reports
           || ' times]' || chr(10) || body ELSE body END AS feed_content, created_at, num_shares, num_reports, score, cid
       FROM (SELECT i.impression_id, p.user_id AS author_id,
         CASE WHEN rp THEN 'User ' || p.user_id || ' reposted a post from User ' || q.user_id || '. Repost content: '
             || r.content || '. '
           WHEN p.original_post_id IS NOT NULL THEN 'User ' || p.user_id || ' quoted a post from User ' || q.user_id
             || '. Quote content: ' || p.quote_content || '. Original Content: ' || p.content
           ELSE p.content END AS body,
         CASE WHEN rp THEN r.created_at ELSE p.created_at END AS created_at,
         CASE WHEN rp THEN r.num_shares ELSE p.num_shares END AS num_shares,
         CASE WHEN rp THEN r.num_reports ELSE p.num_reports END AS num_reports,
         CASE WHEN rp THEN r.num_likes - r.num_dislikes ELSE p.num_likes - p.num_dislikes END AS score,
         CASE WHEN rp THEN r.post_id ELSE p.post_id END AS cid
       FROM (SELECT impression_id, post_id, root_post_id FROM impressions WHERE shown) i
       JOIN (SELECT *, original_post_id IS NOT NULL AND quote_content IS NULL AS rp FROM post) p ON i.post_id = p.post_id
       LEFT JOIN post q ON p.original_post_id = q.post_id JOIN post r ON i.root_post_id = r.post_id))
       LEFT JOIN (SELECT conv_id AS p, count(*) AS c FROM conversations GROUP BY 1) m ON m.p = cid""",
)
def _(t: Logs):
    shown = t.impressions.where("shown").select("impression_id", "post_id")
    comments = t.table("conversations").select(F.col("conv_id").alias("post_id"), "turn")
    out = exposure.format_feed(shown, t.post, t.roots, comments, report_threshold=3)
    return out.select(
        "impression_id", "author_id", F.sha2("feed_content", 256).alias("content_hash"), "created_at", "num_shares",
        "num_reports", "score", "comment_count",
    )


@query(
    "feed_comments",
    """SELECT i.impression_id, CASE WHEN p.original_post_id IS NOT NULL AND p.quote_content IS NULL THEN i.root_post_id ELSE i.post_id END AS comments_post_id,
         c.turn AS comment_id, c.conv_id * 3 + c.turn AS commenter_id, sha256(c.text) AS content_hash, c.turn AS created_at, c.turn * 2 - c.conv_id % 3 AS score
       FROM impressions i JOIN post p ON p.post_id = i.post_id JOIN conversations c
         ON c.conv_id = CASE WHEN p.original_post_id IS NOT NULL AND p.quote_content IS NULL THEN i.root_post_id ELSE i.post_id END WHERE i.shown""",
)
def _(t: Logs):
    conv, turn = F.col("conv_id"), F.col("turn")
    # each text is hashed once, not once for each entry that shows it
    comments = t.table("conversations").select(
        conv.alias("post_id"), turn.alias("comment_id"), (conv * 3 + turn).alias("user_id"), F.sha2("text", 256).alias("content"),
        turn.alias("created_at"), (turn * 2).alias("num_likes"), (conv % 3).alias("num_dislikes"),
    )
    shown = t.impressions.where("shown").select("impression_id", "post_id")
    feed = exposure.format_feed(shown, t.post, t.roots, comments.select("post_id"), report_threshold=3)
    out = exposure.feed_comments(feed, comments)
    return out.select(
        "impression_id", "comments_post_id", "comment_id", "commenter_id", F.col("content").alias("content_hash"), "created_at", "score"
    )
