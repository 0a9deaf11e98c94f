"""Queries B1, B3, B6, B7: scalar exposure expressions over the candidate log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions.draw import uniform
from .registry import query
from .views import OMEGA_INTER, OMEGA_INTRA, SEED, Logs


@query("keep_probability", "SELECT impression_id, round(keep_probability, 9) AS keep_probability FROM impressions")
def _(t: Logs):
    keep = sc.keep_probability("user_community", "author_community", "risk_score", OMEGA_INTRA, OMEGA_INTER)
    return t.impressions.select("impression_id", F.round(keep, 9).alias("keep_probability"))


@query("exposure_decision", "SELECT impression_id, root_post_id, shown_u AS draw, shown FROM impressions")
def _(t: Logs):
    u = uniform(SEED, "timestep", "user_id", "root_post_id")
    return t.impressions.select("impression_id", "root_post_id", u.alias("draw"), (u < F.col("keep_probability")).alias("shown"))


@query(
    "risk_bucket",
    """SELECT post_id, CASE WHEN risk_score IS NULL THEN 'unknown' WHEN risk_score = 0 THEN 'low' WHEN risk_score = 1 THEN 'high' ELSE 'intermediate' END AS bucket,
         CASE WHEN risk_score IS NULL THEN 'unknown' WHEN risk_score <= 0.3 THEN 'low' WHEN risk_score >= 0.7 THEN 'high' ELSE 'intermediate' END AS band
       FROM (SELECT p.post_id, k.risk_score FROM post p LEFT JOIN post_risk k ON p.post_id = k.post_id)""",
)
def _(t: Logs):
    rows = t.post.select("post_id").join(t.post_risk, "post_id", "left")
    return rows.select("post_id", sc.risk_bucket("risk_score").alias("bucket"), sc.risk_band("risk_score").alias("band"))


@query(
    "community_relation",
    """SELECT a.rowid, CASE WHEN u.community = w.community THEN 'intra' WHEN u.community IS NOT NULL AND w.community IS NOT NULL THEN 'inter'
         WHEN a.target_post_id IS NULL THEN 'not_applicable' ELSE 'unknown' END AS relation
       FROM actions a LEFT JOIN users u ON a.user_id = u.user_id AND u.user_id % 9 <> 0 LEFT JOIN roots r ON a.target_post_id = r.post_id
       LEFT JOIN users w ON r.root_author_id = w.user_id""",
)
def _(t: Logs):
    # every ninth label hidden, so that unknown relations occur
    mine = t.users.where("user_id % 9 != 0").select("user_id", F.col("community").alias("user_community"))
    theirs = t.users.select(F.col("user_id").alias("root_author_id"), F.col("community").alias("author_community"))
    roots = t.roots.select(F.col("post_id").alias("target_post_id"), "root_author_id")
    rows = t.actions.select("rowid", "user_id", "target_post_id").join(mine, "user_id", "left").join(roots, "target_post_id", "left")
    rows = rows.join(theirs, "root_author_id", "left")
    return rows.select("rowid", sc.community_relation("user_community", "author_community", "target_post_id").alias("relation"))
