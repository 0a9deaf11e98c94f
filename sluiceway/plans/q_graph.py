"""Queries G1-G14 and M20: repost chains, contact graph, threshold adoption."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, hierarchy, threshold
from .registry import query
from .views import Logs

THETA = 0.06


@query("post_roots", "SELECT post_id, root_post_id, root_author_id, depth FROM roots")
def _(t: Logs):
    return hierarchy.post_roots(t.post).select("post_id", "root_post_id", "root_author_id", "depth")


def _damaged(t: Logs):
    """The forest with holes (every 37th post gone) and two-post cycles."""
    d = F.col("post_id")
    parent = F.when((d % 41 == 1), d + 1).when((d % 41 == 2), d - 1).otherwise(F.col("original_post_id"))
    return t.post.where(d % 37 != 36).withColumn("original_post_id", parent)


@query(
    "post_root_errors",
    """SELECT post_id, error FROM (
         SELECT p.post_id, CASE WHEN a.post_id IS NOT NULL THEN 'absent' WHEN g.post_id IS NULL THEN 'cycle' END AS error
         FROM damaged p LEFT JOIN good g ON p.post_id = g.post_id LEFT JOIN lost a ON p.post_id = a.post_id)
       WHERE error IS NOT NULL""",
    damaged="""SELECT post_id, CASE WHEN post_id % 41 = 1 THEN post_id + 1 WHEN post_id % 41 = 2 THEN post_id - 1
         ELSE original_post_id END AS parent FROM post WHERE post_id % 37 <> 36""",
    good="""SELECT post_id FROM damaged WHERE parent IS NULL
         UNION ALL SELECT d.post_id FROM damaged d JOIN good g ON d.parent = g.post_id""",
    lost="""SELECT post_id FROM damaged WHERE parent IS NOT NULL AND parent NOT IN (SELECT post_id FROM damaged)
         UNION ALL SELECT d.post_id FROM damaged d JOIN lost l ON d.parent = l.post_id""",
)
def _(t: Logs):
    bad = hierarchy.resolve_chains(_damaged(t)).where("error is not null")
    return bad.select("post_id", F.substring_index("error", " ", 1).alias("error"))


@query(
    "cascade_size_direct",
    """SELECT r.post_id AS root_post_id, count(*)::BIGINT AS cascade_size FROM post r
       JOIN post p ON p.post_id = r.post_id OR p.original_post_id = r.post_id
       WHERE r.original_post_id IS NULL GROUP BY 1""",
)
def _(t: Logs):
    return hierarchy.cascade_direct(t.post)


@query(
    "cascade_size_full",
    """SELECT r.root_post_id, count(*)::BIGINT AS cascade_size, max(r.depth) AS max_depth,
         count(DISTINCT r.user_id)::BIGINT AS authors,
         (count(*) FILTER (p.original_post_id IS NOT NULL AND p.quote_content IS NULL))::BIGINT AS reposts,
         (count(*) FILTER (p.original_post_id IS NOT NULL AND p.quote_content IS NOT NULL))::BIGINT AS quotes
       FROM roots r JOIN post p ON p.post_id = r.post_id GROUP BY 1""",
)
def _(t: Logs):
    return hierarchy.cascade_full(t.post, t.roots)


@query("contact_edges", "SELECT src, dst FROM edges")
def _(t: Logs):
    return graph.contact_edges(t.follow)


MIX = """SELECT '{mode}' AS mode, (count(*) FILTER (s.community = d.community AND a <> b))::BIGINT AS intra_edges,
    (count(*) FILTER (s.community <> d.community))::BIGINT AS inter_edges, (count(*) FILTER (a <> b))::BIGINT AS total_edges,
    (count(*) FILTER (s.community <> d.community))::DOUBLE / nullif(count(*) FILTER (a <> b), 0) AS mu,
    coalesce(sum(n) FILTER (a = b), 0)::BIGINT AS self_loops, coalesce(sum(n - 1) FILTER (a <> b), 0)::BIGINT AS duplicates,
    count(*) = count(s.community) AND count(*) = count(d.community) AS valid
  FROM (SELECT {ends}, count(*) AS n FROM follow GROUP BY 1, 2)
  LEFT JOIN users s ON a = s.user_id LEFT JOIN users d ON b = d.user_id"""


@query(
    "mixing_stats",
    MIX.format(mode="symmetrize", ends="least(follower_id, followee_id) AS a, greatest(follower_id, followee_id) AS b")
    + " UNION ALL "
    + MIX.format(mode="arcs", ends="follower_id AS a, followee_id AS b"),
)
def _(t: Logs):
    return graph.mixing_stats(t.follow, t.users).unionByName(graph.mixing_stats(t.follow, t.users, "arcs"))


@query(
    "mixing_per_community",
    """SELECT u.community, count(*)::BIGINT AS nodes, coalesce(sum(intra), 0)::BIGINT AS intra_incidents,
         coalesce(sum(inter), 0)::BIGINT AS inter_incidents, (count(*) FILTER (c.user_id IS NULL))::BIGINT AS isolated_nodes
       FROM users u LEFT JOIN (SELECT c.user_id, count(*) FILTER (a.community = b.community) AS intra,
           count(*) FILTER (a.community <> b.community) AS inter
         FROM contacts c JOIN users a ON c.user_id = a.user_id JOIN users b ON c.neighbor_id = b.user_id GROUP BY 1) c
       ON u.user_id = c.user_id GROUP BY 1""",
)
def _(t: Logs):
    return graph.mixing_per_community(t.follow, t.users)


@query(
    "missing_community_edges",
    """SELECT follower_id AS src, followee_id AS dst FROM follow
       WHERE follower_id NOT IN (SELECT user_id FROM users WHERE user_id % 50 <> 0)
         OR followee_id NOT IN (SELECT user_id FROM users WHERE user_id % 50 <> 0)""",
)
def _(t: Logs):
    # every 50th label removed: all endpoints of the whole table are labelled otherwise
    return graph.missing_community_edges(t.follow, t.users.where("user_id % 50 != 0"))


@query(
    "degree_split",
    """SELECT u.user_id, count(c.neighbor_id)::BIGINT AS total_degree,
         (count(*) FILTER (b.community = u.community))::BIGINT AS intra_degree,
         (count(*) FILTER (b.community <> u.community))::BIGINT AS inter_degree
       FROM users u LEFT JOIN contacts c ON u.user_id = c.user_id LEFT JOIN users b ON c.neighbor_id = b.user_id GROUP BY 1""",
)
def _(t: Logs):
    return graph.degree_split(t.follow, t.users)


@query("root_adopters", "SELECT root_post_id, user_id, root_community FROM adopters")
def _(t: Logs):
    return hierarchy.root_adopters(t.roots, t.users)


# what changes at a step: adopters of earlier steps, and what the feeds of the step itself show
STEPS = {
    "adopted_at": """SELECT r.root_post_id, r.user_id, min(p.created_at) AS step FROM roots r JOIN post p ON r.post_id = p.post_id GROUP BY 1, 2""",
    "sighted": """SELECT DISTINCT i.user_id, i.root_post_id, p.user_id AS adopter_id, i.timestep FROM impressions i
      JOIN post p ON i.post_id = p.post_id WHERE i.shown""",
    "steps": """SELECT unnest(range(0::BIGINT, (SELECT max(m) + 2 FROM (SELECT max(created_at) AS m FROM post UNION ALL SELECT max(timestep) FROM trace0)))) AS t""",
    "degrees": "SELECT user_id, count(*) AS degree, count(*) FILTER (same) AS intra FROM labelled GROUP BY 1",
    "labelled": """SELECT c.user_id, c.neighbor_id, a.community = b.community AS same FROM contacts c
      JOIN users a ON c.user_id = a.user_id JOIN users b ON c.neighbor_id = b.user_id""",
    "per_step": f"""SELECT t AS timestep, p.user_id, p.root_post_id, ai::BIGINT AS adopted_intra, ae::BIGINT AS adopted_inter,
      oi::BIGINT AS observable_intra, oe::BIGINT AS observable_inter, g.degree::BIGINT AS total_degree, g.intra::BIGINT AS intra_degree,
      {THETA}::DOUBLE * g.degree AS bound, 1.0::DOUBLE * ai + 0.5::DOUBLE * ae AS native_signal, 1.0::DOUBLE * oi + 0.5::DOUBLE * oe AS observable_signal,
      coalesce(own.step < t, false) AS already_adopted
    FROM (SELECT s.t, c.user_id, a.root_post_id, count(*) FILTER (same) AS ai, count(*) FILTER (NOT same) AS ae,
        count(*) FILTER (same AND o.adopter_id IS NOT NULL) AS oi, count(*) FILTER (NOT same AND o.adopter_id IS NOT NULL) AS oe
      FROM labelled c JOIN adopted_at a ON c.neighbor_id = a.user_id JOIN steps s ON a.step < s.t
      LEFT JOIN sighted o ON o.user_id = c.user_id AND o.root_post_id = a.root_post_id AND o.adopter_id = c.neighbor_id AND o.timestep = s.t
      GROUP BY 1, 2, 3) p
    JOIN degrees g ON g.user_id = p.user_id LEFT JOIN adopted_at own ON own.user_id = p.user_id AND own.root_post_id = p.root_post_id""",
    "root_label": "SELECT DISTINCT root_post_id, root_community FROM adopters",
    "decisions": "SELECT DISTINCT user_id, timestep FROM trace0 WHERE action = 'refresh'",
}
JUDGED = f"""user_id, root_post_id, u.community AS user_community, l.root_community, adopted_intra, adopted_inter, observable_intra,
    observable_inter, total_degree, intra_degree, total_degree - intra_degree AS inter_degree, {THETA}::DOUBLE AS threshold, round(bound, 6) AS boundary,
    native_signal, observable_signal, already_adopted, native_signal > bound AS native_satisfied, observable_signal > bound AS observable_satisfied,
    observable_signal > bound AS threshold_satisfied, observable_intra + observable_inter > 0 AS gate_passed,
    native_signal > bound AND NOT observable_signal > bound AS blocked, observable_signal > bound AND NOT already_adopted AS should_attempt"""
LABELS = "JOIN users u USING (user_id) LEFT JOIN root_label l USING (root_post_id)"


def _states(t: Logs):
    authors = t.post.select("post_id", F.col("user_id").alias("adopter_id"))
    seen = t.impressions.where("shown").select("user_id", "root_post_id", "post_id", F.col("timestep").alias("step")).distinct()
    sightings = seen.join(authors, "post_id").drop("post_id")
    labels = hierarchy.root_adopters(t.roots, t.users).select("root_post_id", "root_community").distinct()
    return threshold.threshold_states(
        t.follow, t.users, t.adoptions, sightings, labels, threshold=THETA, weight_intra=1.0, weight_inter=0.5
    )


@query(
    "threshold_evaluation",
    f"""SELECT timestep, CASE WHEN follows THEN until END AS until, {JUDGED}
        FROM (SELECT *, lead(timestep) OVER w AS until, lead(timestep) OVER w IS NOT NULL AS follows FROM changed
              WINDOW w AS (PARTITION BY user_id, root_post_id ORDER BY timestep)) {LABELS}""",
    **STEPS,
    changed="""SELECT * EXCLUDE (state, before) FROM (
        SELECT *, lag(state) OVER (PARTITION BY user_id, root_post_id ORDER BY timestep) AS before FROM (
          SELECT *, [adopted_intra, adopted_inter, observable_intra, observable_inter, already_adopted::BIGINT] AS state FROM per_step))
      WHERE before IS NULL OR before <> state""",
)
def _(t: Logs):
    return _states(t).withColumn("boundary", F.round("boundary", 6))


@query("threshold_decisions", f"SELECT timestep, {JUDGED} FROM per_step JOIN decisions USING (user_id, timestep) {LABELS}", **STEPS)
def _(t: Logs):
    return threshold.evaluations_at(_states(t), t.refreshes).withColumn("boundary", F.round("boundary", 6))


@query(
    "shadow_summary",
    """SELECT timestep, total::BIGINT AS evaluations, potential_adoptions, blocked, (total - met)::BIGINT AS below_threshold,
         (total - own)::BIGINT AS open_evaluations, open_blocked, (total - own - open_met)::BIGINT AS open_below_threshold
       FROM (SELECT d.timestep, count(*) * (SELECT count(*) FROM (SELECT root_post_id FROM adopted_at GROUP BY 1 HAVING min(step) < d.timestep)) AS total,
           (coalesce(sum(f.potential), 0))::BIGINT AS potential_adoptions, (coalesce(sum(f.blocked), 0))::BIGINT AS blocked, coalesce(sum(f.met), 0) AS met,
           (coalesce(sum(f.open_blocked), 0))::BIGINT AS open_blocked, coalesce(sum(f.open_met), 0) AS open_met, coalesce(sum(own.n), 0) AS own
         FROM decisions d SEMI JOIN users USING (user_id)
         LEFT JOIN flags f ON f.user_id = d.user_id AND f.timestep = d.timestep
         LEFT JOIN (SELECT a.user_id, s.t, count(*) AS n FROM adopted_at a JOIN steps s ON a.step < s.t GROUP BY 1, 2) own
           ON own.user_id = d.user_id AND own.t = d.timestep GROUP BY d.timestep)""",
    **STEPS,
    flags="""SELECT user_id, timestep, count(*) FILTER (observable_signal > bound AND NOT already_adopted) AS potential,
        count(*) FILTER (native_signal > bound AND NOT observable_signal > bound) AS blocked, count(*) FILTER (observable_signal > bound) AS met,
        count(*) FILTER (native_signal > bound AND NOT observable_signal > bound AND NOT already_adopted) AS open_blocked,
        count(*) FILTER (observable_signal > bound AND NOT already_adopted) AS open_met FROM per_step GROUP BY 1, 2""",
)
def _(t: Logs):
    return threshold.shadow_summary(_states(t), t.adoptions, t.users, t.refreshes)


# adopters logged in the first half of the steps; the rounds predict the others
EARLY = 15
SEEDS = f"""SELECT DISTINCT r.root_post_id, r.user_id, u.community FROM roots r JOIN post p ON r.post_id = p.post_id
    JOIN users u ON r.user_id = u.user_id WHERE p.created_at < {EARLY}"""


def _seeds(t: Logs):
    return threshold.initial_adopters(t.roots, t.post, t.users, EARLY)


@query("initial_adopters", "SELECT root_post_id, community, user_id FROM seeds", seeds=SEEDS)
def _(t: Logs):
    return _seeds(t)


# every round hands on all adopters so far, as long as it finds new ones; the last round has them all
ROUNDS = {
    "seeds": SEEDS,
    "labelled": STEPS["labelled"],
    "degrees": STEPS["degrees"],
    "cascade": f"""SELECT user_id, root_post_id, 0 AS round, 0 AS step FROM seeds
      UNION ALL (
        WITH fresh AS (
          SELECT c.user_id, a.root_post_id, max(a.step) + 1 AS step FROM labelled c JOIN cascade a ON c.neighbor_id = a.user_id
          JOIN degrees g ON g.user_id = c.user_id
          WHERE NOT EXISTS (SELECT 1 FROM cascade b WHERE b.user_id = c.user_id AND b.root_post_id = a.root_post_id)
          GROUP BY c.user_id, a.root_post_id HAVING (count(*) FILTER (same)) * 1.0::DOUBLE
            + (count(*) FILTER (NOT same)) * 0.5::DOUBLE > {THETA}::DOUBLE * any_value(g.degree))
        SELECT user_id, root_post_id, round, step + 1 FROM cascade WHERE EXISTS (SELECT 1 FROM fresh)
        UNION ALL SELECT user_id, root_post_id, step, step FROM fresh)""",
    "rounds": "SELECT user_id, root_post_id, round FROM cascade WHERE step = (SELECT max(step) FROM cascade)",
}


def _rounds(t: Logs):
    """The predicted cascades, stored once like the logs they start from; four reports read them."""

    def predict():
        return threshold.threshold_rounds(t.follow, t.users, _seeds(t), threshold=THETA, weight_intra=1.0, weight_inter=0.5)

    return t.derived("rounds", predict)


@query(
    "threshold_rounds",
    "SELECT user_id, root_post_id, round::INTEGER AS round FROM rounds",
    **ROUNDS,
)
def _(t: Logs):
    return _rounds(t)


@query(
    "threshold_round_counts",
    """SELECT root_post_id, round::INTEGER AS round, new_adopters, sum(new_adopters) OVER (PARTITION BY root_post_id
          ORDER BY round)::BIGINT AS total_adopters
        FROM (SELECT root_post_id, round, count(*)::BIGINT AS new_adopters FROM rounds GROUP BY 1, 2)""",
    **ROUNDS,
)
def _(t: Logs):
    return graph.round_counts(_rounds(t))


@query(
    "adoption_summary",
    """SELECT a.root_post_id, count(*)::BIGINT AS final_adopters, round(count(*)::DOUBLE / any_value(n), 6) AS final_fraction,
          (count(*) FILTER (community = root_community))::BIGINT AS intra_adoptions,
          (count(*) FILTER (community <> root_community))::BIGINT AS inter_adoptions,
          round(count(DISTINCT community)::DOUBLE / (SELECT count(DISTINCT community) FROM users), 6) AS coverage,
          count(DISTINCT CASE WHEN round > 0 THEN round END)::BIGINT AS generations
        FROM rounds a JOIN users u ON a.user_id = u.user_id LEFT JOIN (SELECT DISTINCT root_post_id, root_community FROM adopters) l
          ON a.root_post_id = l.root_post_id, cnt GROUP BY 1""",
    **ROUNDS,
)
def _(t: Logs):
    labels = hierarchy.root_adopters(t.roots, t.users).select("root_post_id", "root_community").distinct()
    return (
        graph.adoption_summary(_rounds(t), t.users, labels)
        .withColumn("final_fraction", F.round("final_fraction", 6))
        .withColumn("coverage", F.round("coverage", 6))
    )


@query(
    "adoption_predicted_observed",
    """SELECT root_post_id, count(r)::BIGINT AS predicted, count(o)::BIGINT AS observed, (count(*) FILTER (r IS NOT NULL AND o IS NOT NULL))::BIGINT AS both
        FROM (SELECT coalesce(a.root_post_id, b.root_post_id) AS root_post_id, a.round AS r, b.o
          FROM rounds a FULL JOIN (SELECT DISTINCT root_post_id, user_id, true AS o FROM roots) b
            ON a.root_post_id = b.root_post_id AND a.user_id = b.user_id) WHERE coalesce(r, 1) > 0 GROUP BY 1""",
    **ROUNDS,
)
def _(t: Logs):
    return graph.predicted_against_observed(_rounds(t), t.roots)
