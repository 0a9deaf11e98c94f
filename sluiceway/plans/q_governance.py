"""Queries B5, M1-M6, M20-M22, I9: governance state and exposure metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance
from .registry import query
from .views import Logs

WINDOW, BUDGET = 3, 1.2
CONTROLLER = dict(
    interval=2, step=0.2, risk_target=0.25, cross_target=0.3, report_target=0.1, loss_limit=0.1, budget=BUDGET
)


def _communities(t: Logs):
    return t.users.agg(F.countDistinct("community")).scalar()


@query(
    "realized_cost",
    """SELECT run_id, count(*)::BIGINT AS candidates, round(sum(1.0::DOUBLE - keep_probability), 6) AS realized_cost,
         round(avg(1.0::DOUBLE - keep_probability), 6) AS cost_per_candidate FROM impressions GROUP BY 1""",
)
def _(t: Logs):
    out = governance.realized_cost(t.impressions)
    return out.withColumn("realized_cost", F.round("realized_cost", 6)).withColumn("cost_per_candidate", F.round("cost_per_candidate", 6))


# omegas move with the step so that costs and recommendations have something to follow
OMEGAS = """SELECT run_id, timestep, 1.0::DOUBLE - (timestep % 7) * 0.05::DOUBLE AS omega_intra,
    1.0::DOUBLE - (timestep % 5) * 0.1::DOUBLE AS omega_inter FROM (SELECT DISTINCT run_id, timestep FROM impressions)"""
COSTS = """SELECT *, sum(step_cost) OVER (PARTITION BY run_id ORDER BY timestep) AS cumulative_cost FROM (
    SELECT *, CASE WHEN prev IS NULL THEN (1.0::DOUBLE - omega_intra) + (1.0::DOUBLE - omega_inter)
        ELSE greatest(0.0::DOUBLE, prev - (omega_intra + omega_inter)) END AS step_cost
    FROM (SELECT *, lag(omega_intra + omega_inter) OVER (PARTITION BY run_id ORDER BY timestep) AS prev FROM omegas))"""


def omega_columns() -> dict:
    return {
        "omega_intra": F.lit(1.0) - (F.col("timestep") % 7) * 0.05,
        "omega_inter": F.lit(1.0) - (F.col("timestep") % 5) * 0.1,
    }


def _omegas(t: Logs):
    return t.impressions.select("run_id", "timestep").distinct().withColumns(omega_columns())


@query(
    "cumulative_cost",
    f"""SELECT run_id, timestep, round(step_cost, 6) AS step_cost, round(cumulative_cost, 6) AS cumulative_cost,
          cumulative_cost > {BUDGET} + 1e-12 AS over_budget FROM costs""",
    omegas=OMEGAS,
    costs=COSTS,
)
def _(t: Logs):
    return governance.cumulative_cost(_omegas(t), BUDGET).select(
        "run_id", "timestep", F.round("step_cost", 6).alias("step_cost"),
        F.round("cumulative_cost", 6).alias("cumulative_cost"), "over_budget",
    )


STATE = f"""SELECT run_id, t AS timestep,
    coalesce((count(*) FILTER (shown AND risk_score > 0))::DOUBLE / nullif(count(*) FILTER (shown), 0), 0.0) AS risk_adoption_rate,
    (SELECT count(*) FROM trace0 r WHERE r.timestep BETWEEN t - {WINDOW - 1} AND t AND action IN ('repost', 'quote_post')
      AND 'run-' || (r.user_id % 4) = run_id)::BIGINT AS recent_reposts,
    count(DISTINCT CASE WHEN shown AND risk_score > 0 THEN user_community END)::DOUBLE
      / (SELECT count(DISTINCT community) FROM users) AS community_coverage_ratio,
    coalesce((count(*) FILTER (shown AND user_community <> author_community))::DOUBLE / nullif(count(*) FILTER (shown), 0), 0.0)
      AS cross_community_exposure_ratio,
    (SELECT coalesce((count(*) FILTER (action = 'report_post'))::DOUBLE / nullif(count(*), 0), 0.0) FROM trace0 r
      WHERE r.timestep BETWEEN t - {WINDOW - 1} AND t AND 'run-' || (r.user_id % 4) = run_id) AS report_rate,
    coalesce((count(*) FILTER (NOT shown AND risk_score = 0))::DOUBLE / nullif(count(*) FILTER (risk_score = 0), 0), 0.0)
      AS benign_exposure_loss
  FROM (SELECT r.run_id, a.t, i.* EXCLUDE (run_id) FROM (SELECT DISTINCT run_id FROM impressions) r,
    (SELECT unnest(range(0, 1 + (SELECT max(timestep) FROM trace0)))::BIGINT AS t) a
    LEFT JOIN impressions i ON i.run_id = r.run_id AND i.timestep BETWEEN a.t - {WINDOW - 1} AND a.t) GROUP BY run_id, t"""
STATE_COLUMNS = (
    "risk_adoption_rate", "community_coverage_ratio", "cross_community_exposure_ratio", "report_rate", "benign_exposure_loss",
)


def _rounded(df, names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@query(
    "governance_state",
    "SELECT run_id, timestep, recent_reposts, " + ", ".join(f"round({c}, 6) AS {c}" for c in STATE_COLUMNS) + " FROM state",
    state=STATE,
)
def _(t: Logs):
    return _rounded(governance.governance_state(t.impressions, t.run_trace, _communities(t), window=WINDOW), STATE_COLUMNS)


@query(
    "control_recommendation",
    f"""SELECT run_id, timestep, omega_intra, omega_inter, round(CASE WHEN hold THEN a WHEN over THEN
            least(1, greatest(0, a + (a1 - a) * (remaining / cost))) ELSE a1 END, 6) AS next_omega_intra,
          round(CASE WHEN hold THEN b WHEN over THEN least(1, greatest(0, b + (b1 - b) * (remaining / cost))) ELSE b1 END, 6)
            AS next_omega_inter,
          round(CASE WHEN hold THEN 0.0 WHEN over THEN remaining ELSE greatest(0, cost) END, 6) AS expected_cost,
          CASE WHEN timestep % 2 <> 0 THEN 'between control intervals' WHEN remaining <= 0 THEN 'budget exhausted'
            ELSE 'rule update from diffusion, coverage, reports, and benign loss' END AS reason
        FROM (SELECT *, timestep % 2 <> 0 OR remaining <= 0 AS hold, cost > remaining AND cost > 0 AS over FROM (
          SELECT *, (a - a1) + (b - b1) AS cost FROM (SELECT *, least(1, greatest(0, a - 0.2 * least(1, pressure
              + 0.5 * least(1, recent_reposts / 10.0)) + relax)) AS a1,
            least(1, greatest(0, b - 0.2 * least(1, pressure + cr + 0.5 * community_coverage_ratio) + relax)) AS b1
          FROM (SELECT *, omega_intra AS a, omega_inter AS b, greatest(0.0, {BUDGET} - cumulative_cost) AS remaining,
              greatest(risk_adoption_rate - 0.25, report_rate - 0.1, 0.0) AS pressure,
              greatest(cross_community_exposure_ratio - 0.3, 0.0) AS cr,
              CASE WHEN benign_exposure_loss > 0.1 THEN 0.2 ELSE 0.0 END AS relax
            FROM state JOIN costs USING (run_id, timestep)))))""",
    omegas=OMEGAS,
    costs=COSTS,
    state=STATE,
)
def _(t: Logs):
    costs = governance.cumulative_cost(_omegas(t))
    state = governance.governance_state(
        t.impressions, t.run_trace, _communities(t), window=WINDOW, cumulative_cost=costs, budget=BUDGET
    ).join(costs.select("run_id", "timestep", "omega_intra", "omega_inter"), ["run_id", "timestep"])
    out = governance.control_recommendation(state, **CONTROLLER)
    return out.select(
        "run_id", "timestep", "omega_intra", "omega_inter", F.round("next_omega_intra", 6).alias("next_omega_intra"),
        F.round("next_omega_inter", 6).alias("next_omega_inter"), F.round("expected_cost", 6).alias("expected_cost"), "reason",
    )


@query(
    "run_metrics",
    """SELECT run_id, count(*)::BIGINT AS candidates, (count(*) FILTER (shown))::BIGINT AS shown,
         (count(*) FILTER (NOT shown))::BIGINT AS suppressed, (count(*) FILTER (risk_score > 0))::BIGINT AS high_risk_candidates,
         (count(*) FILTER (risk_score > 0 AND shown))::BIGINT AS high_risk_exposures,
         (count(*) FILTER (risk_score > 0 AND shown AND user_community = author_community))::BIGINT AS intra_high_risk_exposures,
         (count(*) FILTER (risk_score > 0 AND shown AND user_community <> author_community))::BIGINT AS inter_high_risk_exposures,
         (count(*) FILTER (risk_score = 0))::BIGINT AS benign_candidates,
         round(coalesce((count(*) FILTER (risk_score = 0 AND NOT shown))::DOUBLE / nullif(count(*) FILTER (risk_score = 0), 0), 0), 6)
           AS benign_exposure_loss,
         round(count(DISTINCT CASE WHEN risk_score > 0 AND shown THEN user_community END)::DOUBLE
           / (SELECT count(DISTINCT community) FROM users), 6) AS community_coverage,
         round(sum(1.0::DOUBLE - keep_probability), 6) AS realized_cost,
         round(avg(1.0::DOUBLE - keep_probability), 6) AS realized_cost_per_candidate,
         round((1 - min(omega_intra)) + (1 - min(omega_inter)), 6) AS parameter_l1_cost,
         round((exp(-(min(omega_intra) + min(omega_inter))) - exp(-2.0)) / (1 - exp(-2.0)), 6) AS parameter_exponential_cost
       FROM impressions GROUP BY run_id""",
)
def _(t: Logs):
    names = ("benign_exposure_loss", "community_coverage", "realized_cost", "realized_cost_per_candidate",
             "parameter_l1_cost", "parameter_exponential_cost")
    return _rounded(governance.run_metrics(t.impressions, _communities(t)), names)


@query(
    "propagation_metrics",
    """SELECT (count(*) FILTER (rp))::BIGINT AS successful_reposts, (count(*) FILTER (rp AND k.risk_score > 0))::BIGINT
         AS successful_risk_reposts, (count(*) FILTER (k.risk_score > 0))::BIGINT AS risk_cascade_size
       FROM (SELECT r.root_post_id, p.original_post_id IS NOT NULL AND p.quote_content IS NULL AS rp
         FROM roots r JOIN post p ON r.post_id = p.post_id) x LEFT JOIN post_risk k ON x.root_post_id = k.post_id""",
)
def _(t: Logs):
    return governance.propagation_metrics(t.post, t.roots, t.post_risk)


@query(
    "run_metrics_banded",
    """SELECT s.*, d.* EXCLUDE (run_id), (SELECT count(*) FROM roots r JOIN post_risk k ON r.root_post_id = k.post_id
           WHERE k.risk_score >= 0.7)::BIGINT AS risk_cascade_size,
         round((SELECT count(DISTINCT u.community) FROM roots r JOIN post_risk k ON r.root_post_id = k.post_id
           JOIN users u ON r.user_id = u.user_id WHERE k.risk_score >= 0.7)::DOUBLE
           / (SELECT count(DISTINCT community) FROM users), 6) AS risk_author_coverage
       FROM (SELECT run_id, count(*)::BIGINT AS candidates, (count(*) FILTER (shown))::BIGINT AS shown,
           (count(*) FILTER (NOT shown))::BIGINT AS suppressed,
           (count(*) FILTER (risk_score >= 0.7 AND shown))::BIGINT AS high_risk_exposures,
           (count(*) FILTER (risk_score <= 0.3 AND shown))::BIGINT AS low_risk_exposures,
           (count(*) FILTER (risk_score >= 0.7 AND shown AND user_community = author_community))::BIGINT AS intra_high_risk_exposures,
           (count(*) FILTER (risk_score >= 0.7 AND shown AND user_community <> author_community))::BIGINT AS inter_high_risk_exposures,
           round(sum(1.0::DOUBLE - keep_probability), 6) AS realized_cost,
           round((count(*) FILTER (risk_score <= 0.3 AND NOT shown))::DOUBLE / (count(*) FILTER (risk_score <= 0.3)), 6)
             AS benign_exposure_loss
         FROM impressions GROUP BY 1) s
       JOIN (SELECT run_id, (count(*) FILTER (action = 'ignore'))::BIGINT AS ignore_count,
           (count(*) FILTER (action = 'report'))::BIGINT AS report_count, (count(*) FILTER (action = 'repost'))::BIGINT AS repost_count,
           (count(*) FILTER (action = 'quote'))::BIGINT AS quote_count,
           (count(*) FILTER (action = 'repost' AND risk >= 0.7))::BIGINT AS high_risk_reposts,
           (count(*) FILTER (action = 'report' AND risk >= 0.7))::BIGINT AS high_risk_reports,
           (count(*) FILTER (action = 'report' AND risk <= 0.3))::BIGINT AS low_risk_reports
         FROM (SELECT n.*, k.risk_score AS risk FROM snapshots n LEFT JOIN roots r ON n.target_post_id = r.post_id
           LEFT JOIN post_risk k ON r.root_post_id = k.post_id) WHERE status = 'succeeded' GROUP BY 1) d ON s.run_id = d.run_id""",
)
def _(t: Logs):
    roots = t.roots.select(F.col("post_id").alias("target_post_id"), "root_post_id")
    risk = t.post_risk.select(F.col("post_id").alias("root_post_id"), F.col("risk_score").alias("root_risk"))
    decisions = (
        t.snapshots.select("run_id", "action", "status", "target_post_id")
        .join(roots, "target_post_id", "left").join(risk, "root_post_id", "left")
    )
    out = governance.run_metrics_banded(t.impressions, decisions, t.post, t.roots, t.post_risk, t.users)
    return _rounded(out, ("realized_cost", "benign_exposure_loss", "risk_author_coverage"))


BREAKDOWN = """SELECT CASE g WHEN 7 THEN 'overall' WHEN 3 THEN 'bucket' WHEN 5 THEN 'relation' WHEN 6 THEN 'timestep'
      ELSE 'bucket_relation' END AS stratum, bucket, relation, timestep, candidates, shown, candidates - shown AS suppressed,
    (candidates - shown)::DOUBLE / candidates AS suppression_rate
  FROM (SELECT grouping(bucket, relation, timestep) AS g, bucket, relation, timestep, count(*)::BIGINT AS candidates,
      (count(*) FILTER (shown))::BIGINT AS shown
    FROM (SELECT CASE WHEN risk_score = 0 THEN 'low' WHEN risk_score = 1 THEN 'high' ELSE 'intermediate' END AS bucket,
        CASE WHEN user_community = author_community THEN 'intra' ELSE 'inter' END AS relation, timestep, shown FROM impressions)
    GROUP BY GROUPING SETS ((), (bucket), (relation), (timestep), (bucket, relation)))"""


@query(
    "exposure_breakdown",
    """SELECT stratum, bucket, relation, timestep, candidates, shown, suppressed, round(suppression_rate, 6) AS suppression_rate
       FROM breakdown""",
    breakdown=BREAKDOWN,
)
def _(t: Logs):
    return _rounded(governance.exposure_breakdown(t.impressions), ("suppression_rate",))


@query(
    "suppression_gap",
    """SELECT round(h, 6) AS high_rate, round(l, 6) AS low_rate, round(h - l, 6) AS difference FROM (
       SELECT max(suppression_rate) FILTER (bucket = 'high') AS h, max(suppression_rate) FILTER (bucket = 'low') AS l
       FROM breakdown WHERE stratum = 'bucket')""",
    breakdown=BREAKDOWN,
)
def _(t: Logs):
    gap = governance.high_minus_low(governance.exposure_breakdown(t.impressions))
    return _rounded(gap, ("high_rate", "low_rate", "difference"))


@query(
    "smoke_summary",
    """SELECT s.run_id, s.candidates, s.shown, d.reposts, d.reports FROM
       (SELECT run_id, count(*)::BIGINT AS candidates, (count(*) FILTER (shown))::BIGINT AS shown FROM impressions GROUP BY 1) s
       JOIN (SELECT run_id, (count(*) FILTER (action = 'repost'))::BIGINT AS reposts,
         (count(*) FILTER (action = 'report'))::BIGINT AS reports FROM snapshots GROUP BY 1) d ON s.run_id = d.run_id""",
)
def _(t: Logs):
    return governance.run_totals(t.impressions, t.snapshots)


@query(
    "strategy_tradeoff",
    """SELECT baseline, count(*)::BIGINT AS runs, round(avg(cost), 6) AS mean_cost, round(avg(reposts), 6) AS mean_reposts
       FROM runs GROUP BY 1""",
)
def _(t: Logs):
    return _rounded(governance.strategy_tradeoff(t.runs), ("mean_cost", "mean_reposts"))
