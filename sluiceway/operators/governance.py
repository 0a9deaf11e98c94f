"""Windowed governance state, controller arithmetic and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import exponential_cost, l1_cost, ratio, ratio0, risk_bucket
from ..functions.skew import lookup

# ---- fixed values -------------------------------------------------------
BETWEEN_INTERVALS = "between control intervals"
BUDGET_EXHAUSTED = "budget exhausted"
LATE_STEP = "step arrived after a later one"
RULE_UPDATE = "rule update from diffusion, coverage, reports, and benign loss"
# -------------------------------------------------------------------------


def step_axis(impressions: DataFrame, trace: DataFrame) -> DataFrame:
    """Every (run, step) from step 0 to the last step seen anywhere, gaps included."""
    last = impressions.agg(F.max("timestep").alias("t")).unionByName(trace.agg(F.max("timestep").alias("t"))).agg(F.max("t")).scalar()
    runs = impressions.select("run_id").distinct()
    return runs.select("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("timestep"))


def governance_state(
    impressions: DataFrame, trace: DataFrame, communities: Column, *, window: int, cumulative_cost: DataFrame | None = None,
    budget: float | None = None,
) -> DataFrame:
    """State of every run and step over the trailing ``window`` steps.

    Rows are reduced to one per (run, step) first; windows then run over steps only.
    ``trace`` rows carry the run they belong to. Distinct communities are
    found by repeating each step's few communities in the windows it belongs to.
    """
    risky = F.col("shown") & (F.col("risk_score") > 0)
    per = impressions.groupBy("run_id", "timestep").agg(
        F.count_if("shown").alias("shown"),
        F.count_if(risky).alias("risky_shown"),
        F.count_if(F.col("shown") & (F.col("user_community") != F.col("author_community"))).alias("cross_shown"),
        F.count_if(F.col("risk_score") == 0).alias("benign"),
        F.count_if((F.col("risk_score") == 0) & ~F.col("shown")).alias("benign_hidden"),
    )
    acts = trace.groupBy("run_id", "timestep").agg(
        F.count(F.lit(1)).alias("traces"),
        F.count_if(F.col("action").isin("repost", "quote_post")).alias("reposts"),
        F.count_if(F.col("action") == "report_post").alias("reports"),
    )
    axis = step_axis(impressions, trace)
    rows = axis.join(per, ["run_id", "timestep"], "left").join(acts, ["run_id", "timestep"], "left")
    back = W.partitionBy("run_id").orderBy("timestep").rangeBetween(-(window - 1), 0)
    names = ("shown", "risky_shown", "cross_shown", "benign", "benign_hidden", "traces", "reposts", "reports")
    rows = rows.select(
        "run_id", "timestep", *[F.coalesce(F.sum(n).over(back), F.lit(0)).alias(n) for n in names]
    )
    covered = (
        impressions.where(risky)
        .select("run_id", "timestep", "user_community")
        .distinct()
        .select("run_id", "user_community", F.explode(F.sequence(F.col("timestep"), F.col("timestep") + window - 1)).alias("timestep"))
        .distinct()
        .groupBy("run_id", "timestep")
        .agg(F.count(F.lit(1)).alias("covered"))
    )
    rows = rows.join(covered, ["run_id", "timestep"], "left")
    out = rows.select(
        "run_id",
        "timestep",
        ratio0("risky_shown", "shown").alias("risk_adoption_rate"),
        F.col("reposts").alias("recent_reposts"),
        F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.greatest(F.lit(1), communities)).alias("community_coverage_ratio"),
        ratio0("cross_shown", "shown").alias("cross_community_exposure_ratio"),
        ratio0("reports", "traces").alias("report_rate"),
        ratio0("benign_hidden", "benign").alias("benign_exposure_loss"),
    )
    if cumulative_cost is not None:
        out = out.join(cumulative_cost.select("run_id", "timestep", "cumulative_cost"), ["run_id", "timestep"], "left")
        out = out.withColumn("remaining_budget", F.greatest(F.lit(0.0), F.lit(budget) - F.col("cumulative_cost")))
    return out


def control_recommendation(
    state: DataFrame,
    *,
    interval: int,
    step: float,
    risk_target: float,
    cross_target: float,
    report_target: float,
    loss_limit: float,
    budget: float,
) -> DataFrame:
    """Next omegas, cost and reason for every state row.

    Expects the governance state plus omega_intra, omega_inter, cumulative_cost and
    remaining_budget. Lowering an omega costs, raising it is free.
    """
    one, zero, s = F.lit(1.0), F.lit(0.0), F.lit(min(float(step), 1.0))

    def clip(c: Column) -> Column:
        return F.least(one, F.greatest(zero, c))

    d = state.withColumn("a", clip(F.col("omega_intra"))).withColumn("b", clip(F.col("omega_inter")))
    d = d.withColumn(
        "left", F.least(F.col("remaining_budget"), F.greatest(zero, F.lit(max(float(budget), 0.0)) - F.col("cumulative_cost")))
    )
    pressure = F.greatest(F.col("risk_adoption_rate") - risk_target, F.col("report_rate") - report_target, zero)
    cross = F.greatest(F.col("cross_community_exposure_ratio") - cross_target, zero)
    spread = F.least(one, F.col("recent_reposts") / 10.0)
    relax = F.when(F.col("benign_exposure_loss") > loss_limit, s).otherwise(zero)
    d = d.withColumn("a1", clip(F.col("a") - s * F.least(one, pressure + 0.5 * spread) + relax))
    d = d.withColumn("b1", clip(F.col("b") - s * F.least(one, pressure + cross + 0.5 * F.col("community_coverage_ratio")) + relax))
    d = d.withColumn("cost", (F.col("a") - F.col("a1")) + (F.col("b") - F.col("b1")))
    over = (F.col("cost") > F.col("left")) & (F.col("cost") > 0)
    scale = F.when(over, F.col("left") / F.col("cost"))
    gate, empty = F.col("timestep") % interval != 0, F.col("left") <= 0
    hold = gate | empty

    def moved(old: str, new: str) -> Column:
        scaled = clip(F.col(old) + (F.col(new) - F.col(old)) * scale)
        return F.when(hold, F.col(old)).when(over, scaled).otherwise(F.col(new))

    return d.select(
        *[c for c in state.columns if c not in ("omega_intra", "omega_inter")],
        "omega_intra",
        "omega_inter",
        moved("a", "a1").alias("next_omega_intra"),
        moved("b", "b1").alias("next_omega_inter"),
        F.when(hold, zero).when(over, F.col("left")).otherwise(F.greatest(zero, F.col("cost"))).alias("expected_cost"),
        F.when(gate, BETWEEN_INTERVALS).when(empty, BUDGET_EXHAUSTED).otherwise(RULE_UPDATE).alias("reason"),
    )


def cumulative_cost(omegas: DataFrame, budget: float | None = None) -> DataFrame:
    """Running intervention cost per run over (run_id, timestep, omega_intra, omega_inter).

    Starts at the L1 cost of the first omegas; later steps add their net reduction.
    """
    w = W.partitionBy("run_id").orderBy("timestep")
    level = F.col("omega_intra") + F.col("omega_inter")
    drop = F.lag(level).over(w) - level
    first = l1_cost("omega_intra", "omega_inter")
    out = omegas.withColumn("step_cost", F.when(drop.isNull(), first).otherwise(F.greatest(F.lit(0.0), drop)))
    out = out.withColumn("cumulative_cost", F.sum("step_cost").over(w.rowsBetween(W.unboundedPreceding, 0)))
    if budget is not None:
        out = out.withColumn("over_budget", F.col("cumulative_cost") > F.lit(budget + 1e-12))
    return out


def realized_cost(impressions: DataFrame) -> DataFrame:
    """Sum of 1 - keep over all candidates of a run, and per candidate."""
    out = impressions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum(1.0 - F.col("keep_probability")).alias("realized_cost")
    )
    return out.withColumn("cost_per_candidate", ratio0("realized_cost", "candidates"))


def run_metrics(impressions: DataFrame, communities: Column, keys: list[str] | None = None) -> DataFrame:
    """Exposure metrics per run; high risk means a score above zero."""
    keys = keys or ["run_id"]
    shown, risky, benign = F.col("shown"), F.col("risk_score") > 0, F.col("risk_score") == 0
    same = F.col("user_community") == F.col("author_community")
    out = impressions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(shown).alias("shown"),
        F.count_if(~shown).alias("suppressed"),
        F.count_if(risky).alias("high_risk_candidates"),
        F.count_if(risky & shown).alias("high_risk_exposures"),
        F.count_if(risky & shown & same).alias("intra_high_risk_exposures"),
        F.count_if(risky & shown & ~same).alias("inter_high_risk_exposures"),
        F.count_if(benign).alias("benign_candidates"),
        F.count_if(benign & ~shown).alias("benign_hidden"),
        F.countDistinct(F.when(risky & shown, F.col("user_community"))).alias("covered"),
        F.sum(1.0 - F.col("keep_probability")).alias("realized_cost"),
        F.min("omega_intra").alias("omega_intra"),
        F.min("omega_inter").alias("omega_inter"),
    )
    return out.select(
        *keys, "candidates", "shown", "suppressed", "high_risk_candidates", "high_risk_exposures",
        "intra_high_risk_exposures", "inter_high_risk_exposures", "benign_candidates",
        ratio0("benign_hidden", "benign_candidates").alias("benign_exposure_loss"),
        (F.col("covered") / communities).alias("community_coverage"),
        "realized_cost",
        ratio0("realized_cost", "candidates").alias("realized_cost_per_candidate"),
        l1_cost("omega_intra", "omega_inter").alias("parameter_l1_cost"),
        exponential_cost("omega_intra", "omega_inter").alias("parameter_exponential_cost"),
    )


def propagation_metrics(posts: DataFrame, roots: DataFrame, risk: DataFrame) -> DataFrame:
    """Network-wide reposts, risky reposts and size of the risky cascades."""
    kind = posts.select("post_id", (F.col("original_post_id").isNotNull() & F.col("quote_content").isNull()).alias("is_repost"))
    rows = roots.select("post_id", "root_post_id").join(kind, "post_id")
    rows = lookup(rows, risk.select(F.col("post_id").alias("root_post_id"), "risk_score"), "root_post_id", "left")
    risky = F.coalesce(F.col("risk_score") > 0, F.lit(False))
    return rows.agg(
        F.count_if("is_repost").alias("successful_reposts"),
        F.count_if(F.col("is_repost") & risky).alias("successful_risk_reposts"),
        F.count_if(risky).alias("risk_cascade_size"),
    )


def run_metrics_banded(
    impressions: DataFrame, decisions: DataFrame, posts: DataFrame, roots: DataFrame, risk: DataFrame, users: DataFrame,
    *, high: float = 0.7, low: float = 0.3,
) -> DataFrame:
    """Run metrics with banded risk, action counts, and the author coverage of risky cascades.

    ``decisions``: run_id, action, status, root_risk.
    """
    shown = F.col("shown")
    risky, benign = F.col("risk_score") >= high, F.col("risk_score") <= low
    same = F.col("user_community") == F.col("author_community")
    seen = impressions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(shown).alias("shown"),
        F.count_if(~shown).alias("suppressed"),
        F.count_if(risky & shown).alias("high_risk_exposures"),
        F.count_if(benign & shown).alias("low_risk_exposures"),
        F.count_if(risky & shown & same).alias("intra_high_risk_exposures"),
        F.count_if(risky & shown & ~same).alias("inter_high_risk_exposures"),
        F.count_if(benign).alias("b"),
        F.count_if(benign & ~shown).alias("bh"),
        F.sum(1.0 - F.col("keep_probability")).alias("realized_cost"),
    ).withColumn("benign_exposure_loss", ratio0("bh", "b")).drop("b", "bh")
    r, act = F.col("root_risk"), F.col("action")
    done = decisions.where("status = 'succeeded'").groupBy("run_id").agg(
        *[F.count_if(act == a).alias(f"{a}_count") for a in ("ignore", "report", "repost", "quote")],
        F.count_if((act == "repost") & (F.coalesce(r, F.lit(0.0)) >= high)).alias("high_risk_reposts"),
        F.count_if((act == "report") & (F.coalesce(r, F.lit(0.0)) >= high)).alias("high_risk_reports"),
        F.count_if((act == "report") & (r <= low)).alias("low_risk_reports"),
    )
    risky_roots = risk.where(F.col("risk_score") >= high).select(F.col("post_id").alias("root_post_id"))
    authors = lookup(roots.select("root_post_id", "user_id").join(risky_roots, "root_post_id", "left_semi"), users, "user_id", "left")
    total = users.agg(F.countDistinct("community")).scalar()
    spread = authors.agg(
        F.count(F.lit(1)).alias("risk_cascade_size"), (F.countDistinct("community") / total).alias("risk_author_coverage")
    )
    return (
        seen.join(done, "run_id", "left")
        .withColumn("risk_cascade_size", spread.select("risk_cascade_size").scalar())
        .withColumn("risk_author_coverage", spread.select("risk_author_coverage").scalar())
    )


def exposure_breakdown(impressions: DataFrame) -> DataFrame:
    """Candidates, shown, suppressed and rate: overall, by bucket, relation and timestep."""
    same = F.col("user_community") == F.col("author_community")
    rows = impressions.select(
        risk_bucket("risk_score").alias("bucket"),
        F.when(same, "intra").otherwise("inter").alias("relation"),
        "timestep",
        F.col("shown").cast("bigint").alias("s"),
    )
    b, r, t = F.col("bucket"), F.col("relation"), F.col("timestep")
    sets = rows.groupingSets([[], [b], [r], [t], [b, r]], b, r, t).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("candidates"), F.sum("s").alias("shown")
    )
    # grouping_id bits: bucket 4, relation 2, timestep 1; a set bit means "not grouped by"
    stratum = (
        F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "bucket").when(F.col("g") == 5, "relation")
        .when(F.col("g") == 6, "timestep").otherwise("bucket_relation")
    )
    return sets.select(
        stratum.alias("stratum"), "bucket", "relation", "timestep", "candidates", "shown",
        (F.col("candidates") - F.col("shown")).alias("suppressed"),
        ratio(F.col("candidates") - F.col("shown"), F.col("candidates")).alias("suppression_rate"),
    )


def high_minus_low(breakdown: DataFrame) -> DataFrame:
    b = breakdown.where("stratum = 'bucket'")

    def rate(name: str) -> Column:
        return F.max(F.when(F.col("bucket") == name, F.col("suppression_rate")))

    return b.agg(rate("high").alias("high_rate"), rate("low").alias("low_rate")).withColumn(
        "difference", F.col("high_rate") - F.col("low_rate")
    )


def run_totals(impressions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates and shown per run, with reposts and reports of its users."""
    seen = impressions.groupBy("run_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("shown").alias("shown"))
    acts = decisions.groupBy("run_id").agg(
        F.count_if(F.col("action") == "repost").alias("reposts"), F.count_if(F.col("action") == "report").alias("reports")
    )
    return seen.join(acts, "run_id", "full_outer").select(
        "run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "shown", "reposts", "reports")]
    )


def strategy_tradeoff(runs: DataFrame) -> DataFrame:
    """The (strategy, cost, reposts) series of a cost plot."""
    return runs.groupBy("baseline").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("cost").alias("mean_cost"), F.avg("reposts").alias("mean_reposts")
    )
