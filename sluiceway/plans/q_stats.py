"""Queries B4, B10, S1-S15: allocation, calibration and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import stats
from .registry import query
from .views import GRID, Logs

BUDGET, TOLERANCE, GAP, R, SEED = 0.8, 0.05, 0.3, 60, 11
ALL_GRID = [*GRID, (0.2, 1.0), (0.0, 0.0), (0.5, 0.75), (0.9, 0.9)]
ALL_SQL = "(VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in dict.fromkeys(ALL_GRID)) + ") g(a, b)"
METRICS = ("exposures", "reposts", "coverage", "benign_loss", "cost")

MUS = """SELECT condition, baseline, least(1.0, round(avg(measured_mu) * (baseline + 1) / 2.25, 1))::DOUBLE AS mu FROM runs GROUP BY 1, 2"""
DIRECTION = f"CASE WHEN mu < 0.5 - {TOLERANCE} THEN 'intra' WHEN mu > 0.5 + {TOLERANCE} THEN 'inter' ELSE 'balanced' END"


def _mus(t: Logs):
    mu = F.least(F.lit(1.0), F.round(F.avg("measured_mu") * (F.col("baseline") + 1) / 2.25, 1))
    return t.runs.groupBy("condition", "baseline").agg(mu.alias("mu"))


def _r(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@query(
    "control_costs",
    """SELECT a AS omega_intra, b AS omega_inter, round((1 - a) + (1 - b), 6) AS l1_cost,
         round((exp(-(a + b)) - exp(-2.0)) / (1 - exp(-2.0)), 6) AS exponential_cost
       FROM (SELECT DISTINCT least(1.0, round(l_discount * 10, 3))::DOUBLE AS a, least(1.0, round(l_tax * 10, 3))::DOUBLE AS b FROM lineitem)""",
)
def _(t: Logs):
    pairs = t.table("lineitem").select(
        F.least(F.lit(1.0), F.round(F.col("l_discount") * 10, 3)).alias("omega_intra"),
        F.least(F.lit(1.0), F.round(F.col("l_tax") * 10, 3)).alias("omega_inter"),
    ).distinct()
    return pairs.select(
        "*", F.round(sc.l1_cost("omega_intra", "omega_inter"), 6).alias("l1_cost"),
        F.round(sc.exponential_cost("omega_intra", "omega_inter"), 6).alias("exponential_cost"),
    )


BANDS = {
    "strong": dict(max_exclusive=0.3),
    "moderate": dict(min_inclusive=0.3, max_inclusive=0.6),
    "weak": dict(min_exclusive=0.6, max_inclusive=1.0),
    "any": dict(),
}


@query(
    "condition_band",
    """SELECT condition, baseline, mu, band FROM mus JOIN (VALUES ('strong', NULL, NULL, NULL, 0.3), ('moderate', 0.3, NULL, 0.6, NULL),
         ('weak', NULL, 0.6, 1.0, NULL), ('any', NULL, NULL, NULL, NULL)) v(band, ai, ae, bi, be)
       ON (ai IS NULL OR mu >= ai) AND (ae IS NULL OR mu > ae) AND (bi IS NULL OR mu <= bi) AND (be IS NULL OR mu < be)""",
    mus=MUS,
)
def _(t: Logs):
    return stats.classify_bands(_mus(t), "mu", BANDS)


@query(
    "allocate_grid",
    f"""SELECT condition, baseline, mu, direction, a AS omega_intra, b AS omega_inter, round(l1, 6) AS l1_cost,
          round((exp(-(a + b)) - exp(-2.0)) / (1 - exp(-2.0)), 6) AS exponential_cost, consistent,
          row_number() OVER (PARTITION BY condition, baseline ORDER BY NOT consistent, round(l1, 9) DESC, a, b)::INTEGER AS rank,
          CASE mu WHEN 0.2 THEN 0.0 WHEN 0.4 THEN 0.23 WHEN 0.6 THEN 0.38 WHEN 0.8 THEN 0.78 END::DOUBLE AS reference_intra,
          CASE mu WHEN 0.2 THEN 0.85 WHEN 0.4 THEN 0.34 WHEN 0.6 THEN 0.21 WHEN 0.8 THEN 0.1 END::DOUBLE AS reference_inter
        FROM (SELECT *, (1 - a) + (1 - b) AS l1, (direction = 'intra' AND a <= b) OR (direction = 'inter' AND b <= a) OR direction = 'balanced' AS consistent
          FROM (SELECT *, {DIRECTION} AS direction FROM mus), {ALL_SQL}) WHERE l1 <= {BUDGET} + 1e-12""",
    mus=MUS,
)
def _(t: Logs):
    return _r(stats.allocate_grid(_mus(t), ALL_GRID, BUDGET, TOLERANCE), "l1_cost", "exponential_cost")


@query(
    "allocate_strict",
    f"""SELECT condition, baseline, mu, direction, a AS omega_intra, b AS omega_inter FROM (SELECT *, {DIRECTION} AS direction FROM mus), {ALL_SQL}
        WHERE (1 - a) + (1 - b) <= {BUDGET} + 1e-12 AND CASE direction WHEN 'intra' THEN b - a >= {GAP} - 1e-12
          WHEN 'inter' THEN a - b >= {GAP} - 1e-12 ELSE abs(a - b) <= 1e-12 END""",
    mus=MUS,
)
def _(t: Logs):
    return stats.allocate_strict(_mus(t), ALL_GRID, BUDGET, TOLERANCE, GAP)


# eligible pairs per condition: those consistent with the direction of its mean mu
ELIGIBLE = f"""SELECT condition, a AS omega_intra, b AS omega_inter FROM (SELECT *, {DIRECTION} AS direction FROM (
      SELECT condition, avg(measured_mu) AS mu FROM grid_runs GROUP BY 1)), (VALUES (0.2::DOUBLE, 1.0::DOUBLE), (0.4, 0.8), (0.6, 0.6), (0.8, 0.4), (1.0, 0.2)) g(a, b)
    WHERE (direction = 'intra' AND a <= b) OR (direction = 'inter' AND b <= a) OR direction = 'balanced'"""


def _eligible(t: Logs):
    mus = t.grid_runs.groupBy("condition").agg(F.avg("measured_mu").alias("mu"))
    return stats.allocate_grid(mus, GRID, BUDGET, TOLERANCE).where("consistent")


def _means(group: str, source: str = "grid_runs") -> str:
    cols = ", ".join(f"round(avg({m}), 9) AS {m}" for m in (*METRICS, "cascade_size"))
    return f"SELECT {group}, omega_intra, omega_inter, count(*) AS observations, {cols} FROM {source} GROUP BY ALL"


def _selected(order) -> str:
    return f"""SELECT m.* FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY {', '.join(order)}, omega_intra, omega_inter) AS r
        FROM means SEMI JOIN eligible USING (condition, omega_intra, omega_inter)) m WHERE r = 1"""


@query(
    "select_calibrated",
    f"""SELECT condition, 0::BIGINT AS missing, omega_intra, omega_inter, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)},
          observations::BIGINT AS observations FROM picked""",
    eligible=ELIGIBLE, means=_means("condition"), picked=_selected(stats.CALIBRATION_ORDER),
)
def _(t: Logs):
    return _r(stats.select_pair(t.grid_runs, _eligible(t)), *METRICS)


@query(
    "select_threshold",
    """SELECT condition, 0::BIGINT AS missing, omega_intra, omega_inter, round(coverage, 6) AS coverage, round(cascade_size, 6) AS cascade_size,
         round(reposts, 6) AS reposts, round(cost, 6) AS cost, observations::BIGINT AS observations FROM picked""",
    eligible=ELIGIBLE, means=_means("condition"), picked=_selected(stats.THRESHOLD_ORDER),
)
def _(t: Logs):
    return _r(stats.select_pair(t.grid_runs, _eligible(t), stats.THRESHOLD_ORDER), *stats.THRESHOLD_ORDER)


@query(
    "cost_match",
    """SELECT condition, keep, target_cost, mean_cost, round(err, 6) AS relative_error, err <= 0.05 AS within_tolerance FROM (
         SELECT *, row_number() OVER (PARTITION BY condition ORDER BY err, -keep) AS r FROM (
           SELECT c.*, t.target_cost, abs(mean_cost - target_cost) / target_cost AS err FROM (
             SELECT condition, round(0.2 + pair * 0.2, 1)::DOUBLE AS keep, round(avg(cost), 6) AS mean_cost FROM grid_runs GROUP BY 1, 2) c
           JOIN (SELECT condition, round(avg(cost), 6) AS target_cost FROM runs WHERE baseline = 0 GROUP BY 1) t ON c.condition = t.condition))
       WHERE r = 1""",
)
def _(t: Logs):
    targets = t.runs.where("baseline = 0").groupBy("condition").agg(F.round(F.avg("cost"), 6).alias("target_cost"))
    keep = F.round(F.lit(0.2) + F.col("pair") * 0.2, 1).alias("keep")
    candidates = t.grid_runs.groupBy("condition", keep).agg(F.round(F.avg("cost"), 6).alias("mean_cost"))
    return _r(stats.cost_match(targets, candidates, 0.05), "relative_error")


@query(
    "leave_one_out",
    f"""SELECT condition, omega_intra, omega_inter, count(*)::BIGINT AS wins FROM (
          SELECT *, row_number() OVER (PARTITION BY condition, omitted ORDER BY {', '.join(METRICS)}, omega_intra, omega_inter) AS r
          FROM means SEMI JOIN eligible USING (condition, omega_intra, omega_inter)) WHERE r = 1 GROUP BY 1, 2, 3""",
    eligible=ELIGIBLE,
    left_out="SELECT o.seed AS omitted, g.* FROM (SELECT DISTINCT condition, seed FROM grid_runs) o JOIN grid_runs g ON o.condition = g.condition AND o.seed <> g.seed",
    means=_means("condition, omitted", "left_out"),
)
def _(t: Logs):
    return stats.leave_one_out(t.grid_runs, _eligible(t))


BOOT = dict(
    eligible=ELIGIBLE,
    member="SELECT condition, seed, row_number() OVER (PARTITION BY condition ORDER BY seed) AS idx, count(*) OVER (PARTITION BY condition) AS n FROM (SELECT DISTINCT condition, seed FROM grid_runs)",
    drawn=f"""SELECT condition, resample, idx, count(*) AS w FROM (SELECT condition, resample,
          floor((('0x' || substr(md5('{SEED}|' || condition || '|' || resample || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * n)::BIGINT + 1 AS idx
        FROM (SELECT DISTINCT condition, n FROM member), range({R}) a(resample), (SELECT unnest(range(1, 1 + max(n))) AS i FROM member) b WHERE i <= n) GROUP BY ALL""",
    means="SELECT condition, resample, omega_intra, omega_inter, "
    + ", ".join(f"round(sum({m} * w) / sum(w), 9) AS {m}" for m in METRICS)
    + " FROM drawn JOIN member USING (condition, idx) JOIN grid_runs USING (condition, seed) SEMI JOIN eligible USING (condition, omega_intra, omega_inter) GROUP BY ALL",
    chosen=f"""SELECT condition, omega_intra, omega_inter, count(*)::DOUBLE / {R} AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY condition, resample
        ORDER BY {', '.join(METRICS)}, omega_intra, omega_inter) AS r FROM means) WHERE r = 1 GROUP BY ALL""",
)


@query("bootstrap_selection", "SELECT condition, omega_intra, omega_inter, round(frequency, 6) AS frequency FROM chosen", **BOOT)
def _(t: Logs):
    return _r(stats.bootstrap_selection(t.grid_runs, _eligible(t), resamples=R, seed=SEED), "frequency")


@query(
    "selection_stability",
    """SELECT p.condition, p.omega_intra, p.omega_inter, p.direction, round(coalesce(c.frequency, 0), 6) AS pair_frequency,
         round(coalesce(d.f, 0), 6) AS direction_frequency, coalesce(c.frequency, 0) >= 0.8 - 1e-12 AS pair_stable, coalesce(d.f, 0) >= 0.8 - 1e-12 AS direction_stable
       FROM (SELECT *, CASE WHEN omega_intra < omega_inter THEN 'intra' WHEN omega_inter < omega_intra THEN 'inter' ELSE 'balanced' END AS direction FROM picked) p
       LEFT JOIN chosen c USING (condition, omega_intra, omega_inter)
       LEFT JOIN (SELECT condition, CASE WHEN omega_intra < omega_inter THEN 'intra' WHEN omega_inter < omega_intra THEN 'inter' ELSE 'balanced' END AS direction,
         sum(frequency) AS f FROM chosen GROUP BY 1, 2) d ON d.condition = p.condition AND d.direction = p.direction""",
    **BOOT, plain=_means("condition"), picked=_selected(METRICS).replace("FROM means", "FROM plain"),
)
def _(t: Logs):
    eligible = _eligible(t)
    freq = stats.bootstrap_selection(t.grid_runs, eligible, resamples=R, seed=SEED)
    out = stats.selection_stability(freq, stats.select_pair(t.grid_runs, eligible), pair_threshold=0.8, direction_threshold=0.8)
    return _r(out, "pair_frequency", "direction_frequency")


def _ci_views(long_sql: str, keys: str, pipe: str) -> dict[str, str]:
    return dict(
        long=long_sql,
        member=f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seed) AS idx, count(*) OVER (PARTITION BY {keys}) AS n FROM long",
        resampled=f"""SELECT {keys}, resample, i, floor((('0x' || substr(md5('{SEED}|' || {pipe} || '|' || resample || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * n)::BIGINT + 1 AS idx
            FROM (SELECT DISTINCT {keys}, n FROM member), range({R}) a(resample), (SELECT unnest(range(1, 1 + max(n))) AS i FROM member) b WHERE i <= n""",
        resample_means=f"SELECT {keys}, resample, avg(value) AS m FROM resampled JOIN member USING ({keys}, idx) GROUP BY ALL",
        described=f"""SELECT * FROM (SELECT {keys}, count(*)::BIGINT AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sample_std FROM long GROUP BY ALL)
            JOIN (SELECT {keys}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM resample_means GROUP BY ALL) USING ({keys})""",
    )


CI_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "sample_std", "ci_low", "ci_high"))
LONG = " UNION ALL ".join(f"SELECT condition, baseline, seed, '{m}' AS metric, {m} AS value FROM runs" for m in METRICS)


@query(
    "bootstrap_ci",
    f"SELECT condition, baseline, metric, n, {CI_COLUMNS} FROM described",
    **_ci_views(LONG, "condition, baseline, metric", "condition || '|' || baseline || '|' || metric"),
)
def _(t: Logs):
    keys = ["condition", "baseline", "metric"]
    long = stats.unpivot(t.runs, ["condition", "baseline", "seed"], list(METRICS))
    return _r(stats.bootstrap_ci(long, keys, resamples=R, seed=SEED), "mean", "sample_std", "ci_low", "ci_high")


# baseline 4 against every other one; some cells are left out and some doubled to test the checks
PAIRED = """SELECT t.condition, t.metric, t.comparator, t.seed, a AS treatment, b AS comparator_value, CASE WHEN issue IS NULL THEN a - b END AS difference, issue
  FROM (SELECT coalesce(x.condition, y.condition) AS condition, coalesce(x.metric, y.metric) AS metric, coalesce(x.comparator, y.comparator) AS comparator,
      coalesce(x.seed, y.seed) AS seed, x.v AS a, y.v AS b, CASE WHEN x.n > 1 OR y.n > 1 THEN 'duplicate seed' WHEN x.n IS NULL OR y.n IS NULL THEN 'seed sets do not match' END AS issue
    FROM (SELECT condition, metric, c AS comparator, seed, count(*) AS n, min(value) AS v FROM long, range(4) r(c) WHERE baseline = 4 GROUP BY ALL) x
    FULL JOIN (SELECT condition, metric, baseline AS comparator, seed, count(*) AS n, min(value) AS v FROM long WHERE baseline <> 4 {extra} GROUP BY ALL) y
      ON x.condition = y.condition AND x.metric = y.metric AND x.comparator = y.comparator AND x.seed = y.seed) t"""


def _sides(t: Logs):
    long = stats.unpivot(t.runs, ["condition", "baseline", "seed"], list(METRICS))
    treatment = long.where("baseline = 4").select("condition", "metric", F.explode(F.array(*[F.lit(c).cast("bigint") for c in range(4)])).alias("comparator"), "seed", "value")
    return treatment, long.where("baseline != 4").withColumnRenamed("baseline", "comparator")


@query(
    "paired_difference",
    "SELECT condition, metric, comparator, seed, round(treatment, 6) AS treatment, round(comparator_value, 6) AS comparator_value, round(difference, 6) AS difference, issue FROM paired",
    long=LONG,
    paired=PAIRED.format(extra="AND NOT (baseline = 1 AND seed = 3)"),
)
def _(t: Logs):
    treatment, other = _sides(t)
    other = other.where("not (comparator = 1 and seed = 3)").withColumn("which", F.col("comparator")).drop("comparator")
    out = stats.paired_difference(treatment.withColumnRenamed("comparator", "which"), other, ["condition", "metric", "which"])
    out = out.withColumnRenamed("comparator", "comparator_value").withColumnRenamed("which", "comparator")
    return _r(out, "treatment", "comparator_value", "difference")


@query(
    "paired_interpretation",
    f"""SELECT condition, metric, comparator, n, {CI_COLUMNS}, CASE WHEN ci_high < 0 THEN 'stable_decrease' WHEN ci_low > 0 THEN 'stable_increase'
          ELSE 'uncertain_ci_crosses_zero' END AS interpretation FROM described""",
    base=LONG,
    paired=PAIRED.format(extra="").replace("FROM long", "FROM base"),
    **_ci_views("SELECT condition, metric, comparator, seed, difference AS value FROM paired WHERE issue IS NULL", "condition, metric, comparator",
                "condition || '|' || metric || '|' || comparator"),
)
def _(t: Logs):
    treatment, other = _sides(t)
    keys = ["condition", "metric", "which"]
    diff = stats.paired_difference(
        treatment.withColumnRenamed("comparator", "which"), other.withColumnRenamed("comparator", "which"), keys
    ).where("issue is null").select(*keys, "seed", F.col("difference").alias("value"))
    out = stats.interpret(stats.bootstrap_ci(diff, keys, resamples=R, seed=SEED)).withColumnRenamed("which", "comparator")
    return _r(out, "mean", "sample_std", "ci_low", "ci_high")


@query(
    "baseline_aggregate",
    """SELECT condition, baseline, metric, round(avg(value), 6) AS mean, count(*)::BIGINT AS runs,
         array_to_string(list_sort(list_distinct(list(seed))), ',') AS seeds FROM long GROUP BY 1, 2, 3""",
    long=LONG,
)
def _(t: Logs):
    out = stats.baseline_aggregate(t.runs, ["condition", "baseline"], list(METRICS))
    return _r(out.withColumn("seeds", F.array_join(F.transform("seeds", lambda x: x.cast("string")), ",")), "mean")


GAP_METRICS = ("exposures", "reposts", "cascade_size")


@query(
    "runner_up_gap",
    """SELECT x.condition, x.omega_intra AS best_intra, x.omega_inter AS best_inter, y.omega_intra AS second_intra, y.omega_inter AS second_inter,
         round(y.exposures - x.exposures, 6) AS exposures_gap, round(y.reposts - x.reposts, 6) AS reposts_gap, round(y.cascade_size - x.cascade_size, 6) AS cascade_size_gap
       FROM ranked x JOIN ranked y ON x.condition = y.condition AND x.r = 1 AND y.r = 2""",
    eligible=ELIGIBLE, means=_means("condition"),
    ranked="SELECT *, row_number() OVER (PARTITION BY condition ORDER BY exposures, omega_intra, omega_inter) AS r FROM means SEMI JOIN eligible USING (condition, omega_intra, omega_inter)",
)
def _(t: Logs):
    out = stats.runner_up_gap(t.grid_runs, _eligible(t), GAP_METRICS)
    return _r(out, *[f"{m}_gap" for m in GAP_METRICS])


SLICE = """SELECT CASE l_returnflag WHEN 'A' THEN 0.2 WHEN 'N' THEN 0.5 ELSE 0.8 END::DOUBLE AS mu, [0.2, 0.4, 0.6, 0.8, 1.0][l_partkey % 5 + 1]::DOUBLE AS omega_intra,
    [1.0, 0.8, 0.6, 0.4, 0.2][l_partkey % 5 + 1]::DOUBLE AS omega_inter,
    CASE WHEN l_returnflag = 'N' THEN 5.0 + l_tax ELSE (l_discount * (l_partkey % 5 + 1) * 2 + l_tax * (5 - l_partkey % 5)) / 2 END AS outcome FROM lineitem"""


def _slice(t: Logs):
    p = F.col("l_partkey") % 5
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in GRID])
    pair = F.get(pairs, p.cast("int"))
    flag = F.col("l_returnflag")
    outcome = F.when(flag == "N", 5.0 + F.col("l_tax")).otherwise((F.col("l_discount") * (p + 1) * 2 + F.col("l_tax") * (5 - p)) / 2)
    return t.table("lineitem").select(
        F.when(flag == "A", 0.2).when(flag == "N", 0.5).otherwise(0.8).alias("mu"), pair["a"].alias("omega_intra"),
        pair["b"].alias("omega_inter"), outcome.alias("outcome"),
    )


@query(
    "grid_optimum",
    """SELECT mu, b.mu IS NOT NULL AS available, omega_intra, omega_inter, round(mean_outcome, 6) AS mean_outcome, replicates, round(cost, 6) AS cost,
         CASE WHEN m.mu < 0.5 THEN 'intra' ELSE 'inter' END AS expected_direction,
         CASE WHEN omega_intra < omega_inter THEN 'intra' WHEN omega_inter < omega_intra THEN 'inter' WHEN omega_intra = omega_inter THEN 'balanced' END AS observed_direction,
         CASE WHEN omega_intra < omega_inter THEN 'intra' WHEN omega_inter < omega_intra THEN 'inter' WHEN omega_intra = omega_inter THEN 'balanced' END
           = CASE WHEN m.mu < 0.5 THEN 'intra' ELSE 'inter' END AS as_expected
       FROM (SELECT DISTINCT mu FROM slice) m LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mu ORDER BY cost, omega_intra, omega_inter) AS r
         FROM (SELECT mu, omega_intra, omega_inter, round(avg(outcome), 9) AS mean_outcome, count(*)::BIGINT AS replicates,
             round((exp(-(omega_intra + omega_inter)) - exp(-2.0)) / (1 - exp(-2.0)), 12) AS cost FROM slice GROUP BY 1, 2, 3) WHERE mean_outcome <= 0.3) WHERE r = 1) b USING (mu)""",
    slice=SLICE,
)
def _(t: Logs):
    return _r(stats.grid_optimum(_slice(t)), "mean_outcome", "cost")


PLAN_BANDS = {"A": dict(max_exclusive=0.45), "N": dict(min_inclusive=0.43, max_inclusive=0.46), "R": dict(min_exclusive=0.44)}
PLAN_GRID = [*GRID, (0.1, 0.4), (0.9, 0.2)]


@query(
    "budget_check",
    """SELECT 'seeds are not disjoint' AS rule, 'seed ' || seed AS detail FROM (SELECT seed FROM plan WHERE phase = 'calibration' INTERSECT SELECT seed FROM plan WHERE phase = 'evaluation')
       UNION ALL SELECT 'too few seeds', phase || ' ' || n FROM (SELECT phase, count(DISTINCT seed) AS n FROM plan GROUP BY 1) WHERE n < CASE phase WHEN 'calibration' THEN 5 ELSE 10 END
       UNION ALL SELECT 'pair outside the budget', a || ',' || b FROM (VALUES (0.2, 1.0), (0.4, 0.8), (0.6, 0.6), (0.8, 0.4), (1.0, 0.2), (0.1, 0.4), (0.9, 0.2)) g(a, b)
         WHERE (1 - a) + (1 - b) > 0.8 + 1e-12
       UNION ALL SELECT 'mu outside its band', condition || ' ' || seed FROM measured WHERE NOT CASE condition WHEN 'A' THEN mu < 0.45
         WHEN 'N' THEN mu >= 0.43 AND mu <= 0.46 WHEN 'R' THEN mu > 0.44 ELSE false END""",
    plan="SELECT DISTINCT CASE WHEN l_linenumber < 4 THEN 'calibration' ELSE 'evaluation' END AS phase, CASE WHEN l_linenumber < 4 THEN l_suppkey % 7 ELSE l_suppkey % 9 + 5 END AS seed FROM lineitem",
    measured="SELECT condition, seed, round(avg(measured_mu), 6) AS mu FROM runs GROUP BY 1, 2",
)
def _(t: Logs):
    early = F.col("l_linenumber") < 4
    plan = t.table("lineitem").select(
        F.when(early, "calibration").otherwise("evaluation").alias("phase"),
        F.when(early, F.col("l_suppkey") % 7).otherwise(F.col("l_suppkey") % 9 + 5).alias("seed"),
    )
    measured = t.runs.groupBy("condition", "seed").agg(F.round(F.avg("measured_mu"), 6).alias("mu"))
    return stats.budget_check(plan, measured, PLAN_GRID, 0.8, PLAN_BANDS, {"calibration": 5, "evaluation": 10})


@query(
    "strategy_difference_check",
    """SELECT condition, CASE WHEN condition = 'N' THEN 'equal cost' ELSE 'different exposure' END AS rule,
         CASE WHEN condition = 'N' THEN max(c) FILTER (s = 2) = max(c) FILTER (s = 1)
           ELSE max(e) FILTER (s = 0) <> max(e) FILTER (s = 1) AND max(e) FILTER (s = 2) <> max(e) FILTER (s = 1) END AS passed
       FROM (SELECT condition, baseline AS s, sum(exposures) AS e, round(avg(coverage), 2) AS c FROM runs GROUP BY 1, 2) GROUP BY 1""",
)
def _(t: Logs):
    names = F.array(*[F.lit(n) for n in ("none", "static", "theory", "other", "dynamic")])
    cells = t.runs.groupBy("condition", F.get(names, F.col("baseline").cast("int")).alias("strategy")).agg(
        F.sum("exposures").alias("exposures"), F.round(F.avg("coverage"), 2).alias("l1_cost")
    )
    return stats.strategy_difference_check(cells, [("none", "static"), ("theory", "static")], ("theory", "static"), "N")
