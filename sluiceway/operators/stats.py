"""Grid allocation, calibrated selection, bootstrap and paired statistics.

Means that are compared or ordered are rounded to 9 digits first: the order in which a
distributed sum adds its terms must not decide a tie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.draw import pick_index
from ..functions.ordered import prefix_scan
from ..functions.skew import lookup
from ..functions.scalar import BUDGET_SLACK, direction, exponential_cost, in_band, l1_cost, pair_direction

# ---- fixed values -------------------------------------------------------
# mu -> published optimum (omega_intra, omega_inter)
REFERENCE_POINTS = {0.2: (0.00, 0.85), 0.4: (0.23, 0.34), 0.6: (0.38, 0.21), 0.8: (0.78, 0.10)}
CALIBRATION_ORDER = ("exposures", "reposts", "coverage", "benign_loss", "cost")
THRESHOLD_ORDER = ("coverage", "cascade_size", "reposts", "cost")
PAIR = ("omega_intra", "omega_inter")
# -------------------------------------------------------------------------


def pair_array(grid) -> Column:
    """Literal array of the distinct pairs of a configured grid."""
    seen = list(dict.fromkeys((float(a), float(b)) for a, b in grid))
    return F.array(*[F.struct(F.lit(a).alias("omega_intra"), F.lit(b).alias("omega_inter")) for a, b in seen])


def allocate_grid(conditions: DataFrame, grid, budget: float, tolerance: float = 0.05) -> DataFrame:
    """Grid pairs within the budget per condition, consistent with the direction of mu.

    ``conditions``: key columns and mu. Inconsistent pairs come last, then dearer first.
    """
    keys = [c for c in conditions.columns if c != "mu"]
    rows = conditions.select("*", F.inline(pair_array(grid)))
    d = direction("mu", tolerance)
    a, b = F.col("omega_intra"), F.col("omega_inter")
    rows = rows.select(
        *keys, "mu", d.alias("direction"), "omega_intra", "omega_inter", l1_cost(a, b).alias("l1_cost"),
        exponential_cost(a, b).alias("exponential_cost"),
    ).where(F.col("l1_cost") <= budget + BUDGET_SLACK)
    ok = ((F.col("direction") == "intra") & (a <= b)) | ((F.col("direction") == "inter") & (b <= a)) | (F.col("direction") == "balanced")
    rows = rows.withColumn("consistent", ok)
    # a condition holds at most the configured grid, so this window stays small
    w = W.partitionBy(*keys).orderBy(~F.col("consistent"), F.desc(F.round("l1_cost", 9)), "omega_intra", "omega_inter")
    rows = rows.withColumn("rank", F.row_number().over(w))
    ref_a, ref_b = F.lit(None).cast("double"), F.lit(None).cast("double")
    for mu, (ra, rb) in REFERENCE_POINTS.items():
        near = F.abs(F.col("mu") - mu) <= BUDGET_SLACK
        ref_a, ref_b = F.when(near, ra).otherwise(ref_a), F.when(near, rb).otherwise(ref_b)
    return rows.withColumn("reference_intra", ref_a).withColumn("reference_inter", ref_b)


def allocate_strict(conditions: DataFrame, grid, budget: float, tolerance: float, minimum_gap: float) -> DataFrame:
    """Pairs within the budget whose gap is at least the minimum in the right direction."""
    rows = conditions.select("*", direction("mu", tolerance).alias("direction"), F.inline(pair_array(grid)))
    a, b = F.col("omega_intra"), F.col("omega_inter")
    ok = (
        F.when(F.col("direction") == "intra", b - a >= minimum_gap - BUDGET_SLACK)
        .when(F.col("direction") == "inter", a - b >= minimum_gap - BUDGET_SLACK)
        .otherwise(F.abs(a - b) <= BUDGET_SLACK)
    )
    return rows.where((l1_cost(a, b) <= budget + BUDGET_SLACK) & ok)


def mean_metrics(rows: DataFrame, keys: list[str], metrics: tuple[str, ...], weight: str | None = None) -> DataFrame:
    if weight is None:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), *[F.round(F.avg(m), 9).alias(m) for m in metrics])
    return rows.groupBy(*keys).agg(
        F.sum(weight).alias("observations"),
        *[F.round(F.sum(F.col(m) * F.col(weight)) / F.sum(weight), 9).alias(m) for m in metrics],
    )


def select_best(means: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """Lexicographically smallest row per key, by metrics and then the pair."""
    cols = [*order, *PAIR]
    best = means.groupBy(*keys).agg(F.min(F.struct(*cols, "observations")).alias("b"))
    return best.select(*keys, *[F.col("b")[c].alias(c) for c in [*PAIR, *order, "observations"]])


def select_pair(
    runs: DataFrame, eligible: DataFrame, order: tuple[str, ...] = CALIBRATION_ORDER, key: str = "condition"
) -> DataFrame:
    """Best eligible pair per condition; ``missing`` counts eligible pairs never observed."""
    means = mean_metrics(runs, [key, *PAIR], order)
    wanted = eligible.select(key, *PAIR).distinct()
    found = wanted.join(means, [key, *PAIR], "left")
    best = select_best(found.where("observations is not null"), [key], order)
    gaps = found.groupBy(key).agg(F.count_if(F.col("observations").isNull()).alias("missing"))
    return gaps.join(best, key, "left")


def cost_match(targets: DataFrame, candidates: DataFrame, maximum_error: float, key: str = "condition") -> DataFrame:
    """Symmetric candidate nearest in cost: least relative error, ties to the higher keep.

    ``targets``: key, target_cost. ``candidates``: key, keep, mean_cost (few per key).
    """
    rows = candidates.join(targets, key)
    gap = F.abs(F.col("mean_cost") - F.col("target_cost"))
    rows = rows.withColumn("relative_error", F.when(F.col("target_cost") != 0, gap / F.col("target_cost")).otherwise(gap))
    best = rows.groupBy(key, "target_cost").agg(
        F.min(F.struct("relative_error", (-F.col("keep")).alias("k"), "keep", "mean_cost")).alias("b")
    )
    return best.select(
        key, F.col("b")["keep"].alias("keep"), "target_cost", F.col("b")["mean_cost"].alias("mean_cost"),
        F.col("b")["relative_error"].alias("relative_error"),
        (F.col("b")["relative_error"] <= maximum_error).alias("within_tolerance"),
    )


def leave_one_out(
    runs: DataFrame, eligible: DataFrame, order: tuple[str, ...] = CALIBRATION_ORDER, key: str = "condition"
) -> DataFrame:
    """Winner counts when each seed is left out in turn.

    Means without a seed come from the pair's totals minus that seed's own, so no run
    is repeated per omitted seed.
    """
    rows = runs.join(eligible.select(key, *PAIR).distinct(), [key, *PAIR], "left_semi")
    per = rows.groupBy(key, *PAIR, "seed").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in order])
    total = per.groupBy(key, *PAIR).agg(F.sum("n").alias("t_n"), *[F.sum(m).alias(f"t_{m}") for m in order])
    omitted = per.select(key, "seed").distinct()
    cells = omitted.join(total, key).join(per, [key, *PAIR, "seed"], "left")
    left = F.col("t_n") - F.coalesce("n", F.lit(0))
    means = cells.where(left > 0).select(
        key, "seed", *PAIR, left.alias("observations"),
        *[F.round((F.col(f"t_{m}") - F.coalesce(m, F.lit(0.0))) / left, 9).alias(m) for m in order],
    )
    winners = select_best(means, [key, "seed"], order)
    return winners.groupBy(key, *PAIR).agg(F.count(F.lit(1)).alias("wins"))


def resample_weights(members: DataFrame, keys: list[str], resamples: int, seed: int) -> DataFrame:
    """How often each member index is drawn: (keys, resample, idx, weight).

    ``members``: keys, idx (1 to n) and n of their group. Every resample draws n members with
    replacement; each member row makes the draw of its own number in every resample, so a
    group of any size stays as spread out as its rows are.
    """
    rows = members.select(*keys, "n", F.col("idx").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    drawn = rows.withColumn("idx", pick_index(F.col("n"), seed, *keys, "resample", "i"))
    return drawn.groupBy(*keys, "resample", "idx").agg(F.count(F.lit(1)).alias("weight"))


def bootstrap_selection(
    runs: DataFrame, eligible: DataFrame, *, resamples: int, seed: int, order: tuple[str, ...] = CALIBRATION_ORDER,
    key: str = "condition",
) -> DataFrame:
    """Selection frequency of every pair over resamples of the seeds."""
    rows = runs.join(eligible.select(key, *PAIR).distinct(), [key, *PAIR], "left_semi")
    seeds = prefix_scan(rows.select(key, "seed").distinct(), [key], "seed", sums={"idx": F.lit(1).cast("bigint")}, inclusive=True)
    groups = seeds.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    weights = resample_weights(lookup(seeds, groups, key), [key], resamples, seed).join(seeds, [key, "idx"])
    weighted = weights.select(key, "resample", "seed", "weight").join(rows, [key, "seed"])
    means = mean_metrics(weighted, [key, "resample", *PAIR], order, "weight")
    winners = select_best(means, [key, "resample"], order)
    return winners.groupBy(key, *PAIR).agg((F.count(F.lit(1)) / F.lit(resamples)).alias("frequency"))


def selection_stability(frequencies: DataFrame, selected: DataFrame, *, pair_threshold: float, direction_threshold: float, key: str = "condition") -> DataFrame:
    """Frequency of the selected pair and of its direction, against their thresholds."""
    d = pair_direction(*PAIR)
    by_direction = frequencies.groupBy(key, d.alias("direction")).agg(F.sum("frequency").alias("direction_frequency"))
    s = selected.select(key, *PAIR, d.alias("direction"))
    out = s.join(frequencies, [key, *PAIR], "left").join(by_direction, [key, "direction"], "left")
    pf, df = F.coalesce("frequency", F.lit(0.0)), F.coalesce("direction_frequency", F.lit(0.0))
    return out.select(
        key, *PAIR, "direction", pf.alias("pair_frequency"), df.alias("direction_frequency"),
        (pf >= pair_threshold - BUDGET_SLACK).alias("pair_stable"), (df >= direction_threshold - BUDGET_SLACK).alias("direction_stable"),
    )


def unpivot(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return rows.unpivot(keys, metrics, "metric", "value")


def bootstrap_ci(values: DataFrame, keys: list[str], *, resamples: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """n, mean, sample deviation and percentile interval of the mean per group.

    ``values``: keys, seed (orders the members), value. Means of resamples come from
    drawn weights, so a group is never collected.
    """
    size = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sample_std")
    )
    indexed = prefix_scan(values, keys, "seed", sums={"idx": F.lit(1).cast("bigint")}, inclusive=True)
    weights = resample_weights(lookup(indexed.select(*keys, "idx"), size.select(*keys, "n"), keys), keys, resamples, seed)
    means = (
        weights.join(indexed.select(*keys, "idx", "value"), [*keys, "idx"])
        .groupBy(*keys, "resample")
        .agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("m"))
    )
    tail = (1.0 - confidence) / 2.0
    bounds = means.groupBy(*keys).agg(
        F.percentile("m", F.lit(tail)).alias("ci_low"), F.percentile("m", F.lit(1.0 - tail)).alias("ci_high")
    )
    return size.join(bounds, keys)


def paired_difference(treatment: DataFrame, comparator: DataFrame, keys: list[str]) -> DataFrame:
    """Treatment minus comparator matched on keys and seed; ``issue`` names what does not pair.

    Both sides: keys, seed, value.
    """
    on = [*keys, "seed"]

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("value").alias(name))

    both = one(treatment, "treatment").join(one(comparator, "comparator"), on, "full_outer")
    issue = (
        F.when((F.col("n_treatment") > 1) | (F.col("n_comparator") > 1), "duplicate seed")
        .when(F.col("n_treatment").isNull() | F.col("n_comparator").isNull(), "seed sets do not match")
    )
    return both.select(
        *on, "treatment", "comparator", F.when(issue.isNull(), F.col("treatment") - F.col("comparator")).alias("difference"),
        issue.alias("issue"),
    )


def interpret(intervals: DataFrame) -> DataFrame:
    verdict = (
        F.when(F.col("ci_high") < 0, "stable_decrease").when(F.col("ci_low") > 0, "stable_increase").otherwise("uncertain_ci_crosses_zero")
    )
    return intervals.withColumn("interpretation", verdict)


def baseline_aggregate(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Runs, sorted seeds and the mean of every metric per group, in long form."""
    long = unpivot(runs.select(*keys, "seed", *metrics), [*keys, "seed"], metrics)
    means = long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"))
    # the seeds of an experiment cell are its configured repetitions
    seeds = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.array_sort(F.collect_set("seed")).alias("seeds"))
    return means.join(seeds, keys)


def runner_up_gap(runs: DataFrame, eligible: DataFrame, metrics: tuple[str, ...], key: str = "condition") -> DataFrame:
    """Best and second eligible pair by mean exposure, and the gaps of the given metrics."""
    rows = runs.join(eligible.select(key, *PAIR).distinct(), [key, *PAIR], "left_semi")
    means = mean_metrics(rows, [key, *PAIR], metrics)
    w = W.partitionBy(key).orderBy(metrics[0], *PAIR)
    top = means.withColumn("r", F.row_number().over(w)).where("r <= 2")

    def at(r: int, c: str) -> Column:
        return F.max(F.when(F.col("r") == r, F.col(c)))

    return top.groupBy(key).agg(
        at(1, "omega_intra").alias("best_intra"), at(1, "omega_inter").alias("best_inter"),
        at(2, "omega_intra").alias("second_intra"), at(2, "omega_inter").alias("second_inter"),
        *[(at(2, m) - at(1, m)).alias(f"{m}_gap") for m in metrics],
    )


def grid_optimum(samples: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """Cheapest grid point per mu whose mean outcome stays within the cutoff.

    ``samples``: mu, omega_intra, omega_inter, outcome.
    """
    means = samples.groupBy("mu", *PAIR).agg(F.round(F.avg("outcome"), 9).alias("mean_outcome"), F.count(F.lit(1)).alias("replicates"))
    cost = F.round(exponential_cost(*PAIR), 12)
    held = means.where(F.col("mean_outcome") <= cutoff).withColumn("cost", cost)
    best = held.groupBy("mu").agg(F.min(F.struct("cost", *PAIR, "mean_outcome", "replicates")).alias("b"))
    out = samples.select("mu").distinct().join(best, "mu", "left")
    b = F.col("b")
    expected = F.when(F.col("mu") < 0.5, "intra").otherwise("inter")
    observed = F.when(b.isNotNull(), pair_direction(b["omega_intra"], b["omega_inter"]))
    return out.select(
        "mu", b.isNotNull().alias("available"), *[b[c].alias(c) for c in (*PAIR, "mean_outcome", "replicates", "cost")],
        expected.alias("expected_direction"), observed.alias("observed_direction"), (observed == expected).alias("as_expected"),
    )


def budget_check(
    seeds: DataFrame, measurements: DataFrame, grid, budget: float, bands: dict[str, dict], minimum: dict[str, int], exact: bool = False
) -> DataFrame:
    """Violations of an experiment plan as (rule, detail) rows; none means valid.

    ``seeds``: phase, seed. ``measurements``: condition, seed, mu.
    """
    distinct = seeds.select("phase", "seed").distinct()
    names = list(minimum)
    shared = reduce(
        lambda x, y: x.intersect(y), [distinct.where(F.col("phase") == p).select("seed") for p in names]
    ).select(F.lit("seeds are not disjoint").alias("rule"), F.concat(F.lit("seed "), F.col("seed").cast("string")).alias("detail"))
    counts = distinct.agg(*[F.count_if(F.col("phase") == p).alias(p) for p in names])
    pairs = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).alias("n"), F.lit(minimum[p]).alias("least")) for p in names])
    few = counts.select(F.inline(pairs)).where("n < least").select(
        F.lit("too few seeds").alias("rule"), F.concat_ws(" ", "phase", F.col("n").cast("string")).alias("detail")
    )
    cost = l1_cost(*PAIR)
    over = (F.abs(cost - budget) > BUDGET_SLACK) if exact else (cost > budget + BUDGET_SLACK)
    dear = seeds.sparkSession.range(1).select(F.inline(pair_array(grid))).where(over).select(
        F.lit("pair outside the budget").alias("rule"), F.concat_ws(",", *[F.col(c).cast("string") for c in PAIR]).alias("detail")
    )
    ok = F.lit(False)
    for condition, band in bands.items():
        ok = F.when(F.col("condition") == condition, in_band("mu", **band)).otherwise(ok)
    out = measurements.where(~ok).select(
        F.lit("mu outside its band").alias("rule"), F.concat_ws(" ", "condition", F.col("seed").cast("string")).alias("detail")
    )
    return shared.unionByName(few).unionByName(dear).unionByName(out)


def strategy_difference_check(cells: DataFrame, pairs: list[tuple[str, str]], equal_cost: tuple[str, str], balanced: str) -> DataFrame:
    """Exposures must differ between the named strategies; in the balanced condition costs must agree.

    ``cells``: condition, strategy, exposures, l1_cost (one row each).
    """
    names = sorted({n for p in [*pairs, equal_cost] for n in p})
    wide = cells.groupBy("condition").agg(
        *[F.max(F.when(F.col("strategy") == n, F.col("exposures"))).alias(f"e_{n}") for n in names],
        *[F.max(F.when(F.col("strategy") == n, F.col("l1_cost"))).alias(f"c_{n}") for n in names],
    )
    differ = reduce(lambda x, y: x & y, [F.col(f"e_{a}") != F.col(f"e_{b}") for a, b in pairs])
    same = F.col(f"c_{equal_cost[0]}") == F.col(f"c_{equal_cost[1]}")
    is_balanced = F.col("condition") == balanced
    return wide.select(
        "condition", F.when(is_balanced, "equal cost").otherwise("different exposure").alias("rule"),
        F.when(is_balanced, same).otherwise(differ).alias("passed"),
    )


def classify_bands(rows: DataFrame, value: str, bands: dict[str, dict]) -> DataFrame:
    """One row per (row, band) the value falls into; a missing bound is open."""
    hits = F.filter(
        F.array(*[F.when(in_band(value, **band), F.lit(name)) for name, band in bands.items()]), lambda x: x.isNotNull()
    )
    return rows.withColumn("band", F.explode(hits))


