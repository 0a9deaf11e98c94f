"""Small tables with known answers."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sluiceway import extensions
from sluiceway.functions import scalar as sc, text as tx
from sluiceway.operators import audit, choices, dataset, evaluation, exposure, governance, graph, hierarchy, linking, reliability, stats, threshold


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "c")], "user_id bigint, community string")


def arcs(spark, pairs):
    return spark.createDataFrame(pairs, "follower_id bigint, followee_id bigint")


def test_mixing_counts(spark, people, rows_of):
    follow = arcs(spark, [(0, 1), (1, 0), (0, 2), (2, 0), (2, 3), (4, 4)])
    out = graph.mixing_stats(follow, people).first()
    assert (out.intra_edges, out.inter_edges, out.duplicates, out.self_loops) == (2, 1, 2, 1)
    assert out.mu == pytest.approx(1 / 3)
    assert rows_of(graph.isolated_nodes(follow, people), "user_id") == [(4,)]
    per = {r.community: r for r in graph.mixing_per_community(follow, people).collect()}
    assert (per["a"].intra_incidents, per["a"].inter_incidents, per["b"].intra_incidents) == (2, 1, 2)
    assert per["c"].isolated_nodes == 1
    assert sum(r.inter_incidents for r in per.values()) == 2 * out.inter_edges


@pytest.mark.parametrize("pairs, mu", [([(0, 1), (2, 3)], 0.0), ([(0, 2), (1, 3)], 1.0), ([], None)])
def test_mixing_bounds(spark, people, pairs, mu):
    assert graph.mixing_stats(arcs(spark, pairs), people).first().mu == mu


def test_mixing_modes(spark, people):
    follow = arcs(spark, [(0, 1), (1, 0), (0, 2)])
    both = graph.mixing_stats(follow, people).first()
    directed = graph.mixing_stats(follow, people, "arcs").first()
    assert (both.total_edges, both.mu) == (2, 0.5)
    assert (directed.total_edges, directed.mu) == (3, pytest.approx(1 / 3))


def test_unlabelled_endpoint_rejects_even_a_loop(spark, people, rows_of):
    follow = arcs(spark, [(0, 1), (9, 9)])
    assert rows_of(graph.missing_community_edges(follow, people)) == [(9, 9)]
    out = graph.mixing_stats(follow, people).first()
    assert not out.valid and out.mu is None


def test_keep_formula_and_costs(spark):
    df = spark.createDataFrame([("a", "a", 0.5), ("a", "b", 0.5), ("a", "b", 0.0)], "u string, w string, r double")
    keep = [r[0] for r in df.select(sc.keep_probability("u", "w", "r", 0.8, 0.2)).collect()]
    assert keep == pytest.approx([0.9, 0.6, 1.0])
    c = spark.range(1).select(
        sc.exponential_cost(1.0, 1.0).alias("lo"), sc.exponential_cost(0.0, 0.0).alias("hi"), sc.l1_cost(0.6, 0.6).alias("l1")
    ).first()
    assert (c.lo, c.hi, c.l1) == pytest.approx((0.0, 1.0, 0.8))


def test_allocation_direction(spark):
    mus = spark.createDataFrame([("s", 0.2), ("w", 0.8), ("m", 0.52)], "condition string, mu double")
    grid = [(0.2, 1.0), (0.6, 0.6), (1.0, 0.2), (0.0, 0.0), (0.6, 0.6)]
    out = stats.allocate_grid(mus, grid, 0.8, 0.05).collect()
    assert {r.condition: r.direction for r in out} == {"s": "intra", "w": "inter", "m": "balanced"}
    assert all((r.omega_intra, r.omega_inter) != (0.0, 0.0) for r in out) and len(out) == 9
    best = {r.condition: (r.omega_intra, r.omega_inter) for r in out if r.rank == 1}
    assert best["s"] == (0.2, 1.0) and best["w"] == (0.6, 0.6)
    ref = {r.condition: (r.reference_intra, r.reference_inter) for r in out}
    assert ref["s"] == (0.0, 0.85) and ref["m"] == (None, None)
    strict = stats.allocate_strict(mus, grid, 0.8, 0.05, 0.3).collect()
    assert {(r.condition, r.omega_intra) for r in strict} == {("s", 0.2), ("w", 1.0), ("m", 0.6)}


def adoptions(spark, rows):
    return spark.createDataFrame(rows, "root_post_id bigint, user_id bigint, step bigint")


def sightings(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, root_post_id bigint, adopter_id bigint, step bigint")


@pytest.fixture(scope="module")
def root_labels(spark):
    return spark.createDataFrame([(10, "a")], "root_post_id bigint, root_community string")


def at(states, user, step):
    """State of a user and root 10 at a step, by interval lookup; None if no neighbour has adopted."""
    found = states.where(f"user_id = {user} and root_post_id = 10 and timestep <= {step} and (until is null or until > {step})").collect()
    assert len(found) <= 1
    return found[0] if found else None


@pytest.mark.parametrize("theta, met", [(0.5, False), (0.49, True)])
def test_threshold_is_strict(spark, people, root_labels, theta, met):
    follow = arcs(spark, [(0, 1), (1, 2)])
    states = threshold.threshold_states(follow, people, adoptions(spark, [(10, 0, 0)]), sightings(spark, []), root_labels, threshold=theta, gate=False)
    out = at(states, 1, 1)
    assert out.native_signal == 1.0 and out.native_satisfied is met and out.should_attempt is met
    assert (out.threshold, out.boundary, out.user_community, out.root_community) == (theta, theta * 2, "a", "a")


def test_threshold_star(spark, people, root_labels):
    follow = arcs(spark, [(0, 1), (0, 2), (0, 3)])
    states = threshold.threshold_states(
        follow, people, adoptions(spark, [(10, 1, 0), (10, 2, 0)]), sightings(spark, []), root_labels,
        threshold=0.1, weight_intra=0.5, weight_inter=0.25, gate=False,
    )
    out = at(states, 0, 1)
    assert (out.adopted_intra, out.adopted_inter, out.total_degree, out.intra_degree, out.inter_degree) == (1, 1, 3, 1, 2)
    assert out.native_signal == 0.75


def test_threshold_gate_blocks(spark, people, root_labels):
    follow = arcs(spark, [(0, 1), (1, 2)])
    one = adoptions(spark, [(10, 0, 0)])
    out = at(threshold.threshold_states(follow, people, one, sightings(spark, []), root_labels, threshold=0.0), 1, 1)
    assert out.native_satisfied and not out.observable_satisfied and out.blocked and not out.should_attempt
    # user 3 is no contact of user 1
    seen = sightings(spark, [(1, 10, 0, 1), (1, 10, 0, 1), (1, 10, 3, 1)])
    out = at(threshold.threshold_states(follow, people, one, seen, root_labels, threshold=0.0), 1, 1)
    assert out.observable_intra == 1 and out.should_attempt


def test_threshold_changes_with_the_steps(spark, people, root_labels):
    """Merged over all steps user 1 sees an adopter of root 10 and should attempt; step by step the feed comes too early or too late."""
    follow = arcs(spark, [(0, 1), (1, 2)])
    log = adoptions(spark, [(10, 0, 3), (10, 2, 5), (10, 1, 6)])
    seen = sightings(spark, [(1, 10, 0, 3), (1, 10, 0, 5), (1, 10, 0, 6), (1, 10, 2, 5)])
    states = threshold.threshold_states(follow, people, log, seen, root_labels, threshold=0.0)
    assert at(states, 1, 3) is None  # who adopts at step 3 counts from step 4 on, and their post of step 3 does not
    four, five, six, seven = (at(states, 1, k) for k in (4, 5, 6, 7))
    assert (four.adopted_intra, four.observable_intra, four.blocked, four.should_attempt) == (1, 0, True, False)
    assert (five.adopted_intra + five.adopted_inter, five.observable_intra, five.observable_inter, five.should_attempt) == (1, 1, 0, True)
    assert (six.adopted_intra + six.adopted_inter, six.observable_intra, six.already_adopted, six.should_attempt) == (2, 1, False, True)
    assert (seven.observable_intra, seven.already_adopted, seven.until) == (0, True, None)
    # every user decides at steps 4 and 6; the only root is there from step 4 on
    asked = spark.createDataFrame([(u, k) for u in (0, 1, 2, 2, 99) for k in (3, 4, 6)], "user_id bigint, timestep bigint")
    rows = {r.timestep: r for r in threshold.shadow_summary(states, log, people, asked).collect()}
    assert [rows[k].evaluations for k in (3, 4, 6)] == [0, 3, 3]
    assert [rows[k].open_evaluations for k in (3, 4, 6)] == [0, 2, 1]
    assert [(rows[k].potential_adoptions, rows[k].blocked, rows[k].below_threshold) for k in (4, 6)] == [(0, 1, 3), (1, 0, 2)]
    looked_up = threshold.evaluations_at(states, asked).where("user_id = 1").collect()
    assert sorted((r.timestep, r.should_attempt) for r in looked_up) == [(4, False), (6, True)]


def test_first_adoption_counts_once(spark, rows_of):
    roots = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 1, 6), (4, 4, 6)], "post_id bigint, root_post_id bigint, user_id bigint")
    posts = spark.createDataFrame([(1, 0), (2, 9), (3, 4), (4, 2)], "post_id bigint, created_at bigint")
    assert rows_of(threshold.first_adoptions(roots, posts), "root_post_id", "user_id", "step") == [(1, 5, 0), (1, 6, 4), (4, 6, 2)]


def test_threshold_rounds_are_synchronous(spark, rows_of):
    people = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a")], "user_id bigint, community string")
    seeds = spark.createDataFrame([(0, 7)], "user_id bigint, root_post_id bigint")
    out = threshold.threshold_rounds(arcs(spark, [(0, 1), (1, 2)]), people, seeds, threshold=0.0, rounds=3)
    assert rows_of(out, "user_id", "round") == [(0, 0), (1, 1), (2, 2)]
    counts = rows_of(graph.round_counts(out), "round", "new_adopters", "total_adopters")
    assert counts == [(0, 1, 1), (1, 1, 2), (2, 1, 3)]
    label = spark.createDataFrame([(7, "a")], "root_post_id bigint, root_community string")
    assert graph.adoption_summary(out, people, label).first().final_fraction == 1.0


def test_paired_rows(spark, rows_of):
    schema = "condition string, seed bigint, value double"
    t = spark.createDataFrame([("c", 2, 4.0), ("c", 1, 7.0)], schema)
    k = spark.createDataFrame([("c", 1, 3.0), ("c", 2, 9.0)], schema)
    assert rows_of(stats.paired_difference(t, k, ["condition"]), "seed", "difference") == [(1, 4.0), (2, -5.0)]
    odd = spark.createDataFrame([("c", 1, 3.0), ("c", 1, 9.0), ("c", 3, 1.0)], schema)
    issues = rows_of(stats.paired_difference(t, odd, ["condition"]), "seed", "issue")
    assert issues == [(1, "duplicate seed"), (2, "seed sets do not match"), (3, "seed sets do not match")]


def state_row(spark, t, a, b, **over):
    base = dict(
        run_id="r", timestep=t, risk_adoption_rate=0.9, recent_reposts=20, community_coverage_ratio=1.0,
        cross_community_exposure_ratio=0.9, report_rate=0.8, benign_exposure_loss=0.0, cumulative_cost=0.0, remaining_budget=0.2,
        omega_intra=a, omega_inter=b,
    )
    return spark.createDataFrame([{**base, **over}])


def test_controller_budget_and_interval(spark):
    rule = dict(interval=1, step=0.5, risk_target=0.1, cross_target=0.1, report_target=0.1, loss_limit=0.5, budget=0.2)
    out = governance.control_recommendation(state_row(spark, 0, 1.0, 1.0), **rule).first()
    assert out.expected_cost == pytest.approx(0.2)
    assert 0 <= out.next_omega_intra <= 1 and (1 - out.next_omega_intra) + (1 - out.next_omega_inter) == pytest.approx(0.2)
    hold = governance.control_recommendation(state_row(spark, 1, 0.6, 0.3), **{**rule, "interval": 2}).first()
    assert (hold.next_omega_intra, hold.next_omega_inter, hold.expected_cost, hold.reason) == (0.6, 0.3, 0.0, "between control intervals")
    spent = governance.control_recommendation(state_row(spark, 0, 0.6, 0.3, remaining_budget=0.0), **rule).first()
    assert spent.reason == "budget exhausted"


def test_direct_cascade(spark, rows_of):
    posts = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3)], "post_id bigint, original_post_id bigint")
    assert rows_of(hierarchy.cascade_direct(posts)) == [(1, 3)]


def test_roots_errors_and_depth(spark, rows_of):
    data = [(1, 5, None), (2, 6, 1), (3, 7, 2), (4, 7, 3), (10, 1, 11), (11, 1, 10), (12, 1, 11), (20, 1, 99), (21, 1, 20)]
    posts = spark.createDataFrame(data, "post_id bigint, user_id bigint, original_post_id bigint")
    for limit in (None, 0):
        out = {r.post_id: (r.root_post_id, r.depth, r.error) for r in hierarchy.resolve_chains(posts, limit=limit).collect()}
        assert out[4] == (1, 3, None) and out[1] == (1, 0, None)
        assert all(out[p] == (None, None, "cycle") for p in (10, 11, 12))
        assert out[20][2] == out[21][2] == "absent post 99"
    assert rows_of(hierarchy.post_roots(posts), "post_id", "root_author_id") == [(1, 5), (2, 5), (3, 5), (4, 5)]


def test_long_chain_resolves(spark):
    n = 300
    posts = spark.range(n).select(
        F.col("id").alias("post_id"), F.lit(1).cast("bigint").alias("user_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("original_post_id")
    )
    out = hierarchy.post_roots(posts).agg(F.max("depth"), F.countDistinct("root_post_id"), F.count("*")).first()
    assert tuple(out) == (n - 1, 1, n)


def test_exposure_refresh(spark, rows_of):
    users = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "user_id bigint, community string")
    posts = spark.createDataFrame(
        [(1, 2, None, None, 0), (2, 1, 1, None, 0), (3, 1, 2, "q", 0)],
        "post_id bigint, user_id bigint, original_post_id bigint, quote_content string, num_likes bigint",
    )
    follow = arcs(spark, [(0, 2)])
    rec = spark.createDataFrame([(0, 3)], "user_id bigint, post_id bigint")
    merged = exposure.merge_candidates(exposure.recommendation_sample(rec, 2, 1), exposure.following_topk(follow, posts, 2))
    candidates = merged.select(
        F.lit(1).cast("bigint").alias("refresh_id"), F.lit("r").alias("run_id"), F.lit(0).cast("bigint").alias("timestep"), "user_id",
        F.col("position").alias("rank"), "post_id", "base_score", "source",
    )
    risk = spark.createDataFrame([(1, 1.0)], "post_id bigint, risk_score double")
    roots = hierarchy.post_roots(posts)
    out = exposure.govern(candidates, roots, users, risk, F.lit(0.0), F.lit(0.0), seed=7)
    assert rows_of(out, "post_id", "root_post_id", "author_community", "source", "shown") == [
        (1, 1, "b", "following", False), (3, 1, "b", "recommendation", False)
    ]
    # without any risk the whole refresh fails
    none = spark.createDataFrame([(9, 1.0)], "post_id bigint, risk_score double")
    assert exposure.govern(candidates, roots, users, none, F.lit(0.0), F.lit(0.0), seed=7).isEmpty()


def test_merge_keeps_rank_of_repeated_posts(spark, rows_of):
    recommended = spark.createDataFrame([(1, 0, 5, 1.0)], "user_id bigint, rank bigint, post_id bigint, base_score double")
    following = spark.createDataFrame([(1, 0, 5, 9), (1, 1, 6, 4)], "user_id bigint, rank bigint, post_id bigint, num_likes bigint")
    out = exposure.merge_candidates(recommended, following)
    assert rows_of(out, "position", "post_id", "base_score", "source") == [(0, 5, 1.0, "recommendation"), (1, 6, 4.5, "following")]


def test_predictions(spark):
    rows = [("report", '{"action":"report","confidence":0.8,"reason":"x"}', 0.2), ("ignore", "not json", 0.4)]
    out = evaluation.action_eval(spark.createDataFrame(rows, "label string, output string, latency_seconds double")).first()
    assert out.json_valid_rate == 0.5 and out.mean_inference_seconds == pytest.approx(0.3)
    assert out.action_macro_f1 == pytest.approx(0.25) and out.brier_score == pytest.approx((0.04 + 0.0) / 2)


def test_masked_features(spark):
    f = dataset.masked_features(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)), 9, 10)
    out = spark.range(1).select(f["input_ids"].alias("i"), f["labels"].alias("l"), f["attention_mask"].alias("m")).first()
    assert out.i == [1, 2, 3, 4, 9] and out.l == [-100, -100, 3, 4, 9] and out.m == [1] * 5
    f = dataset.masked_features(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)), 9, 4)
    out = spark.range(1).select(f["input_ids"].alias("i"), f["labels"].alias("l")).first()
    assert out.i == [2, 3, 4, 9] and out.l == [-100, 3, 4, 9]
    f = dataset.masked_features(F.array(F.lit(1)), F.array(F.lit(3), F.lit(4)), 9, 2)
    assert spark.range(1).select(f["input_ids"].alias("i")).first().i == [3, 4]


def test_normalize_action_kinds(spark):
    raw = [
        ('{"action":"quote","confidence":1,"reason":"r"}', None), ("nope", "invalid_json"), ("[1]", "invalid_action"),
        ('{"action":"like","confidence":1,"reason":"r"}', "invalid_action"), ('{"action":"quote","confidence":2,"reason":"r"}', "invalid_schema"),
        ('{"action":"quote","confidence":true,"reason":"r"}', "invalid_schema"), ('{"action":"quote","confidence":0.5}', "invalid_schema"),
        ('{"action":"quote","confidence":0.5,"reason":"r","x":1}', "invalid_schema"), ('{"action":3,"confidence":0.5,"reason":"r"}', "invalid_action"),
    ]
    df = spark.createDataFrame(raw, "raw string, want string")
    n = tx.normalize_action("raw")
    got = df.select("want", n["failure_reason"].alias("f"), n["action"].alias("a"), n["confidence"].alias("c"), n["reason"].alias("r")).collect()
    assert [r.f for r in got] == [w for _, w in raw]
    assert (got[0].a, got[0].c) == ("quote", 1.0)
    assert (got[1].a, got[1].c, got[1].r) == ("ignore", 0.0, "safe fallback after invalid_json")


def test_secret_and_redaction(spark):
    tail = "A1b2C3d4E5f6"
    texts = ["x gsk" + "_" + tail, "y SK" + "-" + tail, "z hf" + "_" + tail, "plain gsk" + "_short", "mail me: a.b@x.org or +31 20 123 4567", "sk" + "-" + tail]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(tx.has_key("t").alias("k"), tx.redact("t").alias("r")).collect()
    assert [r.k for r in out] == [True, True, True, False, False, True]
    assert out[0].r == "x [REDACTED_SECRET]" and out[1].r.startswith("y SK") and out[2].r.startswith("z hf")
    assert out[4].r == "mail me: [REDACTED_EMAIL] or [REDACTED_PHONE]" and out[5].r == "[REDACTED_SECRET]"


def test_choice_errors(spark):
    want = {
        "ignore": None, "ignore:1": "ignore with target", "repost": "missing target", "quote:x": "target is not an integer",
        "report:0": "target is not positive", "like:1": "unsupported action", "repost:5": None, None: "missing choice",
    }
    df = spark.createDataFrame([(c,) for c in want], "c string")
    assert {r.c: r.e for r in df.select("c", sc.choice_error("c").alias("e")).collect()} == want


def test_semantic_binding_order(spark):
    legal = ["ignore", "repost:3", "quote:3"]
    data = [
        (0, "ignore", 0, "", None), (5, "ignore", 0, "", "invalid_choice_index"), (-1, "ignore", 0, "", "invalid_choice_index"),
        (1, "quote", 3, "", "choice_action_mismatch"), (1, "repost", 4, "", "choice_target_mismatch"),
        (2, "quote", 3, " ", "quote_text_contract_failure"), (1, "repost", 3, "x", "quote_text_contract_failure"), (2, "quote", 3, "x", None),
    ]
    df = spark.createDataFrame([(*d[:4], legal, d[4]) for d in data], "choice_index bigint, action_type string, target_post_id bigint, quote_text string, legal array<string>, want string")
    assert [r.failure for r in choices.semantic_binding(df).collect()] == [d[4] for d in data]


def test_legal_masks(spark):
    posts = spark.createDataFrame(
        [(1, 9, None, None), (2, 8, 1, None), (3, 5, 1, "q"), (4, 7, 1, None)],
        "post_id bigint, user_id bigint, original_post_id bigint, quote_content string",
    )
    roots = hierarchy.post_roots(posts)
    kinds = posts.select("post_id", (F.col("original_post_id").isNotNull() & F.col("quote_content").isNull()).alias("is_repost")).join(
        roots.select("post_id", "root_post_id"), "post_id"
    )
    reports = spark.createDataFrame([(5, 2, 1)], "user_id bigint, target_post_id bigint, rowid bigint")
    d = spark.createDataFrame([(1, 5, [1, 2]), (2, 7, [2])], "rowid bigint, user_id bigint, visible array<bigint>")
    direct = {r.rowid: r.legal for r in choices.legal_direct(d, kinds, posts, reports).collect()}
    # user 5 quoted the root: v1 counts it, also against the pure repost 2; report of 2 is used up
    assert direct[1] == ["ignore", "quote:1", "report:1", "quote:2"]
    by_root = {r.rowid: r.legal for r in choices.legal_root(d, roots, posts, reports).collect()}
    # v2 ignores quotes but spreads the report over the root
    assert by_root[1] == ["ignore", "repost:1", "quote:1", "repost:2", "quote:2"]
    assert by_root[2] == ["ignore", "quote:2", "report:2"]
    prior = {(r.user_id, r.post_id): (r.has_derivation, r.has_report) for r in choices.prior_actions(
        spark.createDataFrame([(5, 1), (5, 2), (9, 1)], "user_id bigint, post_id bigint"), roots, posts, reports).collect()}
    assert prior == {(5, 1): (True, False), (5, 2): (True, True), (9, 1): (False, False)}


def test_refresh_match_needs_exactly_one(spark, rows_of):
    data = [(1, 1, 0, "refresh"), (2, 1, 0, "repost"), (3, 1, 0, "refresh"), (4, 1, 0, "refresh"), (5, 1, 0, "repost"), (6, 1, 0, "refresh"), (7, 1, 1, "repost"), (8, 1, 1, "do_nothing")]
    trace = spark.createDataFrame(data, "rowid bigint, user_id bigint, timestep bigint, action string")
    out = linking.unique_refresh_match(trace, blocks=2)
    assert rows_of(out, "rowid", "candidates", "refresh_id") == [(2, 1, 1), (5, 2, None), (7, 0, None), (8, 0, None)]


def test_bind_trace_takes_the_next(spark, rows_of):
    trace = spark.createDataFrame([(1, 1, "repost"), (5, 1, "repost"), (7, 2, "repost")], "rowid bigint, user_id bigint, action string")
    asks = spark.createDataFrame([(1, 1, "repost"), (5, 1, "repost"), (0, 2, "repost"), (2, 1, "report_post")], "rowid bigint, user_id bigint, expected string")
    assert rows_of(linking.bind_trace(asks, trace, blocks=2), "rowid", "user_id", "trace_rowid") == [(0, 2, 7), (1, 1, 5), (2, 1, None), (5, 1, None)]


def test_ignore_categories(spark):
    cases = {("high", "low"): "mixed_high_low_feed", ("high",): "missed_intervention_candidate", ("low", "low"): "low_risk_only_usually_acceptable",
             (): "unavailable_or_intermediate_feed", ("low", "intermediate"): "unavailable_or_intermediate_feed"}
    df = spark.createDataFrame([(list(k), v) for k, v in cases.items()], "b array<string>, want string")
    assert all(r.got == r.want for r in df.select("want", audit.ignore_category(F.col("b")).alias("got")).collect())


def test_quality_rates_are_null_without_scores(spark):
    df = spark.createDataFrame([("unscored", "x"), ("unscored", None)], "quality_class string, profile string")
    out = {(r.stratum, r.value): r for r in audit.quality_summary(df, ["profile"]).collect()}
    assert out[("overall", None)].aligned_rate is None and out[("profile", "unavailable")].unscored == 1


def test_failure_accounting_is_exclusive(spark):
    kinds = ["json_validate_failed", "provider_error", "timeout", None, "semantic_mismatch"]
    df = spark.createDataFrame([("r", k) for k in kinds], "run_id string, error_kind string")
    out = reliability.failure_accounting(df, ["run_id"]).first()
    assert (out.provider_failure_count, out.provider_json_validate_failed_count, out.dispatcher_failure_count) == (2, 1, 1)
    assert out.completed_decision_count == 1 and out.incomplete_decision_count == out.unrecovered_logical_error_count == 4


def test_execution_status(spark):
    df = spark.createDataFrame([(3, 3, 0), (3, 0, 3), (3, 2, 1), (3, 3, 1)], "e int, c int, u int")
    status, reasons = reliability.execution_status("e", "c", "u")
    got = [(r.s, r.r) for r in df.select(status.alias("s"), reasons.alias("r")).collect()]
    assert got == [("success", []), ("failed", ["incomplete_decisions", "unrecovered_errors"]),
                   ("degraded", ["incomplete_decisions", "unrecovered_errors"]), ("degraded", ["unrecovered_errors"])]


def test_bootstrap_interval(spark):
    values = spark.createDataFrame([("a", s, float(s)) for s in range(1, 9)] + [("b", 1, 5.0)], "g string, seed bigint, value double")
    first = {r.g: r for r in stats.bootstrap_ci(values, ["g"], resamples=200, seed=3).collect()}
    again = {r.g: r for r in stats.bootstrap_ci(values.repartition(5), ["g"], resamples=200, seed=3).collect()}
    assert first["a"].ci_low == pytest.approx(again["a"].ci_low) and first["a"].ci_high == pytest.approx(again["a"].ci_high)
    assert first["a"].ci_low < 4.5 < first["a"].ci_high
    assert (first["b"].sample_std, first["b"].ci_low, first["b"].ci_high) == (0.0, 5.0, 5.0)
    assert first["a"].sample_std == pytest.approx(math.sqrt(6.0))


def test_status_counts_are_zero_filled(spark, rows_of):
    df = spark.createDataFrame([("failed",)], "status string")
    assert rows_of(dataset.status_counts(df)) == [("failed", 1), ("pending", 0), ("succeeded", 0)]


def test_lifecycle(spark):
    pending = spark.createDataFrame([(f"d{i}", 1, ["ignore", "repost:3"]) for i in range(6)], "decision_id string, user_id bigint, legal array<string>")
    trace = spark.createDataFrame([(1, 1, "repost"), (2, 2, "repost"), (3, 1, "do_nothing")], "rowid bigint, user_id bigint, action string")
    outcomes = spark.createDataFrame(
        [("d0", "succeeded", "repost:3", 1, None), ("d1", "succeeded", "repost:3", 2, None), ("d2", "succeeded", "quote:3", 1, None),
         ("d3", "failed", None, None, "timeout"), ("d4", "failed", None, None, "Bad Name"), ("d5", "succeeded", "ignore", 3, None), ("d5", "failed", None, None, "x")],
        "decision_id string, outcome string, choice string, action_trace_rowid bigint, failure_category string",
    )
    out = {r.decision_id: (r.status, r.reject_reason) for r in dataset.resolve_lifecycle(pending, outcomes, trace).collect()}
    assert out["d0"] == ("succeeded", None) and out["d3"] == ("failed", None)
    assert {k: v[0] for k, v in out.items() if k in ("d1", "d2", "d4", "d5")} == dict.fromkeys(("d1", "d2", "d4", "d5"), "pending")
    assert out["d5"][1] == "more than one outcome"


def test_canonical_text_of_any_depth(spark):
    """Equal to a key-sorted compact print, whatever the spelling; numbers count by value."""
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 6:
            return {rng.choice(["b", "a", "Z", "é", "aa", "_", "k 1", "漢"]): value(depth - 1) for _ in range(rng.randrange(5))}
        return [None, True, rng.randrange(-9, 10**12), rng.choice(["", 'q"\\\\', "é\\n\\t\\x01/", "漢"]), False][kind]

    objects = [{"k": value(4), "a": value(3)} for _ in range(200)]
    rows = []
    for i, o in enumerate(objects):
        shuffled = dict(sorted(o.items(), key=lambda kv: rng.random()))
        rows.append((i, json.dumps(shuffled, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5), json.dumps(o, ensure_ascii=False, sort_keys=True, separators=(",", ":"))))
    rows += [(900, None, "{}"), (901, "", "{}"), (902, "{bad", "{bad"), (903, '{"a":1,"a":2}', '{"a":1,"a":2}'), (904, '{"a":1.0}', '{"a":1}')]
    df = spark.createDataFrame(rows, "id int, raw string, want string")
    assert df.where(~sc.canonical_text("raw").eqNullSafe(F.col("want"))).collect() == []


def test_duplicates_in_other_spellings(spark, rows_of):
    data = [(1, 7, 0, "repost", '{"a":1,"b":2}'), (2, 7, 0, "repost", '{ "b":2, "a":1}'), (3, 7, 0, "repost", '{"a":1,"b":3}'), (4, 7, 0, "do_nothing", None), (5, 7, 0, "do_nothing", "{}")]
    trace = spark.createDataFrame(data, "rowid bigint, user_id bigint, timestep bigint, action string, info string")
    assert rows_of(linking.duplicate_actions(trace), "action", "info", "copies", "first_rowid") == [("do_nothing", "{}", 2, 4), ("repost", '{"a":1,"b":2}', 2, 1)]


def test_extensions_by_name(spark, rows_of):
    rec = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 10)], "user_id bigint, post_id bigint")
    posts = spark.createDataFrame([(10, 5, 3), (11, 5, 9), (12, 6, 1), (13, 6, 4)], "post_id bigint, user_id bigint, num_likes bigint")
    given = dict(rec=rec, follow=arcs(spark, [(1, 5), (1, 6), (2, 6)]), posts=posts, k=3, seed=1)
    built_in = rows_of(extensions.call("generator", "merged", **given))
    assert built_in and rows_of(extensions.call("generator", "merged_by_rows", **given)) == built_in

    class Newest:
        """A deployment's own generator: the two newest posts of the pool."""

        def __init__(self):
            self.posts = []

        def eval(self, row):
            self.user = row["user_id"]
            self.posts.append((row["post_id"], row["base_score"]))

        def terminate(self):
            for position, (post, score) in enumerate(sorted(self.posts, reverse=True)[:2]):
                yield self.user, position, post, score, "own"

    extensions.register_table_function("generator", "newest", Newest, extensions.ranked_pool, ["user_id"], ["part", "rank"])
    own = rows_of(extensions.call("generator", "newest", **given), "user_id", "position", "post_id", "source")
    assert own == [(1, 0, 13, "own"), (1, 1, 11, "own"), (2, 0, 13, "own"), (2, 1, 12, "own"), (3, 0, 10, "own")]
    assert "newest" in extensions.names("generator")


def test_extensions_are_checked(spark):
    extensions.register("metric", "wrong", lambda **_: spark.range(1).select(F.col("id").alias("root_post_id"), F.lit("x").alias("value")))
    with pytest.raises(TypeError, match="value is string, not double"):
        extensions.call("metric", "wrong")
    with pytest.raises(ValueError, match="no metric called nothing"):
        extensions.call("metric", "nothing")
    with pytest.raises(ValueError, match="no such kind"):
        extensions.register("policy", "x", lambda: None)
