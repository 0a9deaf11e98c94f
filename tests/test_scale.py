"""Skew-safe helpers against plain windows, and algorithms against brute force."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from sluiceway.functions import ordered, skew
from sluiceway.functions.draw import uniform
from sluiceway.operators import dataset, exposure, graph, hierarchy, stats, threshold


@pytest.fixture(scope="module")
def log(spark):
    """One key owns half of the rows."""
    rng = random.Random(1)
    data = [(i, 1 if rng.random() < 0.5 else rng.randrange(2, 9), rng.choice(["refresh", "repost", "report_post"]), rng.randrange(100)) for i in range(600)]
    return spark.createDataFrame(data, "rowid bigint, user_id bigint, action string, v bigint").repartition(5)


@pytest.mark.parametrize("block", [1, 7, 40, None])
def test_prefix_scan_equals_window(log, rows_of, block):
    mark = F.when(F.col("action") == "refresh", F.col("v"))
    got = ordered.prefix_scan(log, ["user_id"], "rowid", sums={"s": F.col("v")}, lasts={"l": mark}, blocks=block)
    w = W.partitionBy("user_id").orderBy("rowid").rowsBetween(W.unboundedPreceding, -1)
    want = log.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0))).withColumn("l", F.last(mark, True).over(w))
    assert rows_of(got, "rowid", "s", "l") == rows_of(want, "rowid", "s", "l")
    incl = ordered.prefix_scan(log, ["user_id"], "rowid", sums={"s": F.col("v")}, inclusive=True, blocks=block)
    want = log.withColumn("s", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)))
    assert rows_of(incl, "rowid", "s") == rows_of(want, "rowid", "s")


def test_blocks_follow_rows_not_ids(spark, rows_of):
    """Ids spread over 2^60, one key with half of the rows: blocks stay about equal."""
    rng = random.Random(4)
    sparse = spark.createDataFrame([(rng.randrange(1 << 60), 1 if i % 2 else rng.randrange(2, 50), i) for i in range(4000)], "rowid bigint, user_id bigint, v bigint")
    blocked = ordered._blocked(sparse, ["user_id"], "rowid", 16)
    assert blocked.groupBy("user_id", "__blk").count().agg(F.max("count")).first()[0] <= 2 * 4000 / 16
    w = W.partitionBy("user_id").orderBy("rowid").rowsBetween(W.unboundedPreceding, 0)
    got = ordered.prefix_scan(sparse, ["user_id"], "rowid", sums={"s": F.col("v")}, inclusive=True, blocks=16)
    assert rows_of(got, "rowid", "s") == rows_of(sparse.withColumn("s", F.sum("v").over(w)), "rowid", "s")


@pytest.mark.parametrize("block", [1, 13, None])
def test_next_value_equals_window(log, rows_of, block):
    mark = F.when(F.col("action") == "repost", F.col("rowid"))
    got = ordered.next_value(log, ["user_id"], "rowid", mark, "n", blocks=block)
    w = W.partitionBy("user_id").orderBy("rowid").rowsBetween(1, W.unboundedFollowing)
    assert rows_of(got, "rowid", "n") == rows_of(log.withColumn("n", F.first(mark, True).over(w)), "rowid", "n")


@pytest.mark.parametrize("segment", [4, 9, 100_000])
def test_trailing_list_equals_window(log, rows_of, segment):
    got = ordered.trailing_list(log, ["user_id"], "rowid", F.col("v"), "h", 4, blocks=5, segment=segment)
    w = W.partitionBy("user_id").orderBy("rowid").rowsBetween(-4, -1)
    assert rows_of(got, "rowid", "h") == rows_of(log.withColumn("h", F.collect_list("v").over(w)), "rowid", "h")
    assert set(got.columns) == {"rowid", "user_id", "action", "v", "h"}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, log, rows_of, how):
    dim = spark.createDataFrame([(i, f"n{i}") for i in range(1, 7)], "user_id bigint, name string")
    plain = log.join(dim, "user_id", how)
    salted = skew.salted_join(log, dim, "user_id", how, share=0.1, rows_per_salt=50)
    assert rows_of(salted.select(plain.columns)) == rows_of(plain)
    assert rows_of(skew.lookup(log, dim, "user_id", how, limit=0).select(plain.columns)) == rows_of(plain)


def test_hot_keys_are_found(spark, log):
    hot = [r.user_id for r in skew.hot_keys(log, ["user_id"], 0.3).collect()]
    assert hot == [1]


def test_lookup_splits_a_hot_key(spark, tmp_path):
    """A key with most of the rows is read in several tasks when the dim is not broadcast."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    big = spark.range(200000).repartition(8).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    dim = spark.range(200000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    old = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        out = skew.lookup(big, dim, "k", "left", limit=0)
        assert out.where("d = k * 2").count() == 200000
        grouped = out.groupBy("d").agg(F.max("v").alias("n"))
        grouped.collect()
        assert "skewed" in grouped._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_small_tables_are_recognised(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    df = spark.read.parquet(path)
    assert skew.is_small(df) and not skew.is_small(df, limit=10)


def test_draw_ignores_partitioning(spark, rows_of):
    df = spark.createDataFrame([(7, 1, 2, 3), (7, 1, 2, 4)], "s bigint, t bigint, u bigint, r bigint")
    one = rows_of(df.select("r", uniform(7, "t", "u", "r").alias("x")))
    assert one == rows_of(df.repartition(4).select("r", uniform(7, "t", "u", "r").alias("x")))
    assert one[0][1] == pytest.approx(0.05841121799312532, abs=0)


def test_joint_candidates_brute_force(spark):
    rng = random.Random(5)
    users = list(range(12))
    posts = [(p, rng.choice(users[:6] + [0] * 6)) for p in range(40)]
    follow = [(rng.choice(users), rng.choice(users)) for _ in range(15)]
    for limit in (1, 3, 60):
        want = {}
        for u in users:
            f = {b for a, b in follow if a == u}
            order = sorted([(p, a) for p, a in posts if a != u], key=lambda x: (x[1] not in f, -x[0]))[:limit]
            for i, (p, a) in enumerate(order):
                want[(u, i)] = (p, "following" if a in f else "recommendation")
        got = exposure.joint_candidates(
            spark.createDataFrame([(u,) for u in users], "user_id bigint"), spark.createDataFrame(follow, "follower_id bigint, followee_id bigint"),
            spark.createDataFrame(posts, "post_id bigint, user_id bigint"), limit,
        ).collect()
        assert {(r.user_id, r.position): (r.post_id, r.source) for r in got} == want


def test_settle_brute_force(spark, rows_of):
    """Acceptance in time order, with derivatives that may hang below the root."""
    rng = random.Random(3)
    kinds = {1: (1, False), 2: (1, True), 3: (1, True), 4: (4, False), 5: (4, True)}
    data = []
    for i in range(160):
        action = rng.choice(["repost", "quote", "report", "ignore"])
        target = None if action == "ignore" else rng.choice(list(kinds))
        parent = rng.choice([target, kinds[target][0]]) if action in ("repost", "quote") else None
        data.append((i, rng.randrange(3), action, target, parent))
    derived, reported, want = set(), set(), []
    for rowid, user, action, target, parent in data:
        targets = set() if target is None else {target} | ({kinds[target][0]} if kinds[target][1] else set())
        if action == "repost" and any((user, x) in derived for x in targets):
            continue
        if action == "report" and (user, target) in reported:
            continue
        want.append((rowid,))
        if parent is not None:
            derived.add((user, parent))
        if action == "report":
            reported.add((user, target))
    df = spark.createDataFrame(data, "rowid bigint, user_id bigint, action string, target_post_id bigint, created_parent bigint")
    kind_df = spark.createDataFrame([(p, r, k) for p, (r, k) in kinds.items()], "post_id bigint, root_post_id bigint, is_repost boolean")
    assert rows_of(dataset.settle(df, kind_df), "rowid") == want


def test_adoption_starts_from_the_log(spark, rows_of):
    users = spark.createDataFrame([(1, "c0"), (2, "c1"), (3, "c0")], "user_id bigint, community string")
    roots = spark.createDataFrame([(10, 10, 1), (11, 10, 2), (12, 10, 3), (13, 10, 1)], "post_id bigint, root_post_id bigint, user_id bigint")
    posts = spark.createDataFrame([(10, 0), (11, 5), (12, 20), (13, 3)], "post_id bigint, created_at bigint")
    seeds = threshold.initial_adopters(roots, posts, users, 15)
    assert rows_of(seeds, "root_post_id", "user_id", "community") == [(10, 1, "c0"), (10, 2, "c1")]
    predicted = spark.createDataFrame([(1, 10, 0), (2, 10, 0), (3, 10, 1), (9, 10, 2)], "user_id bigint, root_post_id bigint, round int")
    assert rows_of(graph.predicted_against_observed(predicted, roots)) == [(10, 2, 1, 1)]


def settled_in_order(data, kinds):
    derived, reported, out = set(), set(), []
    for rowid, user, action, target, parent in data:
        targets = {target} | ({kinds[target][0]} if target in kinds and kinds[target][1] else set())
        if action == "repost" and any((user, x) in derived for x in targets if x is not None):
            continue
        if action == "report" and target is not None and (user, target) in reported:
            continue
        out.append((rowid,))
        if parent is not None:
            derived.add((user, parent))
        if action == "report":
            reported.add((user, target))
    return out


DECISIONS = "rowid bigint, user_id bigint, action string, target_post_id bigint, created_parent bigint"
KINDS = "post_id bigint, root_post_id bigint, is_repost boolean"


def test_long_dependency_chain_settles(spark, rows_of, monkeypatch):
    """Each repost falls to the derivation the one before it made; 10,000 in a row alternate, beside a hot post that everyone reposts again."""
    n = 10_000
    data = [(i, 1, "repost", i, i + 1) for i in range(n)] + [(n + i, 2, "repost", 7, 7) for i in range(3000)]
    kinds = spark.createDataFrame([(i, i, False) for i in range(n + 2)], KINDS)
    joins = []
    inner = dataset.cut
    monkeypatch.setattr(dataset, "cut", lambda df: (joins.append(1), inner(df))[1])
    found = rows_of(dataset.settle(spark.createDataFrame(data, DECISIONS), kinds), "rowid")
    assert found == [(i,) for i in range(0, n, 2)] + [(n,)]
    # fourteen doublings and the fixed steps of at most two rounds
    assert len(joins) <= 30


@pytest.mark.parametrize("seed", range(2))
def test_settle_random_dependencies(spark, rows_of, seed):
    """Reposts that derive from any post, so that several open ones stand before another."""
    rng = random.Random(seed)
    kinds = {p: (rng.randrange(1, 9), rng.random() < 0.5) for p in range(1, 16)}
    data = []
    for i in range(260):
        action = rng.choice(["repost"] * 6 + ["quote", "report", "ignore"])
        target = None if action == "ignore" or rng.random() < 0.03 else rng.randrange(1, 18)
        parent = rng.choice([target, rng.randrange(1, 18), None]) if action in ("repost", "quote") else None
        data.append((i, rng.randrange(3), action, target, parent))
    df = spark.createDataFrame(data, DECISIONS).repartition(3)
    kind_df = spark.createDataFrame([(p, r, k) for p, (r, k) in kinds.items()], KINDS)
    assert rows_of(dataset.settle(df, kind_df), "rowid") == settled_in_order(data, kinds)


def test_late_step_is_reported():
    from sluiceway.streaming.controller import CONTROLLER_OUTPUT, Controller

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    import pandas as pd

    from sluiceway.operators.governance import LATE_STEP

    names = ["risk_adoption_rate", "recent_reposts", "community_coverage_ratio", "cross_community_exposure_ratio", "report_rate", "benign_exposure_loss"]
    control = Controller(dict(interval=2, step=5, risk_target=0.25, cross_target=0.3, report_target=0.1, loss_limit=0.1, budget=1.2, omega_intra=1.5, omega_inter=1.0))
    control.state = State()
    batch = lambda steps: iter([pd.DataFrame([[t, *[0.5] * 6] for t in steps], columns=["timestep", *names])])
    first = pd.concat(control.handleInputRows(("run-0",), batch([0, 2]), None))
    second = pd.concat(control.handleInputRows(("run-0",), batch([1, 3]), None))
    assert list(first.columns) == CONTROLLER_OUTPUT.fieldNames() and first.omega_intra.between(0, 1).all()
    assert list(second.timestep) == [1, 3] and list(second.reason == LATE_STEP) == [True, False]


def test_shared_folder_is_required():
    from sluiceway.session import shared_dir

    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Bare)


def test_bootstrap_of_a_large_group(spark):
    """A group of 10^5 members is drawn by its own rows."""
    values = spark.range(100_000).select(F.lit("g").alias("k"), F.col("id").alias("seed"), (F.col("id") % 2).cast("double").alias("value"))
    row = stats.bootstrap_ci(values, ["k"], resamples=5, seed=1).first()
    assert row.n == 100_000 and 0.49 < row.ci_low <= row.ci_high < 0.51


def test_topk_is_cut_before_the_shuffle(spark):
    """Both per-key limits run map-side, so no task ever holds a whole hot key."""
    follow = spark.createDataFrame([(1, 2)], "follower_id bigint, followee_id bigint")
    posts = spark.createDataFrame([(2, 5, 1)], "user_id bigint, post_id bigint, num_likes bigint")
    plan = exposure.following_topk(follow, posts, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def plain_rounds(pairs, community, seeds, theta, intra, inter):
    near = {u: set() for u in community}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    found = {k: 0 for k in seeds}
    step = 0
    while True:
        step += 1
        new = set()
        for root in {r for _, r in seeds}:
            for u in community:
                held = [v for v in near[u] if (v, root) in found]
                signal = sum(intra if community[v] == community[u] else inter for v in held)
                if held and (u, root) not in found and signal > theta * len(near[u]):
                    new.add((u, root))
        if not new:
            return sorted((u, r, k) for (u, r), k in found.items())
        found.update(dict.fromkeys(new, step))


def test_threshold_rounds_reach_the_fixpoint(spark, rows_of):
    """A chain that needs more rounds than layers are kept, and a random graph where pressure adds up over rounds."""
    schema = "follower_id bigint, followee_id bigint"
    chain = [(i, i + 1) for i in range(12)]
    rng = random.Random(8)
    web = [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(170)]
    community = {u: "abc"[u % 3] for u in [*range(13), *range(100, 160)]}
    people = spark.createDataFrame(sorted(community.items()), "user_id bigint, community string")
    seeds = [(0, 1), (101, 1), (105, 1), (107, 2), (108, 2), (109, 2), (131, 2)]
    start = spark.createDataFrame(seeds + seeds[:2], "user_id bigint, root_post_id bigint")
    for theta in (0.2, 0.35):
        out = threshold.threshold_rounds(spark.createDataFrame(chain + web, schema), people, start, threshold=theta, weight_intra=1.0, weight_inter=0.5)
        want = plain_rounds(chain + web, community, seeds, theta, 1.0, 0.5)
        assert rows_of(out, "user_id", "root_post_id", "round") == want
        if theta == 0.2:
            assert max(r for _, _, r in want) > threshold.LAYERS + 2


def test_states_equal_every_step(spark):
    """Change points against an evaluation of each step on its own."""
    rng = random.Random(9)
    community = {u: "ab"[u % 2] for u in range(25)}
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(60)]
    near = {u: {b if a == u else a for a, b in pairs if u in (a, b) and a != b} for u in community}
    log = {(r, u): rng.randrange(8) for r in (1, 2, 3) for u in community if rng.random() < 0.4}
    seen = {(rng.randrange(25), rng.choice((1, 2, 3)), rng.randrange(25), rng.randrange(9)) for _ in range(900)}
    states = threshold.threshold_states(
        spark.createDataFrame(pairs, "follower_id bigint, followee_id bigint"),
        spark.createDataFrame(sorted(community.items()), "user_id bigint, community string"),
        spark.createDataFrame([(r, u, k) for (r, u), k in log.items()], "root_post_id bigint, user_id bigint, step bigint"),
        spark.createDataFrame(sorted(seen), "user_id bigint, root_post_id bigint, adopter_id bigint, step bigint"),
        spark.createDataFrame([(1, "a"), (2, "b")], "root_post_id bigint, root_community string"),
        threshold=0.25, weight_intra=1.0, weight_inter=0.5,
    ).collect()
    held = {}
    for r in states:
        for k in range(r.timestep, 12 if r.until is None else r.until):
            assert (r.user_id, r.root_post_id, k) not in held
            held[r.user_id, r.root_post_id, k] = r
    for u in community:
        for root in (1, 2, 3):
            for k in range(12):
                frozen = {v for v in near[u] if log.get((root, v), 99) < k}
                shown = {v for v in frozen if (u, root, v, k) in seen}
                r = held.get((u, root, k))
                assert (r is not None) == bool(frozen)
                if r:
                    split = lambda vs: (sum(community[v] == community[u] for v in vs), sum(community[v] != community[u] for v in vs))
                    assert ((r.adopted_intra, r.adopted_inter), (r.observable_intra, r.observable_inter)) == (split(frozen), split(shown))
                    assert r.already_adopted == (log.get((root, u), 99) < k)
                    i, j = split(shown)
                    assert r.should_attempt == (i + 0.5 * j > 0.25 * len(near[u]) and not r.already_adopted)
    assert len(states) == sum(1 for (u, root, k), r in held.items() if r.timestep == k)


@pytest.mark.parametrize("seed", [0])
def test_forest_over_batches_equals_the_full_run(spark, rows_of, seed):
    """Parents that come late, never, or in a circle; after each batch the roots are those of all posts so far."""
    rng = random.Random(seed)
    parent = {i: rng.choice([None, rng.randrange(i), rng.randrange(i)]) if i else None for i in range(60)}
    parent |= {i: i - 1 for i in range(60, 140)}  # a long chain
    parent |= {200: 201, 201: 202, 202: 200, 203: 202, 204: 999, 205: 204, 206: 205}  # a circle, what leads into it, an absent post
    order = list(parent)
    rng.shuffle(order)
    schema = "post_id bigint, user_id bigint, original_post_id bigint"
    rooted = spark.createDataFrame([], "post_id bigint, user_id bigint, root_post_id bigint, root_author_id bigint, depth bigint")
    waiting = spark.createDataFrame([], "post_id bigint, user_id bigint, ptr bigint, hops bigint, error string")
    so_far = []
    for k in range(3):
        rows = [(i, i % 7, parent[i]) for i in order[k * 49 : (k + 1) * 49]]
        so_far += rows
        new, waiting = hierarchy.extend_forest(rooted, waiting, spark.createDataFrame(rows, schema))
        new, waiting = hierarchy.cut(new), hierarchy.cut(waiting)
        rooted = rooted.unionByName(new)
        full = spark.createDataFrame(so_far, schema)
        assert rows_of(rooted, "post_id", "root_post_id", "root_author_id", "depth") == rows_of(hierarchy.post_roots(full), "post_id", "root_post_id", "root_author_id", "depth")
        wrong = hierarchy.resolve_chains(full).where("error is not null")
        # a post that leads into a circle is told apart only by where its chain ended
        assert rows_of(waiting, "post_id") == rows_of(wrong, "post_id")
    assert len(so_far) == len(parent)
