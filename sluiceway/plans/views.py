"""Log tables derived from the driver tables, as lazily planned views.

The fact tables other queries start from (roots, impressions, actions, decision
snapshots) are stored once per session in the shared folder, as a deployment stores
its own logs, and read back with column pruning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ordered import prefix_scan
from ..functions import text as tx
from ..functions.scalar import choice_id, decision_id, mapped_action, trace_target
from ..functions.skew import lookup
from ..operators import choices, exposure, hierarchy, threshold
from ..session import shared_dir, tune

CREATED_BASE = 1_000_000_000_000
SEED, OMEGA_INTRA, OMEGA_INTER = 7, 0.65, 0.30
PROFILES = ("verifier", "benign-sharer", "contextualizer", "cautious", "balanced")
GRID = ((0.2, 1.0), (0.4, 0.8), (0.6, 0.6), (0.8, 0.4), (1.0, 0.2))
_STORED: dict[tuple[str, str], Logs] = {}


def logs(spark: SparkSession, sf_dir: str) -> Logs:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _STORED:
        _STORED[key] = Logs(tune(spark), key[1])
    return _STORED[key]


def second_post(refresh: Column, first: Column, n: Column) -> Column:
    """The other post of a feed: any of the ``n`` seeded posts but the first."""
    return (first + 1 + refresh % (n - 1)) % n


def with_context(actions: DataFrame, users: DataFrame, legal: DataFrame) -> DataFrame:
    """``actions`` with the community of the user and the legal choices, null where there are none.

    What is looked up meets on ids alone, so the wide rows are joined once, however large ``users`` is. A user listed
    several times gives each action as often. ``legal``: rowid (unique), legal.
    """
    ids = actions.select("rowid", "user_id").distinct().join(users, "user_id", "left").join(legal, "rowid", "left")
    ids = ids.select(F.col("rowid").alias("__row"), F.col("user_id").alias("__user"), "community", "legal")
    own = F.col("rowid").eqNullSafe(F.col("__row")) & F.col("user_id").eqNullSafe(F.col("__user"))
    return actions.join(ids, own).drop("__row", "__user")


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Derive the facts anew at the next query, after the tables have changed."""
    _STORED.pop((spark.sparkContext.applicationId, sf_dir.rstrip("/")), None)


class Logs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, object] = {}

    # ---- driver tables ----
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def store(self, name: str, df: DataFrame) -> str:
        """Write a derived table to the shared folder and return its path."""
        tag = hashlib.sha256(self.dir.encode()).hexdigest()[:12]
        path = f"{shared_dir(self.spark)}/sluiceway-{self.spark.sparkContext.applicationId}/{tag}/{name}"
        df.write.mode("overwrite").parquet(path)
        return path

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        return self.spark.read.parquet(self.store(name, df))

    def derived(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several queries read: made by the first of them, stored, and read back."""
        return self.once(name, lambda: self._store(name, make()))

    def once(self, name: str, make: Callable[[], object]):
        """What several queries of a session share; the first of them makes it."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @cached_property
    def n_users(self) -> Column:
        return self.table("customer").agg(F.count(F.lit(1))).scalar()

    @cached_property
    def n_posts(self) -> Column:
        return self.table("documents").agg(F.count(F.lit(1))).scalar()

    # ---- dimensions ----
    @cached_property
    def users(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
        return (
            self.table("customer")
            .select("c_custkey", "c_nationkey")
            .join(nation, "c_nationkey")
            .select(
                F.col("c_custkey").alias("user_id"),
                F.concat(F.lit("community-"), F.col("n_regionkey").cast("string")).alias("community"),
            )
        )

    @cached_property
    def follow(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("follower_id"),
            ((F.col("o_orderkey") * 7 + 3) % self.n_users).alias("followee_id"),
        )

    # ---- action log ----
    @cached_property
    def trace(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        action = (
            F.when(F.col("event_type") == "view", "refresh")
            .when(F.col("event_type") == "click", "repost")
            .when(F.col("event_type") == "purchase", "quote_post")
            .when(F.col("event_type") == "error", "report_post")
            .when(F.col("event_type") == "signup", "do_nothing")
        )
        base = self.table("events").select(
            F.col("event_id").alias("rowid"),
            "user_id",
            F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("timestep"),
            action.alias("action"),
            k.alias("k"),
            "ts",
        )
        row, k2 = F.col("rowid"), second_post(F.col("rowid"), F.col("k"), self.n_posts)
        created = (F.lit(CREATED_BASE) + row).cast("string")
        ks = F.col("k").cast("string")
        info = (
            F.when((F.col("action") == "refresh") & (row % 29 == 0),
                   F.lit('{"posts":[],"message":"No posts passed exposure policy."}'))
            .when((F.col("action") == "refresh") & (row % 31 == 0), F.lit('{"posts":[]}'))
            .when(F.col("action") == "refresh",
                  F.concat(F.lit('{"posts":[{"post_id":'), ks, F.lit('},{"post_id":'), k2.cast("string"), F.lit("}]}")))
            .when(F.col("action") == "repost",
                  F.concat(F.lit('{"reposted_id":'), ks, F.lit(',"new_post_id":'), created, F.lit("}")))
            .when(F.col("action") == "quote_post",
                  F.concat(F.lit('{"quoted_id":'), ks, F.lit(',"new_post_id":'), created, F.lit("}")))
            .when(F.col("action") == "report_post",
                  F.concat(F.lit('{"post_id":'), ks, F.lit(',"report_id":'), row.cast("string"), F.lit("}")))
            .otherwise(F.lit("{}"))
        )
        return base.withColumn("info", info)

    @cached_property
    def run_trace(self) -> DataFrame:
        """The action log with the run of each user."""
        return self.trace.withColumn("run_id", F.concat(F.lit("run-"), (F.col("user_id") % 4).cast("string")))

    @cached_property
    def post(self) -> DataFrame:
        """Documents as posts, plus one post per repost or quote of the action log."""
        d, n = F.col("doc_id"), self.n_users
        parent = F.when(d % 5 != 0, F.floor(d / 2).cast("bigint"))
        seeded = self.table("documents").select(
            d.alias("post_id"),
            ((d * 17) % n).alias("user_id"),
            parent.alias("original_post_id"),
            F.when((d % 5 != 0) & (d % 7 == 0), F.col("text")).alias("quote_content"),
            F.coalesce("text", F.lit("")).alias("content"),
            ((d * 13) % 50).alias("num_likes"),
            ((d * 3) % 7).alias("num_dislikes"),
            ((d * 5) % 11).alias("num_shares"),
            ((d * 11) % 6).alias("num_reports"),
            (d % 30).alias("created_at"),
        )
        r = F.col("rowid")
        created = self.trace.where(F.col("action").isin("repost", "quote_post")).select(
            (F.lit(CREATED_BASE) + r).alias("post_id"),
            "user_id",
            F.col("k").alias("original_post_id"),
            F.when(F.col("action") == "quote_post", F.concat(F.lit("quote "), r.cast("string"))).alias("quote_content"),
            F.lit("").alias("content"),
            ((r * 13) % 50).alias("num_likes"),
            ((r * 3) % 7).alias("num_dislikes"),
            ((r * 5) % 11).alias("num_shares"),
            ((r * 11) % 6).alias("num_reports"),
            F.col("timestep").alias("created_at"),
        )
        return seeded.unionByName(created)

    @cached_property
    def post_risk(self) -> DataFrame:
        d = F.col("doc_id")
        labels = self.table("labels").select("doc_id", "toxic")
        unlabelled = F.when(d % 10 == 5, 1.0).when(d % 20 == 10, 0.5).otherwise(0.0)
        return (
            self.table("documents")
            .select("doc_id")
            .join(labels, "doc_id", "left")
            .select(
                d.alias("post_id"),
                F.when(F.col("toxic") == 1, 0.9).when(F.col("toxic") == 0, 0.0).otherwise(unlabelled).alias("risk_score"),
            )
        )

    @cached_property
    def labelled_risk(self) -> DataFrame:
        """Risk known for labelled posts only; tests the fail-closed path."""
        return self.table("labels").select(
            F.col("doc_id").alias("post_id"), F.when(F.col("toxic") == 1, 0.9).otherwise(0.0).alias("risk_score")
        )

    @cached_property
    def rec(self) -> DataFrame:
        return (
            self.trace.where("action = 'refresh'").select("user_id", F.col("k").alias("post_id")).distinct()
        )

    @cached_property
    def texts(self) -> DataFrame:
        docs = self.table("documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("text_id"), "text")
        conv = self.table("conversations").select(
            F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("text_id"),
            "text",
        )
        return docs.unionByName(conv)

    # ---- stored facts ----
    @cached_property
    def roots(self) -> DataFrame:
        return self._store("roots", hierarchy.post_roots(self.post))

    @cached_property
    def adoptions(self) -> DataFrame:
        """(root_post_id, user_id, step): the first post of a user in the tree of a root."""
        return threshold.first_adoptions(self.roots, self.post)

    @cached_property
    def refreshes(self) -> DataFrame:
        """Who decided at which step: (user_id, timestep)."""
        return self.trace.where("action = 'refresh'").select("user_id", "timestep").distinct()

    @cached_property
    def candidates(self) -> DataFrame:
        """One row per refresh and post of its feed: (refresh_id, run_id, timestep, user_id, rank, post_id, ...)."""
        posts = F.from_json("info", "struct<posts:array<struct<post_id:bigint>>>")["posts"]["post_id"]
        return (
            self.trace.where("action = 'refresh'")
            .select("rowid", "user_id", "timestep", F.posexplode(posts).alias("rank", "post_id"))
            .select(
                F.col("rowid").alias("refresh_id"),
                F.concat(F.lit("run-"), (F.col("user_id") % 4).cast("string")).alias("run_id"),
                "timestep",
                "user_id",
                F.col("rank").cast("bigint").alias("rank"),
                "post_id",
                (F.lit(1.0) / (F.col("rank") + 1)).alias("base_score"),
                F.lit("recommendation").alias("source"),
            )
        )

    @cached_property
    def impressions(self) -> DataFrame:
        governed = exposure.govern(
            self.candidates,
            self.roots,
            self.users,
            self.post_risk,
            F.lit(OMEGA_INTRA),
            F.lit(OMEGA_INTER),
            seed=SEED,
        )
        return self._store(
            "impressions", governed.withColumn("impression_id", F.col("refresh_id") * 2 + F.col("rank"))
        )

    @cached_property
    def actions(self) -> DataFrame:
        """Decision traces with choice, latest feed (any timestep) and the last ten tokens."""
        feed = F.from_json("info", "struct<posts:array<struct<post_id:bigint>>,message:string>")
        is_refresh = F.col("action") == "refresh"
        # what is read from a row's info; the text itself stays out of the shuffles
        slim = self.trace.select(
            "rowid", "user_id", "timestep", "action", "k",
            F.when(is_refresh, F.struct(F.col("rowid").alias("refresh_id"), feed["posts"]["post_id"].alias("posts"),
                                        feed["message"].alias("message"))).alias("feed"),
            F.when(~is_refresh, trace_target("action", "info")).alias("target"),
            F.when(~is_refresh, F.get_json_object("info", "$.new_post_id").cast("bigint")).alias("created_post_id"),
        )
        token = F.concat(F.lit("trace-"), F.col("rowid").cast("string"), F.lit(":"), F.col("action"))
        linked = prefix_scan(slim, ["user_id"], "rowid", lasts={"last_feed": F.col("feed")}, trails={"history": (token, 10)})
        act, target = mapped_action("action"), F.col("target")
        return self._store(
            "actions",
            linked.where(~is_refresh).select(
                "rowid",
                "user_id",
                "timestep",
                F.col("action").alias("trace_action"),
                act.alias("action"),
                target.alias("target_post_id"),
                choice_id(act, target).alias("choice"),
                "created_post_id",
                F.col("last_feed")["refresh_id"].alias("refresh_id"),
                F.coalesce(F.col("last_feed")["posts"], F.array().cast("array<bigint>")).alias("visible"),
                F.col("last_feed")["message"].alias("feed_message"),
                "history",
                "k",
            ),
        )

    @cached_property
    def derivations(self) -> DataFrame:
        """(user_id, target_post_id, rowid): created posts found in the post table."""
        made = self.actions.where("created_post_id is not null").select("rowid", F.col("created_post_id").alias("post_id"))
        posts = self.post.select("post_id", "user_id", F.col("original_post_id").alias("target_post_id"))
        return made.join(posts, "post_id").select("user_id", "target_post_id", "rowid")

    @cached_property
    def reports(self) -> DataFrame:
        return self.actions.where("action = 'report'").select("user_id", "target_post_id", "rowid")

    @cached_property
    def post_kind(self) -> DataFrame:
        """Per post its root and whether it is a pure repost."""
        kind = self.post.select(
            "post_id", (F.col("original_post_id").isNotNull() & F.col("quote_content").isNull()).alias("is_repost")
        )
        return kind.join(self.roots.select("post_id", "root_post_id"), "post_id")

    @cached_property
    def snapshots(self) -> DataFrame:
        """Decision snapshots: every action with its as-of legal choices."""
        a = self.actions
        legal = choices.legal_asof(
            a.select("rowid", "user_id", "visible"), self.post_kind, self.derivations, self.reports
        )
        run_id = F.concat(F.lit("run-"), (F.col("user_id") % 4).cast("string"))
        profiles = F.array(*[F.lit(p) for p in PROFILES])
        snap = (
            with_context(a, self.users, legal)
            .select(
                decision_id(run_id, F.col("timestep"), F.col("user_id"), F.col("rowid")).alias("decision_id"),
                run_id.alias("run_id"),
                "user_id",
                "timestep",
                F.col("rowid").alias("decision_sequence"),
                F.col("rowid").alias("action_trace_rowid"),
                "action",
                "target_post_id",
                F.col("choice").alias("selected_choice_id"),
                "refresh_id",
                "visible",
                "feed_message",
                F.coalesce("legal", F.array(F.lit("ignore"))).alias("legal"),
                "history",
                "community",
                F.get(profiles, (F.col("user_id") % 5).cast("int")).alias("profile"),
                F.when(F.col("rowid") % 11 == 0, "failed").otherwise("succeeded").alias("status"),
                "k",
            )
        )
        return self._store("snapshots", snap)

    def with_features(self, df: DataFrame) -> DataFrame:
        """Attach what the audit reads from the rationale (the text of document k).

        Features are taken where the texts are, of documents that are asked for; only they travel to the decisions, never
        the texts.
        """
        asked = df.select("k").distinct()
        docs = self.table("documents").select(F.col("doc_id").alias("k"), "text").join(asked, "k", "left_semi")
        docs = tx.with_features(docs, "text").drop("text")
        return lookup(df, docs, "k", "left")

    # ---- experiment tables ----
    @cached_property
    def runs(self) -> DataFrame:
        return self._cells(F.col("l_linenumber") % 5, "baseline")

    @cached_property
    def grid_runs(self) -> DataFrame:
        cells = self._cells(F.col("l_partkey") % 5, "pair")
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in GRID])
        p = F.get(pairs, F.col("pair").cast("int"))
        return cells.select("*", p["a"].alias("omega_intra"), p["b"].alias("omega_inter"))

    def _cells(self, group: Column, name: str) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(
                F.col("l_returnflag").alias("condition"),
                group.cast("bigint").alias(name),
                (F.col("l_suppkey") % 10).alias("seed"),
            )
            .agg(
                F.count(F.lit(1)).cast("double").alias("exposures"),
                F.count_if(F.col("l_discount") > 0.05).cast("double").alias("reposts"),
                F.round(F.avg("l_tax"), 9).alias("coverage"),
                F.round(F.avg("l_discount"), 9).alias("benign_loss"),
                F.round(F.sum("l_quantity") / 100, 6).alias("cost"),
                F.round(F.avg((F.col("l_quantity") % 10) / 10), 9).alias("measured_mu"),
                F.count_if(F.col("l_tax") > 0.04).cast("double").alias("cascade_size"),
            )
        )
