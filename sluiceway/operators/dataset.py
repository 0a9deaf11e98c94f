"""Decision datasets: construction, reconstruction, validation and binding checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..functions.scalar import choice_action, choice_error, choice_target, mapped_action, trace_target, choice_id
from ..functions.skew import broadcast_limit, is_small, lookup
from ..session import cut
from .choices import legal_asof
from .linking import unique_refresh_match

# ---- fixed values -------------------------------------------------------
PROMPT = (
    "Choose one action and return only strict JSON with keys action, "
    "confidence, reason. Allowed actions: repost, quote, report, ignore.\n"
)
PROMPT_FIELDS = (
    "behavior_history", "community", "feed_post", "legal_choice_ids", "neighbor_interactions", "platform_notice", "user_profile",
)
RESULT_KEYS = ("new_post_id", "quoted_id", "reposted_id", "report_id")
HISTORY_TOKEN = r"^trace-(\d+):[a-z_]+$"
FAILURE_PATTERN = "^[a-z0-9_]{1,64}$"
REJECTS = ("choice is not legal", "action trace does not exist", "action trace does not match", "failure category is not a stable name")
NO_LONGER_PENDING = "decision is missing or no longer pending"
PROVENANCES = ("decision_snapshot", "legacy_refresh_trace_reconstruction")
NOT_UNIQUE = "legacy_refresh_match_is_not_unique"
NO_LABEL = "teacher_sample_missing"
NOT_LEGAL = "recorded choice is absent from reconstructed legal choices"
NOT_VISIBLE = "recorded target is absent from reconstructed feed"
LABEL_DISAGREES = "teacher action label disagrees with the trace"
EMPTY_FEED = "empty feed has no explicit reason"
UNUSED_LABEL = "teacher sample has no uniquely reconstructed decision"
MASK = -100
#: Exceptions are broadcast up to so many times the size other tables are.
EXCEPTIONS = 6
# -------------------------------------------------------------------------


def _keep(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _issue(test: Column, text: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(text))


def history_error(history, trace_rowid) -> Column:
    """True when a token is malformed or not strictly earlier than the trace row."""

    def bad(x: Column) -> Column:
        row = F.regexp_extract(x, HISTORY_TOKEN, 1)
        return (row == "") | (row.try_cast("bigint") >= trace_rowid)

    return F.exists(history, bad)


def same_multiset(a, b) -> Column:
    return F.array_sort(a) == F.array_sort(b)


# ---------------------------------------------------------------- lifecycle


def resolve_lifecycle(pending: DataFrame, outcomes: DataFrame, trace: DataFrame) -> DataFrame:
    """Final status of pending decisions from their proposed outcomes.

    ``pending``: decision_id, user_id, legal. ``outcomes``: decision_id, outcome
    (succeeded or failed), choice, action_trace_rowid, failure_category. ``trace``:
    rowid, user_id, action. An outcome that breaks a rule leaves the decision pending
    with a reject reason; so does a second outcome for the same decision.
    """
    counts = outcomes.groupBy("decision_id").agg(F.count(F.lit(1)).alias("outcomes"), F.min_by(F.struct(*[c for c in outcomes.columns if c != "decision_id"]), F.coalesce("action_trace_rowid", F.lit(-1))).alias("o"))
    rows = pending.join(counts, "decision_id", "left").select(
        *[c for c in pending.columns], "outcomes", F.col("o.*")
    )
    bound = trace.select(F.col("rowid").alias("action_trace_rowid"), F.col("user_id").alias("trace_user"), F.col("action").alias("trace_action"))
    rows = rows.join(bound, "action_trace_rowid", "left")
    won, lost = F.col("outcome") == "succeeded", F.col("outcome") == "failed"
    reject = (
        F.when(F.col("outcomes") > 1, "more than one outcome")
        .when(won & ~F.coalesce(F.array_contains("legal", F.col("choice")), F.lit(False)), REJECTS[0])
        .when(won & F.col("trace_user").isNull(), REJECTS[1])
        .when(won & ((F.col("trace_user") != F.col("user_id")) | ~mapped_action("trace_action").eqNullSafe(choice_action("choice"))),
              REJECTS[2])
        .when(lost & ~F.coalesce(F.col("failure_category").rlike(FAILURE_PATTERN), F.lit(False)), REJECTS[3])
    )
    rows = rows.withColumn("reject_reason", reject)
    status = F.when(F.col("outcome").isNull() | F.col("reject_reason").isNotNull(), "pending").otherwise(F.col("outcome"))
    return rows.select("decision_id", "user_id", status.alias("status"), "reject_reason")


def status_counts(snapshots: DataFrame) -> DataFrame:
    """Snapshots per status, zero-filled over the three statuses."""
    names = ("failed", "pending", "succeeded")
    counts = snapshots.agg(*[F.count_if(F.col("status") == s).alias(s) for s in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("count")) for s in names])))


# ---------------------------------------------------------------- native examples


def _unusual_traces(done: DataFrame, trace: DataFrame) -> DataFrame:
    """(action_trace_rowid, trace_user, trace_kind, traced, dup_row): the trace rows a check can fault, null columns where there is none.

    Left out is the usual case: a trace row with its own id, named by one decision of the same user and
    choice. Only ids, users and choices are shuffled for it.
    """
    kind = mapped_action("action")
    bound = trace.select(
        F.col("rowid").alias("action_trace_rowid"), F.col("user_id").alias("trace_user"), kind.alias("trace_kind"),
        choice_id(kind, trace_target("action", "info")).alias("traced"),
    )
    named = done.where("action_trace_rowid is not null").groupBy("action_trace_rowid").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("user_id", "selected_choice_id")).alias("one")
    )
    copies = F.count(F.lit(1)).over(W.partitionBy("action_trace_rowid"))
    rows = named.join(bound, "action_trace_rowid", "left").withColumn("copies", copies)
    choice = F.col("one")["selected_choice_id"]
    usual = (
        (F.col("n") == 1) & (F.col("copies") == 1) & (F.col("trace_user") == F.col("one")["user_id"])
        & F.col("trace_kind").eqNullSafe(choice_action(choice)) & F.col("traced").eqNullSafe(choice)
    )
    return rows.where(~F.coalesce(usual, F.lit(False))).select(
        "action_trace_rowid", "trace_user", "trace_kind", "traced", (F.col("n") > 1).alias("dup_row")
    )


def _few(df: DataFrame) -> DataFrame:
    """Exceptions, stored to learn their size: broadcast unless there are very many."""
    stored = cut(df)
    return F.broadcast(stored) if is_small(stored, EXCEPTIONS * broadcast_limit(stored)) else stored


def native_examples(snapshots: DataFrame, trace: DataFrame) -> DataFrame:
    """Examples of all succeeded snapshots with their ``errors``; valid rows have none.

    ``snapshots``: decision_id, user_id, timestep, decision_sequence, feed_ids (posts of
    the feed), visible, legal, history, feed_message, community, profile, rationale,
    selected_choice_id, action_trace_rowid, status.

    The wide rows meet only what is wrong with their ids and traces, so they stay where they are as long as that is little.
    """
    done = snapshots.where("status = 'succeeded'")
    # rows sharing an id are few: their keys are found by a count, not a window
    twice_id = done.groupBy("decision_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("decision_id", F.lit(True).alias("dup_id"))
    rows = done.join(_few(_unusual_traces(done, trace)), "action_trace_rowid", "left").join(_few(twice_id), "decision_id", "left")
    choice, target = F.col("selected_choice_id"), choice_target("selected_choice_id")
    named, unusual = F.col("action_trace_rowid").isNotNull(), F.col("dup_row").isNotNull()
    faulty = unusual & F.col("trace_user").isNotNull()
    errors = _keep(
        _issue(choice.isNull() | ~named | F.col("rationale").isNull(), "succeeded fields are missing"),
        _issue(F.size(F.array_distinct("feed_ids")) != F.size("feed_ids"), "feed contains duplicate posts"),
        _issue(~same_multiset("feed_ids", "visible"), "feed and visible posts disagree"),
        _issue(~F.array_contains("legal", choice), "selected choice is not legal"),
        F.concat(F.lit("selected choice: "), choice_error("selected_choice_id")),
        _issue(target.isNotNull() & ~F.array_contains("visible", target), "selected target was not visible"),
        _issue(unusual & F.col("trace_user").isNull(), "action trace does not exist"),
        _issue(faulty & ((F.col("trace_user") != F.col("user_id")) | ~F.col("trace_kind").eqNullSafe(choice_action(choice))),
               "action trace binding is inconsistent"),
        _issue(faulty & ~F.col("traced").eqNullSafe(choice), "selected choice disagrees with the trace"),
        _issue(history_error("history", F.col("action_trace_rowid")), "history holds the current or a later trace"),
        _issue(tx.has_key("rationale"), "rationale contains a credential-like pattern"),
        _issue((F.size("feed_ids") == 0) & (F.coalesce("feed_message", F.lit("")) == ""), "empty feed without a reason"),
        _issue(F.col("dup_id"), "decision id is not unique"),
        _issue(F.col("dup_row"), "action trace is bound twice"),
    )
    return rows.withColumn("errors", errors).select(*example_columns(), "errors")


def example_columns() -> list[Column]:
    """The twenty fields of an example, from snapshot columns."""
    posts = F.transform("feed_ids", lambda x: F.struct(x.alias("post_id")))
    with_message = F.to_json(F.struct(F.col("feed_message").alias("message"), posts.alias("posts")))
    none = F.array().cast("array<string>")
    return [
        F.col("decision_id").alias("sample_id"),
        F.col("action_trace_rowid"),
        F.col("decision_sequence"),
        F.col("timestep").alias("decision_timestep"),
        F.col("profile").alias("user_profile"),
        F.col("community"),
        with_message.alias("feed_post"),
        none.alias("neighbor_interactions"),
        F.col("history").alias("behavior_history"),
        F.lit("").alias("platform_notice"),
        F.struct(choice_action("selected_choice_id").alias("action"), F.lit(1.0).alias("confidence"), F.col("rationale").alias("reason")).alias("label"),
        F.lit("teacher_synthetic").alias("label_source"),
        F.col("visible").alias("visible_post_ids"),
        F.col("legal").alias("legal_choice_ids"),
        F.col("selected_choice_id"),
        F.lit("decision_snapshot").alias("provenance"),
        F.lit(True).alias("action_label_eligible"),
        F.lit(True).alias("rationale_training_eligible"),
        F.lit("unreviewed").alias("rationale_quality_status"),
        F.when(F.size("feed_ids") == 0, F.col("feed_message")).alias("feed_empty_reason"),
    ]


def export_status(snapshots: DataFrame) -> DataFrame:
    """One row: may the snapshots be exported, and is the export degraded."""
    pending, failed = F.count_if(F.col("status") == "pending"), F.count_if(F.col("status") == "failed")
    out = snapshots.agg(pending.alias("pending"), failed.alias("failed"), F.count_if(F.col("status") == "succeeded").alias("succeeded"))
    return out.withColumn("export", F.when(F.col("pending") > 0, "blocked").when(F.col("failed") > 0, "degraded").otherwise("success"))


# ---------------------------------------------------------------- reconstruction


def _settle_reports(reports: DataFrame) -> DataFrame:
    """The first report of each (user, post); nothing else stands against a report."""
    first = reports.groupBy("user_id", "target_post_id").agg(F.min("rowid").alias("__first"))
    found = reports.join(first, ["user_id", "target_post_id"], "left")
    return found.where(F.coalesce("__first", "rowid") == F.col("rowid")).select(*reports.columns)


def _first_by_slot(derivations: DataFrame) -> DataFrame:
    """(user_id, slot, at): the earliest derivation of each post a user derived from."""
    return derivations.where("slot is not null").groupBy("user_id", "slot").agg(F.min("rowid").alias("at"))


def _follow(pointers: DataFrame) -> DataFrame:
    """Pointer doubling: each row's pointer leads to the first decision that has none; ``odd``: an odd number of steps away."""
    while True:
        ahead = pointers.select(F.col("rowid").alias("via"), F.col("via").alias("to"), F.col("odd").alias("more"))
        joined = cut(pointers.join(ahead, "via", "left"))
        found = F.col("to").isNotNull()
        pointers = joined.select("rowid", F.coalesce("to", "via").alias("via"), F.when(found, F.col("odd") != F.col("more")).otherwise(F.col("odd")).alias("odd"))
        if joined.where(found).isEmpty():
            return pointers


def settle(decisions: DataFrame, kinds: DataFrame) -> DataFrame:
    """Decisions accepted when each is judged against the accepted ones before it.

    ``decisions``: rowid, user_id, action, target_post_id, created_parent (parent of the
    post it created, NULL when none counts). A repost falls to an accepted earlier
    derivation of its target, or of the root of a pure repost; a report to an accepted
    earlier report of the same post; nothing else falls.

    A round looks at the open reposts. One falls if a derivation accepted already stands before
    it; it is accepted if no open repost could derive its posts before it; and if exactly one
    could, its fate is the opposite of that one's. These opposites form chains, which pointer doubling
    follows to a settled end: a chain of any length takes one round and the logarithm of its
    length in joins. Only a repost with two or more open ones before it waits for the next
    round, so there are as many rounds as such reposts depend on each other.
    """
    keep = decisions.columns
    is_repost = F.col("action") == "repost"
    reposts = lookup(
        decisions.where(is_repost), kinds.select(F.col("post_id").alias("target_post_id"), "root_post_id", "is_repost"), "target_post_id", "left"
    )
    root = F.when(F.col("is_repost") & (F.col("root_post_id") != F.col("target_post_id")), F.col("root_post_id"))
    open_ = cut(reposts.select(*keep, root.alias("__root")))
    others = cut(
        decisions.where(~is_repost & (F.col("action") != "report")).unionByName(_settle_reports(decisions.where("action = 'report'")))
        .unionByName(decisions.where("action is null"))
    )
    accepted = others
    first = cut(_first_by_slot(others.select("user_id", F.col("created_parent").alias("slot"), "rowid")))
    while not open_.isEmpty():
        # the two earliest open reposts of each post tell whether a later one has none, one or more before it
        earliest = W.partitionBy("user_id", "created_parent").orderBy("rowid")
        two = open_.where("created_parent is not null").select("user_id", "created_parent", "rowid").withColumn("__r", F.row_number().over(earliest)).where("__r <= 2")
        two = cut(two.groupBy("user_id", F.col("created_parent").alias("slot")).agg(F.min("rowid").alias("one"), F.max(F.when(F.col("__r") == 2, F.col("rowid"))).alias("two")))
        rows = open_
        for name, post in (("t", "target_post_id"), ("r", "__root")):
            rows = rows.join(first.select("user_id", F.col("slot").alias(post), F.col("at").alias(f"at_{name}")), ["user_id", post], "left")
            rows = rows.join(two.select("user_id", F.col("slot").alias(post), F.col("one").alias(f"one_{name}"), F.col("two").alias(f"two_{name}")), ["user_id", post], "left")

        def before(c: str) -> Column:
            return F.coalesce(F.col(c) < F.col("rowid"), F.lit(False))

        waits = sum((before(c).cast("int") for c in ("one_t", "two_t", "one_r", "two_r")), F.lit(0))
        verdict = F.when(before("at_t") | before("at_r"), "falls").when(waits == 0, "stands").when(waits == 1, "opposite").otherwise("waits")
        via = F.when(before("one_t"), F.col("one_t")).otherwise(F.col("one_r"))
        rows = cut(rows.select(*keep, "__root", verdict.alias("__verdict"), via.alias("__via")))
        chained = rows.where("__verdict = 'opposite'").select("rowid", F.col("__via").alias("via"), F.lit(True).alias("odd"))
        if not chained.isEmpty():
            ends = rows.where("__verdict <> 'opposite'").select(F.col("rowid").alias("via"), F.col("__verdict").alias("end"))
            fate = _follow(chained).join(ends, "via")
            stands = (F.col("end") == "stands") != F.col("odd")
            fate = fate.select("rowid", F.when(F.col("end") == "waits", "waits").when(stands, "stands").otherwise("falls").alias("__fate"))
            rows = cut(rows.join(fate, "rowid", "left").withColumn("__verdict", F.coalesce("__fate", "__verdict")).drop("__fate"))
        new = rows.where("__verdict = 'stands'").select(*keep)
        accepted = accepted.unionByName(new)
        made = new.select("user_id", F.col("created_parent").alias("slot"), "rowid")
        first = cut(first.withColumnRenamed("at", "rowid").unionByName(made).groupBy("user_id", "slot").agg(F.min("rowid").alias("at")).where("slot is not null"))
        open_ = cut(rows.where("__verdict = 'waits'").select(*keep, "__root"))
    return accepted.select(*keep)


def reconstruct_legacy(
    trace: DataFrame, actions: DataFrame, labels: DataFrame, posts: DataFrame, kinds: DataFrame, issues: DataFrame, users: DataFrame
) -> DataFrame:
    """Pre-decision contexts rebuilt from refresh and action traces, or why they cannot be.

    ``trace``: rowid, user_id, timestep, action. ``actions``: rowid, user_id, timestep,
    action, target_post_id, choice, created_post_id, visible and feed_message (of the
    latest refresh), history. ``labels``: sample_id, action, reason. ``posts``: post_id,
    user_id, original_post_id. ``issues``: sample_id, rationale_quality_status.
    """
    match = unique_refresh_match(trace).select("rowid", "candidates", "refresh_id")
    rows = actions.join(match, "rowid").withColumn("sample_id", F.concat(F.lit("trace-"), F.col("rowid").cast("string")))
    per = labels.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.min("action").alias("label"), F.min("reason").alias("label_reason"))
    rows = rows.join(per, "sample_id", "left")
    unique = F.col("candidates") == 1
    visible = F.coalesce(F.array_contains("visible", F.col("target_post_id")), F.col("target_post_id").isNull())
    agrees = F.coalesce(F.col("label") == F.col("action"), F.lit(False))
    empty = (F.size("visible") == 0) & (F.coalesce("feed_message", F.lit("")) == "")
    rows = cut(
        rows.withColumn("sound", F.col("n").isNotNull() & unique & visible & agrees & ~empty)
        .withColumn("visible_ok", visible).withColumn("label_ok", agrees).withColumn("empty_bad", empty)
    )
    made = posts.select(F.col("post_id").alias("created_post_id"), F.col("user_id").alias("maker"), F.col("original_post_id").alias("parent"))
    sound = rows.where("sound").select("rowid", "user_id", "action", "target_post_id", "created_post_id")
    sound = lookup(sound, made, "created_post_id", "left").select(
        "rowid", "user_id", "action", "target_post_id", F.when(F.col("maker") == F.col("user_id"), F.col("parent")).alias("created_parent")
    )
    accepted = settle(sound, kinds)
    derivations = accepted.where("created_parent is not null").select("user_id", F.col("created_parent").alias("target_post_id"), "rowid")
    reports = accepted.where("action = 'report'").select("user_id", "target_post_id", "rowid")
    context = rows.where((F.col("candidates") == 1) & F.col("n").isNotNull())
    legal = legal_asof(context.select("rowid", "user_id", "visible"), kinds, derivations, reports)
    out = rows.join(legal, "rowid", "left").withColumn("legal", F.coalesce("legal", F.array(F.lit("ignore"))))
    out = out.join(issues, "sample_id", "left")
    out = lookup(out, users.select("user_id", "community"), "user_id", "left")
    errors = _keep(
        _issue(~F.array_contains("legal", F.col("choice")), NOT_LEGAL),
        _issue(~F.col("visible_ok"), NOT_VISIBLE),
        _issue(~F.col("label_ok"), LABEL_DISAGREES),
    )
    reason = (
        F.when(F.col("n").isNull(), NO_LABEL)
        .when(F.col("candidates") != 1, NOT_UNIQUE)
        .when(F.size(errors) > 0, F.array_join(errors, "; "))
        .when(F.col("empty_bad"), EMPTY_FEED)
    )
    eligible = F.col("rationale_quality_status").isNull()
    out = out.withColumn("reason", reason).withColumn("rationale_training_eligible", eligible)
    return out.select(
        "sample_id", "rowid", "user_id", "timestep", "action", "refresh_id", F.col("choice").alias("selected_choice_id"),
        "visible", "legal", "history", "community", F.when(eligible, F.col("label_reason")).otherwise("").alias("label_reason"),
        F.coalesce("rationale_quality_status", F.lit("not_individually_verified")).alias("rationale_quality_status"),
        "rationale_training_eligible", "reason",
    )


def unused_labels(labels: DataFrame, reconstructed: DataFrame) -> DataFrame:
    """Label rows no reconstructed decision took up."""
    used = reconstructed.where("reason is null").select("sample_id")
    return labels.select("sample_id").distinct().join(used, "sample_id", "left_anti").withColumn("reason", F.lit(UNUSED_LABEL))


def label_source_errors(labels: DataFrame) -> DataFrame:
    """Label rows that make a source unusable: missing or repeated ids, credentials."""
    twice = labels.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(tx.has_key("reason")).alias("keys"))
    found = _keep(
        _issue(F.col("sample_id").isNull(), "sample id is missing"),
        _issue(F.col("sample_id").isNotNull() & (F.col("n") > 1), "sample id is not unique"),
        _issue(F.col("keys") > 0, "credential-like pattern"),
    )
    return twice.select("sample_id", F.explode(found).alias("error"))


# ---------------------------------------------------------------- validation


def validate_examples(examples: DataFrame) -> DataFrame:
    """(sample_id, error) rows; none means the dataset is valid."""
    # the feed is parsed twice: as an object for its keys, as posts for its ids
    keys = F.json_object_keys("feed_post")
    feed = F.from_json("feed_post", "struct<posts:array<struct<post_id:bigint>>>")
    ids = F.transform(feed["posts"], lambda p: p["post_id"])
    rows = examples.withColumn("keys", keys).withColumn("ids", ids)
    valid = F.col("keys").isNotNull() & F.col("ids").isNotNull() & ~F.exists("ids", lambda x: x.isNull())
    rows = rows.withColumn("feed_ok", F.coalesce(valid, F.lit(False)))
    choice, target = F.col("selected_choice_id"), choice_target("selected_choice_id")
    legal = F.coalesce(F.array_contains("legal_choice_ids", choice), F.lit(False))
    ok = F.col("feed_ok")
    found = _keep(
        _issue(F.col("decision_sequence").isNull(), "decision sequence is missing"),
        _issue(~F.col("provenance").isin(*PROVENANCES) | F.col("provenance").isNull(), "provenance is not explicit"),
        _issue(~ok, "feed is not a normalized object"),
        _issue(ok & ~same_multiset("ids", "visible_post_ids"), "visible posts disagree with the feed"),
        _issue(ok & (F.size("ids") == 0) & (F.coalesce("feed_empty_reason", F.lit("")) == ""), "empty feed has no reason"),
        _issue(ok & F.arrays_overlap("keys", F.array(*[F.lit(k) for k in RESULT_KEYS])), "feed contains action results"),
        _issue(ok & ~legal, "selected choice is not legal"),
        F.when(ok & legal & choice_error("selected_choice_id").isNotNull(), F.lit("selected choice is invalid")),
        _issue(ok & legal & target.isNotNull() & ~F.array_contains("ids", target), "selected target is not visible"),
        _issue(ok & legal & (choice_action(choice) != F.col("label")["action"]), "selected choice disagrees with the label"),
        _issue(ok & F.col("action_trace_rowid").isNull(), "action trace row is missing"),
        _issue(ok & history_error("behavior_history", F.col("action_trace_rowid")), "history holds the current or a later action"),
        _issue(ok & ~F.col("rationale_training_eligible") & (F.col("label")["reason"] != ""), "ineligible rationale text remains"),
        _issue(ok & tx.has_key(F.concat_ws(" ", "user_profile", "feed_post", "platform_notice", F.col("label")["reason"])), "credential-like pattern"),
    )
    per_row = rows.select("sample_id", F.explode(found).alias("error"))
    twice = examples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per_row.distinct().unionByName(twice.select("sample_id", F.lit("decision id is not unique").alias("error")))


def trace_binding_check(examples: DataFrame, trace: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(sample_id, error): each example has its own existing trace with the label's action,
    and native examples and succeeded snapshots are the same set."""
    bound = trace.select(F.col("rowid").alias("action_trace_rowid"), F.col("action").alias("trace_action"))
    twice = examples.where("action_trace_rowid is not null").groupBy("action_trace_rowid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = examples.select("sample_id", "action_trace_rowid", F.col("label")["action"].alias("label_action"))
    rows = rows.join(bound, "action_trace_rowid", "left").join(twice, "action_trace_rowid", "left")
    known = mapped_action("trace_action")
    found = _keep(
        _issue(F.col("action_trace_rowid").isNull(), "action trace row is not an integer"),
        _issue(F.col("n") > 1, "action trace row is used twice"),
        _issue(F.col("action_trace_rowid").isNotNull() & known.isNull(), "bound action trace is missing"),
        _issue(known != F.col("label_action"), "action label disagrees with the trace"),
    )
    issues = rows.select("sample_id", F.explode(found).alias("error")).distinct()
    # each side of the comparison is read once: one grouping instead of two differences of distinct rows
    native = examples.where("provenance = 'decision_snapshot'").select("sample_id", "action_trace_rowid", F.lit("e").alias("side"))
    done = snapshots.where("status = 'succeeded'").select(F.col("decision_id").alias("sample_id"), "action_trace_rowid", F.lit("s").alias("side"))
    sides = native.unionByName(done).groupBy("sample_id", "action_trace_rowid").agg(F.min("side").alias("first"), F.max("side").alias("last"))
    lone = F.when(F.col("first") == "e", "example without a succeeded snapshot").otherwise("succeeded snapshot without an example")
    apart = sides.where("first = last").select("sample_id", lone.alias("error"))
    return issues.unionByName(apart)


def dataset_validation(snapshots: DataFrame) -> DataFrame:
    """One row: feed consistency, trace binding rate, leaking and distinct ids."""
    done = F.col("status") == "succeeded"
    bound = done & F.col("action_trace_rowid").isNotNull()
    leaks = bound & history_error("history", F.col("action_trace_rowid"))
    out = snapshots.agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.count_if(done).alias("succeeded"),
        F.count_if(~done).alias("failed"),
        F.count_if(same_multiset("feed_ids", "visible")).alias("consistent"),
        F.count_if(bound).alias("bound"),
        F.count_if(leaks).alias("leaking"),
        F.countDistinct("decision_id").alias("distinct_ids"),
    )
    zero = F.lit(0.0)
    return out.select(
        "snapshots", "succeeded", "failed",
        F.coalesce(F.try_divide("consistent", "snapshots"), zero).alias("feed_consistency_rate"),
        F.coalesce(F.try_divide("bound", "succeeded"), zero).alias("trace_binding_rate"),
        "leaking", (F.col("leaking") == 0).alias("leakage_check_passed"), "distinct_ids",
        (F.col("distinct_ids") == F.col("snapshots")).alias("ids_unique"),
    )


def pairing_audit(units: DataFrame, rows: DataFrame, strategies: int) -> DataFrame:
    """Per condition: do all strategies start from the same rows?

    ``units``: condition, strategy. ``rows``: condition, strategy, kind, item. Every
    kind is reduced to a count and an order-free digest per unit, so no unit is
    collected; one distinct (count, digest) per kind means equal starts.
    """
    digest = F.conv(F.substring(F.md5(F.col("item")), 1, 12), 16, 10).cast("decimal(38,0)")
    per = rows.groupBy("condition", "strategy", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("d"))
    same = per.groupBy("condition", "kind").agg(
        F.count(F.lit(1)).alias("present"), F.countDistinct("n", "d").alias("versions")
    )
    count = units.distinct().groupBy("condition").agg(F.count(F.lit(1)).alias("strategies"))
    ok = same.join(count, "condition").groupBy("condition").agg(
        F.min("strategies").alias("strategies"),
        F.max("versions").alias("versions"),
        F.min(F.col("present") == F.col("strategies")).alias("complete"),
    )
    return ok.select(
        "condition", "strategies", ((F.col("strategies") == strategies) & (F.col("versions") == 1) & F.col("complete")).alias("paired")
    )


def feed_policy_consistency(decisions: DataFrame, impressions: DataFrame) -> DataFrame:
    """Per run: share of decisions whose visible posts are exactly the shown impressions of their step.

    The shown posts of a decision are counted and compared by membership instead of
    being collected: equal sets have the same size and no unmatched member.
    """
    shown = impressions.where("shown").groupBy("run_id", "user_id", "timestep", "post_id").agg(F.count(F.lit(1)).alias("copies"))
    totals = shown.groupBy("run_id", "user_id", "timestep").agg(F.sum("copies").alias("shown"))
    keys = ["run_id", "user_id", "timestep"]
    each = decisions.select("decision_id", *keys, F.explode("visible").alias("post_id"))
    hits = each.join(shown, [*keys, "post_id"]).groupBy("decision_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = decisions.join(totals, keys, "left").join(hits, "decision_id", "left")
    zero, size = F.lit(0), F.size("visible")
    same = (F.coalesce("shown", zero) == size) & (F.coalesce("hits", zero) == size)
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(same).alias("consistent"), F.avg(same.cast("double")).alias("consistency_rate")
    )


def refresh_accounting(decisions: DataFrame, trace: DataFrame) -> DataFrame:
    """Per run: refresh traces against decisions; extra refreshes break the one-to-one rule."""
    refreshes = trace.where("action = 'refresh'").groupBy("run_id").agg(F.count(F.lit(1)).alias("refreshes"))
    made = decisions.groupBy("run_id").agg(F.count(F.lit(1)).alias("decisions"))
    out = made.join(refreshes, "run_id", "full_outer")
    d, r = F.coalesce("decisions", F.lit(0)), F.coalesce("refreshes", F.lit(0))
    return out.select("run_id", d.alias("decisions"), r.alias("refreshes"), F.greatest(r - d, F.lit(0)).alias("extra_refreshes"), (d == r).alias("one_to_one"))


def range_violations(rows: DataFrame, key: str, unit: list[str], non_negative: list[str] = (), not_null: list[str] = ()) -> DataFrame:
    """(key, rule) for values outside [0, 1], below zero or missing."""
    found = _keep(
        *[_issue(~F.col(c).between(0, 1), f"{c} outside [0, 1]") for c in unit],
        *[_issue(F.col(c) < 0, f"{c} is negative") for c in non_negative],
        *[_issue(F.col(c).isNull(), f"{c} is missing") for c in not_null],
    )
    return rows.select(key, F.explode(found).alias("rule"))


# ---------------------------------------------------------------- prompts and features


def _json_text(c: Column) -> Column:
    """One JSON string literal."""
    packed = F.to_json(F.array(c))
    return F.substring(packed, F.lit(2), F.length(packed) - 2)


def _json_list(name: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(name, _json_text), ", "), F.lit("]"))


def prompt() -> Column:
    """Instruction and the seven input fields as JSON; no label field can enter."""
    lists = ("behavior_history", "legal_choice_ids", "neighbor_interactions")
    parts: list[Column] = []
    for i, name in enumerate(PROMPT_FIELDS):
        value = _json_list(name) if name in lists else _json_text(F.coalesce(name, F.lit("")))
        parts += [F.lit(("" if i == 0 else ", ") + f'"{name}": '), value]
    return F.concat(F.lit(PROMPT), F.lit("{"), *parts, F.lit("}"))


def masked_features(prompt_ids: Column, target_ids: Column, eos: int | None, max_length: int) -> dict[str, Column]:
    """Input ids and labels: the target is kept, the prompt loses its left end, its labels are masked."""
    target = F.concat(target_ids, F.array(F.lit(eos))) if eos is not None else target_ids
    target = F.slice(target, 1, max_length)
    room = F.greatest(F.lit(0), F.lit(max_length) - F.size(target))
    take = F.least(room, F.size(prompt_ids))
    kept = F.slice(prompt_ids, F.size(prompt_ids) - take + 1, take)
    ids = F.concat(kept, target)
    return {
        "input_ids": ids,
        "attention_mask": F.array_repeat(F.lit(1), F.size(ids)),
        "labels": F.concat(F.array_repeat(F.lit(MASK), F.size(kept)), target),
    }


def word_ids(text: Column, special: bool, vocabulary: int | None = None) -> Column:
    """Ids of whitespace-separated words, from 2 on; 1 starts a prompt.

    With a ``vocabulary`` size the id is a hash of the word, else its position.
    """
    own = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    if vocabulary:
        hashed = F.transform(own, lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % vocabulary) + 2)
        return F.concat(F.array(F.lit(1)), hashed) if special else hashed
    words = F.size(own)
    ids = F.when(words > 0, F.sequence(F.lit(2), words + 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(1)), ids) if special else ids


