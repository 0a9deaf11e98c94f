"""Queries B13, B14, I1-I9, A6, A7: decision datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset
from .q_choices import GAPS
from .registry import query
from .views import Logs

KEY = "k" * 16

# decision snapshots with every kind of defect
DSNAP = f"""SELECT decision_id, run_id, user_id, timestep, s AS decision_sequence, visible AS feed_ids,
    CASE WHEN s % 53 = 0 THEN visible || [9999::BIGINT] ELSE visible END AS visible, legal,
    CASE WHEN s % 61 = 0 THEN history || ['trace-' || (s + 1) || ':refresh'] WHEN s % 127 = 0 THEN history || ['trace-x:refresh'] ELSE history END AS history,
    feed_message, community, profile,
    CASE WHEN s % 73 = 0 THEN NULL WHEN s % 79 = 0 THEN 'see hf' || '_{KEY}' ELSE 'because of trace ' || s END AS rationale,
    CASE WHEN s % 59 = 0 THEN 'like:3' ELSE selected_choice_id END AS selected_choice_id,
    CASE WHEN s % 67 = 0 THEN NULL WHEN s % 71 = 0 THEN s + 1 ELSE s END AS action_trace_rowid,
    CASE WHEN s % 83 = 0 THEN 'pending' ELSE status END AS status
  FROM (SELECT *, decision_sequence AS s FROM snapshots)"""


def dsnap(t: Logs):
    s = F.col("decision_sequence")
    later = F.concat(F.lit("trace-"), (s + 1).cast("string"), F.lit(":refresh"))
    return t.snapshots.select(
        "decision_id", "run_id", "user_id", "timestep", "decision_sequence", F.col("visible").alias("feed_ids"),
        F.when(s % 53 == 0, F.concat("visible", F.array(F.lit(9999).cast("bigint")))).otherwise(F.col("visible")).alias("visible"),
        "legal",
        F.when(s % 61 == 0, F.concat("history", F.array(later))).when(s % 127 == 0, F.concat("history", F.array(F.lit("trace-x:refresh"))))
        .otherwise(F.col("history")).alias("history"),
        "feed_message", "community", "profile",
        F.when(s % 73 == 0, F.lit(None)).when(s % 79 == 0, "see hf" + "_" + KEY)
        .otherwise(F.concat(F.lit("because of trace "), s.cast("string"))).alias("rationale"),
        F.when(s % 59 == 0, "like:3").otherwise(F.col("selected_choice_id")).alias("selected_choice_id"),
        F.when(s % 67 == 0, F.lit(None)).when(s % 71 == 0, s + 1).otherwise(s).alias("action_trace_rowid"),
        F.when(s % 83 == 0, "pending").otherwise(F.col("status")).alias("status"),
    )


BAD_HISTORY = r"len(list_filter(history, lambda x: regexp_extract(x, '^trace-(\d+):[a-z_]+$', 1) = '' OR try_cast(regexp_extract(x, '^trace-(\d+):[a-z_]+$', 1) AS BIGINT) >= action_trace_rowid)) > 0"
TARGET = "try_cast(trim(split_part(selected_choice_id, ':', 2)) AS BIGINT)"
NATIVE = rf"""SELECT d.*, list_filter([
    CASE WHEN selected_choice_id IS NULL OR action_trace_rowid IS NULL OR rationale IS NULL THEN 'succeeded fields are missing' END,
    CASE WHEN list_sort(feed_ids) <> list_sort(visible) THEN 'feed and visible posts disagree' END,
    CASE WHEN NOT list_contains(legal, selected_choice_id) THEN 'selected choice is not legal' END,
    CASE WHEN selected_choice_id = 'like:3' THEN 'selected choice: unsupported action' WHEN {TARGET} <= 0 THEN 'selected choice: target is not positive' END,
    CASE WHEN {TARGET} IS NOT NULL AND NOT list_contains(visible, {TARGET}) THEN 'selected target was not visible' END,
    CASE WHEN action_trace_rowid IS NOT NULL AND trace_user IS NULL THEN 'action trace does not exist' END,
    CASE WHEN trace_user IS NOT NULL AND (trace_user <> user_id OR trace_short IS DISTINCT FROM split_part(selected_choice_id, ':', 1)) THEN 'action trace binding is inconsistent' END,
    CASE WHEN trace_user IS NOT NULL AND trace_choice IS DISTINCT FROM selected_choice_id THEN 'selected choice disagrees with the trace' END,
    CASE WHEN {BAD_HISTORY} THEN 'history holds the current or a later trace' END,
    CASE WHEN regexp_matches(rationale, '(?i)(?:gsk_|sk-|hf_)[A-Za-z0-9_-]{{12,}}') THEN 'rationale contains a credential-like pattern' END,
    CASE WHEN len(feed_ids) = 0 AND coalesce(feed_message, '') = '' THEN 'empty feed without a reason' END,
    CASE WHEN row_copies > 1 THEN 'action trace is bound twice' END], lambda x: x IS NOT NULL) AS errors
  FROM (SELECT d.*, t.user_id AS trace_user, CASE t.action WHEN 'repost' THEN 'repost' WHEN 'quote_post' THEN 'quote' WHEN 'report_post' THEN 'report'
      WHEN 'do_nothing' THEN 'ignore' END AS trace_short, CASE t.action WHEN 'repost' THEN 'repost:' || t.k WHEN 'quote_post' THEN 'quote:' || t.k
      WHEN 'report_post' THEN 'report:' || t.k WHEN 'do_nothing' THEN 'ignore' END AS trace_choice,
      CASE WHEN d.action_trace_rowid IS NOT NULL THEN count(*) OVER (PARTITION BY d.action_trace_rowid) END AS row_copies
    FROM (SELECT * FROM dsnap WHERE status = 'succeeded') d LEFT JOIN trace0 t ON t.rowid = d.action_trace_rowid) d"""
FEED_JSON = """CASE WHEN feed_message IS NOT NULL THEN '{"message":"' || feed_message || '","posts":[' ELSE '{"posts":[' END
    || array_to_string(list_transform(feed_ids, lambda x: '{"post_id":' || x || '}'), ',') || ']}'"""


@query(
    "native_examples",
    f"""SELECT decision_id AS sample_id, action_trace_rowid, decision_sequence, timestep AS decision_timestep, profile AS user_profile, community,
          {FEED_JSON} AS feed_post, array_to_string(history, ',') AS behavior_history, split_part(selected_choice_id, ':', 1) AS action, rationale AS reason,
          array_to_string(visible, ',') AS visible, array_to_string(legal, ',') AS legal, selected_choice_id,
          CASE WHEN len(feed_ids) = 0 THEN feed_message END AS feed_empty_reason, array_to_string(errors, '; ') AS errors FROM native""",
    dsnap=DSNAP, native=NATIVE,
)
def _(t: Logs):
    def text(c):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")

    return dataset.native_examples(dsnap(t), t.trace).select(
        "sample_id", "action_trace_rowid", "decision_sequence", "decision_timestep", "user_profile", "community", "feed_post",
        text("behavior_history").alias("behavior_history"), F.col("label")["action"].alias("action"), F.col("label")["reason"].alias("reason"),
        text("visible_post_ids").alias("visible"), text("legal_choice_ids").alias("legal"), "selected_choice_id", "feed_empty_reason",
        F.array_join("errors", "; ").alias("errors"),
    )


@query(
    "native_export_status",
    """SELECT (count(*) FILTER (status = 'pending'))::BIGINT AS pending, (count(*) FILTER (status = 'failed'))::BIGINT AS failed,
         (count(*) FILTER (status = 'succeeded'))::BIGINT AS succeeded, CASE WHEN count(*) FILTER (status = 'pending') > 0 THEN 'blocked'
         WHEN count(*) FILTER (status = 'failed') > 0 THEN 'degraded' ELSE 'success' END AS export FROM dsnap""",
    dsnap=DSNAP,
)
def _(t: Logs):
    return dataset.export_status(dsnap(t))


@query(
    "status_counts",
    """SELECT v.s AS status, count(d.status)::BIGINT AS count FROM (VALUES ('failed'), ('pending'), ('succeeded')) v(s)
       LEFT JOIN snapshots d ON d.status = v.s GROUP BY 1""",
)
def _(t: Logs):
    return dataset.status_counts(t.snapshots)


# proposed outcomes of pending decisions, some breaking a rule
OUTCOMES = """SELECT decision_id, CASE WHEN s % 11 = 0 THEN 'failed' ELSE 'succeeded' END AS outcome,
    CASE WHEN s % 11 = 0 THEN NULL WHEN s % 31 = 0 THEN 'quote:77777' ELSE selected_choice_id END AS choice,
    CASE WHEN s % 11 = 0 THEN NULL WHEN s % 37 = 0 THEN s + 1 WHEN s % 41 = 0 THEN -5 ELSE s END AS action_trace_rowid,
    CASE WHEN s % 11 <> 0 THEN NULL WHEN s % 2 = 0 THEN 'timeout' ELSE 'Timeout: host 1' END AS failure_category
  FROM (SELECT *, decision_sequence AS s FROM snapshots) WHERE s % 13 <> 0"""


def outcomes_of(snapshots):
    s = F.col("decision_sequence")
    lost = s % 11 == 0
    return snapshots.where(s % 13 != 0).select(
        "decision_id",
        F.when(lost, "failed").otherwise("succeeded").alias("outcome"),
        F.when(lost, F.lit(None)).when(s % 31 == 0, "quote:77777").otherwise(F.col("selected_choice_id")).alias("choice"),
        F.when(lost, F.lit(None)).when(s % 37 == 0, s + 1).when(s % 41 == 0, F.lit(-5).cast("bigint")).otherwise(s).alias("action_trace_rowid"),
        F.when(~lost, F.lit(None)).when(s % 2 == 0, "timeout").otherwise("Timeout: host 1").alias("failure_category"),
    )


@query(
    "decision_lifecycle",
    """SELECT decision_id, user_id, CASE WHEN outcome IS NULL OR reject_reason IS NOT NULL THEN 'pending' ELSE outcome END AS status, reject_reason
       FROM (SELECT p.decision_id, p.user_id, o.outcome, CASE
           WHEN outcome = 'succeeded' AND NOT list_contains(p.legal, o.choice) THEN 'choice is not legal'
           WHEN outcome = 'succeeded' AND t.rowid IS NULL THEN 'action trace does not exist'
           WHEN outcome = 'succeeded' AND (t.user_id <> p.user_id OR CASE t.action WHEN 'repost' THEN 'repost' WHEN 'quote_post' THEN 'quote'
             WHEN 'report_post' THEN 'report' WHEN 'do_nothing' THEN 'ignore' END IS DISTINCT FROM split_part(o.choice, ':', 1)) THEN 'action trace does not match'
           WHEN outcome = 'failed' AND NOT regexp_matches(failure_category, '^[a-z0-9_]{1,64}$') THEN 'failure category is not a stable name' END AS reject_reason
         FROM snapshots p LEFT JOIN outcomes o ON o.decision_id = p.decision_id LEFT JOIN trace0 t ON t.rowid = o.action_trace_rowid)""",
    outcomes=OUTCOMES,
)
def _(t: Logs):
    return dataset.resolve_lifecycle(t.snapshots.select("decision_id", "user_id", "legal"), outcomes_of(t.snapshots), t.trace)


# ---- reconstruction -----------------------------------------------------
LEGACY_LABELS = """SELECT 'trace-' || rowid AS sample_id, CASE WHEN rowid % 41 = 0 THEN 'quote' ELSE action END AS action, 'reason ' || rowid AS reason
    FROM actions WHERE rowid % 37 <> 0 UNION ALL SELECT 'trace-x' || rowid, action, 'stray' FROM actions WHERE rowid % 211 = 0"""
LEGACY = dict(
    gaps=GAPS,
    legacy_labels=LEGACY_LABELS,
    context=f"""SELECT a.*, g.candidates, g.refresh_id AS matched_id, l.action AS label, l.reason AS label_reason, l.sample_id IS NOT NULL AS has_label,
        a.target_post_id IS NULL OR list_contains(a.visible, a.target_post_id) AS visible_ok, coalesce(l.action = a.action, false) AS label_ok,
        len(a.visible) = 0 AND coalesce(a.feed_message, '') = '' AS empty_bad
      FROM actions a JOIN gaps g ON a.rowid = g.rowid LEFT JOIN legacy_labels l ON l.sample_id = 'trace-' || a.rowid""",
    sound="SELECT * FROM context WHERE has_label AND candidates = 1 AND visible_ok AND label_ok AND NOT empty_bad",
    sd="SELECT user_id, target_post_id, min(rowid) AS f FROM sound WHERE created_post_id IS NOT NULL GROUP BY ALL",
    sr="SELECT user_id, target_post_id, min(rowid) AS f FROM sound WHERE action = 'report' GROUP BY ALL",
    legacy_legal="""SELECT rowid, ['ignore'] || flatten(list(opts ORDER BY post_id)) AS legal FROM (SELECT a.rowid, a.post_id, list_filter([
          CASE WHEN coalesce(d1.f < a.rowid, false) OR (k.is_repost AND coalesce(d2.f < a.rowid, false)) THEN NULL ELSE 'repost:' || a.post_id END,
          'quote:' || a.post_id, CASE WHEN coalesce(r1.f < a.rowid, false) THEN NULL ELSE 'report:' || a.post_id END], lambda x: x IS NOT NULL) AS opts
        FROM (SELECT rowid, user_id, unnest(visible) AS post_id FROM context WHERE candidates = 1 AND has_label) a JOIN kinds k ON a.post_id = k.post_id
        LEFT JOIN sd d1 ON a.user_id = d1.user_id AND a.post_id = d1.target_post_id LEFT JOIN sd d2 ON a.user_id = d2.user_id AND k.root_post_id = d2.target_post_id
        LEFT JOIN sr r1 ON a.user_id = r1.user_id AND a.post_id = r1.target_post_id) GROUP BY rowid""",
    rebuilt="""SELECT 'trace-' || c.rowid AS sample_id, c.rowid, c.matched_id AS refresh_id, c.choice AS selected_choice_id, c.history, u.community,
        coalesce(l.legal, ['ignore']) AS legal, c.label_reason, CASE c.rowid % 7 WHEN 0 THEN 'too_short' WHEN 1 THEN 'wrong_post_reference' END AS issue,
        CASE WHEN NOT has_label THEN 'teacher_sample_missing' WHEN candidates <> 1 THEN 'legacy_refresh_match_is_not_unique'
          WHEN NOT list_contains(coalesce(l.legal, ['ignore']), c.choice) OR NOT visible_ok OR NOT label_ok THEN array_to_string(list_filter([
            CASE WHEN NOT list_contains(coalesce(l.legal, ['ignore']), c.choice) THEN 'recorded choice is absent from reconstructed legal choices' END,
            CASE WHEN NOT visible_ok THEN 'recorded target is absent from reconstructed feed' END,
            CASE WHEN NOT label_ok THEN 'teacher action label disagrees with the trace' END], lambda x: x IS NOT NULL), '; ')
          WHEN empty_bad THEN 'empty feed has no explicit reason' END AS reason
      FROM context c LEFT JOIN legacy_legal l ON c.rowid = l.rowid LEFT JOIN users u ON c.user_id = u.user_id""",
)


def _legacy_labels(t: Logs):
    r, a = F.col("rowid"), t.actions.select("rowid", "action")
    n = r.cast("string")
    return (
        a.where(r % 37 != 0)
        .select(F.concat(F.lit("trace-"), n).alias("sample_id"), F.when(r % 41 == 0, "quote").otherwise(F.col("action")).alias("action"),
                F.concat(F.lit("reason "), n).alias("reason"))
        .unionByName(a.where(r % 211 == 0).select(F.concat(F.lit("trace-x"), n).alias("sample_id"), "action", F.lit("stray").alias("reason")))
    )


def _rebuilt(t: Logs):
    r = F.col("rowid")
    issue = F.when(r % 7 == 0, "too_short").when(r % 7 == 1, "wrong_post_reference")
    issues = t.actions.select(F.concat(F.lit("trace-"), r.cast("string")).alias("sample_id"), issue.alias("rationale_quality_status")).where("rationale_quality_status is not null")
    return dataset.reconstruct_legacy(
        t.trace.select("rowid", "user_id", "timestep", "action"), t.actions.drop("refresh_id"), _legacy_labels(t),
        t.post.select("post_id", "user_id", "original_post_id"), t.post_kind, issues, t.users,
    )


@query(
    "legacy_reconstruction",
    """SELECT sample_id, rowid, refresh_id, selected_choice_id, array_to_string(history, ',') AS history, community, array_to_string(legal, ',') AS legal,
         CASE WHEN issue IS NULL THEN label_reason ELSE '' END AS label_reason, coalesce(issue, 'not_individually_verified') AS rationale_quality_status,
         issue IS NULL AS rationale_training_eligible, reason FROM rebuilt""",
    **LEGACY,
)
def _(t: Logs):
    return _rebuilt(t).select(
        "sample_id", "rowid", "refresh_id", "selected_choice_id", F.array_join("history", ",").alias("history"), "community",
        F.array_join("legal", ",").alias("legal"), "label_reason", "rationale_quality_status", "rationale_training_eligible", "reason",
    )


@query(
    "legacy_unused_labels",
    """SELECT DISTINCT sample_id, 'teacher sample has no uniquely reconstructed decision' AS reason FROM legacy_labels
       WHERE sample_id NOT IN (SELECT sample_id FROM rebuilt WHERE reason IS NULL)""",
    **LEGACY,
)
def _(t: Logs):
    return dataset.unused_labels(_legacy_labels(t), _rebuilt(t))


LABEL_SOURCE = """SELECT sample_id, unnest(list_filter([CASE WHEN sample_id IS NULL THEN 'sample id is missing' END,
     CASE WHEN sample_id IS NOT NULL AND count(*) > 1 THEN 'sample id is not unique' END,
     CASE WHEN count(*) FILTER (regexp_matches(reason, '(?i)(?:gsk_|sk-|hf_)[A-Za-z0-9_-]{12,}')) > 0 THEN 'credential-like pattern' END],
     lambda x: x IS NOT NULL)) AS error
   FROM (SELECT CASE WHEN decision_sequence % 301 = 0 THEN NULL
   ELSE 'trace-' || (decision_sequence - CASE WHEN decision_sequence % 97 = 0 THEN decision_sequence % 5 ELSE 0 END) END AS sample_id,
   rationale AS reason FROM dsnap)
   GROUP BY sample_id"""


def _label_source(t: Logs):
    s = F.col("decision_sequence")
    name = F.concat(F.lit("trace-"), (s - F.when(s % 97 == 0, s % 5).otherwise(0)).cast("string"))
    rows = dsnap(t).select(F.when(s % 301 != 0, name).alias("sample_id"), F.col("rationale").alias("reason"))
    return dataset.label_source_errors(rows)


# the same check under both of its names
for _name in ("label_source_errors", "label_source_credentials"):
    query(_name, LABEL_SOURCE, dsnap=DSNAP)(_label_source)


# ---- validation ---------------------------------------------------------
# examples of all snapshots, sound or not, with further defects of their own
EXAMPLES = f"""SELECT sample_id, decision_sequence AS seq, CASE WHEN decision_sequence % 107 <> 0 THEN decision_sequence END AS decision_sequence, action_trace_rowid,
    history, visible, legal, selected_choice_id, feed_ids, feed_message, reason, keyed, provenance, eligible, broken, result_key,
    CASE WHEN decision_sequence % 113 = 0 THEN 'report' ELSE split_part(selected_choice_id, ':', 1) END AS label
  FROM (SELECT decision_id AS sample_id, decision_sequence, action_trace_rowid, history, visible, legal, selected_choice_id, feed_message,
      CASE WHEN decision_sequence % 97 = 0 THEN [] ELSE feed_ids END AS feed_ids, rationale AS reason,
      coalesce(regexp_matches(rationale, '(?i)(?:gsk_|sk-|hf_)[A-Za-z0-9_-]{{12,}}'), false) AS keyed,
      CASE WHEN decision_sequence % 101 = 0 THEN 'unversioned' ELSE 'decision_snapshot' END AS provenance, decision_sequence % 103 <> 0 AS eligible,
      decision_sequence % 89 = 0 AS broken, decision_sequence % 97 = 0 AND decision_sequence % 89 <> 0 AS result_key,
      len(feed_ids) = 0 AS was_empty FROM native)
  , (VALUES (1), (2)) c(copy) WHERE copy = 1 OR decision_sequence % 109 = 0"""


def examples(t: Logs):
    s = F.col("decision_sequence")
    rows = dataset.native_examples(dsnap(t), t.trace).drop("errors")
    rows = rows.withColumn("feed_post", F.when(s % 89 == 0, "not json").when(s % 97 == 0, '{"posts":[],"report_id":1}').otherwise(F.col("feed_post")))
    label = F.col("label")
    rows = (
        rows.withColumn("provenance", F.when(s % 101 == 0, "unversioned").otherwise(F.col("provenance")))
        .withColumn("rationale_training_eligible", s % 103 != 0)
        .withColumn("label", label.withField("action", F.when(s % 113 == 0, "report").otherwise(label["action"])))
    )
    rows = rows.unionByName(rows.where(s % 109 == 0))
    return rows.withColumn("decision_sequence", F.when(s % 107 != 0, s))


@query(
    "validate_examples",
    rf"""SELECT DISTINCT sample_id, unnest(list_filter([CASE WHEN decision_sequence IS NULL THEN 'decision sequence is missing' END,
          CASE WHEN provenance = 'unversioned' THEN 'provenance is not explicit' END, CASE WHEN broken THEN 'feed is not a normalized object' END,
          CASE WHEN NOT broken AND list_sort(feed_ids) <> list_sort(visible) THEN 'visible posts disagree with the feed' END,
          CASE WHEN NOT broken AND len(feed_ids) = 0 AND coalesce(empty_reason, '') = '' THEN 'empty feed has no reason' END,
          CASE WHEN result_key THEN 'feed contains action results' END,
          CASE WHEN NOT broken AND NOT list_contains(legal, selected_choice_id) THEN 'selected choice is not legal' END,
          CASE WHEN NOT broken AND list_contains(legal, selected_choice_id) AND {TARGET} <= 0 THEN 'selected choice is invalid' END,
          CASE WHEN NOT broken AND list_contains(legal, selected_choice_id) AND {TARGET} IS NOT NULL AND NOT list_contains(feed_ids, {TARGET}) THEN 'selected target is not visible' END,
          CASE WHEN NOT broken AND list_contains(legal, selected_choice_id) AND label <> split_part(selected_choice_id, ':', 1) THEN 'selected choice disagrees with the label' END,
          CASE WHEN NOT broken AND action_trace_rowid IS NULL THEN 'action trace row is missing' END,
          CASE WHEN NOT broken AND {BAD_HISTORY} THEN 'history holds the current or a later action' END,
          CASE WHEN NOT broken AND NOT eligible AND reason <> '' THEN 'ineligible rationale text remains' END,
          CASE WHEN NOT broken AND keyed THEN 'credential-like pattern' END], lambda x: x IS NOT NULL)) AS error
        FROM (SELECT e.*, CASE WHEN len(n.feed_ids) = 0 THEN n.feed_message END AS empty_reason FROM example_rows e JOIN native n ON n.decision_id = e.sample_id)
        UNION ALL SELECT sample_id, 'decision id is not unique' FROM example_rows GROUP BY 1 HAVING count(*) > 1""",
    dsnap=DSNAP, native=NATIVE, example_rows=EXAMPLES,
)
def _(t: Logs):
    return dataset.validate_examples(examples(t))


@query(
    "trace_binding_check",
    """SELECT DISTINCT sample_id, unnest(list_filter([CASE WHEN action_trace_rowid IS NULL THEN 'action trace row is not an integer' END,
         CASE WHEN action_trace_rowid IS NOT NULL AND copies > 1 THEN 'action trace row is used twice' END,
         CASE WHEN action_trace_rowid IS NOT NULL AND short IS NULL THEN 'bound action trace is missing' END,
         CASE WHEN short <> label THEN 'action label disagrees with the trace' END], lambda x: x IS NOT NULL)) AS error
       FROM (SELECT e.*, count(*) OVER (PARTITION BY e.action_trace_rowid) AS copies, CASE t.action WHEN 'repost' THEN 'repost' WHEN 'quote_post' THEN 'quote'
           WHEN 'report_post' THEN 'report' WHEN 'do_nothing' THEN 'ignore' END AS short FROM example_rows e LEFT JOIN trace0 t ON t.rowid = e.action_trace_rowid)
       UNION ALL SELECT sample_id, 'example without a succeeded snapshot' FROM (SELECT sample_id, action_trace_rowid FROM example_rows WHERE provenance = 'decision_snapshot'
         EXCEPT SELECT decision_id, action_trace_rowid FROM dsnap WHERE status = 'succeeded' AND decision_sequence % 131 <> 0)
       UNION ALL SELECT decision_id, 'succeeded snapshot without an example' FROM (SELECT decision_id, action_trace_rowid FROM dsnap WHERE status = 'succeeded' AND decision_sequence % 131 <> 0
         EXCEPT SELECT sample_id, action_trace_rowid FROM example_rows WHERE provenance = 'decision_snapshot')""",
    dsnap=DSNAP, native=NATIVE, example_rows=EXAMPLES,
)
def _(t: Logs):
    return dataset.trace_binding_check(examples(t), t.trace, dsnap(t).where("decision_sequence % 131 != 0"))


@query(
    "dataset_validation",
    f"""SELECT count(*)::BIGINT AS snapshots, (count(*) FILTER (done))::BIGINT AS succeeded, (count(*) FILTER (NOT done))::BIGINT AS failed,
          round(avg((list_sort(feed_ids) = list_sort(visible))::INT), 6) AS feed_consistency_rate,
          round((count(*) FILTER (done AND action_trace_rowid IS NOT NULL))::DOUBLE / (count(*) FILTER (done)), 6) AS trace_binding_rate,
          (count(*) FILTER (done AND action_trace_rowid IS NOT NULL AND {BAD_HISTORY}))::BIGINT AS leaking,
          (count(*) FILTER (done AND action_trace_rowid IS NOT NULL AND {BAD_HISTORY})) = 0 AS leakage_check_passed,
          count(DISTINCT decision_id)::BIGINT AS distinct_ids, count(DISTINCT decision_id) = count(*) AS ids_unique
        FROM (SELECT *, status = 'succeeded' AS done FROM dsnap)""",
    dsnap=DSNAP,
)
def _(t: Logs):
    out = dataset.dataset_validation(dsnap(t))
    return out.withColumn("feed_consistency_rate", F.round("feed_consistency_rate", 6)).withColumn("trace_binding_rate", F.round("trace_binding_rate", 6))


@query(
    "pairing_audit",
    """SELECT condition, strategies, strategies = 4 AND versions = 1 AND complete AS paired FROM (
         SELECT condition, any_value(strategies)::BIGINT AS strategies, max(versions) AS versions, bool_and(present = strategies) AS complete FROM (
           SELECT condition, kind, count(*) AS present, count(DISTINCT items) AS versions, any_value(s) AS strategies FROM (
             SELECT condition, strategy, kind, string_agg(item, ',' ORDER BY item) AS items FROM unit_rows GROUP BY 1, 2, 3)
           JOIN (SELECT condition AS c, count(DISTINCT strategy) AS s FROM unit_rows GROUP BY 1) ON c = condition GROUP BY 1, 2) GROUP BY 1)""",
    unit_rows="""SELECT condition, strategy, 'edge' AS kind, follower_id || '-' || followee_id AS item FROM follow, (VALUES ('a'), ('b'), ('c')) x(condition),
          range(4) y(strategy) WHERE NOT (condition = 'b' AND strategy = 2 AND follower_id % 100 = 1)
        UNION ALL SELECT condition, strategy, 'risk', post_id || '=' || risk_score FROM post_risk, (VALUES ('a'), ('b'), ('c')) x(condition), range(4) y(strategy)
          WHERE NOT (condition = 'c' AND strategy = 3)""",
)
def _(t: Logs):
    units = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(s).cast("bigint").alias("strategy")) for c in "abc" for s in range(4)])
    edges = t.follow.select(F.inline(units), F.lit("edge").alias("kind"), F.concat_ws("-", F.col("follower_id").cast("string"), F.col("followee_id").cast("string")).alias("item"), "follower_id")
    edges = edges.where("not (condition = 'b' and strategy = 2 and follower_id % 100 = 1)").drop("follower_id")
    risks = t.post_risk.select(F.inline(units), F.lit("risk").alias("kind"), F.concat_ws("=", F.col("post_id").cast("string"), F.col("risk_score").cast("string")).alias("item"))
    risks = risks.where("not (condition = 'c' and strategy = 3)")
    rows = edges.unionByName(risks)
    return dataset.pairing_audit(rows.select("condition", "strategy"), rows, 4)


@query(
    "feed_policy_consistency",
    """SELECT run_id, count(*)::BIGINT AS decisions, (count(*) FILTER (same))::BIGINT AS consistent, round(avg(same::INT), 6) AS consistency_rate FROM (
         SELECT s.run_id, coalesce(i.shown, []) = list_sort(s.visible) AS same FROM snapshots s LEFT JOIN (
           SELECT run_id, user_id, timestep, list(post_id ORDER BY post_id) AS shown FROM impressions WHERE shown GROUP BY 1, 2, 3) i
         ON i.run_id = s.run_id AND i.user_id = s.user_id AND i.timestep = s.timestep) GROUP BY 1""",
)
def _(t: Logs):
    return dataset.feed_policy_consistency(t.snapshots, t.impressions).withColumn("consistency_rate", F.round("consistency_rate", 6))


@query(
    "refresh_accounting",
    """SELECT run_id, d.n AS decisions, r.n AS refreshes, greatest(r.n - d.n, 0)::BIGINT AS extra_refreshes, d.n = r.n AS one_to_one FROM
       (SELECT run_id, count(*)::BIGINT AS n FROM snapshots GROUP BY 1) d JOIN
       (SELECT 'run-' || (user_id % 4) AS run_id, count(*)::BIGINT AS n FROM trace0 WHERE action = 'refresh' GROUP BY 1) r USING (run_id)""",
)
def _(t: Logs):
    trace = t.trace.select(F.concat(F.lit("run-"), (F.col("user_id") % 4).cast("string")).alias("run_id"), "action")
    return dataset.refresh_accounting(t.snapshots, trace)


@query(
    "snapshot_range_checks",
    """SELECT impression_id, unnest(list_filter([CASE WHEN NOT risk BETWEEN 0 AND 1 THEN 'risk_score outside [0, 1]' END,
         CASE WHEN NOT keep BETWEEN 0 AND 1 THEN 'keep_probability outside [0, 1]' END, CASE WHEN base < 0 THEN 'base_score is negative' END,
         CASE WHEN src IS NULL THEN 'source is missing' END], lambda x: x IS NOT NULL)) AS rule
       FROM (SELECT impression_id, CASE WHEN impression_id % 97 = 0 THEN 1.5 ELSE risk_score END AS risk, CASE WHEN impression_id % 89 = 0 THEN -0.1 ELSE keep_probability END AS keep,
         CASE WHEN impression_id % 83 = 0 THEN -1 ELSE base_score END AS base, CASE WHEN impression_id % 79 <> 0 THEN source END AS src FROM impressions)""",
)
def _(t: Logs):
    return dataset.range_violations(
        damaged_impressions(t), "impression_id", ["risk_score", "keep_probability"], ["base_score"], ["source"]
    )


def damaged_impressions(t: Logs):
    i = F.col("impression_id")
    return (
        t.impressions.withColumn("risk_score", F.when(i % 97 == 0, 1.5).otherwise(F.col("risk_score")))
        .withColumn("keep_probability", F.when(i % 89 == 0, -0.1).otherwise(F.col("keep_probability")))
        .withColumn("base_score", F.when(i % 83 == 0, -1.0).otherwise(F.col("base_score")))
        .withColumn("source", F.when(i % 79 != 0, F.col("source")))
    )


PROMPT_SQL = f"""SELECT sample_id, 'Choose one action and return only strict JSON with keys action, confidence, reason. Allowed actions: repost, quote, report, ignore.' || chr(10)
    || '{{"behavior_history": [' || array_to_string(list_transform(history, lambda x: '"' || x || '"'), ', ') || '], "community": "' || community || '", "feed_post": "'
    || replace({FEED_JSON}, '"', '\\"') || '", "legal_choice_ids": [' || array_to_string(list_transform(legal, lambda x: '"' || x || '"'), ', ')
    || '], "neighbor_interactions": [], "platform_notice": "", "user_profile": "' || profile || '"}}' AS prompt, rationale
  FROM (SELECT *, decision_id AS sample_id FROM native WHERE len(errors) = 0)"""


def _sound(t: Logs):
    return dataset.native_examples(dsnap(t), t.trace).where(F.size("errors") == 0)


@query("prompt_render", "SELECT sample_id, prompt FROM prompts", dsnap=DSNAP, native=NATIVE, prompts=PROMPT_SQL)
def _(t: Logs):
    return _sound(t).select("sample_id", dataset.prompt().alias("prompt"))


MAX_LENGTH = 24


WORDS = 50_000


@query(
    "masked_features",
    rf"""SELECT sample_id, array_to_string(kept || target, ',') AS input_ids, array_to_string(list_transform(kept, lambda x: -100) || target, ',') AS labels
        FROM (SELECT sample_id, target, CASE WHEN len(ids) > {MAX_LENGTH} - len(target) THEN ids[len(ids) - ({MAX_LENGTH} - len(target)) + 1:] ELSE ids END AS kept
          FROM (SELECT sample_id, [1] || list_transform(regexp_extract_all(prompt, '\S+'), lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT % {WORDS} + 2) AS ids,
              (list_transform(regexp_extract_all(rationale, '\S+'), lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT % {WORDS} + 2) || [0])[1:{MAX_LENGTH}] AS target FROM prompts))""",
    dsnap=DSNAP, native=NATIVE, prompts=PROMPT_SQL,
)
def _(t: Logs):
    rows = _sound(t).select("sample_id", dataset.prompt().alias("prompt"), F.col("label")["reason"].alias("target"))
    f = dataset.masked_features(dataset.word_ids(F.col("prompt"), True, WORDS), dataset.word_ids(F.col("target"), False, WORDS), 0, MAX_LENGTH)

    def text(c):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")

    return rows.select("sample_id", text(f["input_ids"]).alias("input_ids"), text(f["labels"]).alias("labels"))
