"""Queries B1, B6, B7, M7-M18, G13, I7, I8, I10: decision audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as sc, text as tx
from ..operators import audit, reliability
from ..operators.evaluation import action_eval
from .q_choices import LINKS
from .q_text import DECLARED, NORMALIZED_SQL, OUTPUTS_SQL, QUOTE_STANCE, outputs
from .registry import query
from .views import Logs

RATIONALES = "SELECT doc_id AS k, text AS rationale FROM documents"
SAMPLES = dict(
    links=LINKS,
    feed_info="""SELECT rowid, list(CASE WHEN risk_score IS NULL THEN 'unknown' WHEN risk_score = 0 THEN 'low' WHEN risk_score = 1 THEN 'high'
          ELSE 'intermediate' END) AS buckets, list_distinct(list(error) FILTER (error IS NOT NULL)) AS errors,
        list(post_id) FILTER (impression_id IS NOT NULL) AS linked_posts, list(impression_id) FILTER (impression_id IS NOT NULL) AS linked_ids
      FROM links GROUP BY 1""",
    one_community="""SELECT user_id, min(c) AS community FROM (SELECT user_id, user_community AS c FROM impressions
        UNION ALL SELECT root_author_id, author_community FROM impressions) GROUP BY 1 HAVING min(c) = max(c)""",
    one_risk="SELECT root_post_id, min(risk_score) AS risk_score FROM impressions GROUP BY 1 HAVING min(risk_score) = max(risk_score)",
    joined=f"""SELECT s.decision_sequence AS rowid, s.user_id, s.timestep, s.action, s.target_post_id, s.selected_choice_id AS choice, s.refresh_id,
        s.visible, s.legal, coalesce(d.rationale, '') AS reason, trim(lower(coalesce(d.rationale, ''))) AS s, lower(coalesce(d.rationale, '')) AS low,
        r.root_post_id, r.root_author_id, k.risk_score, uc.community AS user_community, ac.community AS author_community,
        coalesce(f.buckets, []) AS buckets, coalesce(f.errors, []) AS errors,
        coalesce(list_count(list_filter(coalesce(f.linked_posts, []), lambda x: x = s.target_post_id)), 0) = 1 AS linked_once
      FROM snapshots s LEFT JOIN ({RATIONALES}) d ON s.k = d.k LEFT JOIN roots r ON s.target_post_id = r.post_id
      LEFT JOIN one_risk k ON k.root_post_id = r.root_post_id LEFT JOIN one_community uc ON uc.user_id = s.user_id
      LEFT JOIN one_community ac ON ac.user_id = r.root_author_id LEFT JOIN feed_info f ON f.rowid = s.decision_sequence""",
    flagged=rf"""SELECT *, CASE WHEN risk_score IS NULL THEN 'unknown' WHEN risk_score = 0 THEN 'low' WHEN risk_score = 1 THEN 'high' ELSE 'intermediate' END AS risk_bucket,
        CASE WHEN user_community = author_community THEN 'intra' WHEN user_community IS NOT NULL AND author_community IS NOT NULL THEN 'inter'
          WHEN target_post_id IS NULL THEN 'not_applicable' ELSE 'unknown' END AS community_relation,
        CASE WHEN action = 'quote' THEN {QUOTE_STANCE} END AS quote_stance,
        CASE WHEN action <> 'ignore' THEN NULL WHEN list_contains(buckets, 'high') AND list_contains(buckets, 'low') THEN 'mixed_high_low_feed'
          WHEN list_contains(buckets, 'high') THEN 'missed_intervention_candidate'
          WHEN len(buckets) > 0 AND len(list_filter(buckets, lambda x: x <> 'low')) = 0 THEN 'low_risk_only_usually_acceptable'
          ELSE 'unavailable_or_intermediate_feed' END AS ignore_category,
        length(s) = 0 AS empty, length(s) > 0 AND (length(s) < 20 OR len(regexp_split_to_array(s, '\s+')) < 4) AS too_short,
        len({DECLARED}) > 0 AND NOT list_contains({DECLARED}, action) AS action_contradiction,
        list_filter(list_transform(regexp_extract_all(s, '(?:post\s*#?|repost:)\s*(\d+)', 1), lambda x: x::BIGINT), lambda x: NOT list_contains(visible, x))
          || CASE WHEN target_post_id IS NOT NULL THEN list_filter(list_transform(regexp_extract_all(s, 'repost:\s*(\d+)', 1), lambda x: x::BIGINT),
             lambda x: x <> target_post_id) ELSE [] END AS wrong_refs,
        coalesce(target_post_id IS NOT NULL AND root_author_id IS NOT NULL AND user_id <> root_author_id AND contains(s, 'own original post'), false)
          AS factual_author_mismatch,
        list_sort(list_distinct(errors || list_filter([CASE WHEN refresh_id IS NULL THEN 'no preceding refresh trace for user' END,
          CASE WHEN target_post_id IS NOT NULL AND NOT list_contains(visible, target_post_id) THEN 'action target is not in the preceding visible feed' END,
          CASE WHEN target_post_id IS NOT NULL AND NOT linked_once THEN 'target action does not map to exactly one shown impression' END,
          CASE WHEN NOT list_contains(legal, choice) THEN 'recorded action is absent from reconstructed legal choices' END], lambda x: x IS NOT NULL)))
          AS link_errors
      FROM joined""",
    samples="""SELECT *, CASE WHEN action = 'report' AND risk_bucket = 'high' THEN 'aligned_report_high' WHEN action = 'report' AND risk_bucket = 'low'
          THEN 'reverse_report_low' WHEN action = 'repost' AND risk_bucket = 'low' THEN 'aligned_repost_low' WHEN action = 'repost' AND risk_bucket = 'high'
          THEN 'reverse_repost_high' WHEN action = 'quote' THEN 'manual_quote_' || quote_stance WHEN action = 'ignore' THEN 'ignore_' || ignore_category
          ELSE 'unavailable' END AS rule_classification,
        action = 'quote' OR coalesce(ignore_category <> 'low_risk_only_usually_acceptable', false) OR empty OR too_short OR action_contradiction
          OR factual_author_mismatch OR len(wrong_refs) > 0 AS manual_review
      FROM flagged""",
)


def samples(t: Logs):
    snap = t.with_features(
        t.snapshots.select(
            F.col("decision_sequence").alias("rowid"), "user_id", "timestep", "action", "target_post_id",
            F.col("selected_choice_id").alias("choice"), "refresh_id", "visible", "legal", "k",
        )
    )
    return audit.audit_samples(snap, t.impressions, t.roots)


@query(
    "teacher_audit",
    """SELECT rowid, user_id, timestep, action, target_post_id, root_post_id, root_author_id, risk_score, risk_bucket, user_community, author_community,
         community_relation, quote_stance, ignore_category, rule_classification, manual_review, array_to_string(link_errors, ';') AS link_errors,
         empty, too_short, action_contradiction, factual_author_mismatch, array_to_string(list_sort(list_distinct(wrong_refs)), ',') AS wrong_refs,
         linked_once, array_to_string(list_filter([CASE WHEN target_post_id IS NULL THEN 'target: ignore has no action target' END,
           CASE WHEN target_post_id IS NOT NULL AND risk_score IS NULL THEN 'risk_score: root has no unique risk score in the impressions' END,
           CASE WHEN user_community IS NULL THEN 'user_community: user has no unique community in the impressions' END,
           CASE WHEN target_post_id IS NOT NULL AND author_community IS NULL THEN 'author_community: root author has no unique community in the impressions' END,
           CASE WHEN target_post_id IS NOT NULL AND NOT linked_once THEN 'target_impression_id: target action does not map to exactly one shown impression' END],
           lambda x: x IS NOT NULL), ';') AS null_reasons
       FROM samples""",
    **SAMPLES,
)
def _(t: Logs):
    s = samples(t)
    return s.select(
        "rowid", "user_id", "timestep", "action", "target_post_id", "root_post_id", "root_author_id", "risk_score", "risk_bucket",
        "user_community", "author_community", "community_relation", "quote_stance", "ignore_category", "rule_classification", "manual_review",
        F.array_join("link_errors", ";").alias("link_errors"), "empty", "too_short", "action_contradiction", "factual_author_mismatch",
        F.array_join(F.transform("wrong_post_reference_ids", lambda x: x.cast("string")), ",").alias("wrong_refs"),
        F.col("target_impression_id").isNotNull().alias("linked_once"), F.array_join("null_reasons", ";").alias("null_reasons"),
    )


@query(
    "action_distribution",
    """SELECT a AS action, count(s.rowid)::BIGINT AS count, round(count(s.rowid)::DOUBLE / (SELECT count(*) FROM actions), 6) AS proportion
       FROM (VALUES ('ignore'), ('quote'), ('report'), ('repost')) v(a) LEFT JOIN actions s ON s.action = a GROUP BY 1""",
)
def _(t: Logs):
    return audit.action_distribution(t.actions).withColumn("proportion", F.round("proportion", 6))


_COUNTS = ", ".join(f"(count(*) FILTER (action = '{a}'))::BIGINT AS {a}" for a in sc.ACTIONS)


@query(
    "action_crosstabs",
    f"""SELECT v AS value, {_COUNTS}, 'risk_bucket' AS dimension FROM (VALUES ('low'), ('high'), ('intermediate'), ('unknown'), ('not_applicable')) x(v)
        LEFT JOIN samples ON v = CASE WHEN target_post_id IS NULL THEN 'not_applicable' ELSE risk_bucket END GROUP BY 1
        UNION ALL SELECT v, {_COUNTS}, 'community_relation' FROM (VALUES ('intra'), ('inter'), ('not_applicable'), ('unknown')) x(v)
        LEFT JOIN samples ON v = community_relation GROUP BY 1
        UNION ALL SELECT timestep::VARCHAR, {_COUNTS}, 'timestep' FROM samples GROUP BY 1""",
    **SAMPLES,
)
def _(t: Logs):
    s = samples(t).select("action", "target_post_id", "risk_bucket", "community_relation", "timestep")
    return audit.action_crosstabs(s)


@query(
    "rule_classification",
    """SELECT rule_classification, count(*)::BIGINT AS samples, (count(*) FILTER (manual_review))::BIGINT AS manual_review FROM samples GROUP BY 1""",
    **SAMPLES,
)
def _(t: Logs):
    return audit.classification_counts(samples(t))


ISSUES = """SELECT rowid, unnest(list_filter([CASE WHEN action_contradiction THEN 'action_contradiction' END, CASE WHEN empty THEN 'empty' END,
    CASE WHEN factual_author_mismatch THEN 'factual_author_mismatch' END, CASE WHEN too_short THEN 'too_short' END,
    CASE WHEN len(wrong_refs) > 0 THEN 'wrong_post_reference' END], lambda x: x IS NOT NULL)) AS issue FROM samples"""


# issues are rare in the texts: every sample also gets some from its row number
def _issues(t: Logs):
    r = F.col("rowid")
    extra = F.filter(
        F.array(*[F.when(r % m == 0, F.lit(name)) for m, name in ((3, "too_short"), (5, "wrong_post_reference"), (7, "action_contradiction"), (11, "factual_author_mismatch"), (13, "empty"))]),
        lambda x: x.isNotNull(),
    )
    return audit.rationale_issues(samples(t)).unionByName(t.actions.select("rowid", F.explode(extra).alias("issue")))


@query(
    "rationale_issue_priority",
    """SELECT rowid, CASE min(CASE issue WHEN 'factual_author_mismatch' THEN 0 WHEN 'action_contradiction' THEN 1 WHEN 'wrong_post_reference' THEN 2
           WHEN 'empty' THEN 3 ELSE 4 END) WHEN 0 THEN 'factual_relation_error' WHEN 1 THEN 'action_contradiction' WHEN 2 THEN 'wrong_post_reference'
         WHEN 3 THEN 'empty_rationale' ELSE 'too_short' END AS rationale_quality_status
       FROM (SELECT * FROM issues UNION ALL SELECT rowid, unnest(list_filter([CASE WHEN rowid % 3 = 0 THEN 'too_short' END,
         CASE WHEN rowid % 5 = 0 THEN 'wrong_post_reference' END, CASE WHEN rowid % 7 = 0 THEN 'action_contradiction' END,
         CASE WHEN rowid % 11 = 0 THEN 'factual_author_mismatch' END, CASE WHEN rowid % 13 = 0 THEN 'empty' END], lambda x: x IS NOT NULL)) FROM actions)
       GROUP BY 1""",
    issues=ISSUES,
    **SAMPLES,
)
def _(t: Logs):
    return audit.issue_priority(_issues(t))


@query(
    "risk_crosscheck",
    """SELECT e.post_id AS root_post_id, e.risk_score AS expected_risk, min(i.risk_score) AS lowest, max(i.risk_score) AS highest,
         count(i.risk_score)::BIGINT AS impressions,
         coalesce(min(i.risk_score) = max(i.risk_score) AND min(i.risk_score) = e.risk_score, false) AS matches
       FROM labelled_risk e LEFT JOIN impressions i ON i.root_post_id = e.post_id GROUP BY 1, 2""",
)
def _(t: Logs):
    expected = t.labelled_risk.select(F.col("post_id").alias("root_post_id"), F.col("risk_score").alias("expected_risk"))
    return audit.risk_crosscheck(t.impressions, expected)


DECIDED = """SELECT s.*, r.root_post_id, k.risk_score AS root_risk FROM snapshots s LEFT JOIN roots r ON s.target_post_id = r.post_id
    LEFT JOIN post_risk k ON r.root_post_id = k.post_id"""


def decided(t: Logs):
    roots = t.roots.select(F.col("post_id").alias("target_post_id"), "root_post_id", "root_author_id")
    risk = t.post_risk.select(F.col("post_id").alias("root_post_id"), F.col("risk_score").alias("root_risk"))
    return t.snapshots.join(roots, "target_post_id", "left").join(risk, "root_post_id", "left")


@query(
    "post_context",
    """SELECT d.decision_id, d.target_post_id, d.root_post_id, d.root_risk, CASE WHEN d.target_post_id IS NULL THEN NULL
         WHEN d.community = a.community THEN 'intra' ELSE 'inter' END AS community_relation,
         CASE WHEN root_risk IS NULL THEN 'unknown' WHEN root_risk <= 0.3 THEN 'low' WHEN root_risk >= 0.7 THEN 'high' ELSE 'intermediate' END AS risk_band
       FROM decided d LEFT JOIN roots r ON d.target_post_id = r.post_id LEFT JOIN users a ON r.root_author_id = a.user_id""",
    decided=DECIDED,
)
def _(t: Logs):
    authors = t.users.select(F.col("user_id").alias("root_author_id"), F.col("community").alias("author_community"))
    d = decided(t).join(authors, "root_author_id", "left")
    relation = sc.community_relation("community", "author_community", "target_post_id")
    return d.select(
        "decision_id", "target_post_id", "root_post_id", "root_risk",
        F.when(F.col("target_post_id").isNotNull(), relation).alias("community_relation"), sc.risk_band("root_risk").alias("risk_band"),
    )


@query(
    "safety_counts",
    """SELECT run_id, count(*)::BIGINT AS decisions, (count(*) FILTER (action = 'report' AND root_risk <= 0.3))::BIGINT AS low_risk_reports,
         (count(*) FILTER (action = 'repost' AND root_risk >= 0.7))::BIGINT AS high_risk_reposts,
         (count(*) FILTER (action = 'ignore' AND EXISTS (SELECT 1 FROM impressions i WHERE i.shown AND i.risk_score >= 0.7 AND i.run_id = d.run_id
           AND i.user_id = d.user_id AND i.timestep = d.timestep AND list_contains(d.legal, 'report:' || i.post_id))))::BIGINT AS missed_interventions
       FROM decided d WHERE status = 'succeeded' GROUP BY 1""",
    decided=DECIDED,
)
def _(t: Logs):
    flags = audit.safety_counts(decided(t), t.impressions)
    return flags.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if("low_risk_report").alias("low_risk_reports"),
        F.count_if("high_risk_repost").alias("high_risk_reposts"), F.count_if("missed_intervention").alias("missed_interventions"),
    )


def _in(tokens) -> str:
    return "(" + " OR ".join(f"contains(lower(rationale), '{x}')" for x in tokens) + ")"


@query(
    "profile_consistency",
    f"""SELECT profile, verdict, count(*)::BIGINT AS decisions FROM (SELECT profile, CASE WHEN factual THEN 'factual_rationale_error'
          WHEN (profile = 'verifier' AND action = 'report' AND root_risk >= 0.7) OR (profile = 'benign-sharer' AND action = 'repost' AND root_risk <= 0.3)
            OR (profile = 'contextualizer' AND action = 'quote' AND root_risk >= 0.7) OR (profile = 'cautious' AND action = 'ignore')
            OR (profile = 'balanced' AND ((action = 'report' AND root_risk >= 0.7) OR (action = 'repost' AND root_risk <= 0.3))) THEN 'profile_consistent'
          WHEN profile IN ('verifier', 'benign-sharer', 'balanced') AND action = 'repost' AND root_risk >= 0.7 THEN 'profile_inconsistent'
          ELSE 'unscored' END AS verdict
        FROM (SELECT d.*, coalesce((root_risk >= 0.7 AND action <> 'quote' AND {_in(tx.SAYS_LOW)}) OR (root_risk <= 0.3 AND {_in(tx.SAYS_HIGH)}), false)
            OR decision_sequence % 97 = 0 AS factual
          FROM decided d LEFT JOIN (SELECT doc_id, text AS rationale FROM documents) ON d.k = doc_id WHERE status = 'succeeded')) GROUP BY 1, 2""",
    decided=DECIDED,
)
def _(t: Logs):
    d = t.with_features(decided(t).where("status = 'succeeded'"))
    fits = tx.consistent_with(F.col("action"), F.col("root_risk"), F.col("features"))
    wrong = F.coalesce(~fits, F.lit(False)) | (F.col("decision_sequence") % 97 == 0)
    verdict = audit.profile_consistency("profile", "action", "root_risk", wrong)
    return d.select("profile", verdict.alias("verdict")).groupBy("profile", "verdict").agg(F.count(F.lit(1)).alias("decisions"))


# (quality class, action, profile, root post kind, stance); None is a wildcard
RUBRIC = [
    ("aligned", "report", None, "high", None),
    ("aligned", "repost", None, "low", None),
    ("acceptable", "repost", None, None, None),
    ("acceptable", "ignore", None, None, None),
    ("acceptable", "quote", None, None, "unclear"),
    ("aligned", "quote", "contextualizer", None, None),
    ("concerning", "repost", None, "high", None),
    ("concerning", "report", "cautious", "low", None),
]
_RULES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in RUBRIC)
RUBRIC_SQL = dict(
    decided=DECIDED,
    rated=f"""SELECT d.decision_id, d.action, d.profile, d.stance, d.root_kind, d.relation, coalesce(CASE min(CASE q WHEN 'concerning' THEN 0
          WHEN 'aligned' THEN 1 WHEN 'acceptable' THEN 2 END) WHEN 0 THEN 'concerning' WHEN 1 THEN 'aligned' WHEN 2 THEN 'acceptable' END, 'unscored') AS quality_class
        FROM (SELECT d.decision_id, d.action, d.profile, CASE WHEN root_risk IS NULL THEN NULL WHEN root_risk <= 0.3 THEN 'low' WHEN root_risk >= 0.7 THEN 'high'
            ELSE 'intermediate' END AS root_kind, CASE WHEN d.action <> 'quote' THEN 'not_applicable' WHEN d.decision_sequence % 3 = 0 THEN 'challenge'
            ELSE 'unclear' END AS stance, CASE WHEN d.target_post_id IS NULL THEN NULL WHEN d.community = a.community THEN 'intra' ELSE 'inter' END AS relation
          FROM decided d LEFT JOIN roots r ON d.target_post_id = r.post_id LEFT JOIN users a ON r.root_author_id = a.user_id WHERE d.status = 'succeeded') d
        LEFT JOIN (VALUES {_RULES}) v(q, a, p, r, s) ON v.a = d.action AND (v.p IS NULL OR v.p = d.profile) AND (v.r IS NULL OR v.r = d.root_kind)
          AND (v.s IS NULL OR v.s = d.stance) GROUP BY ALL""",
)


def _rated(t: Logs):
    authors = t.users.select(F.col("user_id").alias("root_author_id"), F.col("community").alias("author_community"))
    d = decided(t).where("status = 'succeeded'").join(authors, "root_author_id", "left")
    relation = sc.community_relation("community", "author_community", "target_post_id")
    d = d.select(
        "decision_id", "action", "profile", F.when(F.col("root_risk").isNotNull(), sc.risk_band("root_risk")).alias("root_post"),
        F.when(F.col("action") != "quote", "not_applicable").when(F.col("decision_sequence") % 3 == 0, "challenge").otherwise("unclear").alias("stance"),
        F.when(F.col("target_post_id").isNotNull(), relation).alias("relation"),
    )
    return audit.rubric_classify(d, RUBRIC)


@query("rubric_classify", "SELECT decision_id, action, profile, stance, quality_class FROM rated", **RUBRIC_SQL)
def _(t: Logs):
    return _rated(t).select("decision_id", "action", "profile", "stance", "quality_class")


@query(
    "quality_summary",
    """SELECT stratum, value, aligned, acceptable, concerning, unscored, aligned + acceptable + concerning AS scored,
         round(aligned::DOUBLE / nullif(aligned + acceptable + concerning, 0), 6) AS aligned_rate,
         round(acceptable::DOUBLE / nullif(aligned + acceptable + concerning, 0), 6) AS acceptable_rate,
         round(concerning::DOUBLE / nullif(aligned + acceptable + concerning, 0), 6) AS concerning_rate
       FROM (SELECT stratum, value, (count(*) FILTER (quality_class = 'aligned'))::BIGINT AS aligned,
           (count(*) FILTER (quality_class = 'acceptable'))::BIGINT AS acceptable, (count(*) FILTER (quality_class = 'concerning'))::BIGINT AS concerning,
           (count(*) FILTER (quality_class = 'unscored'))::BIGINT AS unscored
         FROM (SELECT 'overall' AS stratum, NULL AS value, quality_class FROM rated UNION ALL SELECT 'relation', coalesce(relation, 'unavailable'), quality_class FROM rated
           UNION ALL SELECT 'profile', profile, quality_class FROM rated UNION ALL SELECT 'root_post', coalesce(root_kind, 'unavailable'), quality_class FROM rated
           UNION ALL SELECT 'stance', stance, quality_class FROM rated) GROUP BY 1, 2)""",
    **RUBRIC_SQL,
)
def _(t: Logs):
    out = audit.quality_summary(_rated(t), ["relation", "profile", "root_post", "stance"])
    for c in ("aligned_rate", "acceptable_rate", "concerning_rate"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "backend_quality",
    """SELECT b.backend, coalesce(scored, 0)::BIGINT AS scored, coalesce(concerning, 0)::BIGINT AS concerning_count,
         round(aligned::DOUBLE / nullif(scored, 0), 6) AS aligned_rate, round(acceptable::DOUBLE / nullif(scored, 0), 6) AS acceptable_rate,
         round(concerning::DOUBLE / nullif(scored, 0), 6) AS concerning_rate, coalesce(risky, 0)::BIGINT AS repost_high_risk_count,
         coalesce(mild, 0)::BIGINT AS report_low_risk_count
       FROM (SELECT DISTINCT run_id AS backend FROM snapshots UNION ALL SELECT 'idle') b LEFT JOIN (
         SELECT split_part(decision_id, ':', 1) AS backend, count(*) FILTER (quality_class <> 'unscored') AS scored, count(*) FILTER (quality_class = 'aligned') AS aligned,
           count(*) FILTER (quality_class = 'acceptable') AS acceptable, count(*) FILTER (quality_class = 'concerning') AS concerning,
           count(*) FILTER (action = 'repost' AND root_kind = 'high') AS risky, count(*) FILTER (action = 'report' AND root_kind = 'low') AS mild
         FROM rated GROUP BY 1) q ON q.backend = b.backend""",
    **RUBRIC_SQL,
)
def _(t: Logs):
    """Each run stands for the backend that decided in it; one backend decided nothing."""
    rows = _rated(t).withColumn("backend", F.substring_index("decision_id", ":", 1))
    backends = t.snapshots.select(F.col("run_id").alias("backend")).distinct().unionByName(t.spark.sql("SELECT 'idle' AS backend"))
    out = audit.backend_quality(rows, backends)
    for c in ("aligned_rate", "acceptable_rate", "concerning_rate"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "shape_stats",
    """SELECT h.status, h.shape, h.size::INTEGER AS size, h.decisions, round(m.mean_size, 6) AS mean_size FROM (
       SELECT status, shape, size, count(*)::BIGINT AS decisions FROM (SELECT status, 'legal_choices' AS shape, len(legal) AS size FROM snapshots
         UNION ALL SELECT status, 'feed_size', len(visible) FROM snapshots) GROUP BY 1, 2, 3) h
       JOIN (SELECT status, shape, avg(size) AS mean_size FROM (SELECT status, 'legal_choices' AS shape, len(legal) AS size FROM snapshots
         UNION ALL SELECT status, 'feed_size', len(visible) FROM snapshots) GROUP BY 1, 2) m ON h.status = m.status AND h.shape = m.shape""",
)
def _(t: Logs):
    return audit.shape_stats(t.snapshots).withColumn("mean_size", F.round("mean_size", 6))


@query(
    "repeated_root_actions",
    """SELECT d.decision_id, d.run_id, d.user_id, d.action, d.root_post_id, g.n AS decisions FROM decided d JOIN (
         SELECT run_id, user_id, action, root_post_id, count(*)::BIGINT AS n FROM decided WHERE status = 'succeeded' AND action IN ('report', 'repost')
         GROUP BY ALL HAVING count(*) > 1) g ON g.run_id = d.run_id AND g.user_id = d.user_id AND g.action = d.action AND g.root_post_id = d.root_post_id
       WHERE d.status = 'succeeded'""",
    decided=DECIDED,
)
def _(t: Logs):
    return audit.repeated_root_actions(decided(t))


ATTEMPTS = """SELECT decision_sequence AS decision_id, run_id, profile, unnest(range(1, 2 + decision_sequence % 3)) AS attempt,
    unnest(range(1, 2 + decision_sequence % 3)) = 1 + decision_sequence % 3 AND decision_sequence % 11 <> 0 AS succeeded FROM snapshots"""


@query(
    "reliability_summary",
    """SELECT run_id, count(*)::BIGINT AS logical_decisions, (count(*) FILTER (ok))::BIGINT AS completed, count(first_ok)::BIGINT AS first_attempts,
         (count(*) FILTER (first_ok))::BIGINT AS first_attempt_successes, sum(n - 1)::BIGINT AS retries, (count(*) FILTER (ok AND n > 1))::BIGINT AS retry_successes,
         (count(*) FILTER (NOT ok))::BIGINT AS unrecovered, round((count(*) FILTER (first_ok))::DOUBLE / count(first_ok), 6) AS first_attempt_success_rate,
         round((count(*) FILTER (ok))::DOUBLE / count(*), 6) AS post_retry_success_rate
       FROM (SELECT run_id, decision_id, count(*) AS n, bool_or(succeeded) AS ok, bool_or(succeeded) FILTER (attempt = 1) AS first_ok
         FROM attempts GROUP BY 1, 2) GROUP BY 1""",
    attempts=ATTEMPTS,
)
def _(t: Logs):
    s = F.col("decision_sequence")
    attempts = t.snapshots.select(
        s.alias("decision_id"), "run_id", F.explode(F.sequence(F.lit(1).cast("bigint"), 1 + s % 3)).alias("attempt")
    ).withColumn("succeeded", (F.col("attempt") == 1 + F.col("decision_id") % 3) & (F.col("decision_id") % 11 != 0))
    out = reliability.reliability_summary(attempts, ["run_id"])
    return out.withColumn("first_attempt_success_rate", F.round("first_attempt_success_rate", 6)).withColumn(
        "post_retry_success_rate", F.round("post_retry_success_rate", 6)
    )


KINDS = ("json_validate_failed", "provider_error", "call_limit_exceeded", "schema_validation_error", "choice_index_error", "semantic_mismatch", "timeout")


@query(
    "failure_accounting",
    f"""SELECT run_id, (count(*) FILTER (i IN (1, 2, 3)))::BIGINT AS provider_failure_count, (count(*) FILTER (i = 1))::BIGINT AS provider_json_validate_failed_count,
          (count(*) FILTER (i = 4))::BIGINT AS local_schema_failure_count, (count(*) FILTER (i = 5))::BIGINT AS invalid_choice_index_count,
          (count(*) FILTER (i = 6))::BIGINT AS semantic_final_failure_count, (count(*) FILTER (i = 7))::BIGINT AS dispatcher_failure_count,
          (count(*) FILTER (i IS NULL))::BIGINT AS completed_decision_count, count(i)::BIGINT AS incomplete_decision_count,
          count(i)::BIGINT AS unrecovered_logical_error_count
        FROM (SELECT run_id, CASE WHEN status = 'failed' THEN 1 + decision_sequence % {len(KINDS)} END AS i FROM snapshots) GROUP BY 1""",
)
def _(t: Logs):
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("decision_sequence") % len(KINDS)).cast("int"))
    d = t.snapshots.select("run_id", F.when(F.col("status") == "failed", kind).alias("error_kind"))
    return reliability.failure_accounting(d, ["run_id"])


STATUS_IN = """SELECT run_id, user_id, count(*) AS logical, count(*) FILTER (status = 'succeeded') AS done FROM snapshots GROUP BY 1, 2"""


@query(
    "run_status",
    """SELECT user_id, CASE WHEN len(fatal) > 0 THEN 'failed' WHEN len(soft) > 0 THEN 'degraded' ELSE 'success' END AS status,
         array_to_string(CASE WHEN len(fatal) > 0 THEN fatal ELSE soft END, ',') AS reasons FROM (SELECT user_id,
         list_filter([CASE WHEN user_id % 13 = 0 THEN 'no_successful_provider_responses' END, CASE WHEN user_id % 26 = 0 THEN 'no_impression_records' END,
           CASE WHEN user_id % 29 = 0 THEN 'governance_not_executed' END, CASE WHEN user_id % 31 = 0 THEN 'output_secret_scan_failed' END],
           lambda x: x IS NOT NULL) AS fatal,
         list_sort(list_filter([CASE WHEN done <> logical THEN 'incomplete_agent_decisions' END, CASE WHEN user_id % 5 = 0 THEN 'physical_call_limit_exceeded' END,
           CASE WHEN user_id % 7 >= 3 AND done < logical THEN 'physical_call_limit_reached_with_incomplete_decisions' END,
           CASE WHEN user_id % 11 = 0 THEN 'empty_provider_response' END, CASE WHEN user_id % 3 = 0 AND user_id % 4 <> 1 THEN 'unrecovered_provider_error' END,
           CASE WHEN user_id % 4 = 1 THEN 'unrecovered_http_429' END], lambda x: x IS NOT NULL)) AS soft FROM status_in)""",
    status_in=STATUS_IN,
)
def _(t: Logs):
    u = F.col("user_id")
    runs = t.snapshots.groupBy("run_id", "user_id").agg(
        F.count(F.lit(1)).alias("logical_decisions"), F.count_if(F.col("status") == "succeeded").alias("completed_decisions")
    )
    rows = runs.select(
        "user_id", "logical_decisions", "completed_decisions", F.when(u % 13 == 0, 0).otherwise(5).alias("provider_responses"),
        F.when(u % 26 == 0, 0).otherwise(9).alias("impressions"), (u % 29 != 0).alias("governance_executed"), (u % 31 != 0).alias("secret_free"),
        F.when(u % 4 == 1, F.array(F.lit(429), F.lit(400))).otherwise(F.array().cast("array<int>")).alias("http_statuses"),
        F.when(u % 5 == 0, 1).otherwise(0).alias("call_limit_exceeded"), (u % 7).alias("remote_attempts"), F.lit(3).alias("max_calls"),
        F.when(u % 11 == 0, 1).otherwise(0).alias("empty_responses"), F.when(u % 3 == 0, 1).otherwise(0).alias("unrecovered"),
    )
    return reliability.run_status(rows).select("user_id", "status", F.array_join("reasons", ",").alias("reasons"))


@query(
    "action_eval",
    """SELECT round((SELECT avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END) FROM (
           SELECT v.a, count(*) FILTER (label = v.a AND pred = v.a) AS tp, count(*) FILTER (label <> v.a AND pred = v.a) AS fp,
             count(*) FILTER (label = v.a AND pred <> v.a) AS fn FROM scored, (VALUES ('ignore'), ('quote'), ('report'), ('repost')) v(a) GROUP BY 1)), 6) AS action_macro_f1,
         round(avg(action_valid::INT), 6) AS json_valid_rate, round(avg((confidence - (pred = label)::INT) ** 2), 6) AS brier_score,
         round(avg(latency_seconds), 6) AS mean_inference_seconds FROM scored""",
    outputs=OUTPUTS_SQL,
    normalized=NORMALIZED_SQL,
    scored="SELECT *, CASE WHEN action_valid THEN action ELSE '__invalid__' END AS pred FROM normalized",
)
def _(t: Logs):
    out = action_eval(outputs(t).withColumnRenamed("raw", "output"))
    for c in out.columns:
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "dispatch_counters",
    """SELECT run_id, (count(*) FILTER (r = 0))::BIGINT AS dispatcher_success_count, (count(*) FILTER (r = 1))::BIGINT AS dispatcher_failure_count,
         (count(*) FILTER (r = 2))::BIGINT AS invalid_choice_count, (count(*) FILTER (r = 3))::BIGINT AS invalid_post_reference_count,
         (count(*) FILTER (r = 0 AND action = 'ignore'))::BIGINT AS ignore_count, (count(*) FILTER (r = 0 AND action = 'quote'))::BIGINT AS quote_count,
         (count(*) FILTER (r = 0 AND action = 'report'))::BIGINT AS report_count, (count(*) FILTER (r = 0 AND action = 'repost'))::BIGINT AS repost_count
       FROM (SELECT run_id, action, CASE WHEN decision_sequence % 17 = 0 THEN 1 WHEN decision_sequence % 19 = 0 THEN 2 WHEN decision_sequence % 23 = 0 THEN 3 ELSE 0 END AS r
         FROM snapshots) GROUP BY 1""",
)
def _(t: Logs):
    s = F.col("decision_sequence")
    result = F.when(s % 17 == 0, "dispatch_failed").when(s % 19 == 0, "invalid_choice").when(s % 23 == 0, "invalid_post_reference").otherwise("dispatched")
    return reliability.merge_counters(t.snapshots.select("run_id", "action", result.alias("result")), ["run_id"])


@query(
    "execution_status",
    """SELECT user_id, CASE WHEN done = logical AND lost = 0 THEN 'success' WHEN done = 0 THEN 'failed' ELSE 'degraded' END AS status,
         array_to_string(list_filter([CASE WHEN done <> logical THEN 'incomplete_decisions' END, CASE WHEN lost > 0 THEN 'unrecovered_errors' END], lambda x: x IS NOT NULL), ',') AS reasons
       FROM (SELECT user_id, count(*) AS logical, count(*) FILTER (status = 'succeeded') AS done, count(*) FILTER (status = 'failed' AND decision_sequence % 2 = 0) AS lost
         FROM snapshots GROUP BY 1)""",
)
def _(t: Logs):
    per = t.snapshots.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("logical"), F.count_if(F.col("status") == "succeeded").alias("done"),
        F.count_if((F.col("status") == "failed") & (F.col("decision_sequence") % 2 == 0)).alias("lost"),
    )
    status, reasons = reliability.execution_status("logical", "done", "lost")
    return per.select("user_id", status.alias("status"), F.array_join(reasons, ",").alias("reasons"))
