"""Queries B8, B9, B11, B12, B16, J7-J19, M17: choices and as-of links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions.ordered import prefix_scan
from ..operators import choices, linking
from ..session import cut
from .registry import query
from .views import Logs


def _joined(df, *names):
    """Arrays as comma-separated text."""
    for n in names:
        df = df.withColumn(n, F.array_join(F.transform(n, lambda x: x.cast("string")), ","))
    return df


# a choice column with every kind of defect, derived from the action rows
RAW_CHOICE = """SELECT rowid, CASE rowid % 13 WHEN 0 THEN 'ignore:5' WHEN 1 THEN 'repost' WHEN 2 THEN 'like:' || k WHEN 3 THEN 'quote:x' || k
    WHEN 4 THEN 'report:-' || k WHEN 5 THEN 'repost:0' WHEN 6 THEN 'report: ' || k ELSE choice END AS raw FROM actions"""


def _raw_choice(t: Logs):
    m, k = F.col("rowid") % 13, F.col("k").cast("string")
    raw = (
        F.when(m == 0, "ignore:5").when(m == 1, "repost").when(m == 2, F.concat(F.lit("like:"), k))
        .when(m == 3, F.concat(F.lit("quote:x"), k)).when(m == 4, F.concat(F.lit("report:-"), k)).when(m == 5, "repost:0")
        .when(m == 6, F.concat(F.lit("report: "), k)).otherwise(F.col("choice"))
    )
    return t.actions.select("rowid", raw.alias("raw"))


@query(
    "choice_parse",
    """SELECT rowid, action, target, CASE WHEN action NOT IN ('ignore', 'quote', 'report', 'repost') THEN 'unsupported action'
         WHEN action = 'ignore' AND sep THEN 'ignore with target' WHEN action <> 'ignore' AND NOT sep THEN 'missing target'
         WHEN action <> 'ignore' AND target IS NULL THEN 'target is not an integer'
         WHEN action <> 'ignore' AND target <= 0 THEN 'target is not positive' END AS error
       FROM (SELECT rowid, split_part(raw, ':', 1) AS action, contains(raw, ':') AS sep,
         CASE WHEN contains(raw, ':') THEN try_cast(trim(split_part(raw, ':', 2)) AS BIGINT) END AS target FROM raw_choice)""",
    raw_choice=RAW_CHOICE,
)
def _(t: Logs):
    return _raw_choice(t).select(
        "rowid", sc.choice_action("raw").alias("action"), sc.choice_target("raw").alias("target"), sc.choice_error("raw").alias("error")
    )


@query(
    "trace_choice",
    """SELECT rowid, CASE action WHEN 'repost' THEN 'repost:' || coalesce(info->>'$.reposted_id', info->>'$.post_id')
         WHEN 'quote_post' THEN 'quote:' || coalesce(info->>'$.quoted_id', info->>'$.post_id', info->>'$.original_post_id')
         WHEN 'report_post' THEN 'report:' || (info->>'$.post_id') ELSE 'ignore' END AS choice
       FROM trace WHERE action <> 'refresh'""",
)
def _(t: Logs):
    acts = t.trace.where("action != 'refresh'")
    return acts.select("rowid", sc.choice_id(sc.mapped_action("action"), sc.trace_target("action", "info")).alias("choice"))


@query(
    "decision_id",
    "SELECT rowid, printf('run-%d:t%06d:u%06d:d%06d', user_id % 4, timestep, user_id, rowid) AS decision_id FROM trace0",
)
def _(t: Logs):
    run = F.concat(F.lit("run-"), (F.col("user_id") % 4).cast("string"))
    return t.trace.select("rowid", sc.decision_id(run, "timestep", "user_id", "rowid").alias("decision_id"))


@query(
    "canonical_hash",
    """SELECT rowid, sha256('{"action":"' || action || '","history":[' || coalesce(list_aggregate(list_transform(history,
         lambda x: '"' || x || '"'), 'string_agg', ','), '') || '],"target":' || coalesce(target_post_id::VARCHAR, 'null')
         || ',"user_id":' || user_id || ',"visible":[' || coalesce(list_aggregate(visible, 'string_agg', ','), '') || ']}') AS hash
       FROM actions""",
)
def _(t: Logs):
    h = sc.canonical_hash(user_id="user_id", action="action", target="target_post_id", visible="visible", history="history")
    return t.actions.select("rowid", h.alias("hash"))


LEGAL_DIRECT = """SELECT rowid, array_to_string(['ignore'] || coalesce(flatten(list(opts ORDER BY post_id)), []), ',') AS legal FROM (
    SELECT a.rowid, a.post_id, list_filter([
        CASE WHEN d1.user_id IS NOT NULL OR (k.is_repost AND d2.user_id IS NOT NULL) THEN NULL ELSE 'repost:' || a.post_id END,
        'quote:' || a.post_id, CASE WHEN r1.user_id IS NOT NULL THEN NULL ELSE 'report:' || a.post_id END],
        lambda x: x IS NOT NULL) AS opts
    FROM (SELECT rowid, user_id, unnest(visible) AS post_id FROM actions) a JOIN kinds k ON a.post_id = k.post_id
    LEFT JOIN made d1 ON a.user_id = d1.user_id AND a.post_id = d1.t LEFT JOIN made d2 ON a.user_id = d2.user_id AND k.root_post_id = d2.t
    LEFT JOIN firsts_r r1 ON a.user_id = r1.user_id AND a.post_id = r1.target_post_id) GROUP BY rowid"""
MADE = "SELECT DISTINCT user_id, original_post_id AS t FROM post WHERE original_post_id IS NOT NULL"


def _decisions(t: Logs):
    return t.actions.select("rowid", "user_id", "visible")


def _direct(t: Logs):
    return choices.legal_direct(_decisions(t), t.post_kind, t.post.select("user_id", "original_post_id"), t.reports)


@query("legal_choices_direct", "SELECT rowid, legal FROM legal_direct", legal_direct=LEGAL_DIRECT, made=MADE)
def _(t: Logs):
    return _joined(_direct(t), "legal")


ROOT_ACTS = dict(
    reposted="""SELECT DISTINCT p.user_id, r.root_post_id FROM post p JOIN roots r ON p.post_id = r.post_id
        WHERE p.original_post_id IS NOT NULL AND p.quote_content IS NULL""",
    reported="SELECT DISTINCT f.user_id, r.root_post_id FROM reports f JOIN roots r ON f.target_post_id = r.post_id",
)


@query(
    "legal_choices_root",
    """SELECT rowid, array_to_string(['ignore'] || flatten(list(opts ORDER BY post_id)), ',') AS legal FROM (
       SELECT a.rowid, a.post_id, list_filter([CASE WHEN x.user_id IS NULL THEN 'repost:' || a.post_id END, 'quote:' || a.post_id,
           CASE WHEN y.user_id IS NULL THEN 'report:' || a.post_id END], lambda v: v IS NOT NULL) AS opts
       FROM (SELECT rowid, user_id, unnest(visible) AS post_id FROM actions) a JOIN roots r ON a.post_id = r.post_id
       LEFT JOIN reposted x ON x.user_id = a.user_id AND x.root_post_id = r.root_post_id
       LEFT JOIN reported y ON y.user_id = a.user_id AND y.root_post_id = r.root_post_id) GROUP BY rowid""",
    **ROOT_ACTS,
)
def _(t: Logs):
    legal = choices.legal_root(
        _decisions(t), t.roots, t.post.select("post_id", "user_id", "original_post_id", "quote_content"), t.reports
    )
    return _joined(legal, "legal")


@query(
    "prior_actions",
    """SELECT q.user_id, q.post_id, d.user_id IS NOT NULL AS has_derivation, f.user_id IS NOT NULL AS has_report
       FROM (SELECT DISTINCT user_id, k AS post_id FROM trace0) q JOIN roots r ON q.post_id = r.post_id
       LEFT JOIN (SELECT DISTINCT p.user_id, r.root_post_id FROM post p JOIN roots r ON p.post_id = r.post_id
         WHERE p.original_post_id IS NOT NULL) d ON d.user_id = q.user_id AND d.root_post_id = r.root_post_id
       LEFT JOIN firsts_r f ON f.user_id = q.user_id AND f.target_post_id = q.post_id""",
)
def _(t: Logs):
    pairs = t.trace.select("user_id", F.col("k").alias("post_id")).distinct()
    return choices.prior_actions(pairs, t.roots, t.post.select("post_id", "user_id", "original_post_id"), t.reports)


@query("legal_choices_asof", "SELECT rowid, array_to_string(legal, ',') AS legal FROM legal_asof")
def _(t: Logs):
    return _joined(choices.legal_asof(_decisions(t), t.post_kind, t.derivations, t.reports), "legal")


@query(
    "state_fingerprint",
    """SELECT a.rowid, sha256(a.user_id || '|' || coalesce(v.txt, '') || '|' || coalesce(o.n, 0) || '|' || coalesce(o.d, 0)) AS state_identifier
       FROM actions a LEFT JOIN (SELECT x.rowid, string_agg(x.post_id || ',' || p.user_id || ',' || coalesce(p.original_post_id::VARCHAR, 'null')
           || ',' || CASE WHEN p.quote_content IS NULL THEN 'plain' ELSE 'quote' END || ',' || CASE WHEN f.user_id IS NOT NULL
           THEN 'reported' ELSE 'open' END, ';' ORDER BY x.post_id) AS txt
         FROM (SELECT rowid, user_id, unnest(visible) AS post_id FROM actions) x JOIN post p ON x.post_id = p.post_id
         LEFT JOIN firsts_r f ON f.user_id = x.user_id AND f.target_post_id = x.post_id GROUP BY 1) v ON a.rowid = v.rowid
       LEFT JOIN (SELECT user_id, count(*) AS n, sum(('0x' || substr(md5(original_post_id::VARCHAR), 1, 8))::BIGINT)::BIGINT AS d
         FROM post WHERE original_post_id IS NOT NULL AND quote_content IS NULL GROUP BY 1) o ON o.user_id = a.user_id""",
)
def _(t: Logs):
    own = t.post.where("original_post_id is not null and quote_content is null").select(
        "user_id", F.col("original_post_id").alias("target_post_id")
    )
    posts = t.post.select("post_id", "user_id", "original_post_id", "quote_content")
    return choices.state_fingerprint(_decisions(t), posts, t.reports, own)


@query(
    "revalidate_choice",
    """SELECT a.rowid, CASE WHEN NOT list_contains(coalesce(l.legal, ['ignore']), a.choice) THEN 'not in the frozen choices'
         WHEN NOT list_contains(string_split(coalesce(d.legal, 'ignore'), ','), a.choice) THEN 'no longer legal' END AS reject_reason
       FROM actions a LEFT JOIN legal_asof l ON a.rowid = l.rowid LEFT JOIN legal_direct d ON a.rowid = d.rowid""",
    legal_direct=LEGAL_DIRECT,
    made=MADE,
)
def _(t: Logs):
    frozen = t.snapshots.select(F.col("action_trace_rowid").alias("rowid"), "legal", F.col("selected_choice_id").alias("choice"))
    rows = frozen.join(_direct(t).withColumnRenamed("legal", "now"), "rowid", "left")
    rows = rows.withColumn("now", F.coalesce("now", F.array(F.lit("ignore"))))
    return choices.revalidate(rows, "choice", "legal", "now").select("rowid", "reject_reason")


RESPONSES = """SELECT decision_id, legal, CASE WHEN s % 17 = 0 THEN 99 ELSE s % len(legal) END AS choice_index,
    CASE WHEN s % 19 = 0 THEN 'quote' ELSE split_part(legal[(s % len(legal)) + 1], ':', 1) END AS action_type,
    CASE WHEN s % 23 = 0 THEN 7 WHEN contains(legal[(s % len(legal)) + 1], ':')
      THEN split_part(legal[(s % len(legal)) + 1], ':', 2)::BIGINT ELSE 0 END AS target_post_id,
    CASE WHEN s % 5 = 0 THEN '' ELSE 'text' END AS quote_text
  FROM (SELECT *, decision_sequence AS s FROM snapshots)"""


def _responses(t: Logs):
    s = F.col("decision_sequence")
    picked = F.get("legal", (s % F.size("legal")).cast("int"))
    return t.snapshots.select(
        "decision_id",
        "legal",
        F.when(s % 17 == 0, F.lit(99).cast("bigint")).otherwise(s % F.size("legal")).alias("choice_index"),
        F.when(s % 19 == 0, "quote").otherwise(sc.choice_action(picked)).alias("action_type"),
        F.when(s % 23 == 0, F.lit(7).cast("bigint")).otherwise(F.coalesce(sc.choice_target(picked), F.lit(0))).alias("target_post_id"),
        F.when(s % 5 == 0, "").otherwise("text").alias("quote_text"),
    )


@query(
    "semantic_binding",
    """SELECT decision_id, indexed_choice, CASE WHEN indexed_choice IS NULL THEN 'invalid_choice_index'
         WHEN action_type <> split_part(indexed_choice, ':', 1) THEN 'choice_action_mismatch'
         WHEN target_post_id <> CASE WHEN contains(indexed_choice, ':') THEN split_part(indexed_choice, ':', 2)::BIGINT ELSE 0 END
           THEN 'choice_target_mismatch'
         WHEN action_type = 'quote' AND trim(quote_text) = '' THEN 'quote_text_contract_failure'
         WHEN action_type <> 'quote' AND quote_text <> '' THEN 'quote_text_contract_failure' END AS failure
       FROM (SELECT *, legal[choice_index + 1] AS indexed_choice FROM responses)""",
    responses=RESPONSES,
)
def _(t: Logs):
    return choices.semantic_binding(_responses(t)).select("decision_id", "indexed_choice", "failure")


@query("asof_last_feed", "SELECT rowid, user_id, refresh_id FROM ordered WHERE action <> 'refresh'")
def _(t: Logs):
    return linking.asof_last_feed(t.trace.select("rowid", "user_id", "action")).select("rowid", "user_id", "refresh_id")


GAPS = """SELECT a.rowid, a.user_id, a.timestep, a.action, count(r.rowid)::BIGINT AS candidates,
    CASE WHEN count(r.rowid) = 1 THEN min(r.rowid) END AS refresh_id
  FROM (SELECT *, coalesce(lag(rowid) OVER (PARTITION BY user_id ORDER BY rowid), -1) AS prev FROM trace0 WHERE action <> 'refresh') a
  LEFT JOIN (SELECT rowid, user_id, timestep FROM trace0 WHERE action = 'refresh') r
    ON r.user_id = a.user_id AND r.timestep = a.timestep AND r.rowid > a.prev AND r.rowid < a.rowid GROUP BY ALL"""


@query(
    "unique_refresh_match",
    "SELECT *, CASE WHEN candidates <> 1 THEN 'refresh match is not unique' END AS reason FROM gaps",
    gaps=GAPS,
)
def _(t: Logs):
    return linking.unique_refresh_match(t.trace)


LINKS = """SELECT v.rowid, v.pos, v.post_id, coalesce(x.n, 0)::BIGINT AS matches,
    CASE WHEN x.n = 1 THEN x.impression_id END AS impression_id, CASE WHEN x.n = 1 THEN x.shown END AS shown,
    CASE WHEN x.n = 1 THEN x.risk_score END AS risk_score, CASE WHEN x.n = 1 THEN x.author_community END AS author_community,
    CASE WHEN coalesce(x.n, 0) <> 1 THEN 'post ' || v.post_id || ' has ' || coalesce(x.n, 0) || ' matching impression rows'
      WHEN NOT x.shown THEN 'visible post ' || v.post_id || ' has an impression marked shown=0' END AS error
  FROM (SELECT rowid, user_id, timestep, unnest(visible) AS post_id, generate_subscripts(visible, 1) - 1 AS pos FROM actions) v
  LEFT JOIN (SELECT timestep, user_id, post_id, count(*) AS n, min(impression_id) AS impression_id, bool_and(shown) AS shown,
      min(risk_score) AS risk_score, min(author_community) AS author_community FROM impressions GROUP BY 1, 2, 3) x
    ON x.timestep = v.timestep AND x.user_id = v.user_id AND x.post_id = v.post_id"""


@query("feed_impression_link", "SELECT * REPLACE (pos::INTEGER AS pos) FROM links", links=LINKS)
def _(t: Logs):
    return linking.feed_impression_link(t.actions, t.impressions)


LABELS = """SELECT 'trace-' || rowid AS sample_id, CASE WHEN rowid % 41 = 0 THEN 'quote' ELSE action END AS action
      FROM actions WHERE rowid % 37 <> 0
    UNION ALL SELECT 'trace-' || rowid, action FROM actions WHERE rowid % 101 = 0
    UNION ALL SELECT 'trace-x' || rowid, action FROM actions WHERE rowid % 211 = 0"""


def _labels(t: Logs):
    """Labels with gaps, duplicates, strays and wrong actions."""
    a, r = t.actions.select("rowid", "action"), F.col("rowid")
    name = F.concat(F.lit("trace-"), r.cast("string"))
    return (
        a.where(r % 37 != 0).select(name.alias("sample_id"), F.when(r % 41 == 0, "quote").otherwise(F.col("action")).alias("action"))
        .unionByName(a.where(r % 101 == 0).select(name.alias("sample_id"), "action"))
        .unionByName(a.where(r % 211 == 0).select(F.concat(F.lit("trace-x"), r.cast("string")).alias("sample_id"), "action"))
    )


@query(
    "trace_label_diff",
    """SELECT sample_id, unnest(list_filter([CASE WHEN l.n IS NULL THEN 'trace_only' END, CASE WHEN a.action IS NULL THEN 'label_only' END,
         CASE WHEN l.n > 1 THEN 'duplicate_label' END, CASE WHEN a.action <> l.label THEN 'label_mismatch' END],
         lambda x: x IS NOT NULL)) AS issue
       FROM (SELECT 'trace-' || rowid AS sample_id, action FROM actions) a
       FULL JOIN (SELECT sample_id, count(*) AS n, min(action) AS label FROM labels_in GROUP BY 1) l USING (sample_id)""",
    labels_in=LABELS,
)
def _(t: Logs):
    acts = t.actions.select(F.concat(F.lit("trace-"), F.col("rowid").cast("string")).alias("sample_id"), "action")
    return linking.trace_label_diff(acts, _labels(t))


# the same facts in several spellings: other key order, blanks, an empty object written three ways
SPELLED = """SELECT user_id, timestep, action, rowid, CASE WHEN action = 'do_nothing' THEN CASE rowid % 3 WHEN 0 THEN '{}' WHEN 1 THEN ' { } ' END
    WHEN rowid % 2 = 0 THEN '{"u":1,"on":{"n":[{"x":' || (rowid % 3) || ',"y":"é\\n"}],"a":true}}'
    ELSE '{ "on" : {"a": true, "n": [ {"y":"\\u00e9\\n", "x": ' || (rowid % 3) || '} ] }, "u": 1}' END AS info
  FROM trace0 WHERE action <> 'refresh'"""


@query(
    "duplicate_actions",
    """SELECT user_id, timestep, action, info, count(*)::BIGINT AS copies, min(rowid) AS first_rowid, max(rowid) AS last_rowid
       FROM (SELECT * REPLACE (CASE WHEN info IS NULL OR json_extract(info, '$.u') IS NULL THEN '{}'
           ELSE '{"on":{"a":' || json_extract(info, '$.on.a') || ',"n":[{"x":' || json_extract(info, '$.on.n[0].x') || ',"y":"'
             || replace(json_extract_string(info, '$.on.n[0].y'), chr(10), '\\n') || '"}]},"u":' || json_extract(info, '$.u') || '}' END AS info) FROM spelled)
       GROUP BY ALL HAVING count(*) > 1""",
    spelled=SPELLED,
)
def _(t: Logs):
    r, x = F.col("rowid"), (F.col("rowid") % 3).cast("string")
    empty = F.when(r % 3 == 0, "{}").when(r % 3 == 1, " { } ")
    one = F.concat(F.lit('{"u":1,"on":{"n":[{"x":'), x, F.lit(',"y":"é\\n"}],"a":true}}'))
    other = F.concat(F.lit('{ "on" : {"a": true, "n": [ {"y":"\\u00e9\\n", "x": '), x, F.lit('} ] }, "u": 1}'))
    info = F.when(F.col("action") == "do_nothing", empty).when(r % 2 == 0, one).otherwise(other)
    return linking.duplicate_actions(t.trace.withColumn("info", info))


def _hist_sql(n: int) -> str:
    return f"""SELECT rowid, coalesce(string_agg('trace-' || rowid || ':' || action, ',') OVER (PARTITION BY user_id ORDER BY rowid
        ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), '') AS history FROM trace0"""


@query("behavior_history", _hist_sql(10))
def _(t: Logs):
    slim = t.trace.select("rowid", "user_id", "action")
    return _joined(linking.behavior_history(slim, 10).select("rowid", "history"), "history")


@query("behavior_history_newest20", _hist_sql(20))
def _(t: Logs):
    slim = t.trace.select("rowid", "user_id", "action")
    return _joined(linking.behavior_history(slim, 20).select("rowid", "history"), "history")


@query(
    "behavior_history_first50",
    """SELECT user_id, string_agg('trace-' || rowid || ':' || action, ',' ORDER BY rowid) AS history FROM (
       SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rowid) AS r FROM trace0) WHERE r <= 50 GROUP BY 1""",
)
def _(t: Logs):
    return _joined(linking.first_history(t.trace, 50), "history")


@query(
    "bind_trace",
    """SELECT d.rowid, d.user_id, d.expected, min(b.rowid) AS trace_rowid FROM (SELECT rowid, user_id,
         ['repost', 'quote_post', 'report_post', 'do_nothing'][(k % 4) + 1] AS expected FROM trace0 WHERE action = 'refresh') d
       LEFT JOIN trace0 b ON b.user_id = d.user_id AND b.action = d.expected AND b.rowid > d.rowid GROUP BY ALL""",
)
def _(t: Logs):
    names = F.array(*[F.lit(a) for a in ("repost", "quote_post", "report_post", "do_nothing")])
    asks = t.trace.where("action = 'refresh'").select("rowid", "user_id", F.get(names, (F.col("k") % 4).cast("int")).alias("expected"))
    return linking.bind_trace(asks, t.trace)


CREATED = """SELECT c.refresh_id * 2 + 1000000000 AS impression_id, c.timestep, c.own AS post_id FROM (
    SELECT rowid AS refresh_id, timestep, action, last_value(CASE WHEN action IN ('repost', 'quote_post') THEN 1000000000000 + rowid END
      IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rowid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM trace0) c
    WHERE c.action = 'refresh' AND c.own IS NOT NULL
  UNION ALL SELECT impression_id, timestep, post_id FROM impressions"""


@query(
    "repost_continuation",
    """SELECT s.rowid, s.created_post_id, count(*)::BIGINT AS later_impressions, min(i.impression_id) AS first_impression_id
       FROM (SELECT a.rowid, a.timestep, a.created_post_id FROM actions a JOIN roots r ON a.target_post_id = r.post_id
         JOIN post_risk k ON r.root_post_id = k.post_id WHERE a.action = 'repost' AND k.risk_score = 1.0) s
       JOIN own_impressions i ON i.post_id = s.created_post_id AND i.timestep > s.timestep GROUP BY 1, 2""",
    own_impressions=CREATED,
)
def _(t: Logs):
    made = F.when(F.col("created_post_id").isNotNull(), F.col("created_post_id"))
    log = t.trace.select("rowid", "user_id", "timestep", "action", F.get_json_object("info", "$.new_post_id").cast("bigint").alias("created_post_id"))
    # stored, so that the range shuffle samples numbers and not texts; other rows neither show a post nor create one
    log = cut(log).where("action = 'refresh' or created_post_id is not null")
    own = prefix_scan(log, ["user_id"], "rowid", lasts={"own": made}).where("action = 'refresh' and own is not null")
    shown = own.select((F.col("rowid") * 2 + 1000000000).alias("impression_id"), "timestep", F.col("own").alias("post_id"))
    impressions = shown.unionByName(t.impressions.select("impression_id", "timestep", "post_id"))
    roots = t.roots.select(F.col("post_id").alias("target_post_id"), "root_post_id")
    high = t.post_risk.where("risk_score = 1.0").select(F.col("post_id").alias("root_post_id"))
    samples = (
        t.actions.where("action = 'repost'").select("rowid", "timestep", "created_post_id", "target_post_id")
        .join(roots, "target_post_id").join(high, "root_post_id", "left_semi")
    )
    return linking.repost_continuation(samples, impressions)


@query(
    "decision_subset",
    """SELECT decision_id, run_id, user_id, timestep FROM snapshots s WHERE EXISTS (SELECT 1 FROM actions w
       WHERE w.action = 'report' AND w.user_id = s.user_id AND w.timestep = s.timestep)""",
)
def _(t: Logs):
    wanted = t.actions.where("action = 'report'").select("user_id", "timestep")
    rows = t.snapshots.select("decision_id", "run_id", "user_id", "timestep")
    return linking.decision_subset(rows, wanted, ["user_id", "timestep"])


@query(
    "state_fingerprint_roots",
    """SELECT a.rowid, sha256('v2|' || a.user_id || '|' || coalesce(v.txt, '') || '|' || coalesce(x.d, '0/0') || '|' || coalesce(y.d, '0/0')) AS state_identifier
       FROM actions a LEFT JOIN (SELECT x.rowid, string_agg(x.post_id || ',' || p.user_id || ',' || coalesce(p.original_post_id::VARCHAR, 'null')
           || ',' || CASE WHEN p.quote_content IS NULL THEN 'plain' ELSE 'quote' END || ',' || r.root_post_id, ';' ORDER BY x.post_id) AS txt
         FROM (SELECT rowid, unnest(visible) AS post_id FROM actions) x JOIN post p ON x.post_id = p.post_id JOIN roots r ON r.post_id = x.post_id GROUP BY 1) v
         ON a.rowid = v.rowid
       LEFT JOIN (SELECT user_id, count(*) || '/' || sum(('0x' || substr(md5(root_post_id::VARCHAR), 1, 8))::BIGINT) AS d FROM reposted GROUP BY 1) x ON x.user_id = a.user_id
       LEFT JOIN (SELECT user_id, count(*) || '/' || sum(('0x' || substr(md5(root_post_id::VARCHAR), 1, 8))::BIGINT) AS d FROM reported GROUP BY 1) y ON y.user_id = a.user_id""",
    **ROOT_ACTS,
)
def _(t: Logs):
    posts = t.post.select("post_id", "user_id", "original_post_id", "quote_content")
    return choices.root_fingerprint(_decisions(t), posts, t.roots, t.reports, protocol="v2")


# two attempts per decision: the second repeats the choice with the mistakes of every third taken out
CHECKED = """SELECT decision_id, run_id, attempt, CASE WHEN indexed_choice IS NULL THEN 'invalid_choice_index'
      WHEN fixed THEN NULL WHEN action_type <> split_part(indexed_choice, ':', 1) THEN 'choice_action_mismatch'
      WHEN target_post_id <> CASE WHEN contains(indexed_choice, ':') THEN split_part(indexed_choice, ':', 2)::BIGINT ELSE 0 END THEN 'choice_target_mismatch'
      WHEN action_type = 'quote' AND quote_text = '' THEN 'quote_text_contract_failure' WHEN action_type <> 'quote' AND quote_text <> '' THEN 'quote_text_contract_failure' END AS failure
    FROM (SELECT r.*, legal[choice_index + 1] AS indexed_choice, split_part(r.decision_id, ':', 1) AS run_id, attempt,
      attempt = 2 AND right(r.decision_id, 6)::BIGINT % 3 = 0 AS fixed FROM responses r, (VALUES (1), (2)) v(attempt))"""


def _attempts(t: Logs):
    checked = choices.semantic_binding(_responses(t))
    number = F.substring_index("decision_id", ":d", -1).cast("bigint")
    tries = checked.select("decision_id", "failure", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    semantic = F.col("failure") != "invalid_choice_index"
    return tries.withColumn("failure", F.when((F.col("attempt") == 2) & (number % 3 == 0) & semantic, F.lit(None)).otherwise(F.col("failure")))


@query(
    "semantic_audit_metrics",
    """SELECT run_id, sum(a + b + c)::BIGINT AS semantic_failures, sum(a)::BIGINT AS choice_action_mismatch, sum(b)::BIGINT AS choice_target_mismatch,
         sum(c)::BIGINT AS quote_text_contract_failure, (count(*) FILTER (first_bad < last))::BIGINT AS corrections,
         (count(*) FILTER (first_bad < last AND ends_well))::BIGINT AS corrections_succeeded,
         (count(*) FILTER (first_bad < last AND NOT ends_well))::BIGINT AS corrections_failed
       FROM (SELECT run_id, decision_id, count(*) FILTER (failure = 'choice_action_mismatch') AS a, count(*) FILTER (failure = 'choice_target_mismatch') AS b,
           count(*) FILTER (failure = 'quote_text_contract_failure') AS c, min(attempt) FILTER (failure IS NOT NULL AND failure <> 'invalid_choice_index') AS first_bad,
           max(attempt) AS last, bool_and(failure IS NULL) FILTER (attempt = 2) AS ends_well FROM checked GROUP BY 1, 2) GROUP BY 1""",
    responses=RESPONSES,
    checked=CHECKED,
)
def _(t: Logs):
    return choices.semantic_metrics(_attempts(t).withColumn("run_id", F.substring_index("decision_id", ":", 1)), ["run_id"])


@query(
    "semantic_inconsistent_successes",
    """SELECT run_id, count(*)::BIGINT AS succeeded, (count(*) FILTER (NOT coalesce(ok, false)))::BIGINT AS semantic_inconsistent_successes
       FROM snapshots s LEFT JOIN (SELECT decision_id, arg_max(failure IS NULL, attempt) AS ok FROM checked WHERE decision_id NOT LIKE '%7' GROUP BY 1) c
         ON c.decision_id = s.decision_id WHERE s.status = 'succeeded' GROUP BY 1""",
    responses=RESPONSES,
    checked=CHECKED,
)
def _(t: Logs):
    """Some successes have no response on record."""
    return choices.inconsistent_successes(t.snapshots, _attempts(t).where("decision_id not like '%7'"))
