"""The derived views once more, as DuckDB SQL, for the side-by-side check."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "cnt": "SELECT count(*)::BIGINT AS n FROM customer",
    "posts_n": "SELECT count(*)::BIGINT AS np FROM documents",
    "users": """SELECT c_custkey AS user_id, 'community-' || n_regionkey::VARCHAR AS community
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "follow": "SELECT o_custkey AS follower_id, (o_orderkey * 7 + 3) % n AS followee_id FROM orders, cnt",
    "trace0": """SELECT event_id AS rowid, user_id,
          date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS timestep,
          CASE event_type WHEN 'view' THEN 'refresh' WHEN 'click' THEN 'repost' WHEN 'purchase' THEN 'quote_post'
            WHEN 'error' THEN 'report_post' WHEN 'signup' THEN 'do_nothing' END AS action,
          json_extract_string(props, '$.k')::BIGINT AS k, ts
        FROM events""",
    "trace": """SELECT trace0.*, CASE
          WHEN action = 'refresh' AND rowid % 29 = 0 THEN '{"posts":[],"message":"No posts passed exposure policy."}'
          WHEN action = 'refresh' AND rowid % 31 = 0 THEN '{"posts":[]}'
          WHEN action = 'refresh' THEN '{"posts":[{"post_id":' || k || '},{"post_id":' || ((k + 1 + rowid % (np - 1)) % np) || '}]}'
          WHEN action = 'repost' THEN '{"reposted_id":' || k || ',"new_post_id":' || (1000000000000 + rowid) || '}'
          WHEN action = 'quote_post' THEN '{"quoted_id":' || k || ',"new_post_id":' || (1000000000000 + rowid) || '}'
          WHEN action = 'report_post' THEN '{"post_id":' || k || ',"report_id":' || rowid || '}'
          ELSE '{}' END AS info FROM trace0, posts_n""",
    "post": """SELECT doc_id AS post_id, (doc_id * 17) % n AS user_id,
          CASE WHEN doc_id % 5 <> 0 THEN doc_id // 2 END AS original_post_id,
          CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN text END AS quote_content,
          coalesce(text, '') AS content,
          (doc_id * 13) % 50 AS num_likes, (doc_id * 3) % 7 AS num_dislikes, (doc_id * 5) % 11 AS num_shares,
          (doc_id * 11) % 6 AS num_reports, doc_id % 30 AS created_at
        FROM documents, cnt
        UNION ALL
        SELECT 1000000000000 + rowid, user_id, k, CASE WHEN action = 'quote_post' THEN 'quote ' || rowid END, '',
          (rowid * 13) % 50, (rowid * 3) % 7, (rowid * 5) % 11, (rowid * 11) % 6, timestep
        FROM trace0 WHERE action IN ('repost', 'quote_post')""",
    "walk": """SELECT post_id, user_id, post_id AS root_post_id, user_id AS root_author_id, 0::BIGINT AS depth
        FROM post WHERE original_post_id IS NULL
        UNION ALL
        SELECT p.post_id, p.user_id, w.root_post_id, w.root_author_id, w.depth + 1
        FROM post p JOIN walk w ON p.original_post_id = w.post_id""",
    "roots": "SELECT * FROM walk",
    "post_risk": """SELECT d.doc_id AS post_id, CASE WHEN toxic = 1 THEN 0.9::DOUBLE WHEN toxic = 0 THEN 0.0::DOUBLE
          WHEN d.doc_id % 10 = 5 THEN 1.0::DOUBLE WHEN d.doc_id % 20 = 10 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS risk_score
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "labelled_risk": """SELECT doc_id AS post_id, CASE WHEN toxic = 1 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS risk_score
        FROM labels""",
    "rec": "SELECT DISTINCT user_id, k AS post_id FROM trace0 WHERE action = 'refresh'",
    "texts": """SELECT 'doc-' || doc_id AS text_id, text FROM documents
        UNION ALL SELECT 'conv-' || conv_id || '-' || turn, text FROM conversations""",
    "candidates": """SELECT rowid AS refresh_id, 'run-' || (user_id % 4) AS run_id, timestep, user_id,
          r AS rank, CASE WHEN r = 0 THEN k ELSE (k + 1 + rowid % (np - 1)) % np END AS post_id, 1.0::DOUBLE / (r + 1) AS base_score,
          'recommendation' AS source
        FROM trace0, posts_n, (VALUES (0::BIGINT), (1::BIGINT)) v(r)
        WHERE action = 'refresh' AND rowid % 29 <> 0 AND rowid % 31 <> 0""",
    "impressions": """SELECT *, shown_u < keep_probability AS shown FROM (
          SELECT *, 1.0::DOUBLE - risk_score * (1.0::DOUBLE - CASE WHEN user_community = author_community
              THEN omega_intra ELSE omega_inter END) AS keep_probability,
            ('0x' || substr(md5('7|' || timestep || '|' || user_id || '|' || root_post_id), 1, 8))::BIGINT
              / 4294967296.0::DOUBLE AS shown_u
          FROM (SELECT c.*, r.root_post_id, r.root_author_id, u.community AS user_community, a.community AS author_community,
              coalesce(k1.risk_score, k2.risk_score) AS risk_score, 0.65::DOUBLE AS omega_intra, 0.3::DOUBLE AS omega_inter,
              c.refresh_id * 2 + c.rank AS impression_id
            FROM candidates c JOIN roots r ON c.post_id = r.post_id JOIN users u ON c.user_id = u.user_id
            JOIN users a ON r.root_author_id = a.user_id
            LEFT JOIN post_risk k1 ON r.root_post_id = k1.post_id LEFT JOIN post_risk k2 ON c.post_id = k2.post_id))""",
    "ordered": """SELECT *, last_value(CASE WHEN action = 'refresh' THEN rowid END IGNORE NULLS) OVER (
          PARTITION BY user_id ORDER BY rowid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS refresh_id,
          coalesce(list('trace-' || rowid || ':' || action) OVER (
          PARTITION BY user_id ORDER BY rowid ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS history
        FROM trace""",
    "feeds": """SELECT refresh_id, list(post_id ORDER BY rank) AS visible FROM candidates GROUP BY refresh_id""",
    "actions": """SELECT o.rowid, o.user_id, o.timestep, o.action AS trace_action,
          CASE o.action WHEN 'repost' THEN 'repost' WHEN 'quote_post' THEN 'quote' WHEN 'report_post' THEN 'report'
            ELSE 'ignore' END AS action,
          CASE WHEN o.action <> 'do_nothing' THEN o.k END AS target_post_id,
          CASE o.action WHEN 'repost' THEN 'repost:' || o.k WHEN 'quote_post' THEN 'quote:' || o.k
            WHEN 'report_post' THEN 'report:' || o.k ELSE 'ignore' END AS choice,
          CASE WHEN o.action IN ('repost', 'quote_post') THEN 1000000000000 + o.rowid END AS created_post_id,
          o.refresh_id, coalesce(f.visible, []) AS visible,
          CASE WHEN o.refresh_id % 29 = 0 THEN 'No posts passed exposure policy.' END AS feed_message,
          o.history, o.k
        FROM ordered o LEFT JOIN feeds f ON o.refresh_id = f.refresh_id WHERE o.action <> 'refresh'""",
    "derivations": "SELECT user_id, k AS target_post_id, rowid FROM trace0 WHERE action IN ('repost', 'quote_post')",
    "reports": "SELECT user_id, k AS target_post_id, rowid FROM trace0 WHERE action = 'report_post'",
    "kinds": """SELECT p.post_id, r.root_post_id, p.original_post_id IS NOT NULL AND p.quote_content IS NULL AS is_repost
        FROM post p JOIN roots r ON p.post_id = r.post_id""",
    "firsts_d": "SELECT user_id, target_post_id, min(rowid) AS f FROM derivations GROUP BY ALL",
    "firsts_r": "SELECT user_id, target_post_id, min(rowid) AS f FROM reports GROUP BY ALL",
    "legal_asof": """SELECT rowid, ['ignore'] || flatten(list(opts ORDER BY post_id)) AS legal FROM (
          SELECT a.rowid, a.post_id, list_filter([
              CASE WHEN coalesce(d1.f < a.rowid, false) OR (k.is_repost AND coalesce(d2.f < a.rowid, false))
                THEN NULL ELSE 'repost:' || a.post_id END, 'quote:' || a.post_id,
              CASE WHEN coalesce(r1.f < a.rowid, false) THEN NULL ELSE 'report:' || a.post_id END],
              lambda x: x IS NOT NULL) AS opts
          FROM (SELECT rowid, user_id, unnest(visible) AS post_id FROM actions) a JOIN kinds k ON a.post_id = k.post_id
          LEFT JOIN firsts_d d1 ON a.user_id = d1.user_id AND a.post_id = d1.target_post_id
          LEFT JOIN firsts_d d2 ON a.user_id = d2.user_id AND k.root_post_id = d2.target_post_id
          LEFT JOIN firsts_r r1 ON a.user_id = r1.user_id AND a.post_id = r1.target_post_id)
        GROUP BY rowid""",
    "snapshots": """SELECT printf('run-%d:t%06d:u%06d:d%06d', a.user_id % 4, a.timestep, a.user_id, a.rowid) AS decision_id,
          'run-' || (a.user_id % 4) AS run_id, a.user_id, a.timestep, a.rowid AS decision_sequence,
          a.rowid AS action_trace_rowid, a.action, a.target_post_id, a.choice AS selected_choice_id, a.refresh_id, a.visible,
          a.feed_message, coalesce(l.legal, ['ignore']) AS legal, a.history, u.community,
          ['verifier', 'benign-sharer', 'contextualizer', 'cautious', 'balanced'][(a.user_id % 5) + 1] AS profile,
          CASE WHEN a.rowid % 11 = 0 THEN 'failed' ELSE 'succeeded' END AS status, a.k
        FROM actions a LEFT JOIN legal_asof l ON a.rowid = l.rowid LEFT JOIN users u ON a.user_id = u.user_id""",
    "runs": """SELECT l_returnflag AS condition, (l_linenumber % 5)::BIGINT AS baseline, l_suppkey % 10 AS seed,
          count(*)::DOUBLE AS exposures, (count(*) FILTER (l_discount > 0.05))::DOUBLE AS reposts,
          round(avg(l_tax), 9) AS coverage, round(avg(l_discount), 9) AS benign_loss,
          round(sum(l_quantity) / 100, 6) AS cost, round(avg((l_quantity % 10) / 10), 9) AS measured_mu,
          (count(*) FILTER (l_tax > 0.04))::DOUBLE AS cascade_size
        FROM lineitem GROUP BY ALL""",
    "grid_cells": """SELECT l_returnflag AS condition, (l_partkey % 5)::BIGINT AS pair, l_suppkey % 10 AS seed,
          count(*)::DOUBLE AS exposures, (count(*) FILTER (l_discount > 0.05))::DOUBLE AS reposts,
          round(avg(l_tax), 9) AS coverage, round(avg(l_discount), 9) AS benign_loss,
          round(sum(l_quantity) / 100, 6) AS cost, round(avg((l_quantity % 10) / 10), 9) AS measured_mu,
          (count(*) FILTER (l_tax > 0.04))::DOUBLE AS cascade_size
        FROM lineitem GROUP BY ALL""",
    "grid_runs": """SELECT *, [0.2, 0.4, 0.6, 0.8, 1.0][pair + 1]::DOUBLE AS omega_intra,
          [1.0, 0.8, 0.6, 0.4, 0.2][pair + 1]::DOUBLE AS omega_inter FROM grid_cells""",
    "edges": """SELECT DISTINCT least(follower_id, followee_id) AS src, greatest(follower_id, followee_id) AS dst
        FROM follow WHERE follower_id <> followee_id""",
    "contacts": "SELECT src AS user_id, dst AS neighbor_id FROM edges UNION ALL SELECT dst, src FROM edges",
    "adopters": """SELECT DISTINCT r.root_post_id, r.user_id, u.community AS root_community
        FROM roots r LEFT JOIN users u ON r.root_author_id = u.user_id""",
}


def _needed(body: str, extra: dict[str, str]) -> list[str]:
    """Names used by ``body``, directly or through other views, dependencies first."""
    known = {**VIEWS, **extra}
    seen: set[str] = set()
    order: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"[a-z_0-9]+", text)) & known.keys()):
            if name not in seen:
                seen.add(name)
                visit(known[name])
                order.append(name)

    visit(body)
    return order


def with_views(body: str, **extra: str) -> str:
    """Prefix ``body`` with the views it uses (``extra`` adds views of its own)."""
    known = {**VIEWS, **extra}
    parts = [f"{n} AS ({known[n]})" for n in _needed(body, extra)]
    if not parts:
        return body
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
