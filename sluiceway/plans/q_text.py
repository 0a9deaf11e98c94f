"""Queries T1-T8: text operators over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .registry import query
from .views import Logs

# Fake keys and wording put into every few texts, on both sides, so that the rare
# patterns occur; joined from pieces so that no key-like literal stands in the source.
KEY_TAIL = "A1b2C3d4E5f6G7"
SPIKED_SQL = f"""SELECT text_id, n, text || CASE n % 8 WHEN 0 THEN ' gsk' || '_{KEY_TAIL}' WHEN 1 THEN ' SK' || '-{KEY_TAIL}'
    WHEN 2 THEN ' hf' || '_{KEY_TAIL}' WHEN 3 THEN ' call +31 20 555 01 99 or a.b@mail.example' WHEN 4 THEN ' sk' || '-{KEY_TAIL}'
    ELSE '' END AS text FROM (SELECT text_id, text, length(text) AS n FROM texts)"""


def _spiked(t: Logs):
    n = F.length("text")
    tail = (
        F.when(n % 8 == 0, " gsk" + "_" + KEY_TAIL).when(n % 8 == 1, " SK" + "-" + KEY_TAIL).when(n % 8 == 2, " hf" + "_" + KEY_TAIL)
        .when(n % 8 == 3, " call +31 20 555 01 99 or a.b@mail.example").when(n % 8 == 4, " sk" + "-" + KEY_TAIL).otherwise("")
    )
    return t.texts.select("text_id", n.cast("bigint").alias("n"), F.concat("text", tail).alias("text"))


@query(
    "secret_scan",
    """SELECT count(*)::BIGINT AS texts, (count(*) FILTER (regexp_matches(text, '(?i)(?:gsk_|sk-|hf_)[A-Za-z0-9_-]{12,}')))::BIGINT AS flagged,
         sum(len(regexp_extract_all(text, 'gsk_[A-Za-z0-9_-]{12,}')))::BIGINT AS gsk,
         sum(len(regexp_extract_all(text, 'sk-[A-Za-z0-9_-]{12,}')))::BIGINT AS sk,
         sum(len(regexp_extract_all(text, 'hf_[A-Za-z0-9]{12,}')))::BIGINT AS hf,
         (count(*) FILTER (regexp_matches(text, '(?i)(?:gsk_|sk-|hf_)[A-Za-z0-9_-]{12,}'))) = 0 AS passed FROM spiked""",
    spiked=SPIKED_SQL,
)
def _(t: Logs):
    rows = _spiked(t)
    return rows.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(tx.has_key("text")).alias("flagged"),
        *[F.sum(c.cast("bigint")).alias(name) for name, c in tx.key_counts("text").items()],
        (F.count_if(tx.has_key("text")) == 0).alias("passed"),
    )


REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(text,
      '(?:gsk_[A-Za-z0-9_-]{12,}|sk-[A-Za-z0-9_-]{12,})', '[REDACTED_SECRET]', 'g'),
      '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[REDACTED_EMAIL]', 'g'),
      '\+?\d[\d ()-]{7,}\d', '[REDACTED_PHONE]', 'g')"""


@query("redact_sensitive", f"SELECT text_id, sha256({REDACTED}) AS redacted, {REDACTED} <> text AS changed FROM spiked", spiked=SPIKED_SQL)
def _(t: Logs):
    clean = tx.redact("text")
    return _spiked(t).select("text_id", F.sha2(clean, 256).alias("redacted"), (clean != F.col("text")).alias("changed"))


# wording of every stance, spread over the texts by their length
PHRASES = (
    "", "this claim is false", "is this true", "confirmed by many", "[stance:challenge] why", "[stance:correct] see source",
    "[stance:support] sharing", "verified benign update", "high-risk and unverified", "strategy alpha", "the risk_score is low",
    "the appropriate action is to report post #5", "action should be quote; repost: 7", "my own original post repost:3",
)
_P = ", ".join("'" + p + "'" for p in PHRASES)
WORDED_SQL = f"""SELECT text_id, n, lower(text || ' ' || p) AS low, text || ' ' || p AS reason, action, risk FROM (
    SELECT text_id, n, text, [{_P}][(n % {len(PHRASES)}) + 1] AS p, ['ignore', 'quote', 'report', 'repost'][((n // 3) % 4) + 1] AS action,
      [NULL, 0.0, 0.5, 0.9][((n // 5) % 4) + 1]::DOUBLE AS risk
    FROM (SELECT text_id, text, length(text) AS n FROM texts))"""


def _worded(t: Logs):
    n = F.length("text").cast("bigint")

    def nth(values, i):
        return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))

    return t.texts.select(
        "text_id",
        n.alias("n"),
        F.concat("text", F.lit(" "), nth(PHRASES, n % len(PHRASES))).alias("reason"),
        nth(("ignore", "quote", "report", "repost"), F.floor(n / 3) % 4).alias("action"),
        nth((None, 0.0, 0.5, 0.9), F.floor(n / 5) % 4).cast("double").alias("risk"),
    )


def _any(col: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({col}, '{x}')" for x in tokens) + ")"


QUOTE_STANCE = f"""CASE WHEN {_any('low', tx.CORRECTIVE)} THEN 'corrective' WHEN {_any('low', tx.QUESTIONING)} THEN 'questioning'
    WHEN {_any('low', tx.SUPPORTIVE)} THEN 'supportive' ELSE 'unclear' END"""


@query("quote_stance", f"SELECT text_id, {QUOTE_STANCE} AS stance FROM worded", worded=WORDED_SQL)
def _(t: Logs):
    return _worded(t).select("text_id", tx.quote_stance("reason").alias("stance"))


@query(
    "rationale_stance",
    f"""SELECT text_id, CASE WHEN action <> 'quote' THEN 'not_applicable' WHEN a + b + c <> 1 THEN 'unclear' WHEN a = 1 THEN 'challenge'
          WHEN b = 1 THEN 'correct' ELSE 'support' END AS stance FROM (SELECT text_id, action, {_any('low', tx.STANCE_CHALLENGE)}::INT AS a,
          {_any('low', tx.STANCE_CORRECT)}::INT AS b, {_any('low', tx.STANCE_SUPPORT)}::INT AS c FROM worded)""",
    worded=WORDED_SQL,
)
def _(t: Logs):
    return _worded(t).select("text_id", tx.rationale_stance("action", "reason").alias("stance"))


DECLARED = "list_filter(['ignore', 'quote', 'report', 'repost'], lambda a: contains(s, 'appropriate action is to ' || a) OR contains(s, 'appropriate action is ' || a) OR contains(s, 'action should be ' || a))"


@query(
    "rationale_quality",
    rf"""SELECT text_id, length(s) = 0 AS empty, length(s) > 0 AND (length(s) < 20 OR len(regexp_split_to_array(s, '\s+')) < 4) AS too_short,
          len(declared) > 0 AND NOT list_contains(declared, action) AS action_contradiction,
          array_to_string(refs, ',') AS refs, array_to_string(list_sort(list_distinct(list_filter(refs, lambda x: x NOT IN (3, 5))
            || CASE WHEN action <> 'ignore' THEN list_filter(explicit, lambda x: x <> 3) ELSE [] END)), ',') AS wrong_refs,
          action <> 'ignore' AND contains(s, 'own original post') AS factual_author_mismatch
        FROM (SELECT *, {DECLARED} AS declared,
            list_sort(list_distinct(list_transform(regexp_extract_all(s, '(?:post\s*#?|repost:)\s*(\d+)', 1), lambda x: x::BIGINT))) AS refs,
            list_transform(regexp_extract_all(s, 'repost:\s*(\d+)', 1), lambda x: x::BIGINT) AS explicit
          FROM (SELECT text_id, action, trim(low) AS s FROM worded))""",
    worded=WORDED_SQL,
)
def _(t: Logs):
    rows = _worded(t)
    target = F.when(F.col("action") != "ignore", F.lit(3).cast("bigint"))
    visible = F.array(F.lit(3), F.lit(5)).cast("array<bigint>")
    rows = tx.with_features(rows, "reason", "f")
    q = tx.rationale_flags(F.col("f"), "action", target, visible, F.lit(1), F.lit(2))

    def text(c):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")

    return rows.select(
        "text_id", q["empty"].alias("empty"), q["too_short"].alias("too_short"), q["action_contradiction"].alias("action_contradiction"),
        text(q["referenced_post_ids"]).alias("refs"), text(q["wrong_post_reference_ids"]).alias("wrong_refs"),
        q["factual_author_mismatch"].alias("factual_author_mismatch"),
    )


@query(
    "rationale_fact_check",
    rf"""SELECT text_id, CASE WHEN risk IS NULL THEN NULL ELSE NOT ((risk >= 0.7 AND {_any('low', tx.SAYS_LOW)} AND action <> 'quote')
            OR (risk <= 0.3 AND {_any('low', tx.SAYS_HIGH)})) END AS consistent,
          array_to_string(list_filter([
            CASE WHEN risk >= 0.7 AND action = 'repost' AND {_any('low', tx.SAYS_LOW_STRICT)} THEN 'high_risk_target_described_as_benign' END,
            CASE WHEN risk <= 0.3 AND {_any('low', tx.SAYS_HIGH_STRICT)} THEN 'low_risk_target_described_as_high_risk' END,
            CASE WHEN len(users_named) > 0 AND NOT list_contains(users_named, 4) THEN 'selected_post_author_relation_error' END],
            lambda x: x IS NOT NULL), ',') AS reasons
        FROM (SELECT *, list_transform(regexp_extract_all(reason || CASE WHEN n % 4 = 0 THEN ' by User 4' WHEN n % 4 = 1 THEN ' by user 5' ELSE '' END,
            '(?i)\buser\s+(\d+)\b', 1), lambda x: x::BIGINT) AS users_named FROM worded)""",
    worded=WORDED_SQL,
)
def _(t: Logs):
    rows = _worded(t)
    named = F.concat("reason", F.when(F.col("n") % 4 == 0, " by User 4").when(F.col("n") % 4 == 1, " by user 5").otherwise(""))
    reasons = tx.factual_reasons("action", "risk", named, F.lit(4).cast("bigint"))
    rows = tx.with_features(rows, "reason")
    return rows.select(
        "text_id", tx.consistent_with(F.col("action"), F.col("risk"), F.col("features")).alias("consistent"), F.array_join(reasons, ",").alias("reasons")
    )


# outputs with every kind of defect, one per action row
OUTPUTS_SQL = """SELECT rowid, action AS label, k / 100.0::DOUBLE AS latency_seconds, CASE
    WHEN rowid % 17 = 0 THEN 'not json' WHEN rowid % 19 = 0 THEN '[1,2]' WHEN rowid % 23 = 0 THEN '{"action":"like","confidence":0.5,"reason":"x"}'
    WHEN rowid % 29 = 0 THEN '{"action":"report","confidence":1.5,"reason":"x"}' WHEN rowid % 31 = 0 THEN '{"action":"report","confidence":0.5}'
    WHEN rowid % 37 = 0 THEN '{"action":"report","confidence":"0.5","reason":"x"}'
    WHEN rowid % 41 = 0 THEN '{"action":"report","confidence":0.5,"reason":"x","note":1}'
    WHEN rowid % 43 = 0 THEN '{"action":"ignore","confidence":1,"reason":"whole number"}'
    ELSE '{"action":"' || CASE WHEN rowid % 5 = 0 THEN nxt ELSE action END || '","confidence":0.' || (rowid % 90 + 10) || ',"reason":"r' || rowid || '"}' END AS raw
  FROM (SELECT *, CASE action WHEN 'ignore' THEN 'quote' WHEN 'quote' THEN 'report' WHEN 'report' THEN 'repost' ELSE 'ignore' END AS nxt FROM actions)"""
NORMALIZED_SQL = """SELECT rowid, label, latency_seconds, json_ok AS json_valid, ok AS action_valid, CASE WHEN ok THEN NULL WHEN NOT json_ok THEN 'invalid_json'
      WHEN NOT act THEN 'invalid_action' ELSE 'invalid_schema' END AS failure_reason,
    CASE WHEN ok THEN j->>'$.action' ELSE 'ignore' END AS action, CASE WHEN ok THEN (j->>'$.confidence')::DOUBLE ELSE 0.0::DOUBLE END AS confidence
  FROM (SELECT *, json_ok AND act AND coalesce(list_sort(json_keys(j)) = ['action', 'confidence', 'reason'] AND json_type(j, '$.reason') = 'VARCHAR'
      AND json_type(j, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND try_cast(j->>'$.confidence' AS DOUBLE) BETWEEN 0 AND 1, false) AS ok
    FROM (SELECT *, json_ok AND coalesce(json_type(j) = 'OBJECT' AND (j->>'$.action') IN ('ignore', 'quote', 'report', 'repost'), false) AS act
      FROM (SELECT *, json_valid(raw) AS json_ok, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM outputs)))"""


def outputs(t: Logs):
    r, n = F.col("rowid"), F.col("rowid").cast("string")
    nxt = (
        F.when(F.col("action") == "ignore", "quote").when(F.col("action") == "quote", "report")
        .when(F.col("action") == "report", "repost").otherwise("ignore")
    )
    good = F.concat(
        F.lit('{"action":"'), F.when(r % 5 == 0, nxt).otherwise(F.col("action")), F.lit('","confidence":0.'),
        (r % 90 + 10).cast("string"), F.lit(',"reason":"r'), n, F.lit('"}'),
    )
    raw = (
        F.when(r % 17 == 0, "not json").when(r % 19 == 0, "[1,2]").when(r % 23 == 0, '{"action":"like","confidence":0.5,"reason":"x"}')
        .when(r % 29 == 0, '{"action":"report","confidence":1.5,"reason":"x"}').when(r % 31 == 0, '{"action":"report","confidence":0.5}')
        .when(r % 37 == 0, '{"action":"report","confidence":"0.5","reason":"x"}')
        .when(r % 41 == 0, '{"action":"report","confidence":0.5,"reason":"x","note":1}')
        .when(r % 43 == 0, '{"action":"ignore","confidence":1,"reason":"whole number"}').otherwise(good)
    )
    return t.actions.select("rowid", F.col("action").alias("label"), (F.col("k") / 100.0).alias("latency_seconds"), raw.alias("raw"))


@query(
    "normalize_action",
    "SELECT rowid, json_valid, action_valid, failure_reason, action, round(confidence, 6) AS confidence FROM normalized",
    outputs=OUTPUTS_SQL,
    normalized=NORMALIZED_SQL,
)
def _(t: Logs):
    n = tx.normalize_action("raw")
    return outputs(t).select(
        "rowid", *[n[c].alias(c) for c in ("json_valid", "action_valid", "failure_reason", "action")],
        F.round(n["confidence"], 6).alias("confidence"),
    )


@query(
    "action_validity_rates",
    """SELECT count(*)::BIGINT AS total, round(avg(json_valid::INT), 6) AS json_valid_rate, round(avg(action_valid::INT), 6) AS action_valid_rate
       FROM normalized""",
    outputs=OUTPUTS_SQL,
    normalized=NORMALIZED_SQL,
)
def _(t: Logs):
    n = tx.normalize_action("raw")
    return outputs(t).agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg(n["json_valid"].cast("int")), 6).alias("json_valid_rate"),
        F.round(F.avg(n["action_valid"].cast("int")), 6).alias("action_valid_rate"),
    )


@query(
    "prompt_isolation",
    f"SELECT text_id FROM worded WHERE {_any('low', tx.INTERNAL_TERMS)} OR contains(low, 'strategy alpha') OR contains(low, action || ' post')",
    worded=WORDED_SQL,
)
def _(t: Logs):
    isolated = tx.prompt_isolated("reason", F.lit("Strategy Alpha"), F.concat("action", F.lit(" post")))
    return _worded(t).where(~isolated).select("text_id")
