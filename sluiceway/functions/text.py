"""Text operators over whole text columns, all as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scalar import ACTIONS, _c

# ---- fixed values -------------------------------------------------------
KEY_PREFIX_PATTERNS = {
    "gsk": "gsk_[A-Za-z0-9_-]{12,}",
    "sk": "sk-[A-Za-z0-9_-]{12,}",
    "hf": "hf_[A-Za-z0-9]{12,}",
}
KEY_PATTERN = "(?i)(?:gsk_|sk-|hf_)[A-Za-z0-9_-]{12,}"
REDACT_KEY = "(?:gsk_[A-Za-z0-9_-]{12,}|sk-[A-Za-z0-9_-]{12,})"
REDACT_EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
REDACT_PHONE = r"(?U)(?<!\d)(?:\+?\d[\d ()-]{7,}\d)(?!\d)"
CORRECTIVE = ("correct", "fact-check", "fact check", "misleading", "false", "unverified", "evidence")
QUESTIONING = ("?", "question", "verify", "uncertain", "is this true")
SUPPORTIVE = ("support", "agree", "confirmed", "is true", "amplify")
STANCE_CHALLENGE = ("[stance:challenge]", "question", "unverified", "doubt")
STANCE_CORRECT = ("[stance:correct]", "correct", "fact-check", "verified source")
STANCE_SUPPORT = ("[stance:support]", "support", "amplify", "agree")
SAYS_HIGH = ("high-risk", "unverified", "risky")
SAYS_LOW = ("verified benign", "benign update", "benign weather", "low-risk")
SAYS_HIGH_STRICT = ("high-risk", "high‑risk", "unverified", "misinformation")
SAYS_LOW_STRICT = ("verified benign", "benign weather")
# {} stands for an action
DECLARES = ("appropriate action is to {}", "appropriate action is {}", "action should be {}")
OWN_POST = "own original post"
POST_REFERENCE = r"(?:post\s*#?|repost:)\s*(\d+)"
REPOST_REFERENCE = r"repost:\s*(\d+)"
USER_REFERENCE = r"(?i)\buser[\s\u202f]+(\d+)\b"
INTERNAL_TERMS = ("measured_mu", "paper_omega", "risk_score")
INVALID = "__invalid__"
# what Unicode counts as white space
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# -------------------------------------------------------------------------


def contains_any(text, tokens: Sequence[str]) -> Column:
    out = F.lit(False)
    for token in tokens:
        out = out | F.contains(_c(text), F.lit(token))
    return out


def strip(text) -> Column:
    return F.trim(_c(text), F.lit(WHITESPACE))


def key_counts(text) -> dict[str, Column]:
    """Matches per key prefix."""
    return {name: F.regexp_count(_c(text), F.lit(p)) for name, p in KEY_PREFIX_PATTERNS.items()}


def has_key(text) -> Column:
    return F.coalesce(_c(text).rlike(KEY_PATTERN), F.lit(False))


def redact(text) -> Column:
    out = F.regexp_replace(_c(text), REDACT_KEY, "[REDACTED_SECRET]")
    out = F.regexp_replace(out, REDACT_EMAIL, "[REDACTED_EMAIL]")
    return F.regexp_replace(out, REDACT_PHONE, "[REDACTED_PHONE]")


def redact_array(values) -> Column:
    return F.transform(_c(values), redact)


def quote_stance(reason) -> Column:
    return _stance(F.lower(_c(reason)))


def _stance(low: Column) -> Column:
    return (
        F.when(contains_any(low, CORRECTIVE), "corrective")
        .when(contains_any(low, QUESTIONING), "questioning")
        .when(contains_any(low, SUPPORTIVE), "supportive")
        .otherwise("unclear")
    )


def rationale_stance(action, rationale) -> Column:
    low = F.lower(_c(rationale))
    ch, co, su = (contains_any(low, t).cast("int") for t in (STANCE_CHALLENGE, STANCE_CORRECT, STANCE_SUPPORT))
    return (
        F.when(_c(action) != "quote", "not_applicable")
        .when(ch + co + su != 1, "unclear")
        .when(ch == 1, "challenge")
        .when(co == 1, "correct")
        .otherwise("support")
    )


def with_features(rows: DataFrame, reason: str, name: str = "features") -> DataFrame:
    """Attach what the audit needs from a rationale, independent of the decision it explains.

    The stripped and lower-cased text are columns of their own first: an expression over
    a long text that many others use must be evaluated once, not once per use.
    """
    rows = rows.withColumn("__t", strip(F.coalesce(_c(reason), F.lit(""))))
    rows = rows.withColumn("__low", F.lower("__t"))
    return rows.withColumn(name, _features(F.col("__t"), F.col("__low"))).drop("__t", "__low")


def _features(text: Column, low: Column) -> Column:
    def numbers(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("bigint"))

    declared = F.filter(F.array(*[F.when(contains_any(low, [d.format(a) for d in DECLARES]), F.lit(a)) for a in ACTIONS]), lambda x: x.isNotNull())
    return F.struct(
        (F.length(text) == 0).alias("empty"),
        ((F.length(text) > 0) & ((F.length(text) < 20) | (F.size(F.split(text, r"(?U)\s+")) < 4))).alias("too_short"),
        declared.alias("declared"),
        F.array_sort(F.array_distinct(numbers(POST_REFERENCE))).alias("referenced"),
        numbers(REPOST_REFERENCE).alias("reposts"),
        F.contains(low, F.lit(OWN_POST)).alias("own_post"),
        _stance(low).alias("quote_stance"),
        contains_any(low, SAYS_HIGH).alias("says_high"),
        contains_any(low, SAYS_LOW).alias("says_low"),
    )


def no_features() -> Column:
    """Features of a decision without a rationale."""
    return _features(F.lit(""), F.lit(""))


def rationale_flags(f: Column, action, target, visible, user_id, root_author) -> dict[str, Column]:
    """Quality flags of one rationale from its features; ``visible`` is an array of post ids."""
    wrong = F.array_except(f["referenced"], _c(visible))
    wrong = F.when(
        _c(target).isNotNull(),
        F.array_union(wrong, F.filter(f["reposts"], lambda x: x != _c(target))),
    ).otherwise(wrong)
    return {
        "empty": f["empty"],
        "too_short": f["too_short"],
        "action_contradiction": (F.size(f["declared"]) > 0) & ~F.array_contains(f["declared"], _c(action)),
        "referenced_post_ids": f["referenced"],
        "wrong_post_reference_ids": F.array_sort(F.array_distinct(wrong)),
        "factual_author_mismatch": F.coalesce(
            _c(target).isNotNull()
            & _c(root_author).isNotNull()
            & (_c(user_id) != _c(root_author))
            & f["own_post"],
            F.lit(False),
        ),
    }


def consistent_with(action: Column, risk: Column, f: Column) -> Column:
    """NULL without a risk, else whether wording and risk agree."""
    bad = ((risk >= 0.7) & f["says_low"] & (action != "quote")) | ((risk <= 0.3) & f["says_high"])
    return F.when(risk.isNotNull(), ~bad)


def factual_reasons(action, risk, rationale, target_author) -> Column:
    """Sorted reasons why a rationale contradicts its target (strict variant)."""
    low, r = F.lower(_c(rationale)), _c(risk)
    users = F.transform(
        F.regexp_extract_all(_c(rationale), F.lit(USER_REFERENCE), F.lit(1)),
        lambda x: x.try_cast("bigint"),
    )
    hits = F.array(
        F.when((r >= 0.7) & (_c(action) == "repost") & contains_any(low, SAYS_LOW_STRICT),
               F.lit("high_risk_target_described_as_benign")),
        F.when((r <= 0.3) & contains_any(low, SAYS_HIGH_STRICT), F.lit("low_risk_target_described_as_high_risk")),
        F.when(_c(target_author).isNotNull() & (F.size(users) > 0) & ~F.array_contains(users, _c(target_author)),
               F.lit("selected_post_author_relation_error")),
    )
    return F.filter(hits, lambda x: x.isNotNull())


def normalize_action(raw) -> dict[str, Column]:
    """Strict action object {action, confidence in [0,1], reason} or a safe fallback."""
    v = F.try_parse_json(_c(raw))
    shape = F.schema_of_variant(v)
    known = F.coalesce(F.try_variant_get(v, "$.action", "string").isin(*ACTIONS), F.lit(False))
    conf = F.try_variant_get(v, "$.confidence", "double")
    is_object = shape.startswith("OBJECT<")
    action_ok = F.coalesce(is_object & known, F.lit(False))
    strict = shape.rlike(
        r"^OBJECT<action: STRING, confidence: (?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)), reason: STRING>$"
    )
    valid = F.coalesce(v.isNotNull() & action_ok & strict & (conf >= 0) & (conf <= 1), F.lit(False))
    failure = (
        F.when(valid, F.lit(None).cast("string"))
        .when(v.isNull(), "invalid_json")
        .when(~action_ok, "invalid_action")
        .otherwise("invalid_schema")
    )
    return {
        "json_valid": v.isNotNull(),
        "action_valid": valid,
        "failure_reason": failure,
        "action": F.when(valid, F.try_variant_get(v, "$.action", "string")).otherwise("ignore"),
        "confidence": F.when(valid, conf).otherwise(0.0),
        "reason": F.when(valid, F.try_variant_get(v, "$.reason", "string")).otherwise(
            F.concat(F.lit("safe fallback after "), failure)
        ),
    }


def prompt_isolated(text, *terms, internal: Sequence[str] = INTERNAL_TERMS) -> Column:
    """True when the lower-cased input holds none of the terms.

    ``terms`` are columns such as strategy and condition; a deployment adds its
    own internal names through ``internal``.
    """
    low = F.lower(_c(text))
    hit = contains_any(low, internal)
    for term in terms:
        hit = hit | F.contains(low, F.lower(_c(term)))
    return ~hit
