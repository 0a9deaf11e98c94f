"""Scalar expressions: exposure policy, costs, buckets, choices, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values -------------------------------------------------------
# trace action -> choice action
ACTION_MAP = {
    "repost": "repost",
    "quote_post": "quote",
    "report_post": "report",
    "do_nothing": "ignore",
}
ACTIONS = ("ignore", "quote", "report", "repost")
STATUSES = ("failed", "pending", "succeeded")
RISK_BUCKETS = ("low", "high", "intermediate", "unknown", "not_applicable")
RELATIONS = ("intra", "inter", "not_applicable", "unknown")
BUDGET_SLACK = 1e-12
# -------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def keep_probability(user_community, author_community, risk, omega_intra, omega_inter) -> Column:
    omega = F.when(_c(user_community) == _c(author_community), _c(omega_intra)).otherwise(_c(omega_inter))
    return F.lit(1.0) - _c(risk) * (F.lit(1.0) - omega)


def l1_cost(omega_intra, omega_inter) -> Column:
    return (F.lit(1.0) - _c(omega_intra)) + (F.lit(1.0) - _c(omega_inter))


def exponential_cost(omega_intra, omega_inter) -> Column:
    floor = F.exp(F.lit(-2.0))
    return (F.exp(-(_c(omega_intra) + _c(omega_inter))) - floor) / (F.lit(1.0) - floor)


def ratio(num, den) -> Column:
    """NULL on a zero denominator."""
    return F.when(_c(den) != 0, _c(num).cast("double") / _c(den).cast("double"))


def ratio0(num, den) -> Column:
    """0.0 on a zero denominator."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def risk_bucket(risk) -> Column:
    r = _c(risk)
    return (
        F.when(r.isNull(), "unknown").when(r == 0.0, "low").when(r == 1.0, "high").otherwise("intermediate")
    )


def risk_band(risk, low: float = 0.3, high: float = 0.7) -> Column:
    r = _c(risk)
    return (
        F.when(r.isNull(), "unknown").when(r <= low, "low").when(r >= high, "high").otherwise("intermediate")
    )


def community_relation(user_community, author_community, target) -> Column:
    u, a = _c(user_community), _c(author_community)
    return (
        F.when(u == a, "intra")
        .when(u.isNotNull() & a.isNotNull(), "inter")
        .when(_c(target).isNull(), "not_applicable")
        .otherwise("unknown")
    )


def in_band(value, min_inclusive=None, min_exclusive=None, max_inclusive=None, max_exclusive=None) -> Column:
    """Band test; a NULL bound is open, a NULL value is outside."""
    v, ok = _c(value), _c(value).isNotNull()
    for bound, test in (
        (min_inclusive, lambda b: v >= b),
        (min_exclusive, lambda b: v > b),
        (max_inclusive, lambda b: v <= b),
        (max_exclusive, lambda b: v < b),
    ):
        if bound is not None:
            b = _c(bound)
            ok = ok & (b.isNull() | test(b))
    return ok


def direction(mu, tolerance=0.05) -> Column:
    m = _c(mu)
    return (
        F.when(m < F.lit(0.5) - _c(tolerance), "intra")
        .when(m > F.lit(0.5) + _c(tolerance), "inter")
        .otherwise("balanced")
    )


def pair_direction(omega_intra, omega_inter) -> Column:
    a, b = _c(omega_intra), _c(omega_inter)
    return F.when(a < b, "intra").when(b < a, "inter").otherwise("balanced")


def choice_action(choice) -> Column:
    return F.substring_index(_c(choice), ":", 1)


def choice_target(choice) -> Column:
    raw = F.when(F.instr(_c(choice), ":") > 0, F.regexp_replace(_c(choice), r"^[^:]*:", ""))
    return F.trim(raw).try_cast("bigint")


def choice_error(choice) -> Column:
    """NULL for a valid choice id, else the first reason it is not one."""
    c = _c(choice)
    action, has_target = choice_action(c), F.instr(c, ":") > 0
    target = choice_target(c)
    return (
        F.when(c.isNull(), "missing choice")
        .when(~action.isin(*ACTIONS), "unsupported action")
        .when((action == "ignore") & has_target, "ignore with target")
        .when((action != "ignore") & ~has_target, "missing target")
        .when((action != "ignore") & target.isNull(), "target is not an integer")
        .when((action != "ignore") & (target <= 0), "target is not positive")
    )


def trace_target(action, info) -> Column:
    """Target post of an action trace: the first non-null key of that action."""
    a, i = _c(action), _c(info)

    def first(*keys):
        return F.coalesce(*[F.get_json_object(i, f"$.{k}") for k in keys]).cast("bigint")

    return (
        F.when(a == "repost", first("reposted_id", "post_id"))
        .when(a == "quote_post", first("quoted_id", "post_id", "original_post_id"))
        .when(a == "report_post", first("post_id"))
    )


def mapped_action(action) -> Column:
    out = None
    for trace_name, name in ACTION_MAP.items():
        test = _c(action) == trace_name
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def choice_id(action, target) -> Column:
    return F.when(_c(action) == "ignore", F.lit("ignore")).otherwise(
        F.concat(_c(action), F.lit(":"), _c(target).cast("string"))
    )


def decision_id(run_id, timestep, user_id, sequence) -> Column:
    return F.format_string(
        "%s:t%06d:u%06d:d%06d", _c(run_id), _c(timestep).cast("bigint"), _c(user_id), _c(sequence)
    )


def canonical_json(**fields) -> Column:
    """Compact JSON object with sorted keys; NULL values are written as null."""
    cols = [_c(fields[k]).alias(k) for k in sorted(fields)]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def canonical_text(raw) -> Column:
    """A JSON text of any depth in one spelling: keys sorted at every level, no blanks, numbers by value.

    Null and empty text count as an empty object. What is no JSON, or names a key twice, stays as it is.
    """
    text = _c(raw)
    return F.when(text.isNull() | (text == ""), F.lit("{}")).otherwise(F.coalesce(F.to_json(F.try_parse_json(text)), text))


def canonical_hash(**fields) -> Column:
    return F.sha2(canonical_json(**fields), 256)
