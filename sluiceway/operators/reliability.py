"""Attempt counters, failure categories and run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import ACTIONS, ratio0

# ---- fixed values -------------------------------------------------------
# raw error kind -> failure category
FAILURE_CATEGORY = {
    "json_validate_failed": "provider_json_validate_failed",
    "provider_error": "provider_failure",
    "call_limit_exceeded": "provider_failure",
    "schema_validation_error": "local_schema_failure",
    "choice_index_error": "invalid_choice_index",
    "semantic_mismatch": "semantic_consistency_failure",
}
OTHER_FAILURE = "dispatcher_failure"
# -------------------------------------------------------------------------


def failure_category(kind) -> Column:
    out, k = None, F.col(kind)
    for raw, category in FAILURE_CATEGORY.items():
        out = F.when(k == raw, category) if out is None else out.when(k == raw, category)
    return F.when(k.isNotNull(), out.otherwise(OTHER_FAILURE))


def reliability_summary(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of attempt counters with first-attempt and post-retry success rates.

    ``attempts``: decision_id, attempt (1 is the first), succeeded, keys.
    """
    per = attempts.groupBy(*keys, "decision_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("attempt") == 1, F.col("succeeded"))).alias("first_ok"),
        F.max("succeeded").alias("ok"),
    )
    out = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("logical_decisions"),
        F.count_if("ok").alias("completed"),
        F.count("first_ok").alias("first_attempts"),
        F.count_if("first_ok").alias("first_attempt_successes"),
        F.sum(F.col("n") - 1).alias("retries"),
        F.count_if(F.col("ok") & (F.col("n") > 1)).alias("retry_successes"),
        F.count_if(~F.col("ok")).alias("unrecovered"),
    )
    return out.withColumn("first_attempt_success_rate", ratio0("first_attempt_successes", "first_attempts")).withColumn(
        "post_retry_success_rate", ratio0("completed", "logical_decisions")
    )


def failure_accounting(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Mutually exclusive failure categories per group.

    ``decisions``: error_kind (NULL when completed). Incomplete decisions are the sum
    of the categories, never logical minus completed. A failed JSON validation counts
    as a provider failure too.
    """
    c = failure_category("error_kind")
    d = decisions.withColumn("category", c)

    def n(*names: str) -> Column:
        return F.count_if(F.col("category").isin(*names))

    return d.groupBy(*keys).agg(
        n("provider_json_validate_failed", "provider_failure").alias("provider_failure_count"),
        n("provider_json_validate_failed").alias("provider_json_validate_failed_count"),
        n("local_schema_failure").alias("local_schema_failure_count"),
        n("invalid_choice_index").alias("invalid_choice_index_count"),
        n("semantic_consistency_failure").alias("semantic_final_failure_count"),
        n(OTHER_FAILURE).alias("dispatcher_failure_count"),
        F.count_if(F.col("category").isNull()).alias("completed_decision_count"),
        F.count_if(F.col("category").isNotNull()).alias("incomplete_decision_count"),
        F.count_if(F.col("category").isNotNull()).alias("unrecovered_logical_error_count"),
    )


def run_status(runs: DataFrame) -> DataFrame:
    """failed / degraded / success with ordered reasons, from one counter row per run.

    Expects provider_responses, impressions, governance_executed, secret_free,
    logical_decisions, completed_decisions, http_statuses (array of unrecovered codes),
    call_limit_exceeded, remote_attempts, max_calls, empty_responses, unrecovered.
    """
    c = F.col

    def keep(*items: Column) -> Column:
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    fatal = keep(
        F.when(c("provider_responses") == 0, F.lit("no_successful_provider_responses")),
        F.when(c("impressions") == 0, F.lit("no_impression_records")),
        F.when(~c("governance_executed"), F.lit("governance_not_executed")),
        F.when(~c("secret_free"), F.lit("output_secret_scan_failed")),
    )
    short = c("completed_decisions") != c("logical_decisions")
    soft = keep(
        F.when(short, F.lit("incomplete_agent_decisions")),
        F.when(c("call_limit_exceeded") > 0, F.lit("physical_call_limit_exceeded")),
        F.when(
            (c("remote_attempts") >= c("max_calls")) & (c("completed_decisions") < c("logical_decisions")),
            F.lit("physical_call_limit_reached_with_incomplete_decisions"),
        ),
        F.when(c("empty_responses") > 0, F.lit("empty_provider_response")),
        F.when((c("unrecovered") > 0) & (F.size("http_statuses") == 0), F.lit("unrecovered_provider_error")),
    )
    http = F.transform(
        F.filter("http_statuses", lambda s: s.isin(401, 403, 404, 429) | (s >= 500)),
        lambda s: F.concat(F.lit("unrecovered_http_"), s.cast("string")),
    )
    degraded = F.array_sort(F.array_distinct(F.concat(soft, http)))
    return runs.withColumn("fatal", fatal).withColumn("soft", degraded).withColumn(
        "status", F.when(F.size("fatal") > 0, "failed").when(F.size("soft") > 0, "degraded").otherwise("success")
    ).withColumn("reasons", F.when(F.size("fatal") > 0, c("fatal")).otherwise(c("soft"))).drop("fatal", "soft")


def execution_status(expected, completed, unrecovered) -> tuple[Column, Column]:
    """(status, reasons) of a batch by its counters."""
    e, d, u = F.col(expected), F.col(completed), F.col(unrecovered)
    reasons = F.filter(
        F.array(F.when(d != e, F.lit("incomplete_decisions")), F.when(u > 0, F.lit("unrecovered_errors"))),
        lambda x: x.isNotNull(),
    )
    status = F.when((d == e) & (u == 0), "success").when(d == 0, "failed").otherwise("degraded")
    return status, reasons


def merge_counters(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Dispatch counters of several sources merged into one row per group.

    ``sources``: keys, result (dispatched, dispatch_failed, invalid_choice or
    invalid_post_reference), action. Actions count when they were dispatched.
    """
    r = F.col("result")
    done = r == "dispatched"
    return sources.groupBy(*keys).agg(
        F.count_if(done).alias("dispatcher_success_count"),
        F.count_if(r == "dispatch_failed").alias("dispatcher_failure_count"),
        F.count_if(r == "invalid_choice").alias("invalid_choice_count"),
        F.count_if(r == "invalid_post_reference").alias("invalid_post_reference_count"),
        *[F.count_if(done & (F.col("action") == a)).alias(f"{a}_count") for a in ACTIONS],
    )
