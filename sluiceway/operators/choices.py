"""Legal choices of a decision: direct, by root and as of a trace row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import choice_action, choice_target
from ..functions.skew import lookup


def _options(repost: Column, report: Column, post: str = "post_id") -> Column:
    """Choice ids of one visible post, in action order repost, quote, report."""
    pid = F.col(post).cast("string")
    return F.filter(
        F.array(
            F.when(repost, F.concat(F.lit("repost:"), pid)),
            F.concat(F.lit("quote:"), pid),
            F.when(report, F.concat(F.lit("report:"), pid)),
        ),
        lambda x: x.isNotNull(),
    )


def _collect(rows: DataFrame, key: str) -> DataFrame:
    """One array per decision; a feed holds few posts, so the groups stay small."""
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("post_id", "opts"))).alias("o"))
    return per.select(key, F.concat(F.array(F.lit("ignore")), F.flatten(F.transform("o", lambda x: x["opts"]))).alias("legal"))


def _visible(decisions: DataFrame, key: str) -> DataFrame:
    return decisions.select(key, "user_id", F.explode(F.array_distinct("visible")).alias("post_id"))


def _first(events: DataFrame, name: str, target: str) -> DataFrame:
    """Earliest row per (user, target): 'done before x' is then first < x."""
    return events.groupBy("user_id", F.col("target_post_id").alias(target)).agg(F.min("rowid").alias(name))


def legal_direct(decisions: DataFrame, kinds: DataFrame, posts: DataFrame, reports: DataFrame, key: str = "rowid") -> DataFrame:
    """Repost unless the user already derived the target (or its root when the target
    is a pure repost), quote always, report unless this very post was reported."""
    derived = posts.where("original_post_id is not null").select("user_id", F.col("original_post_id").alias("t")).distinct()
    done = F.lit(True).alias("x")
    rows = lookup(_visible(decisions, key), kinds, "post_id", "inner")
    rows = rows.join(derived.select("user_id", F.col("t").alias("post_id"), done.alias("own")), ["user_id", "post_id"], "left")
    rows = rows.join(
        derived.select("user_id", F.col("t").alias("root_post_id"), done.alias("root_done")), ["user_id", "root_post_id"], "left"
    )
    reported = reports.select("user_id", F.col("target_post_id").alias("post_id")).distinct().withColumn("rep", F.lit(True))
    rows = rows.join(reported, ["user_id", "post_id"], "left")
    can_repost = F.col("own").isNull() & ~(F.col("is_repost") & F.col("root_done").isNotNull())
    return _collect(rows.select(key, "post_id", _options(can_repost, F.col("rep").isNull()).alias("opts")), key)


def acted_roots(posts: DataFrame, roots: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user, root) pairs with a pure repost, and with a report."""
    by_root = roots.select("post_id", "root_post_id")
    pure = posts.where("original_post_id is not null and quote_content is null").select("user_id", "post_id")
    reposted = pure.join(by_root, "post_id").select("user_id", "root_post_id").distinct()
    flagged = reports.select("user_id", F.col("target_post_id").alias("post_id")).distinct()
    reported = lookup(flagged, by_root, "post_id", "inner").select("user_id", "root_post_id").distinct()
    return reposted, reported


def legal_root(decisions: DataFrame, roots: DataFrame, posts: DataFrame, reports: DataFrame, key: str = "rowid") -> DataFrame:
    """Repost and report fall away once the user acted on any post of the same root."""
    reposted, reported = acted_roots(posts, roots, reports)
    rows = lookup(_visible(decisions, key), roots.select("post_id", "root_post_id"), "post_id", "inner")
    rows = rows.join(reposted.withColumn("a", F.lit(True)), ["user_id", "root_post_id"], "left")
    rows = rows.join(reported.withColumn("b", F.lit(True)), ["user_id", "root_post_id"], "left")
    opts = _options(F.col("a").isNull(), F.col("b").isNull())
    return _collect(rows.select(key, "post_id", opts.alias("opts")), key)


def prior_actions(pairs: DataFrame, roots: DataFrame, posts: DataFrame, reports: DataFrame) -> DataFrame:
    """Per (user, post): a derivation of any kind on the same root, a report of this post."""
    by_root = roots.select("post_id", "root_post_id")
    derived = (
        posts.where("original_post_id is not null").select("user_id", "post_id").join(by_root, "post_id")
        .select("user_id", "root_post_id").distinct().withColumn("has_derivation", F.lit(True))
    )
    reported = reports.select("user_id", F.col("target_post_id").alias("post_id")).distinct().withColumn("has_report", F.lit(True))
    rows = lookup(pairs, by_root, "post_id", "inner")
    rows = rows.join(derived, ["user_id", "root_post_id"], "left").join(reported, ["user_id", "post_id"], "left")
    return rows.select(
        "user_id",
        "post_id",
        F.coalesce("has_derivation", F.lit(False)).alias("has_derivation"),
        F.coalesce("has_report", F.lit(False)).alias("has_report"),
    )


def legal_asof(
    decisions: DataFrame, kinds: DataFrame, derivations: DataFrame, reports: DataFrame, *, key: str = "rowid"
) -> DataFrame:
    """Choices as of a trace row: only derivations and reports before it count.

    The earliest derivation per (user, target) decides, so the as-of condition is an
    equi-join on a pre-aggregated table and one comparison.
    """
    rows = lookup(_visible(decisions, key), kinds, "post_id", "inner")
    rows = rows.join(_first(derivations, "own", "post_id"), ["user_id", "post_id"], "left")
    rows = rows.join(_first(derivations, "root_first", "root_post_id"), ["user_id", "root_post_id"], "left")
    rows = rows.join(_first(reports, "rep", "post_id"), ["user_id", "post_id"], "left")

    def before(name: str) -> Column:
        return F.coalesce(F.col(name) < F.col(key), F.lit(False))

    can_repost = ~before("own") & ~(F.col("is_repost") & before("root_first"))
    return _collect(rows.select(key, "post_id", _options(can_repost, ~before("rep")).alias("opts")), key)


def revalidate(rows: DataFrame, choice: str, frozen: str, current: str) -> DataFrame:
    """The choice must be in the frozen list and in the list rebuilt from later state."""
    reason = (
        F.when(~F.array_contains(frozen, F.col(choice)), "not in the frozen choices")
        .when(~F.array_contains(current, F.col(choice)), "no longer legal")
    )
    return rows.withColumn("reject_reason", reason)


def choice_at(index: Column, legal: Column) -> Column:
    """Choice under a 0-based index, NULL when out of range."""
    return F.when((index >= 0) & (index < F.size(legal)), F.get(legal, index.cast("int")))


def semantic_binding(rows: DataFrame) -> DataFrame:
    """First failing check between a response and the indexed legal choice.

    Expects choice_index, action_type, target_post_id (0 for none), quote_text, legal.
    """
    chosen = choice_at(F.col("choice_index"), F.col("legal"))
    quote = F.coalesce(F.col("quote_text"), F.lit(""))
    reason = (
        F.when(F.col("choice_index").isNull() | chosen.isNull(), "invalid_choice_index")
        .when(~F.col("action_type").eqNullSafe(choice_action(chosen)), "choice_action_mismatch")
        .when(~F.col("target_post_id").eqNullSafe(F.coalesce(choice_target(chosen), F.lit(0))), "choice_target_mismatch")
        .when((F.col("action_type") == "quote") & (F.trim(quote) == ""), "quote_text_contract_failure")
        .when((F.col("action_type") != "quote") & (quote != ""), "quote_text_contract_failure")
    )
    return rows.withColumn("indexed_choice", chosen).withColumn("failure", reason)


def state_fingerprint(
    decisions: DataFrame, posts: DataFrame, reports: DataFrame, reposted: DataFrame, key: str = "rowid"
) -> DataFrame:
    """sha256 per decision over the rows that decide legality.

    Visible posts and own reports are cut to the feed. The user's own reposts are
    unbounded, so they enter as a count and an order-free sum of per-target hashes
    computed once per user instead of one long list.
    """
    visible = _visible(decisions, key)
    p = posts.select("post_id", F.col("user_id").alias("author_id"), "original_post_id", F.col("quote_content").isNull().alias("no_quote"))
    rows = lookup(visible, p, "post_id", "inner")
    reported = reports.select("user_id", F.col("target_post_id").alias("post_id")).distinct().withColumn("rep", F.lit(True))
    rows = rows.join(reported, ["user_id", "post_id"], "left")
    line = F.concat_ws(
        ",",
        F.col("post_id").cast("string"),
        F.col("author_id").cast("string"),
        F.coalesce(F.col("original_post_id").cast("string"), F.lit("null")),
        F.when(F.col("no_quote"), "plain").otherwise("quote"),
        F.when(F.col("rep"), "reported").otherwise("open"),
    )
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("post_id", line.alias("l")))).alias("a"))
    per = per.select(key, F.array_join(F.transform("a", lambda x: x["l"]), ";").alias("posts_text"))
    digest = F.conv(F.substring(F.md5(F.col("target_post_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    own = (
        reposted.groupBy("user_id", "target_post_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("user_id").agg(F.sum("n").alias("reposts"), F.sum(digest * F.col("n")).alias("repost_digest"))
    )
    out = decisions.select(key, "user_id").join(per, key, "left")
    out = lookup(out, own, "user_id", "left")
    text = F.concat_ws(
        "|",
        F.col("user_id").cast("string"),
        F.coalesce("posts_text", F.lit("")),
        F.coalesce("reposts", F.lit(0)).cast("string"),
        F.coalesce("repost_digest", F.lit(0)).cast("string"),
    )
    return out.select(key, F.sha2(text, 256).alias("state_identifier"))


def root_fingerprint(
    decisions: DataFrame, posts: DataFrame, roots: DataFrame, reports: DataFrame, *, protocol: str, key: str = "rowid"
) -> DataFrame:
    """The root-aware fingerprint: visible posts with their roots, and the roots the user
    already reposted or reported, under a protocol tag.

    The acted roots of a user are unbounded and enter as counts and order-free digests.
    """
    reposted, reported = acted_roots(posts, roots, reports)
    digest = F.conv(F.substring(F.md5(F.col("root_post_id").cast("string")), 1, 8), 16, 10).cast("bigint")

    def acted(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.groupBy("user_id").agg(F.concat_ws("/", F.count(F.lit(1)).cast("string"), F.sum(digest).cast("string")).alias(name))

    p = posts.select("post_id", F.col("user_id").alias("author_id"), "original_post_id", F.col("quote_content").isNull().alias("no_quote"))
    rows = lookup(_visible(decisions, key), p, "post_id", "inner")
    rows = lookup(rows, roots.select("post_id", "root_post_id"), "post_id", "left")
    line = F.concat_ws(
        ",",
        F.col("post_id").cast("string"),
        F.col("author_id").cast("string"),
        F.coalesce(F.col("original_post_id").cast("string"), F.lit("null")),
        F.when(F.col("no_quote"), "plain").otherwise("quote"),
        F.coalesce(F.col("root_post_id").cast("string"), F.lit("null")),
    )
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("post_id", line.alias("l")))).alias("a"))
    per = per.select(key, F.array_join(F.transform("a", lambda x: x["l"]), ";").alias("posts_text"))
    out = decisions.select(key, "user_id").join(per, key, "left")
    out = lookup(lookup(out, acted(reposted, "d"), "user_id", "left"), acted(reported, "r"), "user_id", "left")
    none = F.lit("0/0")
    text = F.concat_ws(
        "|", F.lit(protocol), F.col("user_id").cast("string"), F.coalesce("posts_text", F.lit("")), F.coalesce("d", none), F.coalesce("r", none)
    )
    return out.select(key, F.sha2(text, 256).alias("state_identifier"))


def semantic_metrics(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Attempt-level counts of semantic mismatches and of the corrections that followed.

    ``checked``: keys, decision_id, attempt, failure (of :func:`semantic_binding`). Bad
    indexes are a category of their own and no semantic mismatch.
    """
    kinds = ("choice_action_mismatch", "choice_target_mismatch", "quote_text_contract_failure")
    bad = F.coalesce(F.col("failure").isin(*kinds), F.lit(False))
    per = checked.groupBy(*keys, "decision_id").agg(
        *[F.count_if(F.col("failure") == k).alias(k) for k in kinds],
        F.max(F.when(bad, F.col("attempt"))).alias("last_bad"),
        F.min(F.when(bad, F.col("attempt"))).alias("first_bad"),
        F.max("attempt").alias("last"),
        F.max_by(F.col("failure").isNull(), "attempt").alias("ends_well"),
    )
    corrected = F.col("first_bad").isNotNull() & (F.col("last") > F.col("first_bad"))
    return per.groupBy(*keys).agg(
        F.sum(sum((F.col(k) for k in kinds), F.lit(0))).alias("semantic_failures"),
        *[F.sum(k).alias(k) for k in kinds],
        F.count_if(corrected).alias("corrections"),
        F.count_if(corrected & F.col("ends_well")).alias("corrections_succeeded"),
        F.count_if(corrected & ~F.col("ends_well")).alias("corrections_failed"),
    )


def inconsistent_successes(decisions: DataFrame, checked: DataFrame) -> DataFrame:
    """Per run: succeeded decisions, and those of them whose last response is not semantically consistent.

    ``decisions``: decision_id, run_id, status. ``checked``: decision_id, attempt, failure (of
    :func:`semantic_binding`). A success without any response on record counts as inconsistent.
    """
    last = checked.groupBy("decision_id").agg(F.max_by(F.col("failure").isNull(), "attempt").alias("consistent"))
    done = decisions.where("status = 'succeeded'").select("decision_id", "run_id").join(last, "decision_id", "left")
    return done.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("succeeded"), F.count_if(~F.coalesce("consistent", F.lit(False))).alias("semantic_inconsistent_successes")
    )
