"""Impression log and JSON lines writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import canonical_json

IMPRESSION_UNIT = ("risk_score", "omega_intra", "omega_inter", "keep_probability")
IMPRESSION_REQUIRED = (
    "run_id", "timestep", "user_id", "post_id", "root_post_id", "user_community", "author_community", "base_score", "shown", "source",
)


def split_impressions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reason) by the range rules of the log."""
    bad = F.filter(
        F.array(
            *[F.when(~F.coalesce(F.col(c).between(0, 1), F.lit(False)), F.lit(c)) for c in IMPRESSION_UNIT],
            *[F.when(F.col(c).isNull(), F.lit(c)) for c in IMPRESSION_REQUIRED],
        ),
        lambda x: x.isNotNull(),
    )
    marked = rows.withColumn("reject", F.array_join(bad, ","))
    return marked.where("reject = ''").drop("reject"), marked.where("reject != ''")


def append_impressions(rows: DataFrame, path: str) -> DataFrame:
    """Append the valid rows, partitioned by run and step; returns the quarantined ones.

    Rows are clustered on the partition columns before the write so that a task opens
    few files; adaptive execution splits a partition that is too large.
    """
    valid, rejected = split_impressions(rows)
    valid.hint("rebalance", "run_id", "timestep").write.mode("append").partitionBy("run_id", "timestep").parquet(path)
    return rejected


def write_examples(examples: DataFrame, path: str) -> None:
    """Canonical JSON lines in decision order: sequence (missing last), then sample id."""
    missing = F.col("decision_sequence").isNull()
    sequence = F.coalesce("decision_sequence", F.lit(0))
    line = canonical_json(**{c: F.col(c) for c in examples.columns})
    ordered = examples.select(line.alias("value"), missing.alias("m"), sequence.alias("s"), F.col("sample_id").alias("i"))
    ordered.repartitionByRange("m", "s", "i").sortWithinPartitions("m", "s", "i").select("value").write.mode("overwrite").text(path)
