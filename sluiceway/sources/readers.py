"""Log tables, JSON lines and tab-separated samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalar import ACTIONS
from ..functions.skew import broadcast_limit, leaf_bytes

# the columns every log table must offer, with their types
SCHEMAS = {
    "post": "post_id bigint, user_id bigint, original_post_id bigint, content string, quote_content string, num_likes bigint",
    "follow": "follower_id bigint, followee_id bigint",
    "rec": "user_id bigint, post_id bigint",
    "trace": "rowid bigint, user_id bigint, timestep bigint, action string, info string",
    "impression": (
        "impression_id bigint, run_id string, timestep bigint, user_id bigint, post_id bigint, root_post_id bigint, "
        "user_community string, author_community string, base_score double, risk_score double, omega_intra double, "
        "omega_inter double, keep_probability double, shown boolean, source string"
    ),
    "snapshot": (
        "decision_id string, run_id string, user_id bigint, timestep bigint, decision_sequence bigint, action_trace_rowid bigint, "
        "action string, target_post_id bigint, selected_choice_id string, refresh_id bigint, visible array<bigint>, "
        "feed_message string, legal array<string>, history array<string>, community string, profile string, status string"
    ),
}
EXAMPLE_SCHEMA = (
    "sample_id string, action_trace_rowid bigint, decision_sequence bigint, decision_timestep bigint, user_profile string, "
    "community string, feed_post string, neighbor_interactions array<string>, behavior_history array<string>, "
    "platform_notice string, label struct<action:string,confidence:double,reason:string>, label_source string, "
    "visible_post_ids array<bigint>, legal_choice_ids array<string>, selected_choice_id string, provenance string, "
    "action_label_eligible boolean, rationale_training_eligible boolean, rationale_quality_status string, feed_empty_reason string"
)


MIN_SPLIT = 1 << 20
SPLIT_ROW_BYTES = 256


def read_table(spark: SparkSession, path: str, name: str, *, options: dict | None = None, fmt: str = "parquet") -> DataFrame:
    """A log table with its declared columns; any format Spark reads, JDBC included."""
    reader = spark.read.format(fmt).options(**(options or {}))
    df = reader.load(path) if path else reader.load()
    wanted = [c.strip().split(" ") for c in SCHEMAS[name].split(", ")]
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in wanted])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) with 1-based line numbers, blank lines counted.

    Rows of one split are contiguous and in file order. Lines are counted per split and
    the splits of a file added up, so a large file is still read in parallel.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("start"))
    # one row per file split, so its size is known before the read
    splits = (leaf_bytes(lines) or 0) // MIN_SPLIT + len(lines.inputFiles())
    small = splits * SPLIT_ROW_BYTES <= broadcast_limit(lines)
    out = lines.join(F.broadcast(starts) if small else starts, ["file", "block"])
    return out.select("file", (F.col("id") - F.col("first") + F.col("start") + 1).alias("line"), "value")


def scan_examples(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Examples of JSON lines files; blank lines are skipped.

    Bad lines come back as rows with ``error`` set. With ``strict`` any bad line fails
    the read with the first line numbers.
    """
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = rows.withColumn("v", F.try_parse_json("value")).withColumn("e", F.from_json("value", EXAMPLE_SCHEMA))
    shape = F.schema_of_variant("v")
    error = (
        F.when(F.col("v").isNull(), "invalid JSON")
        .when(~shape.startswith("OBJECT<"), "line is not a JSON object")
        .when(F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.sample_id", "variant")) != "STRING", F.lit(True)), "sample_id is not a string")
        .when(~F.coalesce(F.col("e")["label"]["action"].isin(*ACTIONS), F.lit(False)), "label.action is missing or invalid")
    )
    out = parsed.withColumn("error", error)
    if strict:
        first = [f"{r.line}: {r.error}" for r in out.where("error is not null").orderBy("line").select("line", "error").limit(5).collect()]
        if first:
            raise ValueError("bad example lines: " + "; ".join(first))
    return out.select("file", "line", "error", F.when(F.col("error").isNull(), F.col("e")).alias("example"))


def scan_samples(spark: SparkSession, path: str, schema: str = "mu double, omega_intra double, omega_inter double, rho_A double, rho_B double") -> DataFrame:
    """Tab-separated samples with a header row."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)
