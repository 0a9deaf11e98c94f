"""Queries A1-A5: sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import dataset
from ..session import new_folder
from ..sources import readers, sinks
from .q_dataset import DSNAP, FEED_JSON, NATIVE, damaged_impressions, dsnap
from .registry import query
from .views import Logs


# what the content of a table is compared by, one column list for both sides
CONTENT = {
    "post": ("post", "post_id, user_id, original_post_id, content, quote_content, num_likes"),
    "follow": ("follow", "follower_id, followee_id"),
    "rec": ("rec", "user_id, post_id"),
    "trace": ("trace", "rowid, user_id, timestep, action, info"),
    "impression": ("impressions", "impression_id, run_id, timestep, user_id, post_id, root_post_id, user_community, author_community, source"),
    "snapshot": ("snapshots", "decision_id, run_id, user_id, timestep, decision_sequence, action_trace_rowid, action, target_post_id, selected_choice_id, refresh_id, community, profile, status"),
}


@query(
    "scan_tables",
    " UNION ALL ".join(
        f"SELECT '{log}' AS log, count(*)::BIGINT AS rows, sum(('0x' || substr(md5(concat_ws('|', {columns})), 1, 8))::BIGINT)::BIGINT AS content FROM {view}"
        for log, (view, columns) in CONTENT.items()
    ),
)
def _(t: Logs):
    """Log tables written as a platform would, read back through the typed reader."""
    views = {"post": t.post, "follow": t.follow, "rec": t.rec, "trace": t.trace, "impression": t.impressions, "snapshot": t.snapshots}
    out = None
    for name, df in views.items():
        path = new_folder(t.spark, f"out/{name}")
        df.write.parquet(path)
        columns = CONTENT[name][1].split(", ")
        mark = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("bigint")
        row = readers.read_table(t.spark, path, name).agg(F.count(F.lit(1)).alias("rows"), F.sum(mark).alias("content"))
        row = row.select(F.lit(name).alias("log"), "rows", "content")
        out = row if out is None else out.unionByName(row)
    return out


LINES = """SELECT rowid, CASE rowid % 50 WHEN 0 THEN '' WHEN 1 THEN 'broken {' WHEN 2 THEN '[1]' WHEN 3 THEN '{"sample_id":' || rowid || ',"label":{"action":"quote"}}'
    WHEN 4 THEN '{"sample_id":"s' || rowid || '","label":{"action":"like"}}' ELSE '{"sample_id":"s' || rowid || '","label":{"action":"' || action || '","confidence":1.0,"reason":"r"}}' END AS value
    FROM actions"""


@query(
    "scan_examples_jsonl",
    """SELECT line, error, CASE WHEN error IS NULL THEN 's' || rowid END AS sample_id FROM (SELECT rowid, row_number() OVER (ORDER BY rowid)::BIGINT AS line, value,
         CASE rowid % 50 WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'line is not a JSON object' WHEN 3 THEN 'sample_id is not a string'
           WHEN 4 THEN 'label.action is missing or invalid' END AS error FROM lines) WHERE value <> ''""",
    lines=LINES,
)
def _(t: Logs):
    r, n = F.col("rowid"), F.col("rowid").cast("string")
    m = r % 50
    value = (
        F.when(m == 0, "").when(m == 1, "broken {").when(m == 2, "[1]")
        .when(m == 3, F.concat(F.lit('{"sample_id":'), n, F.lit(',"label":{"action":"quote"}}')))
        .when(m == 4, F.concat(F.lit('{"sample_id":"s'), n, F.lit('","label":{"action":"like"}}')))
        .otherwise(F.concat(F.lit('{"sample_id":"s'), n, F.lit('","label":{"action":"'), F.col("action"), F.lit('","confidence":1.0,"reason":"r"}}')))
    )
    path = new_folder(t.spark, "out/lines")
    # one ordered file per range: line numbers restart per file, so the check adds the ranges up
    t.actions.select("rowid", value.alias("value")).repartitionByRange(4, "rowid").sortWithinPartitions("rowid").select("value").write.text(path)
    sizes = readers.numbered_lines(t.spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("file", F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("start"))
    rows = readers.scan_examples(t.spark, path, strict=False)
    return rows.join(F.broadcast(starts), "file").select(
        (F.col("line") + F.col("start")).alias("line"), "error", F.col("example")["sample_id"].alias("sample_id")
    )


def _before():
    # one row per file
    return W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)


@query(
    "scan_samples_tsv",
    """SELECT mu, omega_intra, omega_inter, count(*)::BIGINT AS replicates, round(avg((rho_a + rho_b) / 2), 6) AS mean_rho FROM (
         SELECT CASE l_returnflag WHEN 'A' THEN 0.2 WHEN 'N' THEN 0.5 ELSE 0.8 END::DOUBLE AS mu, [0.2, 0.4, 0.6, 0.8, 1.0][l_partkey % 5 + 1]::DOUBLE AS omega_intra,
           [1.0, 0.8, 0.6, 0.4, 0.2][l_partkey % 5 + 1]::DOUBLE AS omega_inter, l_discount * 5 AS rho_a, l_tax * 5 AS rho_b FROM lineitem) GROUP BY 1, 2, 3""",
)
def _(t: Logs):
    p = F.col("l_partkey") % 5
    flag = F.col("l_returnflag")
    samples = t.table("lineitem").select(
        F.when(flag == "A", 0.2).when(flag == "N", 0.5).otherwise(0.8).alias("mu"), F.round(F.lit(0.2) + p * 0.2, 1).alias("omega_intra"),
        F.round(F.lit(1.0) - p * 0.2, 1).alias("omega_inter"), (F.col("l_discount") * 5).alias("rho_A"), (F.col("l_tax") * 5).alias("rho_B"),
    )
    path = new_folder(t.spark, "out/samples")
    samples.write.csv(path, sep="\t", header=True)
    rho = F.avg((F.col("rho_A") + F.col("rho_B")) / 2)
    return readers.scan_samples(t.spark, path).groupBy("mu", "omega_intra", "omega_inter").agg(
        F.count(F.lit(1)).alias("replicates"), F.round(rho, 6).alias("mean_rho")
    )


@query(
    "sink_impressions",
    """SELECT run_id, timestep, count(*)::BIGINT AS rows, (count(*) FILTER (shown))::BIGINT AS shown, round(sum(keep_probability), 6) AS keep_sum, '' AS reject
       FROM impressions WHERE impression_id % 97 <> 0 AND impression_id % 89 <> 0 AND impression_id % 79 <> 0 GROUP BY 1, 2
       UNION ALL SELECT run_id, timestep, count(*), (count(*) FILTER (shown)), NULL, array_to_string(list_filter([CASE WHEN impression_id % 97 = 0 THEN 'risk_score' END,
           CASE WHEN impression_id % 89 = 0 THEN 'keep_probability' END, CASE WHEN impression_id % 79 = 0 THEN 'source' END], lambda x: x IS NOT NULL), ',') AS reject
       FROM impressions WHERE impression_id % 97 = 0 OR impression_id % 89 = 0 OR impression_id % 79 = 0 GROUP BY 1, 2, 6""",
)
def _(t: Logs):
    path = new_folder(t.spark, "out/impressions")
    rejected = sinks.append_impressions(damaged_impressions(t), path)
    kept = t.spark.read.parquet(path).groupBy("run_id", F.col("timestep").cast("bigint").alias("timestep")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("shown").alias("shown"), F.round(F.sum("keep_probability"), 6).alias("keep_sum"), F.lit("").alias("reject")
    )
    lost = rejected.groupBy("run_id", "timestep", "reject").agg(F.count(F.lit(1)).alias("rows"), F.count_if("shown").alias("shown"))
    return kept.unionByName(lost.withColumn("keep_sum", F.lit(None).cast("double")))


@query(
    "sink_examples_jsonl",
    f"""SELECT '{{"action_label_eligible":true,"action_trace_rowid":' || action_trace_rowid || ',"behavior_history":[' || array_to_string(list_transform(history, lambda x: '"' || x || '"'), ',')
          || '],"community":"' || community || '","decision_sequence":' || decision_sequence || ',"decision_timestep":' || timestep || ',"feed_empty_reason":'
          || CASE WHEN len(feed_ids) = 0 THEN '"' || feed_message || '"' ELSE 'null' END || ',"feed_post":"' || replace({FEED_JSON}, '"', '\\"') || '","label":{{"action":"'
          || split_part(selected_choice_id, ':', 1) || '","confidence":1.0,"reason":"' || rationale || '"}},"label_source":"teacher_synthetic","legal_choice_ids":['
          || array_to_string(list_transform(legal, lambda x: '"' || x || '"'), ',') || '],"neighbor_interactions":[],"platform_notice":"","provenance":"decision_snapshot"'
          || ',"rationale_quality_status":"unreviewed","rationale_training_eligible":true,"sample_id":"' || decision_id || '","selected_choice_id":"' || selected_choice_id
          || '","user_profile":"' || profile || '","visible_post_ids":[' || array_to_string(visible, ',') || ']}}' AS value
        FROM native WHERE len(errors) = 0""",
    dsnap=DSNAP, native=NATIVE,
)
def _(t: Logs):
    path = new_folder(t.spark, "out/examples")
    sound = dataset.native_examples(dsnap(t), t.trace).where(F.size("errors") == 0).drop("errors")
    sinks.write_examples(sound, path)
    return t.spark.read.text(path)
