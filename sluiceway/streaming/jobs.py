"""Streaming jobs: exposure, windowed state, controller, de-duplication.

Event time is the time of a refresh; one timestep is one day of it. The exposure job
writes the impression log; the others return an unstarted streaming DataFrame, so that
the caller picks sink and trigger.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.exposure import govern
from ..operators.hierarchy import extend_forest
from ..session import new_folder
from .controller import CONTROLLER_OUTPUT, Controller
from .panes import STATE_OUTPUT, StepStates, partial_panes

STEP = "1 day"
IMPRESSION_SCHEMA = (
    "refresh_id bigint, rank int, ts timestamp, run_id string, timestep bigint, user_id bigint, post_id bigint, root_post_id bigint, "
    "user_community string, author_community string, risk_score double, omega_intra double, omega_inter double, keep_probability double, shown boolean"
)


def read_events(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Run over everything available into a table folder and read that back.

    Offsets, state and results lie under ``base`` (a new folder by default). Called again
    with the same ``base`` the job goes on where its last commit ended.
    """
    spark = stream.sparkSession
    base = base or new_folder(spark, f"stream/{name}")
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_to_latest(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregating stream over what is there now; its rows as they stand, open windows included.

    Update mode writes each changed row once a batch; the latest of each key counts. Rows of
    windows that the watermark has not closed yet are provisional: a later run replaces them.
    """
    spark = stream.sparkSession
    base = new_folder(spark, f"stream/{name}")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{stream.schema.simpleString()[7:-1].replace(':', ' ')}, batch bigint").parquet(f"{base}/rows")
    newest = W.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r", "batch")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def govern_stream(
    refreshes: DataFrame, sink: str, roots: DataFrame, users: DataFrame, risk: DataFrame, omega_intra: float, omega_inter: float, *, seed: int,
) -> None:
    """Govern a stream of refreshes into the impression log under ``sink``.

    ``refreshes``: refresh_id, ts, run_id, user_id, timestep, posts (array). A refresh is
    one row, so all its candidates are in one micro-batch and fail together, as in the
    batch path. Each batch is one folder; a replayed batch holds the same rows and is
    skipped once its folder is complete, so readers of the log never see a row twice.
    """
    spark = refreshes.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{sink}/log/batch={batch_id}"
        if _exists(spark, f"{folder}/_SUCCESS"):
            return
        candidates = batch.select("refresh_id", "ts", "run_id", "user_id", "timestep", F.posexplode("posts").alias("rank", "post_id"))
        rows = govern(candidates, roots, users, risk, F.lit(omega_intra), F.lit(omega_inter), seed=seed)
        rows.select(*[F.col(c).cast(t) for c, t in (x.split(" ") for x in IMPRESSION_SCHEMA.split(", "))]).write.mode("overwrite").parquet(folder)

    query = (
        refreshes.writeStream.foreachBatch(write).option("checkpointLocation", f"{sink}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()


ROOTED = "post_id bigint, user_id bigint, root_post_id bigint, root_author_id bigint, depth bigint"
WAITING = "post_id bigint, user_id bigint, ptr bigint, hops bigint, error string"


def roots_stream(posts: DataFrame, sink: str) -> tuple[DataFrame, DataFrame]:
    """Keep the roots of a stream of posts (post_id, user_id, original_post_id) under ``sink``: (rooted, waiting).

    Each batch adds the rows it could root as one folder and writes anew those that wait for an
    absent post, which are few. A batch that is replayed starts from the state of the batch
    before it and is skipped once its folder is complete. Posts are expected once each.
    """
    spark = posts.sparkSession

    def rooted_by(batches: list[int]) -> DataFrame:
        return spark.read.schema(ROOTED).parquet(*[f"{sink}/rooted/batch={k}" for k in batches]) if batches else spark.createDataFrame([], ROOTED)

    def done() -> list[int]:
        found = []
        while _exists(spark, f"{sink}/waiting/batch={len(found)}/_SUCCESS"):
            found.append(len(found))
        return found

    def waits_after(batches: list[int]) -> DataFrame:
        return spark.read.schema(WAITING).parquet(f"{sink}/waiting/batch={batches[-1]}") if batches else spark.createDataFrame([], WAITING)

    def write(batch: DataFrame, batch_id: int) -> None:
        if _exists(spark, f"{sink}/waiting/batch={batch_id}/_SUCCESS"):
            return
        before = list(range(batch_id))
        new, waiting = extend_forest(rooted_by(before), waits_after(before), batch.select("post_id", "user_id", "original_post_id"))
        new.write.mode("overwrite").parquet(f"{sink}/rooted/batch={batch_id}")
        # the batch counts once this is complete
        waiting.write.mode("overwrite").parquet(f"{sink}/waiting/batch={batch_id}")

    query = posts.writeStream.foreachBatch(write).option("checkpointLocation", f"{sink}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return rooted_by(done()), waits_after(done())


def impression_stream(spark: SparkSession, sink: str, delay: str) -> DataFrame:
    """The impression log as a stream with a watermark on the refresh time."""
    return spark.readStream.schema(IMPRESSION_SCHEMA).parquet(f"{sink}/log").withWatermark("ts", delay)


def _exposure_counts() -> list[Column]:
    risky = F.col("shown") & (F.col("risk_score") > 0)
    benign = F.col("risk_score") == 0
    return [
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("shown").alias("shown"),
        F.count_if(risky).alias("risky_shown"),
        F.count_if(F.col("shown") & (F.col("user_community") != F.col("author_community"))).alias("cross_shown"),
        F.count_if(benign).alias("benign"),
        F.count_if(benign & ~F.col("shown")).alias("benign_hidden"),
    ]


def exposure_by_step(impressions: DataFrame, step: str = STEP) -> DataFrame:
    """Candidates, shown and suppressed per run and step."""
    out = impressions.groupBy("run_id", F.window("ts", step).alias("w")).agg(*_exposure_counts())
    return out.select(
        "run_id", F.col("w")["start"].alias("step_start"), "candidates", "shown", (F.col("candidates") - F.col("shown")).alias("suppressed")
    )


def governance_state_stream(
    impressions: DataFrame, actions: DataFrame, *, window: int, communities: int, budget: float, origin: str,
) -> DataFrame:
    """State of every closed step per run over the trailing ``window`` steps; see panes.StepStates.

    ``actions``: ts, run_id, action. ``communities``: how many there are. The cost follows the
    omegas that the impressions were governed by, as in the batch path. Events of a step that is
    closed already come out as one row each batch, marked ``late``.
    """
    start = int(datetime.fromisoformat(origin).replace(tzinfo=timezone.utc).timestamp() * 1000)
    return partial_panes(impressions, actions, origin).groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=StepStates(start, window, communities, budget), outputStructType=STATE_OUTPUT, outputMode="append", timeMode="eventTime"
    )


def decision_dedup(decisions: DataFrame, keys: list[str], delay: str = "2 days") -> DataFrame:
    """One row per logical decision; repeats within the watermark are dropped."""
    return decisions.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def controller_stream(steps: DataFrame, config: dict) -> DataFrame:
    """Controller decisions over a stream of (run_id, timestep, state ratios), such as governance_state_stream."""
    return steps.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=Controller(config), outputStructType=CONTROLLER_OUTPUT, outputMode="append", timeMode="none"
    )
