"""Sources, sinks and streams."""

import datetime
import functools
import json
import random

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import dataset, exposure, governance
from sluiceway.sources import readers, sinks
from sluiceway.operators.governance import LATE_STEP
from sluiceway.streaming import controller_stream, decision_dedup, govern_stream, governance_state_stream, lifecycle_stream, run_to_table
from sluiceway.streaming.jobs import IMPRESSION_SCHEMA


def test_examples_lines_and_errors(spark, tmp_path):
    good = json.dumps({"sample_id": "a", "label": {"action": "quote", "confidence": 1.0, "reason": "r"}})
    lines = [good, "", "{bad", "[1]", json.dumps({"sample_id": 5, "label": {"action": "quote"}}), json.dumps({"sample_id": "b", "label": {"action": "like"}})]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(lines) + "\n")
    out = {r.line: (r.error, r.example.sample_id if r.example else None) for r in readers.scan_examples(spark, str(path), strict=False).collect()}
    assert out == {
        1: (None, "a"), 3: ("invalid JSON", None), 4: ("line is not a JSON object", None), 5: ("sample_id is not a string", None),
        6: ("label.action is missing or invalid", None),
    }
    with pytest.raises(ValueError, match="3: invalid JSON"):
        readers.scan_examples(spark, str(path))


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"{i}\n" for i in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        out = readers.numbered_lines(spark, str(path))
        assert out.where(F.col("line") != F.col("value").cast("bigint")).count() == 0 and out.count() == 20000
        assert out.select("file").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_examples_round_trip_in_order(spark, tmp_path):
    rows = [("s2", 2), ("s1", 1), ("s9", None), ("s0", 2)]
    df = spark.createDataFrame(rows, "sample_id string, decision_sequence bigint").withColumn(
        "label", F.struct(F.lit("quote").alias("action"), F.lit(1.0).alias("confidence"), F.lit("é").alias("reason"))
    )
    path = str(tmp_path / "out")
    sinks.write_examples(df, path)
    text = [r.value for r in readers.numbered_lines(spark, path).orderBy("file", "line").collect()]
    assert [json.loads(v)["sample_id"] for v in text] == ["s1", "s0", "s2", "s9"]
    assert text[0] == json.dumps(json.loads(text[0]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_impression_sink_quarantines(spark, tmp_path):
    base = spark.range(4).select(
        F.col("id").alias("impression_id"), F.lit("r").alias("run_id"), (F.col("id") % 2).alias("timestep"), F.col("id").alias("user_id"),
        F.col("id").alias("post_id"), F.col("id").alias("root_post_id"), F.lit("a").alias("user_community"), F.lit("a").alias("author_community"),
        F.lit(1.0).alias("base_score"), F.when(F.col("id") == 3, 1.5).otherwise(0.5).alias("risk_score"), F.lit(0.5).alias("omega_intra"),
        F.lit(0.5).alias("omega_inter"), F.lit(0.5).alias("keep_probability"), F.lit(True).alias("shown"), F.lit("following").alias("source"),
    )
    path = str(tmp_path / "log")
    rejected = sinks.append_impressions(base, path)
    assert [r.reject for r in rejected.collect()] == ["risk_score"]
    sinks.append_impressions(base, path)
    assert spark.read.parquet(path).count() == 6


def test_stream_fails_whole_refreshes_like_the_batch(spark, tmp_path, rows_of):
    users = spark.createDataFrame([(0, "a"), (1, "b")], "user_id bigint, community string")
    roots = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 3, 1)], "post_id bigint, root_post_id bigint, root_author_id bigint")
    risk = spark.createDataFrame([(1, 0.5)], "post_id bigint, risk_score double")
    data = [(1, "r", 0, 0, [1, 2]), (2, "r", 0, 1, [1, 3]), (3, "r", 1, 1, [2])]
    src = tmp_path / "in"
    rows = spark.createDataFrame(data, "refresh_id bigint, run_id string, user_id bigint, timestep bigint, posts array<bigint>").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    rows.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    sink = str(tmp_path / "sink")
    govern_stream(stream, sink, roots, users, risk, 0.5, 0.2, seed=7)
    got = spark.read.parquet(f"{sink}/log").select("refresh_id", "post_id", "shown")
    flat = rows.select("refresh_id", "run_id", "user_id", "timestep", F.posexplode("posts").alias("rank", "post_id"))
    want = exposure.govern(flat, roots, users, risk, F.lit(0.5), F.lit(0.2), seed=7).select("refresh_id", "post_id", "shown")
    assert rows_of(got) == rows_of(want)
    # refresh 2 holds post 3, whose root has no risk: none of its posts may appear
    assert {r.refresh_id for r in got.collect()} == {1, 3}
    govern_stream(stream, sink, roots, users, risk, 0.5, 0.2, seed=7)
    assert spark.read.parquet(f"{sink}/log").count() == got.count()


def test_dedup_and_controller_streams(spark, tmp_path):
    src = tmp_path / "ev"
    spark.range(10).select((F.col("id") % 4).alias("d"), F.lit("2024-01-01").cast("timestamp").alias("ts")).write.parquet(str(src))
    stream = spark.readStream.schema("d bigint, ts timestamp").parquet(str(src))
    base = str(tmp_path / "job")
    assert run_to_table(decision_dedup(stream, ["d"]), "t", base).count() == 4
    # the same job again finds nothing new, also when the same decision arrives once more
    spark.range(1).select(F.lit(2).cast("bigint").alias("d"), F.lit("2024-01-01").cast("timestamp").alias("ts")).write.mode("append").parquet(str(src))
    assert run_to_table(decision_dedup(stream, ["d"]), "t", base).count() == 4
    steps = tmp_path / "st"
    spark.range(4).select(
        F.lit("r").alias("run_id"), F.col("id").alias("timestep"), F.lit(0.9).alias("risk_adoption_rate"), F.lit(20).cast("bigint").alias("recent_reposts"),
        F.lit(1.0).alias("community_coverage_ratio"), F.lit(0.9).alias("cross_community_exposure_ratio"), F.lit(0.8).alias("report_rate"),
        F.lit(0.0).alias("benign_exposure_loss"),
    ).write.parquet(str(steps))
    schema = spark.read.parquet(str(steps)).schema
    config = dict(interval=2, step=0.5, risk_target=0.1, cross_target=0.1, report_target=0.1, loss_limit=0.5, budget=0.2, omega_intra=1.0, omega_inter=1.0)
    out = run_to_table(controller_stream(spark.readStream.schema(schema).parquet(str(steps)), config), "c").orderBy("timestep").collect()
    assert [round(r.cumulative_cost, 6) for r in out] == [0.2, 0.2, 0.2, 0.2]
    assert out[1].reason == "between control intervals" and out[2].reason == "budget exhausted"


CONTROL = dict(interval=2, step=0.3, risk_target=0.1, cross_target=0.1, report_target=0.1, loss_limit=0.5, budget=1.2, omega_intra=1.0, omega_inter=1.0)


@pytest.fixture
def few_partitions(spark):
    """Stateful jobs on small data: each partition keeps a state store of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_state_and_controller_over_deliveries(spark, tmp_path, few_partitions):
    """Days out of order inside the watermark give the batch result; a day that comes after its step was closed is late."""
    rng = random.Random(2)
    names = [f.split(" ")[0] for f in IMPRESSION_SCHEMA.split(", ")]
    day0 = datetime.datetime(2024, 1, 1)

    def impressions(days):
        out = []
        for d in days:
            for _ in range(12):
                run, shown, risk = rng.choice("pqq"), rng.random() < 0.7, rng.choice([0.0, 0.0, 0.9])
                ts = day0 + datetime.timedelta(days=d, hours=rng.randint(0, 23))
                out.append((1, 0, ts, run, d, 1, 1, 1, rng.choice(["a", "b", "c", "new"][: 2 + d // 3]), rng.choice("ab"), risk, 1 - d * 0.05, 1 - (d % 3) * 0.1, 0.5, shown))
        return spark.createDataFrame(out, IMPRESSION_SCHEMA)

    def actions(days):
        out = [(day0 + datetime.timedelta(days=d, hours=rng.randint(0, 23)), rng.choice("pq"), rng.choice(["repost", "report_post", "do_nothing"])) for d in days for _ in range(9)]
        return spark.createDataFrame(out, "ts timestamp, run_id string, action string")

    # steps 0 to 3 are closed when the third delivery comes: its day 1 is late, its day 6 is not
    deliveries = [[0, 1, 3], [2, 5, 7], [6, 1, 11]]
    on_time, counted = [], []
    for k, days in enumerate(deliveries):
        seen, acts = impressions(days).persist(), actions(days).persist()
        seen.coalesce(1).write.parquet(str(tmp_path / "log" / str(k)))
        acts.coalesce(1).write.parquet(str(tmp_path / "act" / str(k)))
        keep = F.col("timestep") != 1 if k == 2 else F.lit(True)
        on_time.append(seen.where(keep))
        day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
        counted.append(acts.withColumn("timestep", day).where(keep))

        def stream(folder, schema):
            return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / folder)).withWatermark("ts", "2 days")

        state = governance_state_stream(stream("log", IMPRESSION_SCHEMA), stream("act", "ts timestamp, run_id string, action string"), window=3, communities=4, budget=1.2, origin="2024-01-01")
        got = run_to_table(state, "s", str(tmp_path / "job-state")).collect()
        decided = run_to_table(controller_stream(state, CONTROL), "c", str(tmp_path / "job-control")).collect()

    log, trace = (functools.reduce(lambda a, b: a.unionByName(b), x) for x in (on_time, counted))
    assert names == log.columns
    costs = governance.cumulative_cost(log.select("run_id", "timestep", "omega_intra", "omega_inter").distinct())
    want = {(r.run_id, r.timestep): r for r in governance.governance_state(log, trace, F.lit(4), window=3).collect()}
    cost = {(r.run_id, r.timestep): r.cumulative_cost for r in costs.collect()}
    closed = {(r.run_id, r.timestep): r for r in got if not r.late}
    assert sorted(closed) == [(run, k) for run in "pq" for k in range(9)] and len(closed) == sum(not r.late for r in got)
    spent = {"p": 0.0, "q": 0.0}
    for key in sorted(closed, key=lambda x: x[1]):
        a, b = closed[key], want[key]
        for c in ("risk_adoption_rate", "community_coverage_ratio", "cross_community_exposure_ratio", "report_rate", "benign_exposure_loss", "recent_reposts"):
            assert getattr(a, c) == pytest.approx(getattr(b, c)), (key, c)
        spent[key[0]] = cost.get(key, spent[key[0]])
        assert a.cumulative_cost == pytest.approx(spent[key[0]]) and a.remaining_budget == pytest.approx(max(0.0, 1.2 - spent[key[0]]))
    late = sorted((r.run_id, r.timestep) for r in got if r.late)
    assert set(late) <= {("p", 1), ("q", 1)} and ("q", 1) in late
    assert [(r.run_id, r.timestep) for r in sorted(decided) if r.reason == LATE_STEP] == late
    moved = {(r.run_id, r.timestep): r for r in decided if r.reason != LATE_STEP}
    assert sorted(moved) == sorted(closed)
    # the decisions equal those over the closed steps as one finished table
    spark.createDataFrame([r for r in got if not r.late]).coalesce(1).write.parquet(str(tmp_path / "steps"))
    table = spark.read.parquet(str(tmp_path / "steps"))
    at_once = run_to_table(controller_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "steps")), CONTROL), "c").collect()
    assert sorted(at_once) == sorted(moved.values())


def test_lifecycle_stream_equals_the_batch(spark, tmp_path, few_partitions):
    """Outcomes before their decision, twice, too late and unannounced; the job restarts between deliveries."""
    start = datetime.datetime(2024, 1, 1)
    at = lambda hours: start + datetime.timedelta(hours=hours)
    schemas = {
        "pending": "ts timestamp, decision_id string, user_id bigint, legal array<string>",
        "outcomes": "ts timestamp, decision_id string, outcome string, choice string, action_trace_rowid bigint, failure_category string",
        "trace": "ts timestamp, rowid bigint, user_id bigint, action string",
    }
    legal = ["ignore", "repost:1"]
    pending = [(at(1), f"d{i}", i, legal) for i in range(10)] + [(at(1), "d0", 0, legal), (at(50), "end", 99, legal)]
    trace = [(at(1), 100 + i, i, "repost") for i in range(7)] + [(at(40), 109, 9, "repost"), (at(50), 999, 99, "repost")]
    won = lambda h, d, row, choice="repost:1": (at(h), d, "succeeded", choice, row, None)
    told = [
        won(2, "d0", 100), won(2, "d0", 100), won(2, "d1", 101, "quote:1"), won(2, "d2", 103), won(2, "d3", 555),
        (at(2), "d4", "failed", None, None, "timeout"), (at(2), "d5", "failed", None, None, "Host 1"),
        won(2, "d6", 106), (at(3), "d6", "failed", None, None, "late_one"),  # the first outcome decides
        won(2, "d9", 109),  # its trace comes a day later than the outcome
        won(2, "nobody", 100), won(50, "end", 999),
    ]  # d7 and d8 are never told
    late = [won(30, "d7", 106)]
    # the outcomes of a delivery come before the decisions they belong to
    deliveries = [{"outcomes": told[:11], "pending": pending[:2] + pending[10:11], "trace": trace[:7]}, {"pending": pending[2:10]}, {"outcomes": told[11:] + late, "pending": pending[11:], "trace": trace[7:]}, {}]
    for k, delivery in enumerate(deliveries):
        for name, schema in schemas.items():
            spark.createDataFrame(delivery.get(name, []), schema).coalesce(1).write.parquet(str(tmp_path / name / str(k)))
        s = {n: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / n)).withWatermark("ts", "3 hours") for n, schema in schemas.items()}
        out = run_to_table(lifecycle_stream(s["pending"], s["outcomes"], s["trace"], timeout_ms=24 * 3_600_000, horizon_ms=24 * 3_600_000), "l", str(tmp_path / "job")).collect()
    final = sorted((r.decision_id, r.status, r.reject_reason) for r in out if r.final)
    once = [o for o in told if o[1] not in ("d0", "d6", "d9", "nobody")] + [told[0], told[7]]
    batch = dataset.resolve_lifecycle(
        spark.createDataFrame(pending[:10] + pending[11:], schemas["pending"]).drop("ts"), spark.createDataFrame(once, schemas["outcomes"]).drop("ts"),
        spark.createDataFrame(trace, schemas["trace"]).drop("ts"),
    ).collect()
    want = {r.decision_id: (r.decision_id, r.status, r.reject_reason) for r in batch}
    want["d9"] = ("d9", "pending", "action trace does not exist")
    assert final == sorted(want.values())
    assert ("d6", "succeeded", None) in final and ("d7", "pending", None) in final
    gone = sorted(r.decision_id for r in out if r.reject_reason == dataset.NO_LONGER_PENDING)
    assert gone == ["d0", "d6", "d7", "nobody"] or gone == ["d0", "d6", "nobody"]
