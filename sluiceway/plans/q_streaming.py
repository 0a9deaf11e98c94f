"""Queries U1-U5: the same events as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_folder
from ..streaming import (
    controller_stream,
    decision_dedup,
    exposure_by_step,
    govern_stream,
    governance_state_stream,
    impression_stream,
    lifecycle_stream,
    read_events,
    roots_stream,
    run_to_latest,
    run_to_table,
)
from ..streaming.jobs import IMPRESSION_SCHEMA
from .q_dataset import OUTCOMES, outcomes_of
from .q_governance import BUDGET, COSTS, OMEGAS, STATE, STATE_COLUMNS, WINDOW, omega_columns
from .registry import query
from .views import OMEGA_INTER, OMEGA_INTRA, SEED, Logs, second_post

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
ORIGIN = "2024-01-01"
DELAY_HOURS = 1
#: The events arrive in so many deliveries; a job runs over each of them and keeps its state in between.
DELIVERIES = 2


def _events(t: Logs):
    return read_events(t.spark, t.dir, EVENTS, "events.parquet")


def _refreshes(t: Logs):
    """One row per refresh with the posts of its feed and the event time."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    r = F.col("event_id")
    views = _events(t).where("event_type = 'view'").where((r % 29 != 0) & (r % 31 != 0))
    return views.select(
        r.alias("refresh_id"), "ts", "user_id", F.concat(F.lit("run-"), (F.col("user_id") % 4).cast("string")).alias("run_id"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("timestep"),
        F.array(k, second_post(r, k, t.n_posts)).alias("posts"),
    )


def _governed(t: Logs) -> str:
    """The impression log of the stream, governed once per session like the stored facts."""

    def govern() -> str:
        sink = new_folder(t.spark, "stream/exposure")
        govern_stream(_refreshes(t), sink, t.roots, t.users, t.post_risk, OMEGA_INTRA, OMEGA_INTER, seed=SEED)
        return sink

    return t.once("stream exposure", govern)


def _exposed(t: Logs):
    return impression_stream(t.spark, _governed(t), f"{DELAY_HOURS} hour")


@query("stream_exposure", "SELECT impression_id, root_post_id, round(keep_probability, 9) AS keep_probability, shown FROM impressions")
def _(t: Logs):
    log = t.spark.read.schema(IMPRESSION_SCHEMA).parquet(f"{_governed(t)}/log")
    return log.select(
        (F.col("refresh_id") * 2 + F.col("rank")).alias("impression_id"), "root_post_id",
        F.round("keep_probability", 9).alias("keep_probability"), "shown",
    )


TIMED = "SELECT i.*, t.ts FROM impressions i JOIN trace0 t ON i.refresh_id = t.rowid"


@query(
    "stream_exposure_by_step",
    """SELECT run_id, timestep, count(*)::BIGINT AS candidates, (count(*) FILTER (shown))::BIGINT AS shown,
         (count(*) FILTER (NOT shown))::BIGINT AS suppressed FROM timed GROUP BY 1, 2""",
    timed=TIMED,
)
def _(t: Logs):
    rows = run_to_latest(exposure_by_step(_exposed(t)), "by-step", ["run_id", "step_start"])
    step = F.datediff(F.to_date("step_start"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return rows.select("run_id", step.alias("timestep"), "candidates", "shown", "suppressed")


STATE_NAMES = (*STATE_COLUMNS, "remaining_budget")
# steps end with the day; the watermark has passed those whose end lies a delay before the last event
CLOSED = f"(SELECT max(ts) - INTERVAL {DELAY_HOURS} HOUR FROM trace0) >= DATE '{ORIGIN}' + (timestep + 1)::INTEGER * INTERVAL 1 DAY"
BUDGETS = f"""SELECT s.*, greatest(0.0::DOUBLE, {BUDGET}::DOUBLE - coalesce(last_value(c.cumulative_cost IGNORE NULLS) OVER (
    PARTITION BY s.run_id ORDER BY s.timestep), 0)) AS remaining_budget
  FROM state s LEFT JOIN costs c ON c.run_id = s.run_id AND c.timestep = s.timestep"""


def _deliver(t: Logs, folder: str, k: int) -> None:
    """One more delivery into the folders of a job: impressions and actions of the next days.

    The omegas of the log move with the step, as in the batch queries, so the budget has something to follow.
    """
    bounds = F.col("timestep").between(k * 30 // DELIVERIES, (k + 1) * 30 // DELIVERIES - 1) if k < DELIVERIES - 1 else F.col("timestep") >= k * 30 // DELIVERIES
    log = t.spark.read.schema(IMPRESSION_SCHEMA).parquet(f"{_governed(t)}/log").drop("omega_intra", "omega_inter").withColumns(omega_columns())
    log.where(bounds).select(*[f.split(" ")[0] for f in IMPRESSION_SCHEMA.split(", ")]).write.parquet(f"{folder}/log/{k}")
    t.run_trace.where(bounds).select("ts", "run_id", "action").write.parquet(f"{folder}/actions/{k}")


def _over_deliveries(t: Logs, name: str, job):
    """The rows of a streaming job that is started anew for each delivery, on the state it left."""
    folder = new_folder(t.spark, f"stream/{name}")
    for k in range(DELIVERIES):
        _deliver(t, folder, k)
        seen = t.spark.readStream.schema(IMPRESSION_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/log").withWatermark("ts", f"{DELAY_HOURS} hour")
        acts = t.spark.readStream.schema("ts timestamp, run_id string, action string").option("recursiveFileLookup", "true").parquet(f"{folder}/actions").withWatermark("ts", f"{DELAY_HOURS} hour")
        rows = run_to_table(job(seen, acts), name, f"{folder}/job")
    return rows


def _states(t: Logs):
    communities = t.users.agg(F.countDistinct("community").alias("n")).first()["n"]  # one number
    return lambda seen, acts: governance_state_stream(seen, acts, window=WINDOW, communities=communities, budget=BUDGET, origin=ORIGIN)


@query(
    "stream_governance_state",
    f"""SELECT run_id, timestep, recent_reposts, {", ".join(f"round({c}, 6) AS {c}" for c in STATE_NAMES)} FROM budgets WHERE {CLOSED}""",
    state=STATE,
    omegas=OMEGAS,
    costs=COSTS,
    budgets=BUDGETS,
)
def _(t: Logs):
    rows = _over_deliveries(t, "state", _states(t)).where("not late")
    return rows.select("run_id", "timestep", "recent_reposts", *[F.round(n, 6).alias(n) for n in STATE_NAMES])


@query("stream_post_roots", "SELECT post_id, root_post_id, root_author_id, depth FROM roots")
def _(t: Logs):
    """Roots kept over deliveries in which many parents come after their descendants."""
    folder = new_folder(t.spark, "stream/roots")
    posts = t.post.select("post_id", "user_id", "original_post_id")
    for k in range(3):
        posts.where((F.col("post_id") * 7 + F.floor(F.col("post_id") / 50)) % 3 == k).write.parquet(f"{folder}/posts/{k}")
        arriving = t.spark.readStream.schema(posts.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/posts")
        rooted, _ = roots_stream(arriving, f"{folder}/sink")
    return rooted.select("post_id", "root_post_id", "root_author_id", "depth")


# a decision is announced with its action and told after 90 minutes; it stays pending for 6 hours at most
TOLD_MINUTES, TIMEOUT_HOURS, HORIZON_HOURS = 90, 6, 24


@query(
    "stream_decision_lifecycle",
    f"""SELECT decision_id, user_id, status, reject_reason FROM (
          SELECT *, CASE WHEN outcome IS NULL OR reject_reason IS NOT NULL THEN 'pending' ELSE outcome END AS status FROM judged)
        WHERE status <> 'pending' OR announced + INTERVAL {TIMEOUT_HOURS} HOUR < (SELECT max(announced) - INTERVAL {DELAY_HOURS} HOUR FROM judged)""",
    outcomes=OUTCOMES,
    judged=f"""SELECT p.decision_id, p.user_id, a.ts AS announced, o.outcome, CASE
         WHEN outcome = 'succeeded' AND NOT list_contains(p.legal, o.choice) THEN 'choice is not legal'
         WHEN outcome = 'succeeded' AND t.rowid IS NULL THEN 'action trace does not exist'
         WHEN outcome = 'succeeded' AND (t.user_id <> p.user_id OR CASE t.action WHEN 'repost' THEN 'repost' WHEN 'quote_post' THEN 'quote'
           WHEN 'report_post' THEN 'report' WHEN 'do_nothing' THEN 'ignore' END IS DISTINCT FROM split_part(o.choice, ':', 1)) THEN 'action trace does not match'
         WHEN outcome = 'failed' AND NOT regexp_matches(failure_category, '^[a-z0-9_]{{1,64}}$') THEN 'failure category is not a stable name' END AS reject_reason
       FROM snapshots p JOIN trace0 a ON a.rowid = p.decision_sequence LEFT JOIN outcomes o ON o.decision_id = p.decision_id
       LEFT JOIN trace0 t ON t.rowid = o.action_trace_rowid AND t.ts <= a.ts + INTERVAL {TOLD_MINUTES} MINUTE
         AND t.ts >= a.ts + INTERVAL {TOLD_MINUTES} MINUTE - INTERVAL {HORIZON_HOURS} HOUR""",
)
def _(t: Logs):
    """Decisions, outcomes and traces as three streams, in deliveries by the day they happened."""
    folder = new_folder(t.spark, "stream/lifecycle")
    log = t.trace.withColumn("ts", F.col("ts").cast("timestamp"))
    when = log.select(F.col("rowid").alias("decision_sequence"), "ts")
    pending = t.snapshots.join(when, "decision_sequence").select("ts", "decision_id", "user_id", "legal")
    told = outcomes_of(t.snapshots).join(pending.select("decision_id", (F.col("ts") + F.expr(f"INTERVAL {TOLD_MINUTES} MINUTE")).alias("ts")), "decision_id")
    sides = {"pending": pending, "outcomes": told, "trace": log.select("ts", "rowid", "user_id", "action")}
    day = F.datediff(F.to_date("ts"), F.lit(ORIGIN).cast("date"))
    for k in range(DELIVERIES):
        first, last = k * 30 // DELIVERIES, (k + 1) * 30 // DELIVERIES
        streams = {}
        for name, rows in sides.items():
            rows.where((day >= first) & ((day < last) if k < DELIVERIES - 1 else F.lit(True))).write.parquet(f"{folder}/{name}/{k}")
            read = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")
            streams[name] = read.withWatermark("ts", f"{DELAY_HOURS} hour")
        job = lifecycle_stream(streams["pending"], streams["outcomes"], streams["trace"], timeout_ms=TIMEOUT_HOURS * 3_600_000, horizon_ms=HORIZON_HOURS * 3_600_000)
        rows = run_to_table(job, "lifecycle", f"{folder}/job")
    return rows.where("final").select("decision_id", "user_id", "status", "reject_reason")


@query("stream_decision_dedup", "SELECT rowid AS event_id, action FROM trace0 WHERE action <> 'refresh'")
def _(t: Logs):
    """Every decision event arrives twice, once more with another attempt number."""
    acts = _events(t).where("event_type != 'view'")
    twice = acts.select("event_id", "ts", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    kept = run_to_table(decision_dedup(twice, ["event_id"]).select("event_id", "event_type"), "dedup")
    action = (
        F.when(F.col("event_type") == "click", "repost").when(F.col("event_type") == "purchase", "quote_post")
        .when(F.col("event_type") == "error", "report_post").otherwise("do_nothing")
    )
    return kept.select("event_id", action.alias("action"))


CONFIG = dict(
    interval=2, step=0.2, risk_target=0.25, cross_target=0.3, report_target=0.1, loss_limit=0.1, budget=1.2, omega_intra=1.0, omega_inter=1.0
)


@query(
    "stream_controller",
    f"""SELECT run_id, timestep, round(a, 6) AS omega_intra, round(b, 6) AS omega_inter, round(cost, 6) AS cumulative_cost, reason FROM carried
        WHERE timestep >= 0 AND {CLOSED}""",
    state=STATE,
    carried="""SELECT DISTINCT run_id, -1::BIGINT AS timestep, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS cost, '' AS reason FROM impressions
      UNION ALL SELECT run_id, t, CASE WHEN hold THEN a WHEN spend > remaining THEN least(1, greatest(0, a + (a1 - a) * remaining / spend)) ELSE a1 END,
        CASE WHEN hold THEN b WHEN spend > remaining THEN least(1, greatest(0, b + (b1 - b) * remaining / spend)) ELSE b1 END,
        cost + CASE WHEN hold THEN 0.0 WHEN spend > remaining THEN remaining ELSE greatest(0.0, spend) END,
        CASE WHEN t % 2 <> 0 THEN 'between control intervals' WHEN remaining <= 0 THEN 'budget exhausted'
          ELSE 'rule update from diffusion, coverage, reports, and benign loss' END
      FROM (SELECT *, (a - a1) + (b - b1) AS spend, t % 2 <> 0 OR remaining <= 0 AS hold FROM (
        SELECT *, least(1, greatest(0, a - 0.2 * least(1, pressure + 0.5 * least(1, recent_reposts / 10.0)) + relax)) AS a1,
          least(1, greatest(0, b - 0.2 * least(1, pressure + cr + 0.5 * community_coverage_ratio) + relax)) AS b1 FROM (
          SELECT c.run_id, s.timestep AS t, c.a, c.b, c.cost, greatest(0.0, 1.2 - c.cost) AS remaining, s.recent_reposts, s.community_coverage_ratio,
            greatest(s.risk_adoption_rate - 0.25, s.report_rate - 0.1, 0.0) AS pressure, greatest(s.cross_community_exposure_ratio - 0.3, 0.0) AS cr,
            CASE WHEN s.benign_exposure_loss > 0.1 THEN 0.2 ELSE 0.0 END AS relax
          FROM carried c JOIN state s ON s.run_id = c.run_id AND s.timestep = c.timestep + 1)))""",
)
def _(t: Logs):
    """Controller over the state of each closed step, in the same job that closes it."""
    state = _states(t)
    out = _over_deliveries(t, "controller", lambda seen, acts: controller_stream(state(seen, acts), CONFIG))
    return out.select("run_id", "timestep", *[F.round(c, 6).alias(c) for c in ("omega_intra", "omega_inter", "cumulative_cost")], "reason")
