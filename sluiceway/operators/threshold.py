"""Threshold adoption on the contact graph: as logged, step by step, and as predicted, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.changes import as_changes, change_points, valid_at
from ..functions.skew import broadcast_limit, hot_salts, is_small, leaf_bytes, lookup, salted_join
from ..session import cut
from .graph import labelled_contacts

#: Stored layers of the rounds before they are merged into one.
LAYERS = 8
#: Pairs a new adopter touches, about: so many times smaller than a broadcast is the frontier of a short round.
FAN_OUT = 8
KEYS = ["user_id", "root_post_id"]


def first_adoptions(roots: DataFrame, posts: DataFrame) -> DataFrame:
    """(root_post_id, user_id, step): when a user first wrote into the tree of a root."""
    rows = roots.select("post_id", "root_post_id", "user_id").join(posts.select("post_id", "created_at"), "post_id")
    return rows.groupBy("root_post_id", "user_id").agg(F.min("created_at").alias("step"))


def _degrees(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_degree"), F.count_if("same").alias("intra_degree"))


def threshold_states(
    arcs: DataFrame,
    users: DataFrame,
    adoptions: DataFrame,
    sightings: DataFrame,
    root_communities: DataFrame,
    *,
    threshold: float,
    weight_intra: float = 1.0,
    weight_inter: float = 1.0,
    gate: bool = True,
) -> DataFrame:
    """Threshold state of every (user, root) with an adopted neighbour, as a change-point table.

    A row holds from ``timestep`` until ``until`` (null: for good). ``adoptions``:
    (root_post_id, user_id, step); whoever adopts at a step counts from the next one on, so
    all decisions of a step see the same adopters. ``sightings``: (user_id, root_post_id,
    adopter_id, step); an adopter is observable at the step whose feed shows them, neither
    before nor after. Pairs without an adopted neighbour have signal 0 and satisfy nothing, so leaving
    them out loses no adoption.

    Contacts of celebrities are salted; changes are added up per (user, root, step) before
    they are shuffled. No row is made for a step at which nothing changes.
    """
    contacts = labelled_contacts(arcs, users)
    if not is_small(arcs):
        contacts = cut(contacts)
    held = adoptions.select(F.col("user_id").alias("neighbor_id"), "root_post_id", "step")
    rows = contacts.join(F.broadcast(held), "neighbor_id") if is_small(held) else salted_join(contacts, held, "neighbor_id")
    same, zero = F.col("same").cast("long"), F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    counts = ["adopted_intra", "adopted_inter", "observable_intra", "observable_inter", "own"]

    def events(df: DataFrame, step, **changes) -> DataFrame:
        return df.select(*KEYS, step.alias("timestep"), *[changes.get(c, zero).alias(c) for c in counts])

    gained = events(rows, F.col("step") + 1, adopted_intra=same, adopted_inter=1 - same)
    seen = (
        sightings.select(*KEYS, F.col("adopter_id").alias("neighbor_id"), F.col("step").alias("seen_at")).distinct()
        .join(contacts, ["user_id", "neighbor_id"])
        .join(held, ["root_post_id", "neighbor_id"])
        .where(F.col("step") < F.col("seen_at"))
    )
    ends = F.explode(F.array(F.struct(F.col("seen_at").alias("at"), one.alias("sign")), F.struct((F.col("seen_at") + 1).alias("at"), (-one).alias("sign"))))
    shown = seen.select(*KEYS, "same", ends.alias("e"))
    shown = events(shown, F.col("e.at"), observable_intra=F.col("e.sign") * same, observable_inter=F.col("e.sign") * (1 - same))
    own = events(adoptions, F.col("step") + 1, own=one)
    states = change_points(gained.unionByName(shown).unionByName(own), KEYS, counts, "timestep")
    states = states.where(F.col("adopted_intra") + F.col("adopted_inter") > 0)
    states = lookup(states, _degrees(contacts), "user_id", "left")
    states = lookup(states, users.select("user_id", F.col("community").alias("user_community")), "user_id", "left")
    states = lookup(states, root_communities.select("root_post_id", "root_community"), "root_post_id", "left")
    return _judged(states, threshold, weight_intra, weight_inter, gate)


def _judged(states: DataFrame, threshold: float, weight_intra: float, weight_inter: float, gate: bool) -> DataFrame:
    def signal(kind: str):
        return F.lit(weight_intra) * F.col(f"{kind}_intra") + F.lit(weight_inter) * F.col(f"{kind}_inter")

    rows = states.select(
        *KEYS,
        "timestep",
        "until",
        "user_community",
        "root_community",
        "adopted_intra",
        "adopted_inter",
        "observable_intra",
        "observable_inter",
        "total_degree",
        "intra_degree",
        (F.col("total_degree") - F.col("intra_degree")).alias("inter_degree"),
        F.lit(threshold).alias("threshold"),
        (F.lit(threshold) * F.col("total_degree")).alias("boundary"),
        signal("adopted").alias("native_signal"),
        signal("observable").alias("observable_signal"),
        (F.col("own") > 0).alias("already_adopted"),
    )
    native, observed = F.col("native_signal") > F.col("boundary"), F.col("observable_signal") > F.col("boundary")
    rows = rows.withColumns({"native_satisfied": native, "observable_satisfied": observed})
    satisfied = F.col("observable_satisfied" if gate else "native_satisfied")
    return rows.withColumns(
        {
            "threshold_satisfied": satisfied,
            "gate_passed": (F.col("observable_intra") + F.col("observable_inter") > 0) if gate else F.lit(True),
            "blocked": (F.col("native_satisfied") & ~F.col("observable_satisfied")) if gate else F.lit(False),
            "should_attempt": satisfied & ~F.col("already_adopted"),
        }
    )


def evaluations_at(states: DataFrame, decisions: DataFrame) -> DataFrame:
    """The state of every root with an adopted neighbour at each decision (user_id, timestep)."""
    asked = decisions.select("user_id", F.col("timestep").alias("at")).distinct()
    rows = states.join(asked, "user_id").where(valid_at(F.col("at"), F.col("timestep"), F.col("until")))
    return rows.drop("timestep", "until").withColumnRenamed("at", "timestep")


def shadow_summary(states: DataFrame, adoptions: DataFrame, users: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per step: totals over its deciding users and the roots adopted before it.

    ``open_``: of these, the pairs where the user has not adopted. States are turned into
    changes per user, so a decision adds up running counts: neither decisions x roots nor
    steps x users x roots are formed. Pairs without an adopted neighbour are below the threshold.
    """
    fresh, met = ~F.col("already_adopted"), F.col("observable_satisfied")
    flags = {
        "potential_adoptions": F.col("should_attempt"), "blocked": F.col("blocked"), "met": met,
        "open_blocked": F.col("blocked") & fresh, "open_met": met & fresh,
    }
    zero = F.lit(0).cast("long")
    totals = [*flags, "own", "asked"]

    def padded(df: DataFrame) -> DataFrame:
        return df.select("user_id", "timestep", *[(F.col(c) if c in df.columns else zero).alias(c) for c in totals])

    changes = padded(as_changes(states, ["user_id"], flags, "timestep"))
    own = padded(adoptions.select("user_id", (F.col("step") + 1).alias("timestep"), F.lit(1).cast("long").alias("own")))
    asked = decisions.select("user_id", "timestep").distinct().join(users.select("user_id"), "user_id", "left_semi")
    # an asked step is marked at that step alone
    asked = padded(asked.withColumn("asked", F.lit(1).cast("long")))
    per_step = changes.unionByName(own).unionByName(asked).groupBy("user_id", "timestep").agg(*[F.sum(c).alias(c) for c in totals])
    upto = W.partitionBy("user_id").orderBy("timestep").rowsBetween(W.unboundedPreceding, 0)  # a row for each step at most
    counts = [*flags, "own"]
    running = per_step.select("timestep", "asked", *[F.sum(c).over(upto).alias(c) for c in counts]).where("asked > 0")
    steps = running.groupBy("timestep").agg(F.count(F.lit(1)).alias("users"), *[F.sum(c).alias(c) for c in counts])
    births = adoptions.groupBy("root_post_id").agg((F.min("step") + 1).alias("timestep")).groupBy("timestep").agg(F.count(F.lit(1)).alias("roots"))
    # one row for each step from here on
    both = steps.join(births, "timestep", "full").withColumn("roots", F.sum(F.coalesce("roots", zero)).over(W.partitionBy(F.lit(0)).orderBy("timestep")))
    every = F.col("users") * F.col("roots")
    return both.where(F.col("users").isNotNull()).select(
        "timestep",
        every.alias("evaluations"),
        "potential_adoptions",
        "blocked",
        (every - F.col("met")).alias("below_threshold"),
        (every - F.col("own")).alias("open_evaluations"),
        "open_blocked",
        (every - F.col("own") - F.col("open_met")).alias("open_below_threshold"),
    )


def initial_adopters(roots: DataFrame, posts: DataFrame, users: DataFrame, before: int) -> DataFrame:
    """Logged adopters of each root before a step: (root_post_id, user_id, community)."""
    early = roots.join(posts.select("post_id", "created_at"), "post_id").where(F.col("created_at") < before)
    return lookup(early.select("root_post_id", "user_id").distinct(), users, "user_id", "inner")


class _Layers:
    """Rows kept as stored tables, one for each round; the smaller half is merged when there are many.

    A large layer is rewritten only once the others have grown to its size, so many short rounds
    after a long one cost what they add and not the whole state.
    """

    def __init__(self, merge):
        self._tables: list[DataFrame] = []
        self._merge = merge

    def add(self, table: DataFrame) -> None:
        self._tables.append(table)
        if len(self._tables) > LAYERS:
            self._tables.sort(key=lambda t: leaf_bytes(t) or 0, reverse=True)
            keep = LAYERS // 2
            self._tables[keep:] = [cut(self._merge(_union(self._tables[keep:])))]

    def rows(self) -> DataFrame:
        return _union(self._tables)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def threshold_rounds(
    arcs: DataFrame,
    users: DataFrame,
    seeds: DataFrame,
    *,
    threshold: float,
    weight_intra: float = 1.0,
    weight_inter: float = 1.0,
    rounds: int | None = None,
) -> DataFrame:
    """Synchronous irreversible adoption: (user_id, root_post_id, round), seeds in round 0.

    Runs until a round adopts nobody, or for ``rounds`` rounds. A round joins only the
    adopters of the round before (the frontier) with their contacts, which carry the degree of
    the user. It stores one layer: the pressure so far of each (user, root) the frontier touched, and
    the round if that adopts. Pressure only grows, so the largest of a pair's rows is the latest. Of
    earlier layers a short round reads the touched pairs alone, by a broadcast of them, and shuffles
    nothing else; a long one takes new and earlier rows in one shuffle.
    """
    contacts = cut(labelled_contacts(arcs, users))
    contacts = contacts.join(_degrees(contacts).select("user_id", "total_degree"), "user_id")
    contacts = cut(contacts.repartitionByRange("user_id", "neighbor_id"))  # a user's contacts in one task add up before they are shuffled
    hot = cut(hot_salts(contacts, ["neighbor_id"]))
    zero = F.lit(0).cast("long")
    fresh = cut(seeds.select(*KEYS).distinct())
    felt = ["intra", "inter"]
    state = _Layers(lambda rows: rows.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in (*felt, "round")]))
    state.add(cut(fresh.select(*KEYS, *[zero.alias(c) for c in felt], F.lit(0).alias("round"))))
    signal = F.lit(weight_intra) * F.col("intra") + F.lit(weight_inter) * F.col("inter")
    step = 0
    while rounds is None or step < rounds:
        step += 1
        held = fresh.select(F.col("user_id").alias("neighbor_id"), "root_post_id")
        short = is_small(held, broadcast_limit(held) // FAN_OUT)
        rows = contacts.join(F.broadcast(held), "neighbor_id") if is_small(held) else salted_join(contacts, held, "neighbor_id", hot=hot)
        same = F.col("same")
        new = rows.select(*KEYS, F.coalesce(same, F.lit(False)).cast("long").alias("intra"), F.coalesce(~same, F.lit(False)).cast("long").alias("inter"), "total_degree")
        before = state.rows()
        if short:
            new = cut(new.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in felt], F.max("total_degree").alias("total_degree")))
        touched = new.select(*KEYS)
        if short and is_small(touched):
            before = before.join(F.broadcast(touched), KEYS, "left_semi")
        elif is_small(held):  # roots without a new adopter are at their end
            before = before.join(F.broadcast(held.select("root_post_id").distinct()), "root_post_id", "left_semi")
        none = F.lit(None)
        both = new.select(*KEYS, *felt, *[none.cast("long").alias(f"had_{c}") for c in felt], none.cast("int").alias("round"), "total_degree").unionByName(
            before.select(*KEYS, *[none.cast("long").alias(c) for c in felt], *[F.col(c).alias(f"had_{c}") for c in felt], "round", none.cast("long").alias("total_degree"))
        )
        now = both.groupBy(*KEYS).agg(
            *[(F.coalesce(F.sum(c), zero) + F.coalesce(F.max(f"had_{c}"), zero)).alias(c) for c in felt],
            F.max("round").alias("adopted"), F.max("total_degree").alias("total_degree"),
        ).where("adopted is null and total_degree is not null")
        met = signal > F.lit(threshold) * F.col("total_degree")
        layer = cut(now.select(*KEYS, *felt, F.when(met, F.lit(step)).alias("round")))
        fresh = layer.where("round is not null").select(*KEYS)
        if fresh.isEmpty():
            break
        if not is_small(fresh):
            fresh = cut(fresh)  # of a large layer few rows may be new: their own size tells
        state.add(layer)
    return state.rows().where("round is not null").select(*KEYS, "round")
