"""State machines folded over tables of requested transitions.

A transition says which state it expects and which it wants. It takes effect when it
is legal in itself and the expected state is the current one. Such a step is a function from
state to state, and functions can be chained. An entity's steps are ranked and cut into chunks of a
fixed number; a chunk is folded into a small map, from each state that its steps expect to the state
it ends in. Chunks of chunks are chained to maps in the same way, level by level, until an entity is
one chunk. Then states are handed down again, from the start of an entity to that of every chunk,
and the steps are judged chunk by chunk. So no history is gathered, whatever its length: a group
holds ``chunk`` steps or maps, and an entity with most of the rows is as many tasks as it has chunks.
The size of a map is the number of states its steps expect.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowguard import constants as K
from flowguard.operators.blocks import in_blocks, running
from flowguard.session import materialised

ABSENT = ""
#: Steps of a chunk, and steps of one entity up to which one task ranks them.
CHUNK, CROWD = 256, 500_000


def legal(machine: dict, current: Column, target: Column) -> Column:
    """Is the step in the transition table?"""
    out = F.lit(False)
    for state, targets in machine.items():
        if targets:
            out = out | ((current == state) & target.isin(*targets))
    return F.coalesce(out, F.lit(False))


def transition_error(machine: dict, current: Column, target: Column,
                     disposition: Column | None) -> Column:
    """Reason a single step is refused, or null."""
    error = F.when(~legal(machine, current, target), "invalid_transition")
    if disposition is not None:
        error = (error.when((target == "closed") & disposition.isNull(),
                            "close_requires_disposition")
                 .when((target != "closed") & disposition.isNotNull(),
                       "disposition_only_on_close"))
    return error


def check_transitions(events: DataFrame, machine: dict, dispositions: bool = True) -> DataFrame:
    """Each requested step with the reason it is refused, if any."""
    return events.withColumn("error", transition_error(
        machine, F.col("current"), F.col("target"),
        F.col("disposition") if dispositions else None))


def _ranked(steps: DataFrame, entity: str, crowd: int) -> tuple[DataFrame, int]:
    """Steps with their rank ``_i`` within the entity from 0, and the most steps of an entity."""
    most = steps.groupBy(entity).count().agg(F.max("count")).first()[0] or 0
    order = ["at", "seq", "step_id"]
    if most <= crowd:
        rank = F.row_number().over(W.partitionBy(entity).orderBy(*order))
        return steps.withColumn("_i", (rank - 1).cast("long")), most
    placed = running(in_blocks(steps, [entity], order), [entity], order,
                     {"_i": ("sum", F.lit(1).cast("long"))})
    return placed.withColumn("_i", F.col("_i") - 1).drop("_block"), most


def _parent(chunk: int) -> Column:
    return F.floor(F.col("_i") / chunk).alias("_up")


def _gathered(rows: DataFrame, entity: str, chunk: int, item: Column) -> DataFrame:
    """Chunks (entity, _up, _items): up to ``chunk`` items in order of their rank."""
    return rows.groupBy(entity, _parent(chunk)).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), item.alias("v"))))
        .alias("_items")).withColumn("_items", F.col("_items.v"))


def _step(state: Column, s: Column) -> Column:
    return F.when(s["legal"] & (s["expected"] == state), s["target"]).otherwise(state)


def _map(state: Column, effect: Column) -> Column:
    """The state after a chunk whose map is a list of (key, value)."""
    hit = F.filter(effect, lambda e: e["key"] == state)
    return F.coalesce(F.get(hit, F.lit(0))["value"], state)


def _before(items: Column, start: Column, apply) -> Column:
    """The state that each item of a chunk meets."""
    none = F.array().cast("array<string>")
    return F.aggregate(
        items, F.struct(start.alias("state"), none.alias("seen")),
        lambda acc, x: F.struct(apply(acc["state"], x).alias("state"),
                                F.array_append(acc["seen"], acc["state"]).alias("seen")),
        lambda acc: acc["seen"])


def fold_steps(steps: DataFrame, entity: str, start: Column, chunk: int = CHUNK,
               crowd: int = CROWD) -> DataFrame:
    """Judge steps in the order (at, seq, step_id).

    Columns in: the entity, at, seq, step_id (unique), expected, target, legal.
    Rows out: the step, ``before`` (state it met) and ``accepted``. The number of levels is set when
    this is called, by a count per entity.
    """
    placed, most = _ranked(steps, entity, crowd)
    leaves = _gathered(placed, entity, chunk, F.struct(*steps.columns))
    sizes = [-(-most // chunk)]
    while sizes[-1] > chunk:
        sizes.append(-(-sizes[-1] // chunk))
    if most > chunk:
        leaves = materialised(leaves)

    # Upwards: the map of every chunk, then of every chunk of chunks.
    levels, rows = [], leaves
    for level in range(len(sizes) if most > chunk else 0):
        apply, keys = (_map, lambda e: e["key"]) if level else (_step, None)
        if level:
            wanted = F.array_distinct(F.flatten(F.transform(
                "_items", lambda e: F.transform(e, keys))))
        else:
            wanted = F.array_distinct(F.transform("_items", lambda s: s["expected"]))
        effect = F.transform(F.filter(wanted, lambda e: e.isNotNull()), lambda e: F.struct(
            e.alias("key"), F.aggregate("_items", e, apply).alias("value")))
        effects = rows.select(entity, F.col("_up").alias("_i"), effect.alias("_effect"))
        rows = _gathered(effects, entity, chunk, F.col("_effect"))
        if sizes[level] > chunk:
            rows = materialised(rows)
        levels.append(rows)

    # Downwards: the state that each chunk starts with.
    starts = None
    for rows in reversed(levels):
        if starts is not None:
            rows = rows.join(starts, [entity, "_up"])
        states = _before(F.col("_items"), start if starts is None else F.col("_start"), _map)
        starts = rows.select(entity, "_up", F.posexplode(states).alias("_p", "_next")).select(
            entity, (F.col("_up") * chunk + F.col("_p")).alias("_up"), F.col("_next").alias("_start"))
    judged = leaves if starts is None else leaves.join(starts, [entity, "_up"])
    states = _before(F.col("_items"), start if starts is None else F.col("_start"), _step)
    pairs = F.arrays_zip(F.col("_items").alias("s"), states.alias("before"))
    return (judged.select(F.explode(pairs).alias("p")).select("p.s.*", "p.before")
            .withColumn("accepted", F.col("legal") & (F.col("expected") == F.col("before"))))


def fold_transitions(events: DataFrame, machine: dict, initial: str, entity: str = "entity_id",
                     dispositions: bool = True, chunk: int = CHUNK) -> DataFrame:
    """All requested transitions of workflow entities, accepted or refused with a reason.

    Columns in: entity, at, seq, step_id, current (expected state), target, disposition.
    """
    error = transition_error(machine, F.col("current"), F.col("target"),
                             F.col("disposition") if dispositions else None)
    steps = events.withColumn("_error", error).withColumn("expected", F.col("current")) \
        .withColumn("legal", F.col("_error").isNull())
    done = fold_steps(steps, entity, F.lit(initial), chunk)
    reason = (F.when(F.col("before") != F.col("current"), "state_conflict")
              .otherwise(F.col("_error")))
    return done.select(*events.columns, "before", "accepted", reason.alias("error"))


def final_states(folded: DataFrame, initial: str, entity: str = "entity_id",
                 payload=("disposition",)) -> DataFrame:
    """State per entity after all accepted steps; reopening has cleared the closure."""
    last = F.max(F.when(F.col("accepted"), F.struct("at", "seq", "target", *payload)))
    return (folded.groupBy(entity)
            .agg(last.alias("_l"), F.count_if("accepted").alias("accepted_steps"),
                 F.count_if(~F.col("accepted")).alias("refused_steps"))
            .select(entity, F.coalesce("_l.target", F.lit(initial)).alias("state"),
                    *[F.col(f"_l.{p}").alias(p) for p in payload], "accepted_steps",
                    "refused_steps"))


def reviewed_versions(events: DataFrame) -> DataFrame:
    """First review per rule version decides: approved or retired."""
    first = F.min(F.struct("at", "seq", "approved"))
    return (events.where("kind = 'review'").groupBy("rule_key", "version")
            .agg(first.alias("_r"))
            .select("rule_key", "version", F.col("_r.at").alias("reviewed_at"),
                    F.col("_r.seq").alias("_reviewed_seq"),
                    F.when(F.col("_r.approved"), "approved").otherwise("retired")
                    .alias("lifecycle")))


def fold_rule_lifecycle(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Activation history of rules.

    Columns in: rule_key, at, seq, step_id, kind (review, activate, deactivate), version,
    approved, expected_version. A version can be activated once approved; the expected
    active version has to be the current one; going back to a smaller version is a
    rollback.
    """
    reviews = reviewed_versions(events)
    acts = events.where("kind <> 'review'").join(reviews, ["rule_key", "version"], "left")
    approved = ((F.col("lifecycle") == "approved")
                & (F.struct("reviewed_at", "_reviewed_seq") < F.struct("at", "seq")))
    off = F.col("kind") == "deactivate"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(ABSENT))
    steps = acts.select(
        "rule_key", "at", "seq", "step_id", "kind", "version",
        text("expected_version").alias("expected"),
        F.when(off, F.lit(ABSENT)).otherwise(text("version")).alias("target"),
        F.when(off, F.col("expected_version").isNotNull())
        .otherwise(F.coalesce(approved, F.lit(False))).alias("legal"))
    done = fold_steps(steps, "rule_key", F.lit(ABSENT), chunk)
    was = F.nullif(F.col("before"), F.lit(ABSENT)).cast("int")
    action = (F.when(~F.col("accepted"), F.when(F.col("before") != F.col("expected"),
                                                "active_rule_changed")
                     .when(F.col("kind") == "deactivate", "active_rule_not_found")
                     .otherwise("rule_not_approved"))
              .when(F.col("kind") == "deactivate", "deactivate")
              .when(was == F.col("version"), "unchanged")
              .when(was > F.col("version"), "rollback").otherwise("activate"))
    return done.select("rule_key", "at", "seq", "step_id", "kind", "version",
                       was.alias("previous_version"), "accepted", action.alias("action"))


def expire_requests(requests: DataFrame, now) -> DataFrame:
    """Simulated requests whose time is over become expired."""
    due = (F.col("status") == "simulated") & (F.col("expires_at") <= F.lit(now))
    return requests.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def self_reviews(df: DataFrame) -> DataFrame:
    """Rows reviewed by their own creator."""
    return df.where(F.col("created_by") == F.col("reviewed_by"))


def first_requests(df: DataFrame, keys=("actor_id", "idempotency_key")) -> DataFrame:
    """First request per key, how often it came, and whether a payload differed."""
    keys = list(keys)
    return (df.groupBy(*keys)
            .agg(F.min(F.struct("created_at", "request_id")).alias("_f"),
                 F.count(F.lit(1)).alias("copies"),
                 (F.min("payload_hash") != F.max("payload_hash")).alias("conflict"))
            .select(*keys, F.col("_f.request_id").alias("request_id"), "copies", "conflict"))


def stale_work(df: DataFrame, now, pending_seconds: int, processing_seconds: int,
               n: int | None = None) -> DataFrame:
    """Jobs waiting or running for too long, oldest first; all of them unless ``n`` is given."""
    from datetime import timedelta
    waiting = ((F.col("status") == "pending")
               & (F.col("created_at") < F.lit(now - timedelta(seconds=pending_seconds))))
    running = ((F.col("status") == "processing")
               & (F.col("started_at") < F.lit(now - timedelta(seconds=processing_seconds))))
    late = df.where(waiting | running).orderBy("created_at", "job_id")
    return late if n is None else late.limit(n)


def over_quota(df: DataFrame, n: int = K.MAX_BATCHES_IN_FLIGHT) -> DataFrame:
    """Actors with no batch left: n or more in flight."""
    busy = F.count_if(F.col("status").isin("pending", "processing"))
    return df.groupBy("actor_id").agg(busy.alias("in_flight")).where(F.col("in_flight") >= n)
