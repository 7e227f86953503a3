"""Trailing-window features per (sensor, source), exact and linear after sorting.

A flow counts towards its own window and every later one until it expires, so a
window total is a running sum of arrivals less expiries. Sliding frames, whose cost
grows with rows times frame length, are not needed:

* counts and sums: +x on arrival, -x on expiry;
* distinct counts: an arrival counts unless the same value is still in the window,
  an expiry counts unless the same value came again before it;
* maximum: time is cut into blocks as long as the window; a window is the end of one
  block and the start of the next, so it is the larger of a suffix and a prefix maximum;
* prior service: the previous flow to the same service, if still in the window.

Sources are cut into time slices, each with the rows of one window length before it; one shuffle
serves all windows and features. Sources that crowd a slice are not worked on there: their rows are
dealt out by ranges of (source, time, key), and running totals are carried from block to block
(:mod:`flowguard.operators.blocks`), so one source may fill any number of tasks.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowguard import constants as K
from flowguard.functions.flow_columns import is_failure
from flowguard.operators.blocks import in_blocks, running

SLICES_PER_WINDOW = 4
#: Rows of one source in one slice from which it is dealt out in blocks. At least a thousandth of all
#: rows, so there are at most a thousand such slices.
CROWD = 500_000
#: Rows of a task, context included. Each row is sorted six times over, the last time with its moves.
TASK_ROWS = 50_000
SOURCE = ["sensor_id", "src_address"]
NEEDED = ["event_key", "sensor_id", "src_address", "dst_address", "dst_port", "protocol",
          "packet_count", "byte_count", "duration_ms"]


def slice_length(longest: int, slice_seconds: int | None = None) -> int:
    length = int(slice_seconds or SLICES_PER_WINDOW * longest) * 1_000_000
    if length < longest * 1_000_000:
        raise ValueError("a slice must be at least as long as the longest window")
    return length


def own_slice(length: int) -> Column:
    t = F.unix_micros("event_time")
    return ((t - F.pmod(t, F.lit(length))) / F.lit(length)).cast("long")


def slice_copies(longest: int, slice_seconds: int | None = None) -> Column:
    """The slices a flow goes to: its own, and the next if a window reaches from there to the flow."""
    length = slice_length(longest, slice_seconds)
    own = own_slice(length)
    late = F.unix_micros("event_time") >= (own + 1) * length - longest * 1_000_000
    return F.when(late, F.array(own, own + 1)).otherwise(F.array(own))


def busy_sources(flows: DataFrame, longest: int, slice_seconds: int | None = None,
                 crowd: int = CROWD) -> list[tuple]:
    """(sensor_id, src_address) of sources with more than ``crowd`` rows in one slice.

    A crowd is at least a thousandth of all rows.
    """
    return _counted(flows, longest, slice_seconds, crowd)[0]


def _counted(flows: DataFrame, longest: int, slice_seconds: int | None, crowd: int
             ) -> tuple[list[tuple], int]:
    """The busy sources, and how many rows there are."""
    length = slice_length(longest, slice_seconds)
    counts = flows.groupBy(*SOURCE, own_slice(length).alias("slice")).count()
    seen = counts.agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    total = seen["rows"] or 0
    limit = max(crowd, total // 1000)
    if (seen["most"] or 0) <= limit:
        return [], total
    return [tuple(r) for r in counts.where(F.col("count") > limit).select(*SOURCE).distinct()
            .collect()], total


def sliced(flows: DataFrame, longest: int, slice_seconds: int | None, carry) -> DataFrame:
    """Flows with their slice; late rows of a slice also go to the next as context."""
    length = slice_length(longest, slice_seconds)
    t, own = F.unix_micros("event_time"), own_slice(length)
    copies = slice_copies(longest, slice_seconds)
    failed = is_failure(F.col("source_type"), F.col("state")).cast("long")
    return (flows.select(*NEEDED, *carry, t.alias("t"), failed.alias("failed"),
                         own.alias("_own"), F.explode(copies).alias("slice"))
            .withColumn("target", F.col("slice") == F.col("_own"))
            .withColumn("slice_end", (F.col("slice") + 1) * length)
            .drop("_own"))


def _block(seconds: int) -> Column:
    width = F.lit(seconds * 1_000_000)
    return F.col("t") - F.pmod(F.col("t"), width)


def _moves(rows: DataFrame, seconds) -> DataFrame:
    """Each flow's arrival, and per window the moment it leaves, as far as its slice reaches."""
    t = F.col("t")
    moves = [F.struct(t.alias("pos"), F.lit(-1).alias("leaves"))]
    for i, w in enumerate(seconds):
        end = t + w * 1_000_000
        moves.append(F.when(F.coalesce(end < F.col("slice_end"), F.lit(True)),
                            F.struct(end.alias("pos"), F.lit(i).alias("leaves"))))
    return rows.select("*", F.explode(F.array_compact(F.array(*moves))).alias("m")) \
        .select("*", "m.pos", "m.leaves", F.when(F.col("m.leaves") == -1, 0).otherwise(1)
                .alias("turn")).drop("m")


SWEEP = ["pos", "turn", "event_key", "leaves"]


def _totals(seconds) -> dict:
    """Per name (kind, column): what is totalled along the moves of a source."""
    t, arrives = F.col("t"), F.col("leaves") == -1

    def total(i: int, amount: Column, come: Column = None, go: Column = None):
        plus = amount if come is None else F.when(come, amount).otherwise(0)
        minus = -amount if go is None else F.when(go, -amount).otherwise(0)
        return "sum", F.when(arrives, plus).when(F.col("leaves") == i, minus).otherwise(0)

    def absent(c, reach):
        return F.col(c).isNull() | (F.col(c) < t - reach)

    def unseen(c, reach):
        return F.col(c).isNull() | (F.col(c) > t + reach)

    values = {}
    one, has_port = F.lit(1).cast("long"), F.col("dst_port").isNotNull()
    for i, w in enumerate(seconds):
        reach = w * 1_000_000
        values |= {
            f"n{i}": total(i, one),
            f"dst{i}": total(i, one, absent("dst_prev", reach), unseen("dst_next", reach)),
            f"port{i}": total(i, one, has_port & absent("port_prev", reach),
                              has_port & unseen("port_next", reach)),
            f"packets{i}": total(i, F.col("packet_count")),
            f"bytes{i}": total(i, F.col("byte_count")),
            f"failures{i}": total(i, F.col("failed")),
            f"duration{i}": total(i, F.col("duration_ms")),
            f"prefix{i}": ("max", F.when(arrives, F.struct(
                _block(w).alias("b"), F.col("duration_ms").alias("d")))),
            f"oldest{i}": ("last", F.when(F.col("leaves") == i, F.col(f"after{i}"))),
            f"first{i}": ("first", F.when(arrives, F.col(f"suffix{i}"))),
        }
    return values


def _suffix(w: int) -> Column:
    """Its maximum going back in time is that of the rest of a block: blocks only get smaller."""
    return F.struct((-_block(w)).alias("b"), F.col("duration_ms").alias("d"))


def _dealt(rows: DataFrame, part, expected: int) -> DataFrame:
    """Rows by ``part``, in tasks of about ``TASK_ROWS``; few rows are left to adaptive execution."""
    tasks = -(-expected // TASK_ROWS)
    if tasks <= rows.sparkSession.sparkContext.defaultParallelism:
        return rows.repartition(*part)
    return rows.repartition(tasks, *part)


def _swept_slices(flows: DataFrame, seconds, slice_seconds, carry, total: int) -> DataFrame:
    """Totals at each arrival, a window over each (source, slice)."""
    part = [*SOURCE, "slice"]
    context = max(seconds) * 1_000_000 / slice_length(max(seconds), slice_seconds)
    rows = _dealt(sliced(flows, max(seconds), slice_seconds, carry), part,
                  int(total * (1 + context)))
    forward = ["t", "event_key"]
    by_dst = W.partitionBy(*part, "dst_address").orderBy(*forward)
    by_port = W.partitionBy(*part, "dst_port").orderBy(*forward)
    by_service = W.partitionBy(*part, "dst_address", "dst_port", "protocol").orderBy(*forward)
    backward = W.partitionBy(*part).orderBy(F.col("t").desc(), F.col("event_key").desc())
    rows = rows.select("*", F.lag("t").over(by_dst).alias("dst_prev"),
                       F.lead("t").over(by_dst).alias("dst_next"))
    rows = rows.select("*", F.lag("t").over(by_port).alias("port_prev"),
                       F.lead("t").over(by_port).alias("port_next"))
    rows = rows.select("*", F.lag("t").over(by_service).alias("service_prev"))
    rows = rows.select("*", *[
        F.max(_suffix(w)).over(backward.rowsBetween(W.unboundedPreceding, 0)).alias(f"suffix{i}")
        for i, w in enumerate(seconds)])
    rows = rows.select("*", *[F.lag(f"suffix{i}").over(backward).alias(f"after{i}")
                              for i in range(len(seconds))])
    sweep = W.partitionBy(*part).orderBy(*SWEEP).rowsBetween(W.unboundedPreceding, 0)
    fns = {"sum": F.sum, "max": F.max, "first": lambda c: F.first(c, ignorenulls=True),
           "last": lambda c: F.last(c, ignorenulls=True)}
    totals = _totals(seconds)
    return _moves(rows, seconds).select(
        "event_key", *carry, "t", "service_prev", "target", "leaves",
        *[fns[kind](c).over(sweep).alias(n) for n, (kind, c) in totals.items()]) \
        .where(F.col("target") & (F.col("leaves") == -1))


def _swept_blocks(flows: DataFrame, seconds, carry) -> DataFrame:
    """Totals at each arrival for busy sources, carried over blocks of any source's rows."""
    forward = ["t", "event_key"]
    rows = flows.select(
        *NEEDED, *carry, F.unix_micros("event_time").alias("t"),
        is_failure(F.col("source_type"), F.col("state")).cast("long").alias("failed"),
        F.lit(None).cast("long").alias("slice_end"))
    t = F.col("t")
    for name, of in (("dst", ["dst_address"]), ("port", ["dst_port"]),
                     ("service", ["dst_address", "dst_port", "protocol"])):
        keys = [*SOURCE, *of]
        rows = running(in_blocks(rows, keys, forward), keys, forward,
                       {f"{name}_prev": ("max", t)}, exclusive=True)
        if name != "service":
            rows = running(rows, keys, forward, {f"{name}_next": ("min", t)}, exclusive=True,
                           backward=True)
        rows = rows.drop("_block")
    rows = in_blocks(rows, SOURCE, forward)
    for name, exclusive in (("suffix", False), ("after", True)):
        rows = running(rows, SOURCE, forward, {
            f"{name}{i}": ("max", _suffix(w)) for i, w in enumerate(seconds)},
            exclusive=exclusive, backward=True)
    moves = in_blocks(_moves(rows.drop("_block"), seconds), SOURCE, SWEEP)
    return running(moves, SOURCE, SWEEP, _totals(seconds)).where("leaves = -1")


def window_features(flows: DataFrame, seconds=K.DEFAULT_WINDOWS,
                    slice_seconds: int | None = None, carry=(), crowd: int = CROWD) -> DataFrame:
    """One row per flow: event_key, ``carry`` columns and eleven features per window.

    Flows must be unique by event_key. A window holds what is at most ``seconds`` older
    (inclusive) and not after the flow in the order (event_time, event_key). Rows are counted by source
    and slice when this is called; ``crowd`` says from how many on a source goes by blocks.
    """
    seconds = tuple(int(s) for s in seconds)
    busy, total = _counted(flows, max(seconds), slice_seconds, crowd)
    if not busy:
        return _named(_swept_slices(flows, seconds, slice_seconds, carry, total), seconds, carry)
    names = flows.sparkSession.createDataFrame(busy, "_sensor string, _source string")
    same = F.col("sensor_id").eqNullSafe(F.col("_sensor")) & F.col("src_address").eqNullSafe(
        F.col("_source"))
    quiet = flows.join(F.broadcast(names), same, "left_anti")
    crowded = flows.join(F.broadcast(names), same, "left_semi")
    return _named(_swept_slices(quiet, seconds, slice_seconds, carry, total), seconds, carry).unionAll(
        _named(_swept_blocks(crowded, seconds, carry), seconds, carry))


def _named(swept: DataFrame, seconds, carry) -> DataFrame:
    """The features by name, out of the totals at each arrival."""
    out = []
    for i, w in enumerate(seconds):
        oldest = F.coalesce(F.col(f"oldest{i}"), F.col(f"first{i}"))
        prefix = F.col(f"prefix{i}.d")
        longest = F.when(-oldest["b"] < F.col(f"prefix{i}.b"), F.greatest(prefix, oldest["d"])) \
            .otherwise(prefix)
        prior = F.col("service_prev") >= F.col("t") - w * 1_000_000
        since = (F.col("t") - F.col("service_prev")) / F.lit(1_000_000.0)
        values = {
            "flow_count": F.col(f"n{i}"),
            "unique_dst_address_count": F.col(f"dst{i}"),
            "unique_dst_port_count": F.col(f"port{i}"),
            "packet_total": F.col(f"packets{i}"),
            "byte_total": F.col(f"bytes{i}"),
            "failure_count": F.col(f"failures{i}"),
            "mean_duration_ms": F.col(f"duration{i}") / F.col(f"n{i}"),
            "max_duration_ms": longest,
            "mean_bytes_per_flow": F.col(f"bytes{i}") / F.col(f"n{i}"),
            "seconds_since_prior_service": F.when(prior, since).otherwise(F.lit(0.0)),
            "prior_service_missing": ~F.coalesce(prior, F.lit(False)),
        }
        out += [values[name].alias(f"w{w}_{name}") for name in K.WINDOW_FEATURES]
    return swept.select("event_key", *carry, *out)
