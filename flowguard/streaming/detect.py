"""Streaming rules: a fast append path, and the exact path that re-reads touched buckets."""

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from flowguard.functions.flow_columns import bucket, is_failure
from flowguard.functions.hashing import lane_sums, lanes_to_digest
from flowguard.operators import rules as R
from flowguard.operators.alerts import rollup_alerts
from flowguard.operators.signals import novel_signals, signature_signals, with_signal_keys
from flowguard.session import materialised
from flowguard.sources import readers
from flowguard.streaming.features import ROCKSDB
from flowguard.streaming.ingest import accept_batch, write_batch
from flowguard.streaming.ledger import DatedTable, Ledger, dates_of


def _stream_window(flows: DataFrame, rules, assets: DataFrame | None) -> DataFrame:
    """Matches of rules with one window and the same exclusions, from one stateful pass.

    A flow gives a row for every rule that considers it. Ports are a set of at most 65,536 numbers
    per group; events are only counted and summed, so the state of a group stays small however
    many flows it has.
    """
    for rule in rules:
        rule.check()
    seconds = rules[0].window_seconds
    rows = R.exclude_assets(flows, assets, rules[0].excluded_asset_ids)

    def seen_by(i, rule):
        held = R.GROUPS[rule.evaluator_key]
        scan = rule.evaluator_key == "port_scan_v1"
        applies = F.lit(True) if rule.evaluator_key == "high_connection_rate_v1" \
            else F.col("dst_port").isNotNull()
        if rule.evaluator_key == "repeated_failure_v1":
            applies = applies & is_failure(F.col("source_type"), F.col("state"), rule.failure_states)
        text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
        return F.when(applies, F.struct(
            F.lit(i).alias("rule"),
            (F.col("dst_address") if "dst_address" in held else text).alias("dst_address"),
            (F.col("dst_port") if "dst_port" in held else number).alias("dst_port"),
            (F.col("protocol") if "protocol" in held else text).alias("protocol"),
            (F.col("dst_port") if scan else number).alias("port")))

    def choose(values):
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("rule"))
    asked = rows.select("event_time", "event_key", "sensor_id", "src_address", F.explode(
        F.array_compact(F.array(*[seen_by(i, r) for i, r in enumerate(rules)]))).alias("r"))
    counted = (asked.select("event_time", "event_key", "sensor_id", "src_address", "r.*")
               .groupBy(F.window("event_time", f"{seconds} seconds").alias("w"), "rule", "sensor_id",
                        "src_address", "dst_address", "dst_port", "protocol")
               .agg(F.count(F.lit(1)).alias("n"), *lane_sums(F.col("event_key")),
                    F.size(F.collect_set("port")).alias("ports")))
    scans = choose([r.evaluator_key == "port_scan_v1" for r in rules])
    observed = F.when(scans, F.col("ports")).otherwise(F.col("n")).cast("long")
    threshold = choose([r.threshold for r in rules]).cast("long")
    return counted.where(observed >= threshold).select(
        choose([r.rule_key for r in rules]).alias("rule_key"),
        choose([r.version_id for r in rules]).alias("rule_version_id"),
        choose([r.category for r in rules]).alias("category"),
        choose([r.severity for r in rules]).alias("severity"), F.col("w.start").alias("bucket_start"),
        F.col("w.end").alias("bucket_end"), F.lit(seconds).alias("window_seconds"), "sensor_id",
        "src_address", "dst_address", "dst_port", "protocol", observed.alias("observed_value"),
        threshold.alias("threshold_value"), F.col("n").alias("evidence_count"),
        lanes_to_digest(F.col("n")).alias("evidence_digest"))


def stream_rules(flows: DataFrame, rules, assets: DataFrame | None = None) -> DataFrame:
    """All active rules over a deduplicated stream with a watermark, in append mode.

    Rules of one window and the same exclusions share one scan and one state; ``assets`` is a
    static table.
    """
    shared: dict = {}
    for rule in sorted((r for r in rules if r.active), key=lambda r: r.rule_key):
        shared.setdefault((rule.window_seconds, tuple(rule.excluded_asset_ids)), []).append(rule)
    out = None
    for group in shared.values():
        part = _stream_window(flows, group, assets)
        out = part if out is None else out.unionByName(part)
    return out


BUCKET = ["rule_key", "bucket_start", "sensor_id", "src_address", "dst_address", "dst_port",
          "protocol"]


def bucket_dates(flows: DataFrame, rules) -> list[str]:
    """Dates of all buckets that flows fall into, under any of the rules."""
    ends = []
    for seconds in {r.window_seconds for r in rules}:
        start = bucket(F.col("event_time"), seconds)
        ends += [start, F.timestamp_micros(F.unix_micros(start) + seconds * 1_000_000 - 1)]
    days = flows.select(F.explode(F.array(*[F.struct(a.alias("lo"), b.alias("hi")) for a, b in
                                            zip(ends[::2], ends[1::2])])).alias("b"))
    days = days.select(F.explode(F.sequence(F.to_date("b.lo"), F.to_date("b.hi"))).alias("d"))
    return [str(r[0]) for r in days.distinct().collect()]


def settled_rules(spark: SparkSession, out: str, matches: DataFrame, rules, delay_seconds: int,
                  assets: DataFrame | None = None) -> DataFrame:
    """The append stream's matches, put right where they are not final.

    Buckets that a late flow fell into (from the side table of :func:`ingest.start_divert`) and those
    that the watermark has not closed are evaluated over all their flows; all others stay as the
    stream gave them. Only the dates of those buckets are read.
    """
    ledger, late = Ledger(spark, f"{out}/flows"), DatedTable(spark, f"{out}/late")
    days = ledger.dates()
    if not days:
        return matches
    newest = ledger.read(days[-1:]).agg(F.max("event_time")).first()[0]
    reach = timedelta(seconds=max(r.window_seconds for r in rules) + int(delay_seconds) + 1)
    open_days = [d for d in days if d >= str((newest - reach).date())]
    touched = ledger.read(open_days).where(F.col("event_time") >= F.lit(newest - reach))
    touched = touched.drop("event_date", "batch_id")
    behind = late.read()
    if behind is not None:
        touched = touched.unionByName(behind.drop("event_date", "batch_id"))
    touched = materialised(touched.select("event_time"))
    stored = ledger.read(bucket_dates(touched, rules))
    exact = R.evaluate_rules(stored, rules, assets, touched, unique=True)
    redone = None
    for seconds in sorted({r.window_seconds for r in rules}):
        starts = touched.select(bucket(F.col("event_time"), seconds).alias("_start"),
                                F.lit(seconds).alias("_seconds")).distinct()
        redone = starts if redone is None else redone.unionAll(starts)
    kept = matches.join(redone, (F.col("bucket_start") == F.col("_start"))
                        & (F.col("window_seconds") == F.col("_seconds")), "left_anti")
    return kept.unionByName(exact)


def detect_batch(spark: SparkSession, batch_id: int, out: str, rules, assets,
                 flows: DataFrame | None, signatures: DataFrame | None = None) -> None:
    """Signals and alert changes of a batch whose new flows and signature events are stored.

    The buckets that the flows touch are evaluated over all their flows, signature events
    are signals of their own, novel signals are stored, and alert changes are written. Everything goes into
    folders of this batch, so a repeated batch gives the same tables.
    """
    found, days = None, []
    if flows is not None:
        days = bucket_dates(flows, rules)
        stored = Ledger(spark, f"{out}/flows").read(days, before=batch_id + 1)
        found = with_signal_keys(R.evaluate_rules(stored, rules, assets, flows, unique=True))
    if signatures is not None:
        more = signature_signals(signatures)
        days = sorted({*days, *dates_of(more, "bucket_start")})
        found = more if found is None else found.unionByName(more)
    if found is None:
        return
    table = DatedTable(spark, f"{out}/signals", "bucket_start")
    known = table.read(days, before=batch_id)
    new = found.dropDuplicates(["semantic_key"]) if known is None else novel_signals(found, known)
    table.write(new, batch_id)
    fresh = [f"{table.path}/event_date={d}/batch_id={batch_id}" for d in days
             if batch_id in table._parts(d)]
    if fresh:
        changes = rollup_alerts(spark.read.parquet(*fresh)).withColumn(
            "batch", F.lit(batch_id).cast("long"))
        write_batch(changes, f"{out}/alert_changes", batch_id)


def upsert_batch(batch: DataFrame, batch_id: int, out: str, rules, assets=None) -> None:
    """Exact evaluation of a batch of flows, however late its events are.

    The ledger takes what is new in the batch, and :func:`detect_batch` goes on from there.
    """
    spark = batch.sparkSession
    fresh = Ledger(spark, f"{out}/flows", ["event_key"]).add(batch, batch_id)
    detect_batch(spark, batch_id, out, rules, assets, fresh)


def start_live(spark: SparkSession, path: str, kind: str, out: str, checkpoint: str, job_id: str,
               rules, assets: DataFrame | None = None, sensor_id: str | None = None, **trigger):
    """The whole live path: telemetry files in, flows, signatures, rejects, signals and alerts out."""
    def step(lines, batch_id):
        flows, signatures = accept_batch(lines, batch_id, kind, out, job_id, sensor_id)
        detect_batch(lines.sparkSession, batch_id, out, rules, assets, flows, signatures)
    lines = readers.text_source(spark, path, stream=True)
    return (lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_alerts(spark: SparkSession, out: str) -> DataFrame:
    """Alerts as they stand: all signals added up."""
    signals = DatedTable(spark, f"{out}/signals", "bucket_start").read()
    return rollup_alerts(signals.drop("batch_id", "event_date"))


def start_detection(flows: DataFrame, out: str, checkpoint: str, rules,
                    assets: DataFrame | None = None, **trigger):
    return (flows.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, i: upsert_batch(df, i, out, rules, assets))
            .trigger(**(trigger or {"availableNow": True})).start())


class ChangeCounter(StatefulProcessor):
    """Numbers the changes of an alert in the order of their batches, from 1 on."""

    def init(self, handle):
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        batches = sorted(int(b) for frame in rows for b in frame["batch"])
        held = self.count.get() if self.count.exists() else None
        n = held[0] if held else 0
        self.count.update((n + len(batches),))
        yield pd.DataFrame({"fingerprint": [key[0]] * len(batches), "batch": batches,
                            "sequence": range(n + 1, n + 1 + len(batches))})

    def close(self):
        pass


def alert_feed(spark: SparkSession, out: str, schema) -> DataFrame:
    """Stream of alert changes: which alert, in which batch, and the how manyth change of it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    changes = spark.readStream.schema(schema).parquet(f"{out}/alert_changes/*")
    return changes.select("fingerprint", "batch").groupBy("fingerprint").transformWithStateInPandas(
        statefulProcessor=ChangeCounter(),
        outputStructType="fingerprint string, batch long, sequence long",
        outputMode="Append", timeMode="None")


def start_feed(feed: DataFrame, path: str, checkpoint: str, **trigger):
    """Write the feed as JSON lines; a message bus takes the same rows."""
    return (feed.writeStream.format("json").option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
