"""The streaming paths run to the end over the given tables, as files that arrive."""


from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.plans import bindings as B
from flowguard.plans.registry import query
from flowguard.plans.q_features import WINDOW_SQL, rounded, window_cte
from flowguard.plans.q_ingest import flow_json_lines
from flowguard.session import scratch
from flowguard.streaming import detect, features, ingest
from flowguard.streaming.ledger import Ledger


def live_session(spark):
    """A session of its own for a stream, with as many state partitions as the caller's shuffles.

    The number of state partitions is fixed when a stream first starts.
    """
    live = B.pin_utc(spark.newSession())
    name = "spark.sql.shuffle.partitions"
    live.conf.set(name, spark.conf.get(name))
    return live


SPLIT = 3


def arriving(spark, sf, out, run):
    """Hands the events over in three batches, by id, and runs the stream once after each."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(SPLIT):
        events.where(F.col("event_id") % SPLIT == i).write.parquet(f"{out}/input/{i}")
        run()


def flow_stream(spark, sf, folder=None):
    """The events file, or what arrives in a folder of such files, as a stream of flows."""
    spark = live_session(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    raw = reader.parquet(f"{folder}/input/*") if folder else \
        reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    raw = raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k",
                                                                       B.number_in_props())
    return raw.select("event_id", *[c.alias(n) for n, c in B.flow_columns().items()])


def written(stream, out, name):
    """Runs a stream to the end of what there is, into a table."""
    (stream.writeStream.format("parquet").option("path", f"{out}/{name}")
     .option("checkpointLocation", f"{out}/{name}-checkpoint").trigger(availableNow=True).start()
     .awaitTermination())


def diverted(spark, sf, out, delay=0):
    """Flows in three batches, most of the later two late; ledger, on-time and late tables."""
    arriving(spark, sf, out, lambda: ingest.start_divert(
        flow_stream(spark, sf, out), out, f"{out}/divert", delay).awaitTermination())
    ledger = Ledger(spark, f"{out}/flows").read()
    return ledger.drop("event_date", "batch_id")


@query("str_4_exact_alerts", f"""WITH {B.SIGNALS}
SELECT fingerprint, category, CAST(count(*) AS BIGINT) AS occurrence_count,
  min(bucket_us) AS first_us, max(bucket_end_us) AS last_us FROM signals GROUP BY 1, 2""")
def str_4(spark, sf):
    B.pin_utc(spark)
    out = scratch(spark, "alerts")
    detect.start_detection(flow_stream(spark, sf), out, f"{out}/checkpoint",
                           B.RULES).awaitTermination()
    return detect.current_alerts(spark, out).select(
        "fingerprint", "category", "occurrence_count", B.micros("first_seen").alias("first_us"),
        B.micros("last_seen").alias("last_us"))


@query("str_2_stream_dedup", f"WITH {B.FLOWS} SELECT event_key FROM flows")
def str_2(spark, sf):
    """Each event comes twice within a batch, and all come again in batches after that."""
    B.pin_utc(spark)
    out = scratch(spark, "dedup")

    def run():
        twice = flow_stream(spark, sf, out).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
        ingest.start_divert(twice, out, f"{out}/divert", 0).awaitTermination()
    arriving(spark, sf, out, run)
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{out}/input/again")
    run()
    return Ledger(spark, f"{out}/flows").read().select("event_key")


@query("str_2_within_watermark", f"WITH {B.FLOWS} SELECT event_key FROM flows")
def str_2_within(spark, sf):
    B.pin_utc(spark)
    out = scratch(spark, "dedup")
    twice = flow_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    written(ingest.stream_dedup(twice, "2 days").select("event_key"), out, "rows")
    return spark.read.parquet(f"{out}/rows")


@query("str_1_file_ingest", f"""WITH {B.FLOWS}
SELECT CAST(event_id AS VARCHAR) AS source_event_id, t_us, 'accepted' AS outcome FROM flows
WHERE NOT (event_id % 20 BETWEEN 1 AND 6)
UNION ALL SELECT NULL, NULL, CASE WHEN event_id % 20 = 2 THEN 'empty_record'
  WHEN event_id % 20 = 6 THEN 'line_too_long' ELSE 'invalid_record' END
FROM flows WHERE event_id % 20 BETWEEN 1 AND 6""")
def str_1(spark, sf):
    out = scratch(spark, "ingest")
    flow_json_lines(spark, sf).select("value").write.text(f"{out}/input", compression="gzip")
    ingest.start_ingest(spark, f"{out}/input", "normalized", f"{out}/tables", f"{out}/checkpoint",
                        "job-1").awaitTermination()
    table = Ledger(spark, f"{out}/tables/flows")
    table.compact(table.dates(), 0)
    flows = table.read().select(
        "source_event_id", B.micros("event_time").alias("t_us"), F.lit("accepted")
        .alias("outcome"))
    rejects = ingest.read_batches(spark, f"{out}/tables/rejects").select(
        F.lit(None).cast("string").alias("source_event_id"), F.lit(None).cast("long")
        .alias("t_us"), F.col("error_code").alias("outcome"))
    return flows.unionByName(rejects)


@query("str_3_append_rules", f"""WITH {B.FLOWS}, {B.sql_matches()}
SELECT rule_key, bucket_us, coalesce(sensor_id, 'unspecified') AS sensor, src_address,
  CAST(observed_value AS BIGINT) AS observed_value, {B.sql_digest()} AS evidence_digest
FROM matches""")
def str_3(spark, sf):
    """All buckets: what the append stream closed, late flows, and the open end."""
    B.pin_utc(spark)
    out = scratch(spark, "rules")
    schema = diverted(spark, sf, out).schema
    live = ingest.on_time_flows(live_session(spark), out, schema).withWatermark("event_time", "0 seconds")
    written(detect.stream_rules(live, B.RULES), out, "rows")
    matches = spark.read.parquet(f"{out}/rows")
    return detect.settled_rules(spark, out, matches, B.RULES, 0).select(
        "rule_key", B.micros("bucket_start").alias("bucket_us"),
        F.coalesce("sensor_id", F.lit("unspecified")).alias("sensor"), "src_address",
        "observed_value", "evidence_digest")


def _grown(i):
    """Signals after batch i in buckets that grew with it."""
    return f"""f{i} AS (SELECT *, event_id % {SPLIT} AS batch FROM flows WHERE event_id % {SPLIT} <= {i}),
{B.sql_matches(f'f{i}', f'm{i}').replace(' HAVING ', f' HAVING max(batch) = {i} AND ')},
{B.sql_signals(f'm{i}', f's{i}')}"""


@query("str_5_alert_feed", f"""WITH {B.FLOWS}, {', '.join(_grown(i) for i in range(SPLIT))},
changes AS ({' UNION '.join(f"SELECT fingerprint, {i} AS batch FROM s{i}" for i in range(SPLIT))})
SELECT fingerprint, CAST(batch AS BIGINT) AS batch,
  row_number() OVER (PARTITION BY fingerprint ORDER BY batch) AS sequence FROM changes""")
def str_5(spark, sf):
    """Three batches, after each of which the feed numbers the changes of every alert."""
    B.pin_utc(spark)
    out = scratch(spark, "feed")

    def run():
        live = flow_stream(spark, sf, out)
        detect.start_detection(live, out, f"{out}/checkpoint", B.RULES).awaitTermination()
        session = live.sparkSession
        schema = session.read.parquet(f"{out}/alert_changes/*").schema
        detect.start_feed(detect.alert_feed(session, out, schema), f"{out}/feed",
                          f"{out}/feed-checkpoint").awaitTermination()
    arriving(spark, sf, out, run)
    return spark.read.schema("fingerprint string, batch long, sequence long").json(f"{out}/feed")


WINDOWS = (3600, 86400)


@query("str_6_stream_features", f"""WITH {B.FLOWS},
{', '.join(window_cte(w, WINDOW_SQL) for w in WINDOWS)}
SELECT event_key, {', '.join(f"w{w}_{n}" for w in WINDOWS for n in K.WINDOW_FEATURES)}
FROM flows {' '.join(f"JOIN w{w} USING (event_key)" for w in WINDOWS)}""")
def str_6(spark, sf):
    """All flows: what the stream emitted, late ones and what they change, and the open end."""
    B.pin_utc(spark)
    out = scratch(spark, "features")
    flows = diverted(spark, sf, out)
    live = ingest.on_time_flows(live_session(spark), out, flows.schema)
    written(features.stream_features(live, WINDOWS, "0 seconds"), out, "rows")
    cols = [f"w{w}_{n}" for w in WINDOWS for n in K.WINDOW_FEATURES]
    return features.settled_features(flows, spark.read.parquet(f"{out}/rows"), WINDOWS).select(
        "event_key", *rounded(cols))
