"""Continuous ingestion: parse files as they arrive, route rejects, drop repeats."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowguard.sources import outcomes, readers
from flowguard.streaming.ledger import DatedTable, Ledger, filesystem

PARSERS = {"normalized": readers.parse_flow_lines, "suricata": readers.parse_eve_lines}


def batch_of(frame: DataFrame, batch_id: int) -> DataFrame:
    return frame.withColumn("batch_id", F.lit(batch_id).cast("long"))


def write_batch(frame: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch, overwritten when a batch is run again."""
    frame.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema=None, before: int | None = None
                 ) -> DataFrame | None:
    """All batches written so far, up to (not including) ``before``; null if none."""
    fs, make = filesystem(spark, path)
    if not fs.exists(make(path)) or not len(fs.listStatus(make(path))):
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(path)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def accept_batch(lines: DataFrame, batch_id: int, kind: str, out: str, job_id: str,
                 sensor_id: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Parse one batch of lines; store new flows, signatures and rejects.

    Lines are parsed once, into a staged table. Flows and signatures go to ledgers by event date, which
    stop repeats however late they come. Running a batch again rewrites its own folders only, so a
    lost executor or a restart changes nothing. Returns the new flows and signatures.
    """
    spark = lines.sparkSession
    parse = readers.parse_zeek_lines if kind == "zeek" else PARSERS[kind]
    write_batch(outcomes.with_identity(parse(lines), job_id, sensor_id), f"{out}/staged",
                batch_id)
    staged = spark.read.parquet(f"{out}/staged/batch_id={batch_id}")
    flows, signatures, rejects = outcomes.split_outcomes(staged)
    new = tuple(Ledger(spark, f"{out}/{name}").add(rows, batch_id)
                for name, rows in (("flows", flows), ("signatures", signatures)))
    write_batch(rejects, f"{out}/rejects", batch_id)
    return new


def divert_batch(batch: DataFrame, batch_id: int, out: str, delay_seconds: int) -> None:
    """Stores a batch of flows; what is late goes to a side table, the rest on to the live queries.

    Late is what lies more than the delay before the newest flow of all earlier batches, so a query
    on ``on_time`` with that watermark delay meets nothing that is late to it.
    """
    spark = batch.sparkSession
    fresh = Ledger(spark, f"{out}/flows").add(batch, batch_id)
    earlier = f"{out}/marks/batch_id={batch_id - 1}"
    fs, path = filesystem(spark, earlier)
    mark = spark.read.parquet(earlier).first()["mark"] if fs.exists(path(earlier)) else None
    newest = None
    if fresh is not None:
        newest = fresh.agg(F.max("event_time")).first()[0]
        late = F.lit(False) if mark is None else (
            F.col("event_time") < F.lit(mark) - F.expr(f"INTERVAL {int(delay_seconds)} SECONDS"))
        write_batch(fresh.where(~late), f"{out}/on_time", batch_id)
        DatedTable(spark, f"{out}/late").write(fresh.where(late), batch_id)
    marks = [m for m in (mark, newest) if m is not None]
    write_batch(spark.createDataFrame([(max(marks) if marks else None,)], "mark timestamp"),
                f"{out}/marks", batch_id)


def start_divert(flows: DataFrame, out: str, checkpoint: str, delay_seconds: int, **trigger):
    """Flows into the ledger, without repeats, split into on time and late."""
    return (flows.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, i: divert_batch(df, i, out, delay_seconds))
            .trigger(**(trigger or {"availableNow": True})).start())


def on_time_flows(spark: SparkSession, out: str, schema) -> DataFrame:
    """The stream of flows that were on time."""
    return spark.readStream.schema(schema).parquet(f"{out}/on_time/*")


def start_ingest(spark: SparkSession, path: str, kind: str, out: str, checkpoint: str,
                 job_id: str, sensor_id: str | None = None, **trigger):
    """Watch a folder of telemetry files. ``trigger`` as in ``writeStream.trigger``."""
    lines = readers.text_source(spark, path, stream=True)
    return (lines.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, i: accept_batch(df, i, kind, out, job_id, sensor_id))
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_dedup(flows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, as long as repeats come within the watermark delay.

    :func:`start_divert` stops older repeats too.
    """
    return (flows.withWatermark("event_time", delay)
            .dropDuplicatesWithinWatermark(["event_key"]))
