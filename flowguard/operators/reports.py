"""Counts, summaries and windowed reports over the workflow tables."""

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from flowguard import constants as K

def _n():
    return F.count(F.lit(1))


def state_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(_n().alias("n"))


def detection_metrics(runs: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rows (metric, n): runs by status and the sums over runs and alerts."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    by_status = runs.groupBy("status").agg(_n().alias("n")).select(
        F.concat(F.lit("runs_"), "status").alias("metric"), "n")
    sums = runs.agg(total("signal_count").alias("signals"), total("alert_count").alias("alerts"),
                    total("suppressed_count").alias("suppressed"))
    seen = alerts.agg(total("occurrence_count").alias("occurrences"))
    return (by_status.unionByName(_stacked(sums, ["signals", "alerts", "suppressed"]))
            .unionByName(_stacked(seen, ["occurrences"])))


def _stacked(one_row: DataFrame, names) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in names])
    return one_row.select(F.explode(pairs).alias("p")).select("p.metric", "p.n")


def ingestion_metrics(jobs: DataFrame, now, delay_seconds: int) -> DataFrame:
    """Rows (metric, n): jobs by status, record sums, delayed and failed jobs."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    late = F.lit(now - timedelta(seconds=delay_seconds))
    by_status = jobs.groupBy("status").agg(_n().alias("n")).select(
        F.concat(F.lit("jobs_"), "status").alias("metric"), "n")
    names = ["accepted", "rejected", "duplicate", "delayed", "failed"]
    sums = jobs.agg(
        total("accepted_records").alias("accepted"), total("rejected_records").alias("rejected"),
        total("duplicate_records").alias("duplicate"),
        F.count_if((F.col("status") == "pending") & (F.col("created_at") < late))
        .alias("delayed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return by_status.unionByName(_stacked(sums, names))


def inventory(tables: dict) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        part = df.agg(_n().alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def summary(runs: DataFrame, reports: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: how many runs, reports and feedback entries, and is there enough to judge."""
    counts = [d.agg(_n()).scalar() for d in (reports, feedback)]
    return runs.agg(_n().alias("run_count"),
                    F.coalesce(F.sum("sample_count"), F.lit(0)).alias("sample_count")).select(
        "run_count", counts[0].alias("report_count"), counts[1].alias("feedback_count"),
        (F.col("sample_count") >= K.MINIMUM_SAMPLES).alias("evaluable"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return state_counts(feedback, "disposition")


def report(kind: str, runs: DataFrame, metrics: DataFrame, feedback: DataFrame,
           events: DataFrame, start, end, minimum: int = K.MINIMUM_SAMPLES) -> DataFrame:
    """Rows (section, key, n, status) of one report over [start, end].

    Sections with fewer samples than the minimum hold nothing but their sample count.
    """
    if kind not in K.REPORT_TYPES:
        raise ValueError("unsupported report type")
    inside = F.col("created_at").between(F.lit(start), F.lit(end))
    held = runs.where(inside)
    by_status = held.groupBy("status").agg(_n().alias("n")).select(
        F.lit("run_status_counts").alias("section"), F.col("status").alias("key"), "n")
    by_metric = (metrics.join(held.select("run_id"), "run_id", "left_semi")
                 .groupBy("status").agg(_n().alias("n"))
                 .select(F.lit("metric_status_counts").alias("section"),
                         F.col("status").alias("key"), "n"))
    def one(name, df):
        return df.agg(_n().alias("n")).select(F.lit("totals").alias("section"),
                                              F.lit(name).alias("key"), "n")
    run_count = one("run_count", held)
    feedback_count = one("feedback_count", feedback.where(inside))
    event_count = one("event_count", events.where(inside))
    samples = held.agg(F.coalesce(F.sum("sample_count"), F.lit(0)).cast("long").alias("n"))
    parts = {
        "synthetic_feedback_summary": [feedback_count],
        "synthetic_operations": [event_count, run_count],
        "synthetic_quality_drift": [by_status, by_metric],
        "synthetic_retention_recovery": [event_count],
        "synthetic_gate_evidence": [run_count, event_count],
    }[kind]
    bounded = kind not in ("synthetic_operations", "synthetic_retention_recovery")
    if kind == "synthetic_feedback_summary":
        samples = feedback.where(inside).agg(_n().alias("n"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    if not bounded:
        return rows.select(F.lit(kind).alias("report_type"), "section", "key", "n",
                           F.lit("complete").alias("status"))
    enough = samples.select(F.col("n") >= minimum).scalar()
    size = samples.select(F.lit("totals").alias("section"), F.lit("sample_count").alias("key"),
                          "n")
    return (rows.where(enough).unionByName(size)
            .select(F.lit(kind).alias("report_type"), "section", "key", "n",
                    F.when(enough, "complete").otherwise("not_evaluable").alias("status")))


def recent(df: DataFrame, n: int, where=None, by: str = "created_at", tie: str = "id"
           ) -> DataFrame:
    """The newest n rows, optionally of one status."""
    rows = df if where is None else df.where(where)
    return rows.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(n)


def ordered(df: DataFrame, *by) -> DataFrame:
    return df.orderBy(*by)


def _packed(value):
    """A text as bytes: those a lower-case hex text spells, behind a 1, or its own behind a 0.

    Different texts have different bytes, and hashes take half the room.
    """
    spelled = F.lower(F.hex(F.unhex(value))) == value
    return F.when(spelled, F.concat(F.lit(b"\x01"), F.unhex(value))).otherwise(
        F.concat(F.lit(b"\x00"), value.cast("binary")))


def _unpacked(value):
    rest = F.substring(value, 2, 2 ** 31 - 1)
    return F.when(F.substring(value, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(
        rest.cast("string"))


def feedback_valid(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """Feedback whose evidence hash is one of its run's hashes; hashes are shuffled as bytes."""
    left = feedback.withColumn("evidence_hash", _packed(F.col("evidence_hash")))
    right = runs.select("run_id", F.transform("hashes", _packed).alias("hashes"))
    return (left.join(right, "run_id")
            .where(F.array_contains("hashes", F.col("evidence_hash"))).drop("hashes")
            .withColumn("evidence_hash", _unpacked(F.col("evidence_hash")))
            .select("run_id", *[c for c in feedback.columns if c != "run_id"]))
