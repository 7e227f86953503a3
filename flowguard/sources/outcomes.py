"""Routing of parse outcomes and the counts a job keeps of them."""

from pyspark.sql import DataFrame, functions as F

from flowguard import constants as K
from flowguard.functions.hashing import event_key, signature_event_key


def with_identity(tagged: DataFrame, job_id: str, sensor_id: str | None = None) -> DataFrame:
    return tagged.withColumn("job_id", F.lit(job_id)).withColumn(
        "sensor_id", F.lit(sensor_id).cast("string"))


def split_outcomes(tagged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flows, signatures, rejects); accepted rows get their event key."""
    extra = [c for c in tagged.columns if c not in ("flow", "signature", "error_code")]
    base = tagged if "sensor_id" in extra else tagged.withColumn(
        "sensor_id", F.lit(None).cast("string"))
    keep = extra if "sensor_id" in extra else [*extra, "sensor_id"]
    now = F.current_timestamp().alias("ingested_at")
    flows = base.where(F.col("flow").isNotNull()).select("flow.*", *keep, now) \
        .withColumn("event_key", event_key())
    signatures = base.where(F.col("signature").isNotNull()).select("signature.*", *keep, now) \
        .withColumn("event_key", signature_event_key())
    rejects = base.where(F.col("error_code").isNotNull()).select(*keep, "error_code")
    return flows, signatures, rejects


def job_counts(outcomes: DataFrame) -> DataFrame:
    """Per job: accepted, duplicate and rejected rows and the job's status.

    Input: job_id, error_code, is_new (an accepted row that is new to the ledger).
    """
    good = F.col("error_code").isNull()
    counts = outcomes.groupBy("job_id").agg(
        F.count_if(good & F.col("is_new")).alias("accepted"),
        F.count_if(good & ~F.col("is_new")).alias("duplicate"),
        F.count_if(~good).alias("rejected"))
    none = (F.col("accepted") + F.col("duplicate")) == 0
    return counts.select("*", F.when(none, "rejected").otherwise("succeeded").alias("status"),
                         F.when(none, K.ALL_RECORDS_REJECTED).alias("error_code"))


def write_quarantine(rejects: DataFrame, path: str) -> None:
    """Rejected rows by their reason."""
    rejects.write.mode("append").partitionBy("error_code").parquet(path)
