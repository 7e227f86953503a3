"""Expiry of rows by their several clocks.

Every function returns what stays (and what goes where that is asked for); writing
the result back is a dynamic overwrite of the touched date partitions.
"""

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from flowguard import constants as K


def expire_flows(flows: DataFrame, ledger: DataFrame, now, days: int = K.FLOW_RETENTION_DAYS
                 ) -> tuple[DataFrame, DataFrame]:
    """(flows, ledger) without flows ingested before the cutoff and their ledger rows."""
    cutoff = F.lit(now - timedelta(days=days))
    gone = flows.where(F.col("ingested_at") < cutoff).select("event_key")
    return (flows.where(F.col("ingested_at") >= cutoff),
            ledger.join(gone, "event_key", "left_anti"))


def expire_detection(alerts: DataFrame, evidence: DataFrame, signals: DataFrame,
                     signatures: DataFrame, runs: DataFrame, now,
                     alert_days: int = K.ALERT_RETENTION_DAYS,
                     transient_days: int = K.FLOW_RETENTION_DAYS) -> dict:
    """Tables after expiry: evidence outlives its signal, runs stay while one names them."""
    old_alert = F.lit(now - timedelta(days=alert_days))
    old = F.lit(now - timedelta(days=transient_days))
    kept_alerts = alerts.where(F.col("created_at") >= old_alert)
    kept_signals = signals.where(F.col("created_at") >= old)
    gone = signals.where(F.col("created_at") < old).select(
        F.col("signal_id").alias("_gone")).distinct()
    kept_evidence = (
        evidence.join(alerts.where(F.col("created_at") < old_alert).select("alert_id"),
                      "alert_id", "left_anti")
        .join(gone, F.col("signal_id") == F.col("_gone"), "left")
        .withColumn("signal_id", F.when(F.col("_gone").isNull(), F.col("signal_id")))
        .drop("_gone"))
    kept_runs = runs.where(F.col("created_at") >= old).unionByName(
        runs.where(F.col("created_at") < old)
        .join(kept_signals.select("run_id"), "run_id", "left_semi"))
    return {"alerts": kept_alerts, "evidence": kept_evidence, "signals": kept_signals,
            "signatures": signatures.where(F.col("created_at") >= old), "runs": kept_runs}


def expire(df: DataFrame, now, column: str = "expires_at") -> DataFrame:
    """Rows that are not due yet; rows without a date stay."""
    return df.where(F.col(column).isNull() | (F.col(column) > F.lit(now)))


def redact(df: DataFrame, now, columns, column: str = "expires_at") -> DataFrame:
    """All rows; those due lose the contents of the given columns."""
    due = F.coalesce(F.col(column) <= F.lit(now), F.lit(False))
    return df.select(*[F.when(~due, F.col(c)).alias(c) if c in columns else F.col(c)
                       for c in df.columns])
