"""Metric snapshots and their comparison."""

from pyspark.sql import Column, DataFrame, functions as F

from flowguard import constants as K
from flowguard.functions.contracts import allowed_metric, allowed_sli
from flowguard.operators.ordered import quantiles


def align_metrics(baseline: DataFrame, current: DataFrame, by=()) -> DataFrame:
    """Metrics of two snapshots side by side; what one side lacks stays null."""
    a = baseline.select(*by, "metric_key", F.col("value").alias("baseline_value"),
                        F.col("sample_count").alias("baseline_samples"))
    b = current.select(*by, "metric_key", F.col("value").alias("current_value"),
                       F.col("sample_count").alias("current_samples"))
    return a.join(b, [*by, "metric_key"], "full_outer")


def drift(baseline: DataFrame, current: DataFrame, by=(), samples: tuple | None = None,
          minimum: int = K.MINIMUM_SAMPLES, warning: float = K.WARNING_DELTA,
          critical: float = K.CRITICAL_DELTA) -> DataFrame:
    """Status per metric. ``samples`` are the row counts of the two snapshots, if known."""
    if critical < warning:
        raise ValueError("critical threshold must be at least warning threshold")
    rows = align_metrics(baseline, current, by)
    least = F.least(F.coalesce("baseline_samples", F.lit(0)),
                    F.coalesce("current_samples", F.lit(0)))
    usable = (F.col("baseline_value").isNotNull() & F.col("current_value").isNotNull()
              & (least >= minimum))
    if samples is not None and min(samples) < minimum:
        usable = F.lit(False)
    delta = F.when(usable, F.abs(F.col("current_value") - F.col("baseline_value")))
    status = (F.when(~usable, "not_evaluable").when(delta >= critical, "critical")
              .when(delta >= warning, "warning").otherwise("ok"))
    return rows.select(*by, "metric_key", "baseline_value", "current_value",
                       delta.alias("delta"), status.alias("status"), least.alias("sample_count"))


def drift_overall(results: DataFrame, by=()) -> DataFrame:
    """Worst status; one metric that cannot be compared makes the whole not evaluable."""
    rows = results.groupBy(*by).agg(
        F.count_if(F.col("status") == "warning").alias("warning_count"),
        F.count_if(F.col("status") == "critical").alias("critical_count"),
        F.count_if(F.col("status") == "not_evaluable").alias("_open"))
    status = (F.when(F.col("_open") > 0, "not_evaluable")
              .when(F.col("critical_count") > 0, "critical")
              .when(F.col("warning_count") > 0, "warning").otherwise("ok"))
    return rows.select(*by, status.alias("status"), "warning_count", "critical_count")


def allowed_metrics(snapshots: DataFrame) -> DataFrame:
    """Only the metrics that may be stored."""
    return snapshots.where(allowed_metric(F.col("metric_key")))


def allowed_slis(slis: DataFrame) -> DataFrame:
    return slis.where(allowed_sli(F.col("metric_key"), F.col("dimension")))


def long_metrics(wide: DataFrame, names, by=(), samples: str = "samples") -> DataFrame:
    """Rows (by…, metric_key, value, sample_count) out of metric columns."""
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).cast("double").alias("v"))
                      for n in names])
    return (wide.select(*by, F.col(samples).cast("long").alias("sample_count"),
                        F.explode(pairs).alias("p"))
            .select(*by, F.col("p.k").alias("metric_key"), F.col("p.v").alias("value"),
                    "sample_count"))


def metric_snapshot(df: DataFrame, by, key: str, group: str, missing: Column, unseen: Column,
                    out_of_range: Column, score: str, positive: Column, latency: str) -> DataFrame:
    """All metric keys of a table, per ``by`` group, as long rows.

    Duplicates and groups are counted over pre-aggregated keys; p50 and p95 are exact.
    """
    by = list(by)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        share(missing).alias("missing_rate"), share(unseen).alias("unseen_rate"),
        share(out_of_range).alias("range_failure_rate"), F.avg(score).alias("score_mean"),
        F.stddev_pop(score).alias("score_stddev"), share(positive).alias("positive_rate"))
    keys = (df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by)
            .agg(F.sum(F.col("_n") - 1).alias("_extra"), F.sum("_n").alias("_all")))
    groups = (df.select(*by, group).distinct().groupBy(*by)
              .agg(F.count(F.lit(1)).alias("group_count")))
    tails = quantiles(df, F.col(latency), {"latency_ms_p50": 0.5, "latency_ms_p95": 0.95}, by)
    wide = (base.join(keys, by).join(groups, by).join(tails, by)
            .withColumn("row_count", F.col("samples"))
            .withColumn("duplicate_rate", F.col("_extra") / F.col("_all")))
    return long_metrics(wide, K.METRIC_KEYS, by)


# Which events a service level counts: their kind, and their status or reason.
SLI_COUNTS = {
    "api_request_count": ("api", None, None),
    "api_error_count": ("api", "failed", None),
    "queue_depth": ("queue", None, None),
    "task_success_count": ("task", "succeeded", None),
    "task_failure_count": ("task", "failed", None),
    "task_not_evaluable_count": ("task", "not_evaluable", None),
    "monitoring_stale_count": ("monitoring", None, "stale"),
    "monitoring_hash_mismatch_count": ("monitoring", None, "hash_mismatch"),
    "feedback_unresolved_count": ("feedback", "not_evaluable", None),
    "artifact_integrity_failure_count": ("artifact", "failed", None),
    "retention_cleanup_success_count": ("retention", "succeeded", None),
    "retention_cleanup_failure_count": ("retention", "failed", None),
    "backup_restore_success_count": ("backup", "succeeded", None),
    "backup_restore_failure_count": ("backup", "failed", None),
    "readiness_failure_count": ("readiness", "failed", None),
}


def sli_snapshot(events: DataFrame, window_seconds: int, dims=("component",)) -> DataFrame:
    """Service levels per window and dimensions: counts, failures and exact latencies.

    Events have a kind (api, queue, task, monitoring, feedback, artifact, retention, backup,
    readiness), a status, a reason, a duration (of api events) and an age in seconds (of what waits
    in a queue). Quantiles of a window without such events are null.
    """
    from flowguard.functions.flow_columns import bucket
    rows = events.withColumn("window_start", bucket(F.col("occurred_at"), window_seconds))
    by = ["window_start", *dims]

    def counted(kind, status, reason):
        hit = F.col("kind") == kind
        for name, value in (("status", status), ("reason", reason)):
            hit = hit if value is None else hit & (F.col(name) == value)
        return F.count_if(hit)
    counts = rows.groupBy(*by).agg(*[counted(*v).alias(k) for k, v in SLI_COUNTS.items()])
    latency = quantiles(rows.where("kind = 'api'"), F.col("duration_ms"),
                        {"api_latency_ms_p50": 0.5, "api_latency_ms_p95": 0.95}, by)
    age = quantiles(rows.where("kind = 'queue'"), F.col("age_seconds"),
                    {"queue_age_seconds_p95": 0.95}, by)
    return counts.join(latency, by, "left").join(age, by, "left")
