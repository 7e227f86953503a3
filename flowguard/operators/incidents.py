"""Incidents: groups of alerts, their members and details."""

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from flowguard import constants as K
from flowguard.functions.hashing import lane_sums, lanes_to_digest


def correlation_key(category: Column) -> Column:
    return F.sha2(F.concat(F.lit(K.CORRELATION_VERSION + ":"), category), 256)


def correlated_members(alerts: DataFrame, now, days: int = K.CORRELATION_WINDOW_DAYS) -> DataFrame:
    """Alerts seen lately with the key of the incident they belong to."""
    return (alerts.where(F.col("last_seen") >= F.lit(now - timedelta(days=days)))
            .select(correlation_key(F.col("category")).alias("correlation_key"), "category",
                    "fingerprint"))


def correlate_alerts(alerts: DataFrame, now, days: int = K.CORRELATION_WINDOW_DAYS) -> DataFrame:
    """One incident per category. Members stay a table: a category may hold most alerts."""
    return (correlated_members(alerts, now, days).groupBy("correlation_key", "category")
            .agg(F.count(F.lit(1)).alias("alert_count"), *lane_sums(F.col("fingerprint")))
            .select("correlation_key", "category", "alert_count",
                    lanes_to_digest(F.col("alert_count")).alias("members_digest")))


def new_members(members: DataFrame, existing: DataFrame) -> DataFrame:
    """Members that are not attached to their incident yet."""
    keys = ["correlation_key", "fingerprint"]
    return members.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")


def member_counts(members: DataFrame, existing: DataFrame) -> DataFrame:
    """Per incident: how many members are added and how many it has then."""
    added = new_members(members, existing).groupBy("correlation_key").agg(
        F.count(F.lit(1)).alias("added"))
    had = existing.select("correlation_key", "fingerprint").distinct() \
        .groupBy("correlation_key").agg(F.count(F.lit(1)).alias("had"))
    return (added.join(had, "correlation_key", "left")
            .select("correlation_key", "added",
                    (F.col("added") + F.coalesce("had", F.lit(0))).alias("alert_count")))


def incident_detail(incidents: DataFrame, members: DataFrame, timeline: DataFrame) -> DataFrame:
    """Members and timeline rows of incidents in one ordered table."""
    m = members.select("correlation_key", F.lit("member").alias("kind"),
                       F.lit(None).cast("timestamp").alias("at"),
                       F.col("fingerprint").alias("detail"))
    t = timeline.select("correlation_key", F.lit("timeline").alias("kind"), "at", "detail")
    return (m.unionByName(t).join(incidents.select("correlation_key", "category", "status"),
                                  "correlation_key")
            .orderBy("correlation_key", "kind", "at", "detail"))
