"""Small derived columns of flows and alerts."""

from pyspark.sql import Column, functions as F

from flowguard import constants as K


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the fixed UTC bucket that holds the time."""
    epoch = F.unix_seconds(ts)
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(int(seconds))))


def port_class(port: Column) -> Column:
    return (F.when(port.isNull(), "none").when(port <= 1023, "well_known")
            .when(port <= 49151, "registered").otherwise("dynamic"))


def category(value: Column, vocabulary) -> Column:
    """The token itself, or the reserved tokens for missing and unseen values."""
    return (F.when(value.isNull(), K.MISSING_TOKEN)
            .when(value.isin(*vocabulary), value).otherwise(K.UNKNOWN_TOKEN))


def raw_rate(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / F.when(denominator != 0, denominator))


def bounded_rate(numerator: Column, denominator: Column) -> Column:
    """Zero for a zero denominator, never above the cap."""
    return F.least(raw_rate(numerator, denominator), F.lit(K.RATE_CAP))


def signature_severity(reported: Column) -> Column:
    out = F.lit("informational")
    for level, name in K.REPORTED_SEVERITY.items():
        out = F.when(reported == level, name).otherwise(out)
    return out


def mask_group(grouping: Column, sensitive: bool) -> Column:
    """Without the right to see them, addresses leave the grouping map."""
    if sensitive:
        return grouping
    return F.map_filter(grouping, lambda k, v: ~k.isin("src_address", "dst_address"))


def is_failure(source_type: Column, state: Column, states=K.FAILURE_STATES) -> Column:
    return F.coalesce((source_type == "zeek") & state.isin(*states), F.lit(False))
