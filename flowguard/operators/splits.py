"""Train/validation/test splits by group and time, and their leakage checks."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowguard import constants as K
from flowguard.operators.digest import set_digest
from flowguard.operators.ordered import running_totals


def group_shares(df: DataFrame, group: str, time: str, bucket_seconds: int = 3600) -> DataFrame:
    """Per group: start time, rows, and the share of rows up to and including it."""
    groups = df.groupBy(group).agg(F.min(time).alias("_start"),
                                   F.count(F.lit(1)).alias("_rows"))
    micros = F.unix_micros("_start")
    width = F.lit(bucket_seconds * 1_000_000)
    ranked = running_totals(groups, [F.col("_start"), F.col(group)],
                            micros - F.pmod(micros, width), {"_upto": F.col("_rows")})
    total = df.agg(F.count(F.lit(1)).alias("_total")).scalar()
    return ranked.withColumn("_total", total).withColumn("_share",
                                                         F.col("_upto") / F.col("_total"))


def group_time_split(df: DataFrame, group: str, time: str, shares=K.SPLIT_SHARES,
                     bucket_seconds: int = 3600) -> DataFrame:
    """Adds ``partition``: whole groups, later groups in later partitions.

    A group belongs to the partition in whose share its middle row falls.
    """
    ranked = group_shares(df, group, time, bucket_seconds)
    middle = (F.col("_upto") - F.col("_rows") / 2.0) / F.col("_total")
    first, second = shares[0], shares[0] + shares[1]
    named = ranked.select(group, F.when(middle <= first, K.PARTITIONS[0])
                          .when(middle <= second, K.PARTITIONS[1])
                          .otherwise(K.PARTITIONS[2]).alias("partition"))
    return df.join(named, group)


def partition_overlap(df: DataFrame, key: Column, partition: str = "partition") -> DataFrame:
    """Keys found in more than one partition: smallest and largest name differ."""
    return (df.select(key.alias("key"), partition).groupBy("key")
            .agg(F.min(partition).alias("first_partition"),
                 F.max(partition).alias("last_partition"), F.count(F.lit(1)).alias("copies"))
            .where("first_partition <> last_partition"))


def attach_labels(features: DataFrame, targets: DataFrame, key: str = "event_key") -> DataFrame:
    return features.join(targets, key)


def value_pairs(df: DataFrame, names, label: str) -> DataFrame:
    """Rows (feature, value as text, label)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("string").alias("value"))
                      for n in names])
    return df.select(F.col(label).alias("_label"), F.explode(pairs).alias("p")) \
        .select("p.feature", "p.value", "_label")


def perfect_separators(df: DataFrame, names, label: str) -> DataFrame:
    """Features none of whose values occurs with two labels."""
    per_value = value_pairs(df, names, label).groupBy("feature", "value").agg(
        (F.min("_label") != F.max("_label")).alias("mixed"))
    return (per_value.groupBy("feature")
            .agg(F.count(F.lit(1)).alias("values"), F.count_if("mixed").alias("mixed_values"))
            .where("mixed_values = 0").select("feature", "values"))


def split_report(df: DataFrame, time: str, identity: str, partition: str = "partition"
                 ) -> DataFrame:
    """Per partition: counts, time band, identity digest and the acceptance checks."""
    stats = df.groupBy(partition).agg(F.count(F.lit(1)).alias("rows"),
                                      F.min(time).alias("time_start"),
                                      F.max(time).alias("time_end"))
    ids = set_digest(df, identity, by=[partition], distinct=False) \
        .select(partition, F.col("digest").alias("identity_digest"))
    total = df.agg(F.count(F.lit(1)).alias("_total")).scalar()
    expected = F.create_map(*[x for p, s in zip(K.PARTITIONS, K.SPLIT_SHARES)
                              for x in (F.lit(p), F.lit(s))])
    # One row per partition by now, so at most three.
    order = F.array_position(F.array(*[F.lit(p) for p in K.PARTITIONS]), F.col(partition))
    previous_end = F.lag("time_end").over(W.orderBy(order))
    return (stats.join(ids, partition)
            .select(F.col(partition), "rows", "time_start", "time_end", "identity_digest",
                    (F.abs(F.col("rows") / total - F.try_element_at(expected, partition))
                     <= K.SPLIT_TOLERANCE).alias("ratio_ok"),
                    F.coalesce(previous_end < F.col("time_start"), F.lit(True)).alias("band_ok")))


def counts_by(df: DataFrame, names) -> DataFrame:
    """Rows (kind, value, n) for several columns at once; arrays count per element."""
    out = None
    for name in names:
        kind = df.schema[name].dataType.simpleString()
        value = F.explode(name) if kind.startswith("array") else F.col(name)
        part = (df.select(value.alias("value")).select(F.col("value").cast("string")
                                                       .alias("value")).groupBy("value")
                .agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "value", "n"))
        out = part if out is None else out.unionByName(part)
    return out
