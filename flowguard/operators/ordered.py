"""Running totals and exact quantiles without a single-task sort.

Rows get a bucket that grows with the value. Bucket totals are few and give each
bucket its offset; the order inside a bucket is worked out bucket by bucket. Where the data crowds one
bucket, bounds are sampled from the data instead (:mod:`flowguard.operators.blocks`).
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowguard.operators.blocks import in_blocks, running
from flowguard.operators.vectors import columns_of, filled, vector

STEPS = 4096
#: Rows of a bucket that one task sorts.
CROWD = 500_000
#: Counts of columns that a task holds before it passes them on.
HELD = 1_000_000


def float_bucket(v: Column) -> Column:
    """Order-preserving bucket of a double: 4096 steps between powers of two."""
    v = v.cast("double")
    size = F.abs(v)
    exponent = F.floor(F.log2(F.when(size > 0, size)))
    step = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * STEPS)
    positive = (exponent + 1100) * STEPS + step
    return F.when(v > 0, positive).when(v < 0, -positive).otherwise(F.lit(0)).cast("long")


def running_totals(df: DataFrame, order: list[Column], bucket: Column, values: dict,
                   by=(), crowd: int = CROWD) -> DataFrame:
    """Adds, per value, the total over all rows up to and including this one.

    ``order`` must be unique within ``by`` and ``bucket`` must not fall along it.
    The window over the bucket totals sees one row per bucket, not per input row. Buckets are
    counted when this is called; if one has more than ``crowd`` rows, ranges of the order itself, bounded
    by a sample, take their place.
    """
    rows = df.withColumn("_b", bucket)
    most = rows.groupBy(*by, "_b").count().agg(F.max("count")).first()[0] or 0
    if most > crowd:
        keys = list(by) or ["_all"]
        rows = rows if by else rows.withColumn("_all", F.lit(0))
        blocks = in_blocks(rows, keys, ["_b", *order])
        return running(blocks, keys, ["_b", *order], {
            n: ("sum", c) for n, c in values.items()}).select(*df.columns, *values)
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in values.items()])
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_ob"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    match = reduce(lambda a, b: a & b,
                   [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)],
                   F.col("_b") == F.col("_ob"))
    inside = W.partitionBy(*by, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (rows.join(offsets, match)
            .select(*df.columns,
                    *[(F.col(f"_o_{n}") + F.sum(c).over(inside)).alias(n)
                      for n, c in values.items()]))


def value_counts(df: DataFrame, value: Column, by=()) -> DataFrame:
    """Distinct values with their counts: the small form of a column to be ranked."""
    return (df.select(*by, value.cast("double").alias("_v")).where("_v IS NOT NULL")
            .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))


def quantiles_long(df: DataFrame, value: Column, qs, by=()) -> DataFrame:
    """Exact linear-interpolated quantiles: rows (by…, q, value).

    Counts per value are made first, so repeats cost nothing after the map side.
    A histogram of buckets tells which buckets hold the wanted ranks; only their
    values are sorted.
    """
    keys = list(by) or ["_all"]
    counts = value_counts(df.withColumn("_all", F.lit(0)) if not by else df, value, keys)
    counts = counts.withColumn("_b", float_bucket(F.col("_v")))
    hist = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    return _at_ranks(counts, _wanted_ranks(hist, qs, keys), keys).select(*by, "q", "value")


def _wanted_ranks(hist: DataFrame, qs, keys) -> DataFrame:
    """Which ranks of which buckets (_nb) the quantiles need, out of rows per bucket (_b, _bn)."""
    up_to = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    hist = (hist.withColumn("_cum", F.sum("_bn").over(up_to))
            .withColumn("_total", F.sum("_bn").over(W.partitionBy(*keys))))
    position = {q: F.lit(float(q)) * (F.col("_total") - 1) for q in qs}
    wanted = F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.lit(side).alias("side"),
                 fn(position[q]).cast("long").alias("rank"),
                 (position[q] - F.floor(position[q])).alias("part"))
        for q in qs for side, fn in (("lo", F.floor), ("hi", F.ceil))])
    start = F.col("_cum") - F.col("_bn")
    return (hist.select(*keys, "_b", start.alias("_start"), "_cum",
                        F.explode(wanted).alias("w"))
            .where((F.col("w.rank") >= F.col("_start")) & (F.col("w.rank") < F.col("_cum")))
            .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_nb"),
                    (F.col("w.rank") - F.col("_start")).alias("_rank"), "w.q", "w.side", "w.part"))


def _at_ranks(counts: DataFrame, needed: DataFrame, keys) -> DataFrame:
    """Rows (keys…, q, value): the values at the wanted ranks, out of counts (_b, _v, _n)."""
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
                  F.col("_b") == F.col("_nb"))
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = (counts.join(needed.select(*[f"_k_{k}" for k in keys], "_nb").distinct(), same,
                          "left_semi")
              .withColumn("_c", F.sum("_n").over(inside)))
    hit = (ranked.join(needed, same)
           .where((F.col("_rank") >= F.col("_c") - F.col("_n")) & (F.col("_rank") < F.col("_c"))))
    lo = F.max(F.when(F.col("side") == "lo", F.col("_v")))
    hi = F.max(F.when(F.col("side") == "hi", F.col("_v")))
    return hit.groupBy(*keys, "q").agg((lo + (hi - lo) * F.max("part")).alias("value"))


def quantiles(df: DataFrame, value: Column, qs: dict, by=()) -> DataFrame:
    """Exact quantiles as columns: ``qs`` maps column names to shares."""
    return _as_columns(quantiles_long(df, value, sorted(set(qs.values())), by), qs, by)


def _as_columns(long: DataFrame, qs: dict, by) -> DataFrame:
    return long.groupBy(*by).agg(*[
        F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(name)
        for name, q in qs.items()])


def value_bucket(v: np.ndarray) -> np.ndarray:
    """Order-preserving buckets of doubles: 1024 steps between powers of two."""
    size = np.abs(v).view(np.int64) >> 42
    return np.where(v < 0, -size, size)


def column_counts(df: DataFrame, names, only: dict | None = None) -> DataFrame:
    """Rows (feature, _b, _n): rows per bucket of each column, counted in the tasks first; nulls aside.

    With ``only``, the buckets wanted of each column, rows (feature, _b, _v, _n) per value in these.
    """
    names = list(names)

    def merged(parts):
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)
        if only is None:
            return [pa.array(keys), pa.array(n)]
        return [pa.array(value_bucket(keys)), pa.array(keys), pa.array(n)]

    def passed_on(held):
        for name, parts in zip(names, held):
            if parts:
                cols = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cols[0])), *cols], columns)

    def run(batches):
        held, size = [[] for _ in names], 0
        for batch in batches:
            rows = batch.column(0)
            there = filled(rows, len(names))
            for i, v in enumerate(columns_of(rows, len(names))):
                v = v[there[i]]
                b = value_bucket(v)
                if only is not None:
                    v = b = v[np.isin(b, only.get(names[i], ()))] + 0.0
                if len(b):
                    held[i].append(np.unique(b, return_counts=True))
                    size += len(held[i][-1][0])
            if size > HELD:
                yield from passed_on(held)
                held, size = [[] for _ in names], 0
        yield from passed_on(held)

    keys = ["_b"] if only is None else ["_b", "_v"]
    columns = ["feature", *keys, "_n"]
    kinds = {"feature": "string", "_b": "long", "_v": "double", "_n": "long"}
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(vector(names)).coalesce(3 * cores).mapInArrow(
        run, ", ".join(f"{c} {kinds[c]}" for c in columns))
    return parts.groupBy("feature", *keys).agg(F.sum("_n").alias("_n"))


def column_quantiles(df: DataFrame, names, qs: dict) -> DataFrame:
    """Exact quantiles of many columns, as :func:`quantiles` has them: one row per feature.

    One pass counts rows per bucket, when this is called; another the values in the buckets that hold wanted ranks,
    a few for each column and quantile.
    """
    hist = column_counts(df, names).withColumnRenamed("_n", "_bn")
    needed = _wanted_ranks(hist, sorted(set(qs.values())), ["feature"])
    found = needed.collect()
    only: dict = {}
    for r in found:
        only.setdefault(r["_k_feature"], set()).add(r["_nb"])
    counts = column_counts(df, names, {n: sorted(b) for n, b in only.items()})
    long = _at_ranks(counts, df.sparkSession.createDataFrame(found, needed.schema), ["feature"])
    return _as_columns(long, qs, ["feature"])
