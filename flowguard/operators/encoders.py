"""Vocabularies, ordinal encoding and robust scaling, fitted on training rows only."""

from pyspark.sql import Column, DataFrame, functions as F

from flowguard import constants as K
from flowguard.operators.ordered import column_quantiles, quantiles, running_totals

TRAINING = K.PARTITIONS[0]


def fit_vocabulary(df: DataFrame, column: str, min_freq: int = 1,
                   partition: str = "partition") -> DataFrame:
    """Rows (token, ordinal, frequency): tokens in byte order after the two reserved ones.

    Only the training partition is read, whatever is passed in. Ordinals come from
    running totals, so the vocabulary may have any size.
    """
    value = F.col(column)
    tokens = (df.where((F.col(partition) == TRAINING) & value.isNotNull()
                       & ~value.isin(K.MISSING_TOKEN, K.UNKNOWN_TOKEN))
              .groupBy(value.alias("token")).agg(F.count(F.lit(1)).alias("frequency"))
              .where(F.col("frequency") >= min_freq))
    prefix = F.conv(F.rpad(F.substring(F.hex("token"), 1, 4), 4, "0"), 16, 10).cast("long")
    return (running_totals(tokens, [F.col("token")], prefix, {"_r": F.lit(1)})
            .select("token", (F.col("_r") + 1).alias("ordinal"), "frequency"))


def encode(df: DataFrame, column: str, vocabulary: DataFrame, out: str) -> DataFrame:
    """Ordinal of a fitted vocabulary: missing 0, unseen 1."""
    side = vocabulary.select(F.col("token").alias("_token"), F.col("ordinal").alias("_ordinal"))
    code = F.when(F.col(column).isNull(), 0).otherwise(F.coalesce("_ordinal", F.lit(1)))
    return (df.join(side, F.col(column) == F.col("_token"), "left")
            .withColumn(out, code.cast("long")).drop("_token", "_ordinal"))


def encode_fixed(value: Column, vocabulary) -> Column:
    """Ordinal in a fixed vocabulary; what is not in it becomes 1."""
    at = F.array_position(F.array(*[F.lit(v) for v in vocabulary]), value)
    return F.when(at > 0, at - 1).otherwise(F.lit(1))


def encoded_matrix(features: DataFrame, names=None, keep=()) -> DataFrame:
    """All model columns as doubles: categories by fixed ordinal, booleans as 0 and 1."""
    names = list(names or K.feature_names())
    def number(n):
        vocabulary = K.CATEGORY_VOCABULARIES.get(n)
        c = F.col(n) if vocabulary is None else encode_fixed(F.col(n), vocabulary)
        return c.cast("double").alias(n)
    return features.select(*keep, *[number(n) for n in names])


def fit_scaler(matrix: DataFrame, names, partition: str = "partition") -> DataFrame:
    """Rows (feature, center, scale): training median and interquartile range."""
    train = matrix.where(F.col(partition) == TRAINING)
    q = column_quantiles(train, names, {"q25": 0.25, "center": 0.5, "q75": 0.75})
    spread = F.col("q75") - F.col("q25")
    return q.select("feature", "center",
                    F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("scale"))


def robust_scale(matrix: DataFrame, names, partition: str = "partition") -> DataFrame:
    """Numeric columns less their median, over their spread; categories stay as they are.

    The fitted table has one row per column and becomes constants of the plan.
    """
    numeric = [n for n in names if n not in K.CATEGORY_VOCABULARIES]
    fitted = {r["feature"]: r for r in fit_scaler(matrix, numeric, partition).collect()}
    return matrix.select(*[
        ((F.col(c) - fitted[c]["center"]) / F.lit(fitted[c]["scale"])).alias(c)
        if c in fitted else F.col(c) for c in matrix.columns])


def baseline_medians(matrix: DataFrame, names, partition: str = "partition",
                     label: str = "label") -> DataFrame:
    """Rows (feature, median) of benign training rows."""
    rows = matrix.where((F.col(partition) == TRAINING) & (F.col(label) == 0))
    return column_quantiles(rows, names, {"median": 0.5})


def score_anchors(scores: DataFrame, column: str) -> DataFrame:
    """1st and 99th percentile of scores; their range when these coincide."""
    q = quantiles(scores, F.col(column), {"p01": 0.01, "p99": 0.99, "low": 0.0, "high": 1.0})
    flat = F.col("p01") >= F.col("p99")
    return q.select(F.when(flat, F.col("low")).otherwise(F.col("p01")).alias("lower"),
                    F.when(flat, F.col("high")).otherwise(F.col("p99")).alias("upper"))


def normalize_scores(df: DataFrame, column: str, anchors: DataFrame, out: str = "score"
                     ) -> DataFrame:
    """Scores between the anchors, cut off at 0 and 1.

    Anchors are fitted once; the two numbers become constants of the plan.
    """
    fitted = anchors.first()
    lower, upper = F.lit(fitted["lower"]), F.lit(fitted["upper"])
    return df.withColumn(out, F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), (F.col(column) - lower) / (upper - lower))))


def quantile_threshold(df: DataFrame, column: str = "score", q: float = 0.95) -> DataFrame:
    return quantiles(df, F.col(column), {"threshold": q})


def flagged(df: DataFrame, threshold: DataFrame, column: str = "score") -> DataFrame:
    """Rows at or above a fitted threshold, which becomes a constant of the plan."""
    return df.where(F.col(column) >= F.lit(threshold.first()["threshold"]))
