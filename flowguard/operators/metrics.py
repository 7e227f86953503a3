"""Quality of binary scores."""

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.operators.ordered import float_bucket, running_totals


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def binary_metrics(df: DataFrame, y: str, p: str, t: float = 0.5, by=()) -> DataFrame:
    """Confusion counts and the figures made of them, in one aggregation."""
    label, flag = F.col(y) == 1, F.col(p) >= t
    counts = df.groupBy(*by).agg(
        F.count_if(~label & ~flag).alias("tn"), F.count_if(~label & flag).alias("fp"),
        F.count_if(label & ~flag).alias("fn"), F.count_if(label & flag).alias("tp"),
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    p0, r0, p1, r1 = _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(tp, tp + fp), _ratio(tp,
                                                                                       tp + fn)
    f0, f1 = _ratio(2 * p0 * r0, p0 + r0), _ratio(2 * p1 * r1, p1 + r1)
    n0, n1 = tn + fp, tp + fn
    return counts.select(
        *by, "tn", "fp", "fn", "tp", p0.alias("precision_0"), r0.alias("recall_0"),
        f0.alias("f1_0"), n0.cast("long").alias("support_0"), p1.alias("precision_1"),
        r1.alias("recall_1"), f1.alias("f1_1"), n1.cast("long").alias("support_1"),
        ((f0 + f1) / 2).alias("macro_f1"),
        _ratio(f0 * n0 + f1 * n1, n0 + n1).alias("weighted_f1"),
        _ratio(fp, fp + tn).alias("false_positive_rate"),
        _ratio(fn, fn + tp).alias("false_negative_rate"), "brier")


def score_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per distinct score, from the highest down: positives and negatives up to it.

    Tied scores become one row first; running totals go bucket by bucket.
    """
    tied = (df.groupBy(F.col(p).cast("double").alias("score"))
            .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")))
    return running_totals(tied, [F.col("score").desc()], -float_bucket(F.col("score")),
                          {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")})


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve; a tie counts one half."""
    curve = score_curve(df, y, p)
    area = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return curve.agg(_ratio(area, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    """Sum over scores of recall gained times precision there."""
    curve = score_curve(df, y, p)
    gain = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return curve.agg(_ratio(gain, F.sum("pos").cast("double")).alias("average_precision"))


def prevalence(df: DataFrame, y: str = "label", partition: str = "partition") -> DataFrame:
    """Share of positives in training: the score of the majority reference."""
    return df.where(F.col(partition) == "training").agg(
        F.avg(F.col(y).cast("double")).alias("prevalence"))
