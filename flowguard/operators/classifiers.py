"""Supervised candidates: fitting, choice on validation, one look at the test rows."""

from pyspark.sql import DataFrame, functions as F

from flowguard import constants as K
from flowguard.operators.encoders import robust_scale
from flowguard.operators.logistic import fit_logistic
from flowguard.operators.metrics import binary_metrics
from flowguard.operators.trees import fit_trees


def class_weights(df: DataFrame, label: str = "label") -> tuple[float, float]:
    """n / (2 n_class) of labels 0 and 1."""
    counts = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    ones, zeros = max(counts[0], 1), max(counts[1], 1)
    total = ones + zeros
    return total / (2.0 * zeros), total / (2.0 * ones)


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (2 n_class), the two class counts being constants of the plan."""
    zero, one = class_weights(df, label)
    return df.withColumn("_weight", F.when(F.col(label) == 1, one).otherwise(zero))


ALGORITHMS = ("logistic_regression", "random_forest")


def fit_candidates(matrix: DataFrame, names, trees: int = 300, depth: int = 20,
                   iterations: int = 500, which=ALGORITHMS, label: str = "label",
                   partition: str = "partition") -> dict:
    """Fitted models by name, each with the matrix it reads: name -> (model, rows)."""
    out = {}
    for name in which:
        logistic = name == "logistic_regression"
        rows = robust_scale(matrix, names, partition) if logistic else matrix
        train = rows.where(F.col(partition) == K.PARTITIONS[0])
        if logistic:
            train = with_class_weights(train, label)
            model = fit_logistic(train, names, label, "_weight", 1.0 / max(train.count(), 1),
                                 iterations)
        else:
            model = fit_trees(train, names, label, class_weights(train, label), trees, depth, K.SEED)
        out[name] = (model, rows)
    return out


def probabilities(model, df: DataFrame) -> DataFrame:
    return model.with_probability(df, "probability_1")


def slopes(model, df: DataFrame, names, label: str = "label") -> DataFrame:
    """(feature, slope, size) of a logistic model's penalised loss over weighted rows.

    At the optimum every slope is nought; ``size`` is the mean size of what adds up to it.
    """
    part = F.col("_weight") * (F.col("probability_1") - F.col(label))
    sums = probabilities(model, df).agg(
        F.sum("_weight").alias("_w"),
        *[F.struct(F.sum(part * F.col(n)).alias("s"), F.sum(F.abs(part * F.col(n))).alias("a")).alias(n)
          for n in names])
    held = {n: float(b) * model.penalty for n, b in zip(names, model.coefficients)}
    rows = F.array(*[F.struct(
        F.lit(n).alias("feature"), (F.col(f"{n}.s") / F.col("_w") + F.lit(held[n])).alias("slope"),
        (F.col(f"{n}.a") / F.col("_w") + F.lit(abs(held[n]))).alias("size")) for n in names])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def candidate_metrics(candidates: dict, which: str = "validation", label: str = "label",
                      partition: str = "partition") -> DataFrame:
    """Metrics per candidate on one partition."""
    out = None
    for name, (model, df) in candidates.items():
        part = probabilities(model, df.where(F.col(partition) == which)).select(
            F.lit(name).alias("algorithm"), label, "probability_1")
        out = part if out is None else out.unionByName(part)
    return binary_metrics(out, label, "probability_1", by=["algorithm"])


def select_candidate(candidates: dict, label: str = "label") -> tuple[str, DataFrame]:
    """Best macro F1 on validation, ties to the logistic model; then the test metrics.

    The test rows are scored for the chosen model only, after the choice.
    """
    rows = candidate_metrics(candidates, "validation", label).select("algorithm", "macro_f1")
    best = max(rows.collect(),
               key=lambda r: (r["macro_f1"], r["algorithm"] == "logistic_regression"))
    chosen = best["algorithm"]
    return chosen, candidate_metrics({chosen: candidates[chosen]}, "test", label)


def score_counts(df: DataFrame, model) -> DataFrame:
    """Rows per predicted class; no score leaves the job."""
    scored = probabilities(model, df)
    return (scored.groupBy((F.col("probability_1") >= 0.5).cast("int").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))
