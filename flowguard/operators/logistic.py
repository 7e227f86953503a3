"""Logistic regression by Newton steps: few passes over the rows, whatever their number.

The loss is the weighted mean of the rows' log loss plus half the penalty times the squared slopes; the
intercept is free. Rows are packed into blocks of numbers once, a feature of few values as places in a table
of them. Each pass multiplies the blocks out in the tasks; their sums of loss, gradient and curvature (a few
hundred numbers for some forty features, from three tasks a core at most) are added up by the driver, which
solves one small system a step.

The search sets out from where it ends on every 16th row. That only saves passes: it ends on all rows, by the
slopes of their loss, and the loss has one lowest point.
"""

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowguard.operators.vectors import columns_of, vector
from flowguard.session import materialised

#: The fit ends where no slope of the loss is larger, or a step can't gain more than this.
FLAT, GAIN = 1e-8, 1e-13
#: Rows that are multiplied out at a time.
ROWS = 2048
#: One row of so many is for setting out, if these are so many of each class; a gain that ends the search there.
EVERY, ENOUGH, NEAR = 16, 1000, 1e-7


@dataclass
class LogisticFit:
    """Slopes and intercept, with the penalty they were fitted under."""

    names: list
    coefficients: np.ndarray
    intercept: float
    penalty: float
    passes: int = 0

    def margin(self) -> Column:
        out = F.lit(float(self.intercept))
        for name, slope in zip(self.names, self.coefficients):
            out = out + F.col(name) * F.lit(float(slope))
        return out

    def with_probability(self, df: DataFrame, out: str) -> DataFrame:
        """The rows with the probability of label 1. A null or NaN among the features is an error."""
        m = F.col("_margin")
        odd = m.isNull() | F.isnan(m)
        return df.withColumn("_margin", self.margin()).withColumn(out, F.when(
            odd, F.raise_error(F.lit("null or NaN among the features"))).otherwise(
            1.0 / (1.0 + F.exp(-m)))).drop("_margin")


def packed(values: np.ndarray) -> tuple:
    """(table, places in it) where few values come again and again, else (None, values)."""
    table, places = np.unique(values, return_inverse=True)
    if 4 * len(table) > len(values) and len(table) > 16 or len(table) > 65_536:
        return None, values
    return table, places.astype(np.uint8 if len(table) <= 256 else np.uint16)


def unpacked(column: tuple, part: slice) -> np.ndarray:
    table, values = column
    return values[part] if table is None else table[values[part]]


def packed_rows(df: DataFrame, names, label: str, weight: str) -> DataFrame:
    """Blocks of rows: whether for setting out, rows of label 1 and 0, and packed signs, weights and features."""
    names = list(names)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = columns_of(batch.column(0), len(names) + 2)
            if not np.isfinite(cols).all():
                raise ValueError("null or non-finite value among the labels or features")
            if not np.isin(cols[0], (0, 1)).all():
                raise ValueError("labels are 0 and 1")
            early = np.arange(batch.num_rows) % EVERY == 0
            for is_early in np.unique(early):
                own = [c[early == is_early] for c in cols]
                data = pickle.dumps((2 * own[0] - 1, *[packed(c) for c in own[1:]]), protocol=5)
                ones = int(own[0].sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bool(is_early)]), pa.array([ones]), pa.array([len(own[0]) - ones]),
                     pa.array([data], pa.binary())], ["early", "ones", "zeros", "data"])

    return df.select(vector((label, weight, *names))).mapInArrow(
        run, "early boolean, ones long, zeros long, data binary")


def loss_parts(blocks: DataFrame, theta: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Sums over all rows at ``theta``: weights, log loss, its gradient and its curvature."""
    size = len(theta)
    upper = np.triu_indices(size)
    held = theta.copy()

    def run(batches):
        total, slope, bend = np.zeros(2), np.zeros(size), np.zeros((size, size))
        for batch in batches:
            for data in batch.column(0).to_pylist():
                signs, weights, *columns = pickle.loads(data)
                for i in range(0, len(signs), ROWS):
                    part = slice(i, i + ROWS)
                    sign, weight = signs[part], unpacked(weights, part)
                    x = np.stack([np.ones(len(sign)), *[unpacked(c, part) for c in columns]])
                    m = sign * (held @ x)
                    small = np.exp(-np.abs(m))
                    wrong = np.where(m >= 0, small, 1.0) / (1.0 + small)
                    total += weight.sum(), weight @ (np.log1p(small) - np.minimum(m, 0.0))
                    slope -= x @ (weight * sign * wrong)
                    bend += (x * (weight * small / (1.0 + small) ** 2)) @ x.T
        values = np.concatenate([total, slope, bend[upper]])
        yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], ["v"])

    flat = np.zeros(2 + size + len(upper[0]))
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    for r in blocks.select("data").coalesce(3 * cores).mapInArrow(run, "v binary").collect():
        flat += np.frombuffer(r["v"])
    bend = np.zeros((size, size))
    bend[upper] = flat[2 + size:]
    return flat[0], flat[1], flat[2:2 + size], bend + np.triu(bend, 1).T


def newton_step(slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """The step to the lowest point of the local parabola, features brought to one scale first."""
    scale = 1.0 / np.sqrt(np.maximum(np.diag(bend), 1e-300))
    return -scale * np.linalg.lstsq(bend * np.outer(scale, scale), scale * slope, rcond=1e-15)[0]


def lowest(blocks: DataFrame, theta: np.ndarray, ridge: np.ndarray, iterations: int, gain: float = GAIN
           ) -> tuple[np.ndarray, int]:
    """Where the loss over the blocks is lowest, and passes made; each step is halved until the loss falls."""
    def at(point):
        total, loss, slope, bend = loss_parts(blocks, point)
        if not total > 0:
            raise ValueError("no weighted rows to fit on")
        return (loss / total + ridge @ point ** 2 / 2, slope / total + ridge * point,
                bend / total + np.diag(ridge))

    loss, slope, bend = at(theta)
    passes, share = 1, 1.0
    if not loss <= np.log(2):  # no better a start than nought
        theta = np.zeros(len(theta))
        loss, slope, bend = at(theta)
        passes += 1
    step = newton_step(slope, bend)
    while passes <= iterations and np.abs(slope).max() > FLAT and -slope @ step > gain \
            and share > 1e-9:
        found = at(theta + share * step)
        passes += 1
        if found[0] <= loss + 1e-4 * share * (slope @ step):
            theta, (loss, slope, bend), share = theta + share * step, found, 1.0
            step = newton_step(slope, bend)
        else:
            share /= 2
    return theta, passes


def fit_logistic(train: DataFrame, names, label: str, weight: str, penalty: float,
                 iterations: int = 500) -> LogisticFit:
    """Fits on all rows of ``train``; the passes told are those over all rows."""
    names = list(names)
    theta, ridge = np.zeros(len(names) + 1), np.r_[0.0, np.full(len(names), penalty)]
    blocks = materialised(packed_rows(train, names, label, weight))
    rows = {r["early"]: np.array([r["ones"], r["zeros"]]) for r in blocks.groupBy("early").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).collect()}
    ones, zeros = sum(rows.values(), np.zeros(2, np.int64))
    if not ones + zeros:
        raise ValueError("no weighted rows to fit on")
    if 0 in (ones, zeros):  # one class alone: it is certain
        return LogisticFit(names, theta[1:], np.inf if ones else -np.inf, penalty, 1)
    cores = train.sparkSession.sparkContext.defaultParallelism
    if rows[True].min() >= ENOUGH:
        few = materialised(blocks.where("early").select("data").repartition(cores))
        theta = lowest(few, theta, ridge, iterations, NEAR)[0]
    theta, passes = lowest(blocks, theta, ridge, iterations)
    return LogisticFit(names, theta[1:], float(theta[0]), penalty, passes)
