"""Isolation forest: bounded samples, trees in parallel, scoring in Arrow batches.

A tree sees a fixed number of rows, so the rows drawn and the model are small whatever the
table's size; the table itself is only scanned.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from flowguard import constants as K

#: ``size`` and ``depth`` are those of the node, ``rows`` how many rows the tree was grown on.
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "path double, size int, depth int, rows int")
#: Nodes of 48 bytes that a model may have to be held by the driver and the tasks.
MOST_NODES = 1_000_000
#: Rows whose ways through all trees are held at a time.
OCCLUDED_ROWS = 500


def sample_per_tree(df: DataFrame, key: str, names, trees: int, rows: int) -> DataFrame:
    """Rows (tree, features…): for each tree the ``rows`` smallest hashes of (tree, key).

    Every tree draws from the whole table. Only rows under a bound on the hash are ranked, some
    more than ``rows`` a tree; should a tree have too few, the bound is raised.
    """
    total = df.count()
    share = min(1.0, (rows + 8 * math.sqrt(rows) + 16) / max(total, 1))
    while True:
        bound = F.lit(int(-2 ** 63 + share * (2 ** 64 - 1)) if share < 1 else 2 ** 63 - 1)
        drawn = (df.select(F.col(key).alias("_key"), *names, F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.xxhash64(F.lit(K.SEED), t, F.col(key)) <= bound)).alias("tree"))
            .withColumn("_t", F.xxhash64(F.lit(K.SEED), "tree", "_key")))
        if share == 1.0:
            break
        each = drawn.groupBy("tree").count().agg(F.min("count").alias("least"),
                                                 F.count("*").alias("trees")).first()
        if each["trees"] == trees and each["least"] >= min(rows, total):
            break
        share = min(1.0, 2 * share)
    order = W.partitionBy("tree").orderBy("_t", "_key")
    return (drawn.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows)
            .select("tree", "_rank", *names))


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(values: np.ndarray, seed: int, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, path, size, depth) of one random tree."""
    rng = np.random.default_rng(seed)
    nodes: list = []
    todo = [(np.arange(len(values)), 0, -1, 0)]
    while todo:
        index, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        part = values[index]
        low, high = part.min(axis=0), part.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(index) <= 1 or not len(open_):
            nodes.append([-1, 0.0, me, me, depth + mean_path(len(index)), len(index), depth])
            continue
        f = int(rng.choice(open_))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append([f, cut, -1, -1, 0.0, len(index), depth])
        goes_left = part[:, f] <= cut
        todo.append((index[goes_left], depth + 1, me, 0))
        todo.append((index[~goes_left], depth + 1, me, 1))
    return nodes


def fit_forest(df: DataFrame, key: str, names, trees: int = K.FOREST_TREES,
               rows: int = K.FOREST_ROWS, seed: int = K.SEED) -> DataFrame:
    """Table of tree nodes. ``df`` are the benign training rows."""
    names = list(names)
    limit = math.ceil(math.log2(max(rows, 2)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        values = pdf.sort_values("_rank")[names].to_numpy(dtype=np.float64)
        nodes = grow(values, seed + tree, limit)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "path", "size",
                                           "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        out["rows"] = len(values)
        return out

    return (sample_per_tree(df, key, names, trees, rows).groupBy("tree")
            .applyInPandas(build, NODE_SCHEMA))


class ForestModel:
    """The trees as arrays (tree by node), ready to be shipped to tasks."""

    def __init__(self, nodes: pd.DataFrame, names):
        self.names = list(names)
        rows = int(nodes["rows"].max())
        self.expected = mean_path(rows) or 1.0
        trees = int(nodes["tree"].max()) + 1
        width = int(nodes["node"].max()) + 1
        shape = (trees, width)
        self.feature = np.full(shape, -1, dtype=np.int32)
        self.threshold = np.zeros(shape)
        self.left = np.zeros(shape, dtype=np.int32)
        self.right = np.zeros(shape, dtype=np.int32)
        self.path = np.zeros(shape)
        t, n = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        for name in ("feature", "threshold", "left", "right", "path"):
            getattr(self, name)[t, n] = nodes[name].to_numpy()
        self.depth = math.ceil(math.log2(max(rows, 2)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Isolation score less one half: the larger, the more unusual."""
        return self._score(self._paths(x))

    def _score(self, paths: np.ndarray) -> np.ndarray:
        return np.power(2.0, -paths.mean(axis=1) / self.expected) - 0.5

    def _paths(self, x: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
        """Path lengths (row by tree). ``asked`` (feature, row, tree) is set where a row's way
        through a tree asks for a feature."""
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), dtype=np.int32)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[trees, at]
            if asked is not None:
                row, tree = np.nonzero(f >= 0)
                asked[f[row, tree], row, tree] = True
            goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[trees, at]
            step = np.where(goes_left, self.left[trees, at], self.right[trees, at])
            at = np.where(f < 0, at, step)
        return self.path[trees, at]

    def occluded(self, x: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores, and per feature (row by feature) their change when it is set to its baseline.

        A row is walked again only through trees that asked for the feature on its way, and only where
        its value is not the baseline; in all others its path stays as it is.
        """
        asked = np.zeros((x.shape[1], len(x), len(self.feature)), dtype=bool)
        paths = self._paths(x, asked)
        whole = self._score(paths)
        change = np.zeros(x.shape)
        for i in range(x.shape[1]):
            row, tree = np.nonzero(asked[i] & (x[:, i] != base[i])[:, None])
            if not len(row):
                continue
            moved = np.unique(row)
            at = np.zeros(len(row), dtype=np.int32)
            for _ in range(self.depth):
                f = self.feature[tree, at]
                value = np.where(f == i, base[i], x[row, np.maximum(f, 0)])
                step = np.where(value <= self.threshold[tree, at], self.left[tree, at],
                                self.right[tree, at])
                at = np.where(f < 0, at, step)
            kept = paths[row, tree]
            paths[row, tree] = self.path[tree, at]
            change[moved, i] = whole[moved] - self._score(paths[moved])
            paths[row, tree] = kept
        return whole, change


def load_forest(forest: DataFrame, names, most: int = MOST_NODES) -> ForestModel:
    """Bring the node table to the driver as a model; more than ``most`` nodes are an error."""
    nodes = forest.limit(most + 1).toPandas()
    if len(nodes) > most or nodes.empty:
        raise ValueError("forest size out of bounds")
    return ForestModel(nodes, names)


def _inputs(names) -> Column:
    return F.struct(*[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])


def score_forest(df: DataFrame, model: ForestModel, out: str = "raw_score") -> DataFrame:
    """Adds the raw score; only the model columns travel to Python."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(x: pd.DataFrame) -> pd.Series:
        values = x.to_numpy(dtype=np.float64)
        if not np.isfinite(values).all():
            raise ValueError("non-finite model input")
        return pd.Series(shared.value.raw(values))

    return df.withColumn(out, score(_inputs(model.names)))


def occlusion_deltas(df: DataFrame, model: ForestModel, baseline: dict, out: str = "deltas",
                     score: str = "subject_score") -> DataFrame:
    """Adds the row's score, and its change when one feature at a time is set to its baseline."""
    shared = df.sparkSession.sparkContext.broadcast(
        (model, np.array([baseline[n] for n in model.names], dtype=np.float64)))

    @F.pandas_udf("deltas array<double>, whole double")
    def deltas(x: pd.DataFrame) -> pd.DataFrame:
        forest, base = shared.value
        values = x.to_numpy(dtype=np.float64)
        parts = [forest.occluded(values[at:at + OCCLUDED_ROWS], base)
                 for at in range(0, len(values), OCCLUDED_ROWS)]
        return pd.DataFrame({"deltas": [d for _, change in parts for d in change],
                             "whole": [w for whole, _ in parts for w in whole]})

    return (df.withColumn("_occluded", deltas(_inputs(model.names)))
            .withColumns({out: F.col("_occluded.deltas"), score: F.col("_occluded.whole")})
            .drop("_occluded"))
