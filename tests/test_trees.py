import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowguard.operators import classifiers as C, trees as T

NAMES = ["a", "b", "c"]


def table(spark, n, noise, parts=3):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3))
    y = (x[:, 1] + noise * rng.normal(size=n) > 0.3).astype(int)
    return spark.createDataFrame(
        [(*map(float, r), int(v), "training") for r, v in zip(x, y)],
        "a double, b double, c double, label int, partition string").repartition(parts)


def test_leaves_hold_the_drawn_rows_wherever_they_grew(spark, monkeypatch):
    """Large nodes over all rows, small ones in tasks: each leaf's share is that of the rows that reach it."""
    df = table(spark, 3000, 0.5).cache()
    monkeypatch.setattr(T, "LEAST", 200)
    one = T.fit_trees(df, NAMES, "label", (1.0, 2.0), 6, 8, 5)
    monkeypatch.setattr(T, "LEAST", 10 ** 6)
    two = T.fit_trees(df, NAMES, "label", (1.0, 2.0), 6, 8, 5)
    blocks = T.packed_bins(df, NAMES, "label", one.edges).collect()
    assert sum(len(b["y"]) for b in blocks) == 3000
    for model in (one, two):
        for tree, root in enumerate(model.roots):
            counts = np.zeros((len(model.feature), 2))
            for b in blocks:
                y = np.frombuffer(b["y"], np.uint8)
                draws = T.drawn(5, tree, b["block"], len(y))
                end = T.walk(model.feature, model.cut, model.left,
                             np.frombuffer(b["x"], np.uint8).reshape(-1, 3), np.arange(len(y)), root)
                np.add.at(counts, (end, y), draws)
            own = np.flatnonzero(counts.sum(axis=1))
            assert len(own) > 20 and (model.feature[own] < 0).all()
            assert counts[own].sum(axis=1).min() >= 2
            w = counts[own] * (1.0, 2.0)
            assert model.value[own] == pytest.approx(w[:, 1] / w.sum(axis=1))


def test_deep_trees_take_few_passes(spark):
    """Labels that no tree tells apart grew 20 levels, each of them a pass over all rows."""
    df = table(spark, 2000, 3.0).cache()
    df.count()
    context = spark.sparkContext
    context.setJobGroup("trees", "fit")
    model, rows = C.fit_candidates(df, NAMES, trees=20, which=("random_forest",))["random_forest"]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("trees")) <= 16
    p = F.col("probability_1")
    right = C.probabilities(model, rows).agg(
        F.avg(((p >= 0.5).cast("int") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.9


def test_best_split_equals_a_search():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, T.BINS, (200, 4)).astype(np.uint8), rng.integers(0, 2, 200).astype(np.uint8)
    draws, w = rng.integers(0, 3, 200), np.array([1.0, 3.0])
    looked = np.array([[2, 0, 3]], np.int16)
    counts = T.counted(x, y, draws, np.zeros(200, np.int64), looked)
    splits, place, cut, low = T.best_splits(counts, w, 2)

    def gini(rows):
        c = np.array([draws[rows & (y == v)].sum() for v in (0, 1)]) * w
        return c.sum() * (1 - ((c / c.sum()) ** 2).sum()) if c.sum() else 0.0
    found = max((-gini(x[:, f] <= b) - gini(x[:, f] > b), f, b)
                for f in (0, 2, 3) for b in range(T.BINS - 1)
                if min(draws[x[:, f] <= b].sum(), draws[x[:, f] > b].sum()) >= 2)
    f, b = looked[0, place[0]], cut[0]
    assert splits[0] and -gini(x[:, f] <= b) - gini(x[:, f] > b) == pytest.approx(found[0])
    assert low[0].tolist() == [draws[(x[:, f] <= b) & (y == v)].sum() for v in (0, 1)]


def test_bins_end_where_weighted_classes_part(spark):
    """Classes of unlike size that a value parts: it is half way by weight, so it bounds a bin."""
    df = spark.range(10_000).select((F.col("id") * 1.0).alias("a"), (F.col("id") % 7 * 1.0).alias("b"),
                                    (F.col("id") >= 1234).cast("int").alias("label"))
    a, b = T.bin_edges(df, ["a", "b"], "label", C.class_weights(df))
    assert 1233.0 in a and len(a) == T.BINS - 1
    assert b.tolist() == [0, 1, 2, 3, 4, 5]


def test_odd_rows(spark):
    df = table(spark, 60, 0.0)
    for y in (0, 1):
        model = T.fit_trees(df.withColumn("label", F.lit(y)), NAMES, "label", (1.0, 1.0), 3, 4, 1)
        assert {r[0] for r in model.with_probability(df, "p").select("p").collect()} == {float(y)}
    fit = lambda rows: T.fit_trees(rows, NAMES, "label", (1.0, 1.0), 3, 4, 1)
    with pytest.raises(ValueError, match="no rows"):
        fit(df.limit(0))
    with pytest.raises(ValueError, match="labels"):
        fit(df.withColumn("label", F.lit(None).cast("int")))
    holed = df.withColumn("b", F.when(F.col("b") < 0, F.col("b")))
    with pytest.raises(Exception, match="null or NaN"):
        fit(holed)
    with pytest.raises(Exception, match="null or NaN"):
        fit(df).with_probability(holed, "p").collect()


def test_bins_end_at_weighted_quantiles_put_together_from_summaries(spark, monkeypatch):
    """Every summary of rows keeps the rank of its points; nulls and foreign labels are told."""
    monkeypatch.setattr(T, "SUMMED", 4000)
    monkeypatch.setattr(T, "POINTS", 256)
    rng = np.random.default_rng(4)
    v, y = np.exp(3 * rng.normal(size=30_000)), rng.integers(0, 5, 30_000) // 4
    df = spark.createDataFrame(pd.DataFrame({"a": v, "b": np.round(v), "label": y}))
    a, b = T.bin_edges(df, ["a", "b"], "label", (1.0, 4.0))
    w = np.where(y == 1, 4.0, 1.0)
    assert len(a) == T.BINS - 1 and set(a) <= set(v) and set(b) <= set(np.round(v))
    shares = [w[v <= e].sum() / w.sum() for e in a]
    assert np.abs(shares - np.arange(1, T.BINS) / T.BINS).max() < 2 / 256


def test_tasks_of_a_pass_do_not_follow_the_tables_partitions(spark):
    """Counts of all open nodes came from each partition, and one task a class put all quantiles together."""
    context = spark.sparkContext
    df = table(spark, 600, 0.5, 150).cache()
    df.count()
    context.setJobGroup("many", "fit")
    T.fit_trees(df, NAMES, "label", (1.0, 1.0), 4, 4, 3)
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("many")
              for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numTasks >= 150 for s in stages if s) <= 1


def test_walks_end_in_leaves():
    rng = np.random.default_rng(9)
    x = rng.integers(0, T.BINS, (500, 3)).astype(np.uint8)
    feature, cut = np.array([1, 0, -1, 2, -1, -1, -1]), np.array([9, 20, 0, 30, 0, 0, 0], np.uint8)
    left = np.array([1, 3, -1, 5, -1, -1, -1], np.int32)
    ends = T.walk(feature, cut, left, x, np.arange(500), 0)
    for row, end in zip(x, ends):
        at = 0
        while feature[at] >= 0:
            at = left[at] + int(row[feature[at]] > cut[at])
        assert at == end
    assert T.walk(feature, cut, left, x, np.arange(3), 4).tolist() == [4, 4, 4]
