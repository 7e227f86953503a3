import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.operators import metrics as M, splits as S
from flowguard.operators.encoders import encode, fit_vocabulary, robust_scale
from flowguard.operators.ordered import column_counts, column_quantiles, float_bucket, quantiles, \
    running_totals


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=501), "ties": rng.integers(-3, 3, 400).astype(float),
              "one": np.array([5.0]), "narrow": 0.5 + rng.random(700) / 1e6,
              "wide": 10.0 ** rng.uniform(-300, 300, 200)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs],
                               "g string, v double")
    qs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.95, "f": 1.0}
    got = {r["g"]: r for r in quantiles(df, F.col("v"), qs, ["g"]).collect()}
    for g, vs in groups.items():
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(float(np.quantile(vs, q)), rel=1e-12, abs=1e-300)
    whole = quantiles(df.where("g = 'normal'"), F.col("v"), qs).first()
    assert whole["d"] == pytest.approx(float(np.median(groups["normal"])))


def test_bucket_keeps_the_order(spark):
    rng = np.random.default_rng(2)
    values = np.sort(np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-8, 8, 2000),
                                     2.0 ** np.arange(-60, 60), -(2.0 ** np.arange(-60, 60)),
                                     np.nextafter(2.0 ** np.arange(-60, 60), 0), [0.0]]))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = [r["b"] for r in df.select("i", float_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


def test_running_totals(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(1000)], "i long, v long")
    got = running_totals(df.repartition(9), [F.col("i")], F.floor(F.col("i") / 37), {"s": F.col("v")})
    want = np.cumsum([i % 5 for i in range(1000)])
    assert [r["s"] for r in got.orderBy("i").collect()] == want.tolist()


@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_totals_of_a_crowded_bucket(spark, by):
    """One bucket holds all rows; several blocks work on it and the totals are the same."""
    df = spark.createDataFrame([(i, i % 5, i % 3 if i % 10 else None) for i in range(3000)],
                               "i long, v long, g long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    order = [F.col("i").desc()]
    got, want = (running_totals(df, order, F.lit(0), {"s": F.col("v"), "n": F.lit(1)}, by, crowd=c)
                 for c in (100, 10 ** 6))
    pids = {r[0] for r in got.select(F.spark_partition_id()).distinct().collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = lambda d: sorted(map(str, d.collect()))
    assert text(got) == text(want) and len(pids) > 1


def test_roc_and_average_precision(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 400), rng.integers(0, 20, 400) / 20
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert M.roc_auc(df, "y", "p").first()[0] == pytest.approx(auc)
    ap, before = 0.0, 0
    for cut in sorted(set(p), reverse=True):
        hit = int(((p >= cut) & (y == 1)).sum())
        ap += (hit - before) / y.sum() * hit / int((p >= cut).sum())
        before = hit
    assert M.average_precision(df, "y", "p").first()[0] == pytest.approx(ap)
    m = M.binary_metrics(df, "y", "p").first()
    assert m["tp"] == int(((p >= 0.5) & (y == 1)).sum()) and m["support_0"] == int((y == 0).sum())


def test_split_keeps_groups_whole_and_in_time(spark):
    rows = [(f"g{g}", g * 86_400 + i) for g in range(20) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, s long").select(
        "g", F.timestamp_seconds("s").alias("t"), F.concat_ws("-", "g", F.col("s").cast("string"))
        .alias("id"))
    done = S.group_time_split(df, "g", "t")
    report = {r["partition"]: r for r in S.split_report(done, "t", "id").collect()}
    assert {p: r["rows"] for p, r in report.items()} == {"training": 140, "validation": 30,
                                                         "test": 30}
    assert all(r["ratio_ok"] and r["band_ok"] for r in report.values())
    assert S.partition_overlap(done, F.col("g")).count() == 0
    assert S.partition_overlap(done, F.substring("g", 1, 1)).count() == 1


def test_vocabulary_is_fitted_on_training_only(spark):
    df = spark.createDataFrame(
        [("tcp", "training"), ("udp", "training"), (None, "training"), ("gre", "validation")],
        "p string, partition string")
    vocabulary = fit_vocabulary(df, "p")
    assert {r["token"]: r["ordinal"] for r in vocabulary.collect()} == {"tcp": 2, "udp": 3}
    codes = {r["p"]: r["c"] for r in encode(df, "p", vocabulary, "c").collect()}
    assert codes == {"tcp": 2, "udp": 3, None: 0, "gre": 1}


def test_scaling_with_no_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0, "training"), (3.0, 5.0, "training"),
                                (9.0, 6.0, "test")], "a double, b double, partition string")
    got = [(r["a"], r["b"]) for r in robust_scale(df, ["a", "b"]).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0), (7.0, 1.0)]


def test_quantiles_of_columns_are_exact(spark):
    """Two passes over the rows as they are; values, nulls aside, were all shuffled before."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=5000) * 10.0 ** rng.integers(-3, 6, 5000)
    b = rng.integers(-2, 3, 5000) * 1.0
    rows = [(float(p), None if i % 5 == 0 else float(q), None) for i, (p, q) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    qs = {"low": 0.0, "q25": 0.25, "q50": 0.5, "q87": 0.87, "high": 1.0}
    found = {r["feature"]: r for r in column_quantiles(df, ["a", "b", "c"], qs).collect()}
    assert set(found) == {"a", "b"}
    for name, q in qs.items():
        assert found["a"][name] == pytest.approx(np.quantile(a, q))
        assert found["b"][name] == pytest.approx(np.quantile(b[np.arange(5000) % 5 > 0], q))
    text = column_counts(df, ["a"])._jdf.queryExecution().toString()
    assert "Generate" not in text and "MapInArrow" in text
