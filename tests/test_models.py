import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.operators import attribution as AT, classifiers as C, encoders as E, forest as FO

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    x[:6] += 12.0
    label = (x[:, 1] > 0.3).astype(int)
    part = ["training" if i % 10 < 7 else "validation" if i % 10 < 8 else "test" for i in range(600)]
    data = [(f"k{i:04d}", *map(float, x[i]), int(label[i]), part[i]) for i in range(600)]
    return spark.createDataFrame(
        data, "event_key string, a double, b double, c double, label int, partition string").cache()


def test_forest_finds_outliers_whatever_the_partitions(rows):
    usual = rows.where("a < 6")
    one = FO.fit_forest(usual.repartition(5), "event_key", NAMES, 40, 64)
    two = FO.fit_forest(usual.coalesce(1), "event_key", NAMES, 40, 64)
    assert sorted(one.collect()) == sorted(two.collect())
    sizes = one.groupBy("tree").count().collect()
    assert len(sizes) == 40 and max(s["count"] for s in sizes) <= 2 * 64 - 1
    model = FO.load_forest(one, NAMES)
    scored = FO.score_forest(rows, model)
    top = scored.orderBy(F.col("raw_score").desc()).limit(6).collect()
    assert sum(r["a"] > 6 for r in top) >= 5
    got = E.normalize_scores(scored, "raw_score", E.score_anchors(scored, "raw_score"))
    low, high = got.agg(F.min("score"), F.max("score")).first()
    assert (low, high) == (0.0, 1.0)
    with pytest.raises(Exception, match="non-finite"):
        FO.score_forest(rows.withColumn("a", F.lit(float("nan"))), model).collect()


def test_scores_equal_a_walk_through_the_trees(rows):
    nodes = FO.fit_forest(rows, "event_key", NAMES, 5, 32)
    model, table = FO.load_forest(nodes, NAMES), {}
    for n in nodes.collect():
        table[n["tree"], n["node"]] = n
    sample = rows.limit(20).collect()
    for r in sample:
        x, paths = [r[n] for n in NAMES], []
        for tree in range(5):
            node = table[tree, 0]
            while node["feature"] >= 0:
                side = "left" if x[node["feature"]] <= node["threshold"] else "right"
                node = table[tree, node[side]]
            paths.append(node["path"])
        want = 2.0 ** (-np.mean(paths) / FO.mean_path(32)) - 0.5
        assert model.raw(np.array([x]))[0] == pytest.approx(want)


def test_attribution_of_odd_rows(rows):
    model = FO.load_forest(FO.fit_forest(rows.where("a < 6"), "event_key", NAMES, 40, 64), NAMES)
    base = {r["feature"]: r["median"] for r in E.baseline_medians(rows, NAMES).collect()}
    got = AT.attribute(rows.where("a > 6"), model, base, 2).collect()
    lead = [r for r in got if r["rank"] == 1]
    assert len(got) == 2 * len(lead)
    assert all(r["direction"] == "increase" and r["magnitude"] == 1.0 for r in lead)
    values = {r["event_key"]: r for r in rows.collect()}
    scores = {r["event_key"]: r["raw_score"] for r in FO.score_forest(rows, model).collect()}
    for r in got:
        assert r["raw_value"] == pytest.approx(values[r["event_key"]][r["feature"]], abs=1e-6)
        assert r["subject_score"] == pytest.approx(scores[r["event_key"]], abs=1e-6)
    assert len({r["explanation_id"] for r in got}) == len(lead)
    assert len({r["baseline_score"] for r in got}) == 1
    assert not any(w in r["summary"].lower() for r in lead for w in K.CAUSAL_WORDS)


def test_candidates_and_choice(rows):
    models = C.fit_candidates(rows, NAMES, trees=5, depth=4, iterations=30)
    chosen, test = C.select_candidate(models)
    assert chosen in C.ALGORITHMS and test.first()["macro_f1"] > 0.85
    model, frame = models[chosen]
    assert sum(r["n"] for r in C.score_counts(frame, model).collect()) == 600
    weights = C.with_class_weights(rows).groupBy("label").agg(F.sum("_weight").alias("w")).collect()
    assert weights[0]["w"] == pytest.approx(weights[1]["w"])


def test_each_tree_draws_from_the_whole_table(rows):
    drawn = FO.sample_per_tree(rows, "event_key", NAMES, 20, 64).collect()
    assert len(drawn) == 20 * 64
    by_tree = {}
    for r in drawn:
        by_tree.setdefault(r["tree"], set()).add(tuple(r[n] for n in NAMES))
    assert len(set().union(*by_tree.values())) > 500
    few = FO.fit_forest(rows.limit(10), "event_key", NAMES, 3, 64)
    assert {r["rows"] for r in few.collect()} == {10}
    assert FO.load_forest(few, NAMES).expected == FO.mean_path(10)


def test_a_summary_claims_no_cause(rows):
    bad = rows.limit(1).select(AT.summary_text(F.lit("the_attacker_rate"), F.lit("increase"),
                                               F.lit(1.0)))
    with pytest.raises(Exception, match="claims a cause"):
        bad.collect()


def test_occlusion_walks_only_what_a_feature_can_change(rows):
    model = FO.load_forest(FO.fit_forest(rows, "event_key", NAMES, 20, 64), NAMES)
    x = np.array([[r[n] for n in NAMES] for r in rows.limit(80).collect()])
    base = np.median(x, axis=0)
    x[::4, 1] = base[1]
    whole, change = model.occluded(x, base)
    assert np.array_equal(whole, model.raw(x))
    for i in range(3):
        other = x.copy()
        other[:, i] = base[i]
        assert np.array_equal(change[:, i], whole - model.raw(other))


def test_a_logistic_fit_takes_few_passes_to_the_optimum(spark):
    """Labels that a feature tells apart, features of very unlike sizes: many short steps before."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3)) * [1.0, 300.0, 0.01]
    label = (x[:, 0] + 0.02 * rng.normal(size=900) > 0.2).astype(int)
    df = spark.createDataFrame(
        [(*map(float, r), int(y), "training") for r, y in zip(x, label)],
        "a double, b double, c double, label int, partition string").repartition(3)
    model, frame = C.fit_candidates(df, NAMES, which=("logistic_regression",))[
        "logistic_regression"]
    assert model.passes <= 40
    train = C.with_class_weights(frame)
    for r in C.slopes(model, train, NAMES).collect():
        assert abs(r["slope"]) < 1e-6
    p = C.probabilities(model, train)
    left = p.agg(F.sum(F.col("_weight") * (F.col("label") - F.col("probability_1")))).first()[0]
    assert abs(left) < 1e-4
    with pytest.raises(Exception, match="null"):
        C.probabilities(model, frame.withColumn("a", F.lit(None).cast("double"))).collect()


def test_a_logistic_fit_of_one_class(rows):
    for y, p in ((1, 1.0), (0, 0.0)):
        model, frame = C.fit_candidates(rows.withColumn("label", F.lit(y)), NAMES, which=(
            "logistic_regression",))["logistic_regression"]
        assert {r[0] for r in C.probabilities(model, frame).select("probability_1").collect()} == {p}


def test_a_logistic_fit_of_many_rows_takes_few_passes_over_all(spark):
    """Eleven passes over all rows before; now it sets out from where it ends on some."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40_000, 3)) * [1.0, 300.0, 0.01]
    label = (x[:, 0] + 0.02 * rng.normal(size=40_000) > 0.2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": label,
                                             "partition": "training"})).repartition(3)
    model, frame = C.fit_candidates(df, NAMES, which=("logistic_regression",))["logistic_regression"]
    assert model.passes <= 8
    for r in C.slopes(model, C.with_class_weights(frame), NAMES).collect():
        assert abs(r["slope"]) < 1e-6
