"""Models: classifiers, isolation forest, attribution, with the operators' default sizes."""

from pyspark.sql import Window as W, functions as F

from flowguard import constants as K
from flowguard.operators import attribution as AT, classifiers as C, encoders as E, \
    features as FT, forest as FO
from flowguard.operators.splits import group_time_split
from flowguard.plans import bindings as B
from flowguard.plans.q_splits import SPLIT
from flowguard.plans.registry import query
from flowguard.session import materialised

WINDOWS = K.DEFAULT_WINDOWS
NAMES = list(K.feature_names(WINDOWS))
EULER = 0.5772156649015329


@B.shared_plan
def matrix(spark, sf):
    """Encoded features of all flows with label and partition, stored once."""
    f = B.flows(spark, sf).withColumn("label", (F.col("value") > 20).cast("int"))
    f = group_time_split(f, "user_id", "event_time")
    table = FT.feature_columns(f, WINDOWS, carry=("label", "partition"))
    return materialised(E.encoded_matrix(table, NAMES, keep=("event_key", "label", "partition")))


@B.shared_plan
def fitted(spark, sf, name):
    """One candidate with the matrix it reads."""
    return C.fit_candidates(matrix(spark, sf), NAMES, which=(name,))[name]


# Scores depend on the fit; what SQL can say of them is which rows have one, and their bounds.
ROWS = SPLIT + """,
mr AS (SELECT event_key, CAST(value > 20 AS INT) AS label, partition FROM sf)"""
SCORED = f"WITH {ROWS} SELECT *, TRUE AS in_bounds FROM mr"


def scored_rows(model, rows):
    p = F.col("probability_1")
    return C.probabilities(model, rows).select("event_key", "label", "partition",
                                               p.between(0, 1).alias("in_bounds"))


@query("ml_4_logistic_regression", SCORED)
def ml_4(spark, sf):
    return scored_rows(*fitted(spark, sf, "logistic_regression"))


@query("ml_4_class_balance", f"""WITH {ROWS},
t AS (SELECT label, count(*) AS n FROM mr WHERE partition = 'training' GROUP BY label)
SELECT label, n, round((SELECT sum(n) FROM t) / 2.0 / n, 6) AS weight, 0.0::DOUBLE AS balance FROM t""")
def ml_4_balance(spark, sf):
    """At the optimum the intercept's gradient is nought: weighted residuals cancel out."""
    model, rows = fitted(spark, sf, "logistic_regression")
    train = C.with_class_weights(rows.where("partition = 'training'"))
    scored = C.probabilities(model, train)
    each = scored.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.max("_weight"), 6).alias("weight"),
        F.sum("_weight").alias("w"),
        F.sum(F.col("_weight") * (F.col("label") - F.col("probability_1"))).alias("r"))
    both = W.partitionBy(F.lit(0))  # two rows, one for each class
    return each.select("label", "n", "weight", (F.abs(F.round(
        F.sum("r").over(both) / F.sum("w").over(both), 3)) + 0.0).alias("balance"))


@query("ml_4_optimum", f"""SELECT unnest([{', '.join(f"'{n}'" for n in NAMES)}]) AS feature, TRUE AS level""")
def ml_4_optimum(spark, sf):
    """Every slope of the penalised loss over the training rows is nought, beside what it is made of."""
    model, rows = fitted(spark, sf, "logistic_regression")
    train = C.with_class_weights(rows.where("partition = 'training'"))
    return C.slopes(model, train, NAMES).select(
        "feature", (F.abs("slope") <= 0.0001 + 0.002 * F.col("size")).alias("level"))


# The label follows from the bytes of a flow, which are a feature, so a fit that works knows it.
KNOWN = f"""WITH {ROWS} SELECT partition, count(*) AS n, sum(label)::BIGINT AS positives, TRUE AS known,
  TRUE AS apart FROM mr GROUP BY partition"""


def known_labels(spark, sf, name):
    """Per partition: at least 95 of 100 labels are told right, and the classes' mean scores lie apart."""
    scored = C.probabilities(*fitted(spark, sf, name))
    right = F.avg(((F.col("probability_1") >= 0.5).cast("int") == F.col("label")).cast("int"))
    mean = lambda y: F.avg(F.when(F.col("label") == y, F.col("probability_1")))
    return scored.groupBy("partition").agg(
        F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"),
        (right >= 0.95).alias("known"), (mean(1) - mean(0) > 0.5).alias("apart"))


@query("ml_4_known_labels", KNOWN)
def ml_4_known(spark, sf):
    return known_labels(spark, sf, "logistic_regression")


@query("ml_5_known_labels", KNOWN)
def ml_5_known(spark, sf):
    return known_labels(spark, sf, "random_forest")


@query("ml_5_random_forest", SCORED)
def ml_5(spark, sf):
    return scored_rows(*fitted(spark, sf, "random_forest"))


@query("ml_6_selected_candidate", f"""WITH {ROWS}
SELECT count(*) FILTER (WHERE label = 0) AS support_0, count(*) FILTER (WHERE label = 1)
  AS support_1, TRUE AS consistent FROM mr WHERE partition = 'test'""")
def ml_6(spark, sf):
    """The chosen candidate's test metrics: supports, and that its figures follow from its counts."""
    found = C.select_candidate({n: fitted(spark, sf, n) for n in C.ALGORITHMS})[1]
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def f1(hit, wrong, missed):
        return F.coalesce(F.try_divide(2 * hit, 2 * hit + wrong + missed), F.lit(0.0))
    macro = (f1(tn, fn, fp) + f1(tp, fp, fn)) / 2
    return found.select("support_0", "support_1", (
        (F.abs(F.col("macro_f1") - macro) < 1e-9) & F.col("brier").between(0, 1))
        .alias("consistent"))


@query("ml_11_class_counts", f"""WITH {ROWS}
SELECT count(*) AS n, TRUE AS known_classes FROM mr""")
def ml_11(spark, sf):
    model, rows = fitted(spark, sf, "logistic_regression")
    counts = C.score_counts(rows, model)
    return counts.agg(F.sum("n").alias("n"),
                      F.bool_and(F.col("predicted").isin(0, 1)).alias("known_classes"))


def benign(rows):
    return rows.where("partition = 'training' AND label = 0")


@B.shared_plan
def forest_nodes(spark, sf):
    return materialised(FO.fit_forest(benign(matrix(spark, sf)), "event_key", NAMES))


@query("ml_7_isolation_forest", f"""WITH {ROWS},
b AS (SELECT least({K.FOREST_ROWS}, count(*)) AS n FROM mr
  WHERE partition = 'training' AND label = 0)
SELECT CAST(t AS INT) AS tree, n AS rows_in_leaves, TRUE AS binary, TRUE AS paths_fit
FROM range({K.FOREST_TREES}) AS r(t), b""")
def ml_7(spark, sf):
    """Per tree: its leaves hold its sample, it is binary, and path lengths are depth plus the mean
    path among the leaf's rows."""
    n = F.col("size")
    mean = (F.when(n <= 1, 0.0).when(n == 2, 1.0)
            .otherwise(2 * (F.log(n - 1.0) + EULER) - 2 * (n - 1.0) / n))
    leaf = F.col("feature") < 0
    return forest_nodes(spark, sf).groupBy("tree").agg(
        F.sum(F.when(leaf, n)).cast("long").alias("rows_in_leaves"),
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("binary"),
        F.bool_and(~leaf | (F.abs(F.col("path") - F.col("depth") - mean) < 1e-9))
        .alias("paths_fit"))


def forest_model(spark, sf):
    return FO.load_forest(forest_nodes(spark, sf), NAMES)


@query("ml_8_isolation_scores", f"""WITH {ROWS}
SELECT event_key, partition, TRUE AS raw_in_bounds, TRUE AS score_in_bounds FROM mr""")
def ml_8(spark, sf):
    scored = materialised(FO.score_forest(matrix(spark, sf), forest_model(spark, sf)).select(
        "event_key", "partition", "label", "raw_score"))
    anchors = E.score_anchors(benign(scored), "raw_score")
    return E.normalize_scores(scored, "raw_score", anchors).select(
        "event_key", "partition", (F.abs("raw_score") < 0.5).alias("raw_in_bounds"),
        F.col("score").between(0, 1).alias("score_in_bounds"))


def explained(spark, sf):
    rows = matrix(spark, sf)
    base = {r["feature"]: r["median"] for r in E.baseline_medians(rows, NAMES).collect()}
    return AT.attribute(rows.where("partition = 'validation'"), forest_model(spark, sf), base, 5)


@query("ml_12_occlusion_attribution", f"""WITH {ROWS}
SELECT event_key, sha256('occlusion-1:' || event_key) AS explanation_id, 5 AS n, TRUE AS ordered,
  TRUE AS led, 1 AS summaries FROM mr WHERE partition = 'validation'""")
def ml_12(spark, sf):
    """Per explained row: its five features in falling order, the first at the full scale or all at
    nought, and one summary."""
    lead = F.max(F.when(F.col("rank") == 1, F.col("magnitude")))
    order = F.array_sort(F.collect_list(F.struct("rank", "magnitude")))
    falling = F.transform(order, lambda x: x["magnitude"])
    return explained(spark, sf).groupBy("event_key", "explanation_id").agg(
        F.count("*").cast("int").alias("n"),
        (falling == F.reverse(F.array_sort(falling))).alias("ordered"),
        ((lead == 1) | (F.max("magnitude") < 0.01)).alias("led"),
        F.count("summary").cast("int").alias("summaries"))


@query("agg_16_lead_directions", f"""WITH {ROWS}
SELECT count(*) AS n, TRUE AS known_directions FROM mr WHERE partition = 'validation'""")
def agg_16_lead(spark, sf):
    found = AT.lead_directions(explained(spark, sf))
    return found.agg(F.sum("n").alias("n"), F.bool_and(F.col("direction").isin(
        "increase", "decrease", "neutral")).alias("known_directions"))


# Fixed pseudo-deltas: the ranking is what is checked here, not the model.
NINE = K.DIRECT_FEATURES[:9]


@query("srt_7_top_attributions", f"""WITH {B.EVENTS},
d AS (SELECT event_id, unnest([{', '.join(f"'{n}'" for n in NINE)}]) AS feature,
    unnest([{', '.join(f"((k * {7 * i + 3} + event_id) % 11 - 5) / 10.0::DOUBLE"
                       for i in range(9))}]) AS delta FROM ev),
r AS (SELECT *, max(abs(delta)) OVER (PARTITION BY event_id) AS top,
  row_number() OVER (PARTITION BY event_id ORDER BY abs(delta) DESC, feature) AS rank FROM d)
SELECT event_id, CAST(rank AS BIGINT) AS rank, feature,
  CASE WHEN delta > 1e-9 THEN 'increase' WHEN delta < -1e-9 THEN 'decrease' ELSE 'neutral' END
    AS direction, round(abs(delta) / CASE WHEN top > 1e-9 THEN top ELSE 1 END, 6) AS magnitude
FROM r WHERE rank <= 4""")
def srt_7(spark, sf):
    k, e = F.col("k"), F.col("event_id")
    rows = B.events(spark, sf).withColumn("deltas", F.array(*[
        ((k * (7 * i + 3) + e) % 11 - 5) / F.lit(10.0) for i in range(9)]))
    return AT.top_attributions(rows, NINE, 4, key="event_id").select(
        "event_id", F.col("rank").cast("long").alias("rank"), "feature", "direction", "magnitude")
