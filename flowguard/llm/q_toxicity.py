"""Query of the toxicity classifier over all documents."""

from pyspark.sql import functions as F

from flowguard.llm import toxicity as X
from flowguard.llm.common import fold, table
from flowguard.llm.registry import query

FOLDS, HELD_OUT, REJECT_FROM = 3, 1, 0.7


@query("op7_toxicity")
def op7(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = X.train(docs, labels, FOLDS, HELD_OUT)
    return X.score_documents(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
        .alias("held_out"), "score", (F.col("score") >= REJECT_FROM).cast("int").alias("predicted"))
