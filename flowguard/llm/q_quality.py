"""Query of the quality classifier over all documents."""

from pyspark.sql import functions as F

from flowguard.llm import quality_classifier as Q
from flowguard.llm.common import fold, table
from flowguard.llm.registry import query

FOLDS, HELD_OUT, KEEP_FROM = 5, 0, 0.3


@query("op3_quality")
def op3(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    vectors = Q.word_vectors(docs)
    net = Q.train(docs, labels, vectors, FOLDS, HELD_OUT)
    return Q.score_documents(docs, vectors, net).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
        .alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
