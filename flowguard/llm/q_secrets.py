"""Query of the secret scan over all documents."""

from pyspark.sql import functions as F

from flowguard.llm import secrets as S
from flowguard.llm.common import table
from flowguard.llm.registry import query


def joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


@query("op6_secret_scan")
def op6(spark, sf):
    docs = table(spark, sf, "documents")
    found = S.scan(docs, S.train(docs))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
              for k in S.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256)
                        .alias("base_sha256"), joined(F.col("spans")).alias("spans"))
