"""From raw documents to token ids in five stages, each a job of its own over all that is left.

Every stage takes the documents its predecessor kept and returns a DataFrame with their columns,
the last one the token ids. :func:`run` writes what a stage returns as Parquet into the shared
folder and reads it again for the next, so a stage never starts over what came before it, and
the loss of an executor costs the tasks it ran.
"""

from __future__ import annotations

import uuid

from flowguard.llm import decontamination, near_dedup, secrets, toxicity
from flowguard.llm.bpe import encode_documents
from flowguard.llm.common import table
from flowguard.llm.q_bpe import vocabulary
from flowguard.session import shared_dir


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity classifier scores 0.7 or more go; labels come from ``sf_dir``.

    The classifier is fitted on the labelled rows of all documents of this stage's input, but for
    the held-out fold.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark, docs, sf_dir):
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays."""
    return near_dedup.keep_one_of_each(docs, n=5, percent=80)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold an item of the benchmark, as it is or with other values, go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """Secrets in texts are replaced; all documents stay."""
    return secrets.redact(docs, secrets.train(docs))


def encode(spark, docs, sf_dir):
    """Token ids of every text: (doc_id, ids)."""
    return encode_documents(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("bpe_encoding", encode),
]

#: Training networks and byte-pair encoding can't be said in SQL; tests hold run() against plain
#: Python on a small table.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn over the documents table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
