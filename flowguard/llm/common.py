"""Helpers shared by the operators: tables, words, folds, and streaming over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that separates words: blank and the five control characters 9 to 13.
BREAKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of text that a Python task works on at a time.
BLOCK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null ids have no fold."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def blocks(batches: Iterator[pa.RecordBatch], text_index: int = 1,
           chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts add up to about ``chars`` characters.

    A null text counts as empty. One row is never cut, however long.
    """
    for batch in batches:
        values = [t or "" for t in batch.column(text_index).to_pylist()]
        start = total = 0
        for i, text in enumerate(values):
            total += len(text)
            if total >= chars:
                yield batch.slice(start, i + 1 - start), values[start:i + 1]
                start, total = i + 1, 0
        if start < len(values):
            yield batch.slice(start), values[start:]


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key``: the same rows however partitioned."""
    return rows.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(n)


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int,
                    per_class: int) -> DataFrame:
    """Up to ``per_class`` training labels of each class, as (doc_id, y); one row per id.

    Only ids whose fold is not ``held_out`` are taken. An id with contradicting labels keeps
    the larger one. At most ``2 * per_class`` rows of 12 bytes, so the result may be broadcast.
    """
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col(label).cast("int").alias("y"))
            .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)
                    & (fold(F.col("doc_id"), folds) != held_out))
            .groupBy("doc_id").agg(F.max("y").alias("y")))
    return (bounded_sample(rows.filter("y = 0"), "doc_id", per_class)
            .unionAll(bounded_sample(rows.filter("y = 1"), "doc_id", per_class)))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the cluster's shared checkpoint folder and drop the lineage."""
    from flowguard.session import shared_dir
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
