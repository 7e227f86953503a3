import itertools
import random

from pyspark.sql import functions as F

from flowguard.operators.blocks import edge_keys, in_blocks, running


def test_running_totals_of_a_key_that_fills_blocks(spark):
    g = random.Random(5)
    rows = [(None if g.random() < .05 else 1 if g.random() < .7 else g.randint(2, 40), i,
             g.randint(-50, 50), None if g.random() < .6 else g.randint(0, 9))
            for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, t long, v long, s long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = in_blocks(df, ["k"], ["t"])
        got = running(blocks, ["k"], ["t"], {
            "total": ("sum", F.col("v")), "bits": ("xor", F.col("v")),
            "top": ("max", F.col("v")), "low": ("min", F.col("v")),
            "seen": ("last", F.col("s"))}).collect()
        edges = {r[0] for r in edge_keys(blocks, ["k"]).collect()}
        used = {(r["k"], r["_block"]) for r in blocks.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 1 in edges and len({b for k, b in used if k == 1}) > 1
    want = {}
    for k, part in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])),
                                     key=lambda r: r[0]):
        total, bits, seen, vs = 0, 0, None, []
        for _, t, v, s in part:
            total, bits, seen = total + v, bits ^ v, seen if s is None else s
            vs.append(v)
            want[t] = (k, total, bits, max(vs), min(vs), seen)
    assert {r["t"]: (r["k"], r["total"], r["bits"], r["top"], r["low"], r["seen"])
            for r in got} == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "k long, t long, v long")
    assert running(in_blocks(df, ["k"], ["t"]), ["k"], ["t"], {"x": ("sum", F.col("v"))}).count() == 0
