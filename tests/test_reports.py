from pyspark.sql import functions as F

from flowguard.operators import reports as R


def test_feedback_hashes_are_shuffled_as_bytes(spark):
    odd = ["ab" * 32, "AB" * 32, "abc", "", "zz", "é" * 3, None, "0a", "\x010a"]
    runs = spark.createDataFrame([(1, odd), (1, ["ab" * 32]), (2, ["cd" * 32]), (3, None)],
                                 "run_id long, hashes array<string>")
    feedback = spark.createDataFrame([(n, r, h) for r in (1, 2, 3, None) for n, h in enumerate(odd)],
                                     "note long, run_id long, evidence_hash string")
    got = R.feedback_valid(feedback, runs)
    assert got.columns == ["run_id", "note", "evidence_hash"]
    want = sorted([(1, n, h) for n, h in enumerate(odd) if h is not None] + [(1, 0, "ab" * 32)])
    assert sorted(map(tuple, got.collect())) == want
    size = feedback.where("note = 0").select(F.length(R._packed(F.col("evidence_hash")))).first()[0]
    assert size == 33
