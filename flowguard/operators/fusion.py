"""Fusion of several signal scores per entity into risk, severity and confidence."""

from pyspark.sql import DataFrame, functions as F

from flowguard import constants as K


def fuse(signals: DataFrame, entity: str = "entity_id") -> DataFrame:
    """One assessment per entity.

    Input rows: entity, source, score, quality, category, evidence_hash, reason_codes,
    position (order of the codes). Two valid signals of one source are an error, shown in
    ``duplicate_source``. Everything but the codes is a plain minimum, maximum or count. The codes are
    reduced to distinct ones with their first position before they are put in order,
    so an entity's list is as short as the code vocabulary.
    """
    valid = F.col("quality") == "valid"
    scores = {s: F.max(F.when(valid & (F.col("source") == s), F.col("score")))
              for s in K.FUSION_PRECEDENCE}
    pick = {s: F.max(F.when(valid & (F.col("source") == s), F.col("category")))
            for s in K.FUSION_PRECEDENCE}
    per_source = {s: F.count_if(valid & (F.col("source") == s)) for s in K.FUSION_PRECEDENCE}
    twice = None
    for c in per_source.values():
        twice = c > 1 if twice is None else twice | (c > 1)
    n = F.count_if(valid)
    top, low = F.max(F.when(valid, F.col("score"))), F.min(F.when(valid, F.col("score")))
    base = signals.groupBy(entity).agg(
        n.alias("valid_count"),
        *[c.alias(f"_s_{s}") for s, c in scores.items()], top.alias("_top"), low.alias("_low"),
        F.count_if(valid & F.col("evidence_hash").isNotNull()).alias("_proof"),
        F.coalesce(*pick.values(), F.lit(K.DEFAULT_CATEGORY)).alias("category"),
        twice.alias("duplicate_source"))
    quality_code = F.concat(F.lit("SOURCE_"), F.upper("source"), F.lit("_"), F.upper("quality"))
    listed = F.concat(F.coalesce("reason_codes", F.array().cast("array<string>")),
                      F.when(~valid, F.array(quality_code))
                      .otherwise(F.array().cast("array<string>")))
    codes = (signals.select(entity, "position", F.posexplode(listed).alias("_i", "_code"))
             .groupBy(entity, "_code").agg(F.min(F.struct("position", "_i")).alias("_at"))
             .groupBy(entity).agg(F.transform(
                 F.array_sort(F.collect_list(F.struct("_at", "_code"))), lambda s: s["_code"])
                 .alias("_codes")))
    none = F.col("valid_count") == 0
    spread = F.col("_top") - F.col("_low")
    # Sources are added up in a fixed order, so the sum does not depend on row order.
    weighted, weight = F.lit(0.0), F.lit(0.0)
    for source, w in K.FUSION_WEIGHTS.items():
        held = F.col(f"_s_{source}")
        weighted = weighted + F.coalesce(F.lit(w) * held, F.lit(0.0))
        weight = weight + F.when(held.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    risk = F.when(none, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(
        F.lit(100), F.rint(F.lit(100.0) * weighted / weight).cast("int"))))
    completeness = F.col("_proof") / F.col("valid_count")
    agreement = F.when(F.col("valid_count") == 1, F.lit(0.5)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - spread))
    share = F.least(F.col("valid_count") / F.lit(float(K.CONFIDENCE_DENOMINATOR)), F.lit(1.0))
    severity = F.lit(None).cast("string")
    for band, lower, upper in K.SEVERITY_BANDS:
        severity = F.when(F.col("risk_score").between(lower, upper), band).otherwise(severity)
    empty = F.array().cast("array<string>")
    tail = F.when(none, F.array(F.lit("NO_VALID_SIGNAL"))).otherwise(F.concat(
        F.when(F.col("valid_count") == 1, F.array(F.lit("SINGLE_SOURCE"))).otherwise(empty),
        F.when(spread > 0.5, F.array(F.lit("SIGNAL_DISAGREEMENT"))).otherwise(empty)))
    return (base.join(codes, entity, "left")
            .withColumn("risk_score", risk)
            .withColumn("confidence", F.when(none, F.lit(0.0)).otherwise(F.round(
                F.least(F.lit(1.0), F.greatest(F.lit(0.0), share * completeness * agreement)), 6)))
            .withColumn("severity", severity)
            .withColumn("uncertainty_codes",
                        F.array_distinct(F.concat(F.coalesce("_codes", empty), tail)))
            .withColumn("evidence_complete", ~none & (F.col("_proof") == F.col("valid_count")))
            .select(entity, "valid_count", "risk_score", "confidence", "severity", "category",
                    "uncertainty_codes", "evidence_complete", "duplicate_source"))


def duplicate_sources(signals: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Entities that have two valid signals of one source, which is an error."""
    return (signals.where("quality = 'valid'").groupBy(entity, "source")
            .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(entity, "source", "n"))


def assessment_summary(assessments: DataFrame, flag_at: int = 50) -> DataFrame:
    """Rows, flagged rows, mean risk and counts per severity of a batch."""
    return assessments.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("risk_score") >= flag_at).alias("flagged"),
        F.round(F.avg("risk_score"), 6).alias("mean_risk"),
        *[F.count_if(F.col("severity") == band).alias(band) for band, _, _ in K.SEVERITY_BANDS])
