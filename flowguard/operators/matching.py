"""Threat indicators: matching, states, technique mapping."""

from pyspark.sql import DataFrame, functions as F

from flowguard.functions.text import indicator_hash


def match_indicators(indicators: DataFrame, observations: DataFrame, allowlist: DataFrame, now
                     ) -> DataFrame:
    """Every (observation, indicator) pair of one type and value hash, with its state.

    Observations: indicator_type, raw_value, provenance_hash. Distinct observed values
    are hashed and looked up once; the result is then given to all their observations,
    so a value seen in a third of all rows is resolved one time.
    """
    observed = (observations.select("indicator_type", "raw_value").distinct()
                .withColumn("value_hash", indicator_hash(F.col("indicator_type"),
                                                         F.col("raw_value"))))
    allowed = allowlist.select("value_hash", F.lit(True).alias("_allowed")).distinct()
    state = (F.when(F.col("_allowed"), "allowlist_conflict")
             .when(F.lit(now) >= F.col("expires_at"), "expired").otherwise("active"))
    known = (observed.join(
        indicators.select("indicator_type", "value_hash", "indicator_hash", "source_name",
                          "expires_at"), ["indicator_type", "value_hash"])
        .join(allowed, "value_hash", "left")
        .select("indicator_type", "raw_value", "value_hash", "indicator_hash", "source_name",
                state.alias("state")))
    return (observations.join(known, ["indicator_type", "raw_value"])
            .select(F.sha2(F.concat_ws(":", "indicator_hash", "provenance_hash"), 256)
                    .alias("match_id"), "indicator_hash", "indicator_type", "value_hash",
                    "source_name", "provenance_hash", "state"))


def map_techniques(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mappings with the technique they name."""
    return mappings.join(catalog, "technique_id").select(
        "technique_id", "name", "tactic", "evidence_class", "confidence")


def technique_errors(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Technique ids that are unknown to the catalogue or occur in it twice."""
    unknown = (mappings.join(catalog, "technique_id", "left_anti")
               .select("technique_id", F.lit("unknown_technique").alias("error")).distinct())
    twice = (catalog.groupBy("technique_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("technique_id", F.lit("duplicate_technique").alias("error")))
    return unknown.unionByName(twice)


def explode_techniques(rules: DataFrame) -> DataFrame:
    """Rows (rule_key, technique_id) out of rules with an array of technique ids."""
    return rules.select("rule_key", F.explode("technique_ids").alias("technique_id"))
