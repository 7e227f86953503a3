"""Score fusion and assessment summaries."""

from pyspark.sql import functions as F

from flowguard import constants as K
from flowguard.functions.contracts import fusion_input_ok
from flowguard.operators import fusion as FU
from flowguard.plans import bindings as B
from flowguard.plans.registry import query


def signals(spark, sf):
    """Three events in a row are the signals of one entity, from different sources."""
    e, k = F.col("event_id"), F.col("k")
    names = F.array(*[F.lit(s) for s in K.FUSION_PRECEDENCE])
    quality = F.when(k % 10 == 0, "absent").when(k % 10 == 1, "stale").otherwise("valid")
    return B.events(spark, sf).select(
        F.floor(e / 3).cast("long").alias("entity_id"),
        F.get(names, (e % 4).cast("int")).alias("source"),
        F.least(F.lit(1.0), F.col("value") / 40.0).alias("score"), quality.alias("quality"),
        F.col("event_type").alias("category"),
        F.when(quality == "valid", F.sha2(B.text("event_id"), 256)).alias("evidence_hash"),
        F.when(k % 5 == 0, F.array(F.lit("LOW_VOLUME"))).alias("reason_codes"),
        e.alias("position"))


PICK = "max({1}) FILTER (WHERE quality = 'valid' AND source = '{0}')"
FUSED = B.EVENTS + f""",
sg AS (SELECT event_id // 3 AS entity_id, event_id AS position,
  [{B.sql_list(K.FUSION_PRECEDENCE)}][CAST(event_id % 4 + 1 AS INT)] AS source,
  least(1.0::DOUBLE, value / 40.0::DOUBLE) AS score, event_type AS category,
  CASE WHEN k % 10 = 0 THEN 'absent' WHEN k % 10 = 1 THEN 'stale' ELSE 'valid' END AS quality,
  k % 5 = 0 AS low FROM ev),
base AS (SELECT entity_id, count(*) FILTER (WHERE quality = 'valid') AS n,
  max(score) FILTER (WHERE quality = 'valid') AS top,
  min(score) FILTER (WHERE quality = 'valid') AS bottom,
  {', '.join(f"{PICK.format(s, 'score')} AS s{i}, {PICK.format(s, 'category')} AS c{i}"
             for i, s in enumerate(K.FUSION_PRECEDENCE))}
  FROM sg GROUP BY entity_id),
code_rows AS (
  SELECT entity_id, position * 10 AS place, 'LOW_VOLUME' AS code FROM sg WHERE low
  UNION ALL SELECT entity_id, position * 10 + 1, 'SOURCE_' || upper(source) || '_'
    || upper(quality) FROM sg WHERE quality <> 'valid'
  UNION ALL SELECT entity_id, 9000000000000000, 'NO_VALID_SIGNAL' FROM base WHERE n = 0
  UNION ALL SELECT entity_id, 9000000000000001, 'SINGLE_SOURCE' FROM base WHERE n = 1
  UNION ALL SELECT entity_id, 9000000000000002, 'SIGNAL_DISAGREEMENT' FROM base
    WHERE n > 0 AND top - bottom > 0.5),
codes AS (SELECT entity_id, string_agg(code, ',' ORDER BY place) AS uncertainty FROM (
  SELECT entity_id, code, min(place) AS place FROM code_rows GROUP BY 1, 2) GROUP BY entity_id),
risk AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(round_even(100.0::DOUBLE * (
    {' + '.join(f"coalesce({w}::DOUBLE * s{i}, 0.0::DOUBLE)"
                for i, w in enumerate(K.FUSION_WEIGHTS.values()))}) / (
    {' + '.join(f"CASE WHEN s{i} IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE END"
                for i, w in enumerate(K.FUSION_WEIGHTS.values()))}), 0) AS INT) END AS risk_score
  FROM base),
fused AS (SELECT entity_id, CAST(n AS BIGINT) AS valid_count, risk_score,
  CASE WHEN n = 0 THEN 0.0 ELSE round(least(n / 3.0::DOUBLE, 1.0) * CASE WHEN n = 1 THEN 0.5
    ELSE greatest(0.0, 1.0 - (top - bottom)) END, 6) END AS confidence,
  CASE {' '.join(f"WHEN risk_score <= {hi} THEN '{band}'" for band, lo, hi in K.SEVERITY_BANDS)}
    END AS severity,
  coalesce(c0, c1, c2, c3, 'unusual_behavior') AS category,
  coalesce(uncertainty, '') AS uncertainty_codes, n > 0 AS evidence_complete
  FROM risk LEFT JOIN codes USING (entity_id))"""


@query("ml_14_score_fusion", f"WITH {FUSED} SELECT * FROM fused")
def ml_14(spark, sf):
    good = signals(spark, sf).where(fusion_input_ok())
    return FU.fuse(good).drop("duplicate_source").withColumn(
        "uncertainty_codes", F.concat_ws(",", "uncertainty_codes"))


@query("ml_14_duplicate_sources", f"""WITH {B.EVENTS}
SELECT event_id // 8 AS entity_id,
  [{B.sql_list(K.FUSION_PRECEDENCE)}][CAST(event_id % 4 + 1 AS INT)] AS source, count(*) AS n
FROM ev WHERE k % 10 NOT IN (0, 1) GROUP BY 1, 2 HAVING count(*) > 1""")
def ml_14_duplicates(spark, sf):
    rows = signals(spark, sf).withColumn("entity_id", F.floor(F.col("position") / 8).cast("long"))
    return FU.duplicate_sources(rows)


@query("agg_15_assessment_summary", f"""WITH {FUSED}
SELECT count(*) AS rows, count(*) FILTER (WHERE risk_score >= 50) AS flagged,
  round(avg(risk_score), 6) AS mean_risk,
  {', '.join(f"count(*) FILTER (WHERE severity = '{b}') AS {b}" for b, _, _ in K.SEVERITY_BANDS)}
FROM fused""")
def agg_15(spark, sf):
    return FU.assessment_summary(FU.fuse(signals(spark, sf)))
