"""Scan summary of a feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLEAN_SUMMARY = "Nothing in these lines points to an attack."


def is_threat() -> Column:
    """Threats and policy violations; everything else is a condition."""
    status, domain, kind = F.col("threat_status"), F.col("domain"), F.col("classification_type")
    confirmed = status.isin("SUSPICIOUS", "CONFIRMED") & (domain == "SECURITY_THREATS")
    typed = kind.isin("Threat", "Classification") & domain.isin("SECURITY_THREATS", "COMPLIANCE")
    return confirmed | typed


def split_findings(detections: DataFrame, conditions: DataFrame) -> DataFrame:
    """Detections and conditions with ``is_threat``, first of each (type, address, severity, status)."""
    names = ["stream_id", "threat_type", "source_ip", "severity", "threat_status", "domain", "classification_type",
             "line_index", "confidence", "mitre_attack"]
    keys = ["stream_id", "threat_type", "source_ip", "severity", "threat_status"]
    rows = detections.select(*names).unionByName(conditions.select(*names)).withColumn("is_threat", is_threat())
    rest = ["line_index", "domain", "classification_type", "confidence", "mitre_attack", "is_threat"]
    first = F.min_by(F.struct(*rest), "line_index")
    return rows.groupBy(*keys).agg(first.alias("first")).select(*keys, "first.*")


def threat_summary(findings: DataFrame) -> DataFrame:
    """Per scope: counts, mean probability, distinct threats by first sight, the most certain finding.

    Threats are reduced to one row per (scope, type) before their names are listed, so a list never
    exceeds the rule catalogue.
    """
    threat = F.col("is_threat")
    per_type = findings.groupBy("stream_id", "threat_type", "is_threat").agg(
        F.count("*").alias("n"),
        F.sum(F.round(F.col("confidence") * 1000).cast("bigint")).alias("thousandths"),
        F.min("line_index").alias("first_line"),
        F.max(F.struct(F.col("confidence"), (-F.col("line_index")).alias("order"), F.col("severity"))).alias("top"),
    )
    listed = F.array_sort(F.collect_list(F.when(threat, F.struct("first_line", "threat_type"))))
    total = F.sum(F.when(threat, F.col("n")).otherwise(0))
    mean = F.sum(F.when(threat, F.col("thousandths"))) / F.nullif(total, F.lit(0))
    names = F.transform("listed", lambda s: s["threat_type"])
    grouped = per_type.groupBy("stream_id").agg(
        total.alias("security_threat_count"),
        F.sum(F.when(threat, 0).otherwise(F.col("n"))).alias("condition_count"),
        F.coalesce(F.bround(mean / 10), F.lit(0)).cast("int").alias("probability"),
        listed.alias("listed"),
        F.max(F.when(threat, F.struct("top.confidence", "top.order", "threat_type", "top.severity"))).alias("top"),
    )
    sentence = (
        F.when(F.size("threats") == 0, CLEAN_SUMMARY)
        .when(F.size("threats") == 1,
              F.concat(F.lit("Security threat '"), F.array_join("threats", ""), F.lit("' detected in logs.")))
        .otherwise(F.concat(F.lit("Multiple security threats detected: "), F.array_join("threats", ", "), F.lit(".")))
    )
    return grouped.withColumn("threats", names).select(
        "stream_id", "security_threat_count", "condition_count", "probability",
        F.when(F.size("threats") == 0, "clean").otherwise("threat").alias("status"),
        sentence.alias("reason"),
        F.col("top.threat_type").alias("top_threat"),
        F.coalesce("top.confidence", F.lit(0.0)).alias("top_confidence"),
        F.coalesce("top.severity", F.lit("LOW")).alias("top_severity"),
    )
