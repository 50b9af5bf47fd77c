"""Second, stricter pass over detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.functions.columns import choose, contains_any, literal
from bastionlog.rules.signatures import (
    NOT_APPLICABLE,
    SIGNATURES,
    Signature,
    STRICT_AUTH_WORDS,
    STRICT_BLOCK_WORDS,
    STRICT_EVIDENCE_TYPES,
    STRICT_EXPLICIT_WORDS,
    STRICT_MALICIOUS_WORDS,
    STRICT_PERFORMANCE_WORDS,
)


def is_operational(lowered: Column, domain: Column) -> Column:
    """Condition domains, or performance words without any malicious word."""
    by_words = contains_any(lowered, STRICT_PERFORMANCE_WORDS) & ~contains_any(lowered, STRICT_MALICIOUS_WORDS)
    return domain.isin("NETWORK_PERFORMANCE", "SERVICE_HEALTH") | by_words


def with_peers(found: DataFrame) -> DataFrame:
    """Add ``peers``: other rows of the same type and address in the scope, counted then joined.

    Detections hold one row per key, so they have none; sessions can have many.
    """
    key = ["stream_id", "source_ip", "threat_type"]
    counts = found.groupBy(*key).agg((F.count("*") - 1).alias("peers"))
    return found.join(counts, key)


def assess(detections: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Every detection with its strict confidence, status and severity, and ``operational``.

    A ``peers`` column (see ``with_peers``) counts as support where there is one.
    """
    peers = F.col("peers") if "peers" in detections.columns else F.lit(0)
    lowered = F.lower("raw_message")
    severe = F.col("severity").isin("high", "critical")
    strict_type = F.col("threat_type").isin(*STRICT_EVIDENCE_TYPES)
    support = (
        (peers >= 1).cast("int")
        + contains_any(lowered, STRICT_BLOCK_WORDS).cast("int")
        + contains_any(lowered, STRICT_AUTH_WORDS).cast("int")
        + severe.cast("int")
    )
    weakened = F.when(
        strict_type & ~contains_any(lowered, STRICT_EXPLICIT_WORDS), F.col("confidence") * F.lit(0.7)
    ).otherwise(F.col("confidence"))
    boosted = F.when(support >= 2, F.least(F.lit(1.0), weakened * F.lit(1.2))).otherwise(weakened)
    score = F.col("strict_confidence")
    status = (
        F.when(score < 0.70, F.when((score >= 0.40) | strict_type, "Monitor").otherwise("Informational"))
        .when(score < 0.85, "Suspicious")
        .otherwise("Confirmed")
    )
    name = F.col("strict_status")
    technique = choose("threat_type", [(s.name, literal(s.mitre)) for s in signatures], literal(NOT_APPLICABLE))
    return (
        detections.withColumn("operational", is_operational(lowered, F.col("domain")))
        .withColumn("strict_confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), boosted)))
        .withColumn("strict_status", status)
        .withColumn(
            "strict_severity",
            F.when(name == "Informational", "Low").when(name == "Monitor", "Medium")
            .when(name == "Suspicious", "High").otherwise("Critical"),
        )
        .withColumn("percent", F.floor(score * 100).cast("int"))
        .withColumn("technique", technique)
    )


def findings(assessed: DataFrame) -> DataFrame:
    """Reported findings: the first of each (type, address, status) of a scope."""
    keys = ["stream_id", "threat_type", "source_ip", "strict_status"]
    rest = ["line_index", "event_ts", "domain", "strict_severity", "percent", "technique", "evidence", "explanation",
            "impact", "mitigation"]
    reported = assessed.filter(~F.col("operational") & (F.col("strict_status") != "Informational"))
    first = reported.groupBy(*keys).agg(F.min_by(F.struct(*rest), "line_index").alias("first"))
    return first.select(*keys, "first.*")


def summary(assessed: DataFrame) -> DataFrame:
    """Counts per status, conditions and mean confirmed score, per scope, in one pass."""
    keys = ["stream_id", "threat_type", "source_ip", "strict_status", "operational"]
    status, operational = F.col("strict_status"), F.col("operational")
    distinct = (
        assessed.filter(operational | (status != "Informational"))
        .groupBy(*keys)
        .agg(F.min_by("percent", "line_index").alias("percent"), F.count("*").alias("n"))
    )

    def reported(name: str) -> Column:
        return F.count_if(~operational & (status == name))

    confirmed = ~operational & (status == "Confirmed")
    return distinct.groupBy("stream_id").agg(
        F.count_if(~operational).alias("total_findings"),
        reported("Confirmed").alias("confirmed_threats"),
        reported("Suspicious").alias("suspicious_threats"),
        reported("Monitor").alias("monitor_items"),
        F.sum(F.when(operational, F.col("n")).otherwise(0)).alias("operational_conditions"),
        F.coalesce(F.floor(F.avg(F.when(confirmed, F.col("percent")))), F.lit(0)).cast("int").alias("threat_score"),
    )
