"""Signature matching and line-level predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.functions.columns import imatch
from bastionlog.functions.matching import is_direct, pick_rule, rule_hits, rule_of, signature_codes
from bastionlog.rules.narratives import NETWORK_CONDITION_NOTE, SERVICE_CONDITION_NOTE
from bastionlog.rules.signatures import (
    ACTIVE_EXPLOIT_PATTERN,
    EXPLOIT_THREAT,
    MALICIOUS_CONTEXT_PATTERN,
    NETWORK_CONDITION_PATTERN,
    NETWORK_LABELS,
    NOT_APPLICABLE,
    OPERATIONAL_PATTERN,
    PASSIVE_VULNERABILITY_PATTERN,
    SERVICE_LABELS,
    SIGNATURES,
    Signature,
)

CONDITION_THOUSANDTHS = 600


def match_lines(lines: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Add ``codes``, the array of signatures each line hits. One projection, no shuffle."""
    return lines.withColumn("codes", signature_codes(F.col("raw_message"), signatures))


def name_hits(coded: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Replace ``code`` by the attributes of its rule."""
    rule = rule_of(F.col("code"))
    return coded.select(
        *[c for c in coded.columns if c != "code"],
        rule.alias("rule_no"),
        pick_rule(rule, [s.name for s in signatures]).alias("threat_type"),
        pick_rule(rule, [s.severity for s in signatures]).alias("severity"),
        is_direct(F.col("code")).alias("direct"),
    )


def explode_hits(matched: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """One row per (line, signature hit) with the rule's attributes.

    The outer explode keeps the optimiser from repeating the patterns in a filter below it; lines
    without a hit are dropped by the generated column instead.
    """
    rest = [c for c in matched.columns if c != "codes"]
    hits = matched.select(*rest, F.explode_outer("codes").alias("code")).filter(F.col("code").isNotNull())
    return name_hits(hits, signatures)


def line_flags(matched: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Operational-only, malicious-context and passive-vulnerability marks per line."""
    patterns = [OPERATIONAL_PATTERN, MALICIOUS_CONTEXT_PATTERN, PASSIVE_VULNERABILITY_PATTERN, ACTIVE_EXPLOIT_PATTERN]
    operational, malicious, passive, active = (F.array_contains("marks", i) for i in range(len(patterns)))
    exploit = next((i for i, s in enumerate(signatures) if s.name == EXPLOIT_THREAT), -1)
    other_hits = F.exists("codes", lambda c: rule_of(c) != exploit)
    marked = matched.withColumn("marks", rule_hits(F.col("raw_message"), patterns))
    return marked.select(
        *matched.columns,
        (operational & (F.size("codes") == 0)).alias("operational_only"),
        malicious.alias("malicious_context"),
        (passive & ~active & ~other_hits).alias("passive_vulnerability_only"),
    )


def network_label(text: Column) -> Column:
    """Label of a network condition."""
    high_latency, packet_loss, dns_delay, bandwidth = NETWORK_LABELS
    return (
        F.when(imatch(text, r"packet\s*loss|dropped_packets"), packet_loss)
        .when(imatch(text, "dns|nxdomain"), dns_delay)
        .when(imatch(text, "bandwidth|throughput"), bandwidth)
        .otherwise(high_latency)
    )


def service_label(text: Column) -> Column:
    """Label of a service condition, by keyword; the type's own name when no keyword fits."""
    outage, infrastructure, routing = SERVICE_LABELS
    return (
        F.when(imatch(text, r"rout(e|ing)"), routing)
        .when(imatch(text, "outage|unavailable|unstable"), outage)
        .when(imatch(text, "fail|degradation"), infrastructure)
        .otherwise("Service Health Degraded")
    )


def conditions(flagged: DataFrame) -> DataFrame:
    """One condition row per operational-only line."""
    text = F.col("raw_message")
    network = imatch(text, NETWORK_CONDITION_PATTERN)
    note = [F.when(network, a).otherwise(b) for a, b in zip(NETWORK_CONDITION_NOTE, SERVICE_CONDITION_NOTE)]
    return flagged.filter("operational_only").select(
        "stream_id",
        "line_index",
        "ts",
        "source_ip",
        F.when(network, NETWORK_LABELS[0]).otherwise("Service Health Degraded").alias("threat_type"),
        F.when(network, "NETWORK_PERFORMANCE").otherwise("SERVICE_HEALTH").alias("domain"),
        F.lit("Condition").alias("classification_type"),
        F.lit("NONE").alias("threat_status"),
        F.lit("low").alias("severity"),
        F.lit(CONDITION_THOUSANDTHS / 1000).alias("confidence"),
        F.when(network, network_label(text)).otherwise(service_label(text)).alias("label"),
        F.lit("MONITOR_ONLY").alias("status"),
        F.lit(NOT_APPLICABLE).alias("mitre_attack"),
        note[0].alias("explanation"),
        note[1].alias("impact"),
        note[2].alias("mitigation"),
        "raw_message",
    )
