"""The detection plan: address fill, signatures, corroboration, scoring, deduplication, disambiguation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.functions.columns import UNKNOWN, choose, dimension
from bastionlog.functions.matching import first_indicator, pick_rule
from bastionlog.functions.scoring import (
    badge_status,
    classification_type,
    confidence_thousandths,
    jitter,
    model_share,
    threat_domain,
    threat_status,
    visible_technique,
)
from bastionlog.operators.disambiguate import disambiguate
from bastionlog.operators.features import with_event_time
from bastionlog.operators.fold import keep_one, reduce_hits
from bastionlog.operators.ipfill import resolve_source_ip
from bastionlog.operators.signatures import match_lines, name_hits
from bastionlog.rules.narratives import DEFAULT_EXPLANATION, DEFAULT_IMPACT, DEFAULT_MITIGATION, narrative_rows
from bastionlog.rules.signatures import (
    CVE_MENTION_PATTERN,
    DIRECT_EVIDENCE_REQUIRED,
    SEVERITY_BASE,
    SIGNATURES,
    Signature,
)
from bastionlog.session import materialise

SCOPE = ["stream_id"]


def resolved_hits(features: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """One row per (line, signature hit) with the filled address.

    Lines without a hit travel through the fill only if they can lend an address, and then without
    their text. They are written once, so that lines are parsed and matched in one pass: the fill reads
    them twice, by line and by chunk.
    """
    matched = match_lines(with_event_time(features), signatures)
    terms = [F.col(c) if c in features.columns else F.lit(0.0) for c in ("anomaly", "clf")]
    hits = matched.select(
        "stream_id", "line_index", "event_ts", "source_ip", "raw_message", model_share(*terms).alias("model"), F.explode_outer("codes").alias("code")
    )
    is_hit = F.col("code").isNotNull()
    slim = hits.filter(is_hit | (F.col("source_ip") != UNKNOWN)).withColumn(
        "raw_message", F.when(is_hit, F.col("raw_message"))
    )
    filled = resolve_source_ip(materialise(slim, "hits"), SCOPE).filter(is_hit)
    return name_hits(filled.drop("source_ip").withColumnRenamed("resolved_ip", "source_ip"), signatures)


def scored_hits(features: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """One row per (line, threat) with both candidate scores."""
    base = severity_base("severity")
    spread = jitter(F.col("raw_message"), F.col("threat_type"), F.col("line_index"))
    return (
        resolved_hits(features, signatures)
        .withColumns(
            {
                "jitter": spread,
                "time_us": F.unix_micros(F.col("event_ts").cast("timestamp")),
                "eligible": F.col("direct") | ~F.col("threat_type").isin(*DIRECT_EVIDENCE_REQUIRED),
            }
        )
        .withColumns(
            {
                "plain_score": confidence_thousandths(base, F.col("jitter"), F.lit(False), F.lit(True), F.col("model")),
                "direct_score": confidence_thousandths(base, F.col("jitter"), F.lit(True), F.lit(True), F.col("model")),
            }
        )
    )


def severity_base(severity: str) -> Column:
    return choose(severity, [(n, str(v)) for n, v in SEVERITY_BASE.items()], str(SEVERITY_BASE["medium"]))


def occurrences(features: DataFrame) -> DataFrame:
    """Hit count and evidence mark per (scope, address, threat): a plain, map-side combined count."""
    return (
        resolved_hits(features)
        .groupBy("stream_id", "source_ip", "threat_type")
        .agg(F.count("*").alias("occurrences"), F.bool_or("direct").alias("any_direct"))
    )


def kept_hits(features: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """The hit each (scope, address, threat) keeps, with its confidence in thousandths."""
    hits = scored_hits(features, signatures).select(
        "stream_id", "source_ip", "rule_no", "line_index", "time_us", "jitter", "direct", "eligible",
        "plain_score", "direct_score", "raw_message", "model",
    )
    kept = keep_one(reduce_hits(hits)).filter("segment_count > 0")
    rule = F.col("rule_no")
    return (
        kept.withColumns(
            {
                "threat_type": pick_rule(rule, [s.name for s in signatures]),
                "severity": pick_rule(rule, [s.severity for s in signatures]),
                "category": pick_rule(rule, [s.category for s in signatures]),
                "mitre": pick_rule(rule, [s.mitre for s in signatures]),
            }
        )
        .withColumn(
            "thousandths",
            confidence_thousandths(
                severity_base("severity"), F.col("jitter"), F.col("any_direct"), F.col("hits") >= 2, F.col("model")
            ),
        )
    )


def evidence() -> Column:
    """Evidence sentences: first indicator word, corroboration note, else the pattern note."""
    indicator = first_indicator("raw_message", "threat_type")
    direct = F.when(
        F.col("any_direct"),
        F.coalesce(
            F.concat(F.lit("Direct indicator: '"), indicator, F.lit("'")),
            F.concat(F.lit("Direct signature match for '"), F.col("threat_type"), F.lit("'")),
        ),
    )
    corroborated = F.when(
        F.col("hits") >= 2,
        F.concat(F.col("hits").cast("string"), F.lit(" corroborating log entries from same source")),
    )
    pattern = F.when(
        ~F.col("any_direct") & (F.col("hits") < 2), F.concat(F.lit("Pattern match for '"), F.col("threat_type"), F.lit("'"))
    )
    return F.array_compact(F.array(direct, corroborated, pattern))


def describe(kept: DataFrame) -> DataFrame:
    """Full detection rows: status, domain, evidence and narrative."""
    spark = kept.sparkSession
    notes = dimension(spark, narrative_rows(), ["threat_type", "explanation", "impact", "mitigation"])
    domain = threat_domain(F.col("threat_type"))
    joined = kept.withColumn("domain", domain).join(F.broadcast(notes), "threat_type", "left")
    technique = visible_technique(F.col("domain"), F.col("mitre"))
    return joined.select(
        "stream_id",
        "line_index",
        "source_ip",
        "threat_type",
        "domain",
        classification_type(F.col("domain")).alias("classification_type"),
        threat_status(F.col("thousandths")).alias("threat_status"),
        "severity",
        (F.col("thousandths") / 1000).alias("confidence"),
        F.col("threat_type").alias("label"),
        badge_status(F.col("thousandths"), F.col("severity"), F.col("domain")).alias("status"),
        "category",
        technique.alias("mitre_attack"),
        F.array(technique).alias("mitre_tactics"),
        evidence().alias("evidence"),
        F.coalesce("explanation", F.format_string(DEFAULT_EXPLANATION.replace("{}", "%s"), "threat_type"))
        .alias("explanation"),
        F.coalesce("impact", F.lit(DEFAULT_IMPACT)).alias("impact"),
        F.coalesce("mitigation", F.lit(DEFAULT_MITIGATION)).alias("mitigation"),
        F.timestamp_micros("time_us").cast("timestamp_ntz").alias("event_ts"),
        F.coalesce(
            F.nullif(F.upper(F.regexp_extract("raw_message", "(?i)" + CVE_MENTION_PATTERN, 1)), F.lit("")),
            F.lit("N/A"),
        ).alias("cve_id"),
        F.col("hits").alias("corroborating_count"),
        "raw_message",
    )


def detect(features: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Detections of a feature table, one per (scope, address, threat).

    Where ``features`` has the columns ``anomaly`` and ``clf`` (models' scores of a line, 0 to 1), they take
    part in the confidence.
    """
    return describe(disambiguate(kept_hits(features, signatures), SCOPE))
