"""Confidence arithmetic in whole millionths, so that rounding never depends on binary fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bastionlog.rules.signatures import COMPLIANCE_THREATS, NOT_APPLICABLE

# ---- fixed values: weights in percent, limits in ten-thousandths ---------------------------------
BASE_WEIGHT_PERCENT, MODEL_WEIGHT_PERCENT = 70, 15
WEAK_BASE_PERCENT, WEAK_MODEL_PERCENT = 50, 25
WEAK_FLOOR, WEAK_CAP = 3000, 5500
JITTER_CENTRE = 500
DIRECT_BONUS = 1500
FLOOR_CONFIRMED = 7000
FLOOR_CORROBORATED = 6500
CAP = 9900


def jitter(message: Column, threat: Column, line_index: Column) -> Column:
    """Deterministic spread 0..999 from the first eight hex digits of an MD5."""
    digest = F.md5(F.concat_ws(":", message, threat, line_index.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000).cast("int")


def model_share(anomaly: Column, classified: Column) -> Column:
    """Both models' scores of a line (0 to 1, null counts as 0) as one whole number of ten-thousandths."""
    whole = [F.floor(F.coalesce(c.cast("double"), F.lit(0.0)) * 10_000 + 0.5).cast("int") for c in (anomaly, classified)]
    return whole[0] + whole[1]


def confidence_thousandths(base: Column, spread: Column, direct: Column, corroborated: Column, model: Column | None = None) -> Column:
    """Confidence of a confirmed detection in thousandths (ties round up).

    ``base`` is the severity base, ``direct`` whether the group holds direct evidence, ``corroborated``
    whether it holds two or more lines and ``model`` the line's ``model_share``.
    """
    raw = (
        base * BASE_WEIGHT_PERCENT
        + (F.lit(0) if model is None else model) * MODEL_WEIGHT_PERCENT
        + (spread - JITTER_CENTRE + F.when(direct, DIRECT_BONUS).otherwise(0)) * 100
    )
    floor = F.when(corroborated & ~direct, FLOOR_CORROBORATED).otherwise(FLOOR_CONFIRMED) * 100
    return F.floor((F.least(F.lit(CAP * 100), F.greatest(raw, floor)) + 500) / 1000).cast("int")


def weak_thousandths(base: Column, spread: Column, model: Column) -> Column:
    """Confidence of a hit that lacks the direct evidence its threat needs, in thousandths."""
    raw = base * WEAK_BASE_PERCENT + model * WEAK_MODEL_PERCENT + (spread - JITTER_CENTRE) * 100
    return F.floor((F.least(F.lit(WEAK_CAP * 100), F.greatest(F.lit(WEAK_FLOOR * 100), raw)) + 500) / 1000).cast("int")


def threat_status(thousandths: Column) -> Column:
    """NONE below .40, MONITOR below .70, SUSPICIOUS below .85, CONFIRMED from there."""
    return (
        F.when(thousandths < 400, "NONE")
        .when(thousandths < 700, "MONITOR")
        .when(thousandths < 850, "SUSPICIOUS")
        .otherwise("CONFIRMED")
    )


def badge_status(thousandths: Column, severity: Column, domain: Column) -> Column:
    """Badge shown to analysts."""
    severe = severity.isin("high", "critical")
    condition = domain.isin("NETWORK_PERFORMANCE", "SERVICE_HEALTH")
    return (
        F.when(thousandths < 700, "MONITOR_ONLY")
        .when(condition & severe, "CRITICAL")
        .when(condition, "DEGRADED")
        .when((thousandths >= 850) & severe, "CRITICAL")
        .otherwise("SUSPICIOUS")
    )


def threat_domain(threat: Column) -> Column:
    return F.when(threat.isin(*COMPLIANCE_THREATS), "COMPLIANCE").otherwise("SECURITY_THREATS")


def classification_type(domain: Column) -> Column:
    return (
        F.when(domain == "COMPLIANCE", "Classification")
        .when(domain.isin("NETWORK_PERFORMANCE", "SERVICE_HEALTH"), "Condition")
        .otherwise("Threat")
    )


def visible_technique(domain: Column, mitre: Column) -> Column:
    """Technique ids are shown for security threats only."""
    return F.when(domain == "SECURITY_THREATS", mitre).otherwise(NOT_APPLICABLE)


def risk_level(score_tenths: Column, levels: list[tuple[int, str]]) -> Column:
    """Level name of a risk score given in tenths."""
    chain = F
    for limit, name in levels:
        chain = chain.when(score_tenths > limit * 10, name)
    return chain.otherwise("Low")
