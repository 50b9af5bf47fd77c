"""Known-weakness assessment, stored findings and their exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bastionlog.functions.columns import dimension
from bastionlog.functions.matching import any_literal, pick_rule, rule_hits
from bastionlog.functions.scoring import risk_level
from bastionlog.rules.vulnerabilities import (
    FACTS,
    RISK_LEVELS,
    RISK_PER_SCORE,
    SERVER_ERROR,
    SERVER_ERROR_RISK,
    SIGNALS,
)

STORED = ["cve_id", "description", "cvss_score", "severity", "mitigation"]


def facts(spark: SparkSession) -> DataFrame:
    """Rule key with its identifier, score and texts; as small as the catalogue."""
    names = ["rule_key", "cve_id", "cvss_tenths", "severity", "description", "mitigation"]
    return dimension(spark, FACTS, names)


def vulnerability_hits(features: DataFrame) -> DataFrame:
    """One row per (line, rule key); a 5xx status counts as a rule of its own."""
    keys = [key for key, _ in SIGNALS]
    hits = rule_hits(F.col("raw_message"), [any_literal(words) for _, words in SIGNALS])
    named = F.transform("found", lambda i: pick_rule(i, keys))
    server = F.when(F.col("status_code") >= 500, F.array(F.lit(SERVER_ERROR))).otherwise(F.array().cast("array<string>"))
    return (
        features.select("stream_id", "line_index", "hostname", "status_code", hits.alias("found"))
        .select("stream_id", "line_index", "hostname", F.explode_outer(F.concat(named, server)).alias("rule_key"))
        .filter(F.col("rule_key").isNotNull())
    )


def title(rule_key: Column) -> Column:
    component = F.concat(F.lit("Vulnerable Component Detected: "), F.replace(rule_key, F.lit("_"), F.lit(" ")))
    return F.when(rule_key == SERVER_ERROR, "Server Error Response (5xx)").otherwise(component)


def assess(features: DataFrame, scope: list[str]) -> DataFrame:
    """Findings per scope: the first host, in line order, that shows each weakness."""
    found = vulnerability_hits(features).groupBy(*scope, "rule_key").agg(
        F.min_by("hostname", "line_index").alias("affected_asset"), F.min("line_index").alias("first_line")
    )
    risk = F.when(F.col("rule_key") == SERVER_ERROR, SERVER_ERROR_RISK).otherwise(F.col("cvss_tenths") * RISK_PER_SCORE)
    return found.join(F.broadcast(facts(features.sparkSession)), "rule_key").select(
        *scope, "rule_key", title(F.col("rule_key")).alias("title"), "severity", "cve_id", "description", "mitigation",
        (F.col("cvss_tenths") / 10).alias("cvss_score"), "affected_asset", "first_line",
        risk.alias("risk_tenths"), (risk / 10).alias("risk_contribution"),
    )


def risk_score(findings: DataFrame, scope: list[str]) -> DataFrame:
    """Capped total risk and its level per scope."""
    total = F.least(F.lit(1000), F.sum("risk_tenths")).cast("int")
    return (
        findings.groupBy(*scope)
        .agg(total.alias("tenths"), F.count("*").alias("findings"))
        .select(
            *scope, "findings", (F.col("tenths") / 10).alias("overall_risk_score"),
            risk_level(F.col("tenths"), RISK_LEVELS).alias("risk_level"),
        )
    )


def stored_summary(vulnerabilities: DataFrame) -> DataFrame:
    """Capped total risk of the stored table."""
    tenths = F.least(F.lit(1000), F.sum(F.round(F.col("cvss_score") * 10).cast("int") * RISK_PER_SCORE)).cast("int")
    return vulnerabilities.agg(tenths.alias("tenths"), F.count("*").alias("findings")).select(
        "findings", (F.coalesce("tenths", F.lit(0)) / 10).alias("overall_risk_score"),
        risk_level(F.coalesce("tenths", F.lit(0)), RISK_LEVELS).alias("risk_level"),
    )


def upsert(existing: DataFrame, findings: DataFrame) -> DataFrame:
    """The stored table after new findings, with ``change`` telling what happened to each row.

    Findings are reduced to one row per identifier before the join, on the map side first.
    """
    rest = STORED[1:]
    fresh = findings.groupBy("cve_id").agg(*[F.first(c).alias(c) for c in rest])
    old, new = existing.alias("old"), fresh.alias("new")
    differs = F.lit(False)
    for c in rest:
        differs = differs | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    change = (
        F.when(F.col("old.cve_id").isNull(), "inserted")
        .when(F.col("new.cve_id").isNull() | ~differs, "unchanged")
        .otherwise("updated")
    )
    return old.join(new, F.col("old.cve_id") == F.col("new.cve_id"), "full_outer").select(
        F.coalesce("new.cve_id", "old.cve_id").alias("cve_id"),
        *[F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in rest],
        change.alias("change"),
    )


def export_rows(vulnerabilities: DataFrame) -> DataFrame:
    """Rows of the CSV export, highest score first; nulls become empty text."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    return vulnerabilities.orderBy(F.desc("cvss_score"), "cve_id").select(
        text("cve_id").alias("CVE ID"), text("description").alias("Description"),
        F.coalesce(F.format_number("cvss_score", 1), F.lit("")).alias("CVSS Score"),
        text("severity").alias("Severity"), text("mitigation").alias("Mitigation"),
    )
