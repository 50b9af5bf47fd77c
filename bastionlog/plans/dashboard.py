"""Dashboard figures from the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.operators.alerts import is_security_threat, latest, newest_per_source

LATEST_ALERTS, SHOWN_THREATS, SHOWN_CONDITIONS = 50, 15, 10


def recent_distinct(alerts: DataFrame) -> DataFrame:
    """The latest alerts, newest of each (type, address, severity), marked as threat or condition."""
    return newest_per_source(latest(alerts, LATEST_ALERTS)).withColumn("is_threat", is_security_threat())


def live_threats(alerts: DataFrame) -> DataFrame:
    return recent_distinct(alerts).filter("is_threat").orderBy(F.desc("ts"), F.desc("id")).limit(SHOWN_THREATS)


def live_conditions(alerts: DataFrame) -> DataFrame:
    return recent_distinct(alerts).filter("NOT is_threat").orderBy(F.desc("ts"), F.desc("id")).limit(SHOWN_CONDITIONS)


def key_figures(alerts: DataFrame, health: DataFrame) -> DataFrame:
    """One row: latest health, threat and condition counts, mean probability, status pills.

    Both inputs are reduced to tagged partial rows and met in one global aggregate, so there is no
    join of single rows.
    """
    threat = F.col("is_threat")
    severe = F.col("severity").isin("high", "critical")

    def no(kind: str) -> Column:
        return F.lit(None).cast(kind)

    seen = recent_distinct(alerts).select(
        threat.alias("threat"),
        F.col("confidence"),
        (threat & (F.col("threat_status") == "CONFIRMED")).alias("confirmed"),
        (~threat).alias("network"),
        (threat & severe).alias("service"),
        no("struct<ts:timestamp_ntz,id:bigint,cpu_usage:double,memory_usage:double,active_connections:int>").alias("health"),
    )
    newest = F.max(F.struct("ts", "id", "cpu_usage", "memory_usage", "active_connections"))
    snapshot = health.agg(newest.alias("health")).select(
        no("boolean").alias("threat"), no("double").alias("confidence"), no("boolean").alias("confirmed"),
        no("boolean").alias("network"), no("boolean").alias("service"), "health",
    )
    return seen.unionByName(snapshot).agg(
        F.max("health").alias("health"),
        F.count_if("threat").alias("security_threat_count"),
        F.count_if(~F.col("threat")).alias("condition_count"),
        F.coalesce(
            F.round(F.sum(F.when(F.col("threat"), F.round(F.col("confidence") * 1000).cast("bigint")))
                    / F.nullif(F.count_if("threat"), F.lit(0)) / 10, 1),
            F.lit(0.0),
        ).alias("aggregate_threat_probability"),
        F.when(F.coalesce(F.bool_or("confirmed"), F.lit(False)), "CONFIRMED")
        .when(F.coalesce(F.bool_or("threat"), F.lit(False)), "SUSPICIOUS").otherwise("NORMAL").alias("security_status"),
        F.when(F.coalesce(F.bool_or("network"), F.lit(False)), "DEGRADED").otherwise("NORMAL").alias("network_status"),
        F.when(F.coalesce(F.bool_or("service"), F.lit(False)), "IMPACTED").otherwise("OPERATIONAL").alias("service_status"),
    ).select(
        F.coalesce("health.cpu_usage", F.lit(0.0)).alias("cpu_usage"),
        F.coalesce("health.memory_usage", F.lit(0.0)).alias("memory_usage"),
        F.coalesce("health.active_connections", F.lit(0)).alias("active_connections"),
        "security_threat_count", "condition_count", "aggregate_threat_probability",
        "security_status", "network_status", "service_status",
    )
