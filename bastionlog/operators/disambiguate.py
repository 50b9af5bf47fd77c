"""Resolve competing classifications of one address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bastionlog.functions.columns import or_all
from bastionlog.rules.signatures import AUTH_PRIORITY, SUPPRESSION_PAIRS


def most_specific_auth(detections: DataFrame, scope: list[str]) -> DataFrame:
    """Mark ``kept_auth``: of the sign-in attacks of an address only the most specific stays."""
    rank = F
    for place, name in enumerate(AUTH_PRIORITY):
        rank = rank.when(F.col("threat_type") == name, place)
    rank = rank.otherwise(F.lit(None).cast("int"))
    by_address = W.partitionBy(*scope, "source_ip")
    return detections.withColumn("kept_auth", F.coalesce(rank == F.min(rank).over(by_address), F.lit(True)))


def suppress_losers(marked: DataFrame, scope: list[str]) -> DataFrame:
    """Mark ``suppressed``: a loser goes when its winner survived the sign-in step.

    A winner that is itself suppressed still suppresses. An address has at most one row per threat,
    so the window holds no more rows than there are rules.
    """
    by_address = W.partitionBy(*scope, "source_ip")
    present = F.collect_set(F.when(F.col("kept_auth"), F.col("threat_type"))).over(by_address)
    loses = or_all(
        (F.col("threat_type") == loser) & F.array_contains(F.col("present"), winner)
        for winner, loser in SUPPRESSION_PAIRS
    )
    return marked.withColumn("present", present).withColumn("suppressed", F.col("kept_auth") & loses).drop("present")


def disambiguate(detections: DataFrame, scope: list[str]) -> DataFrame:
    """Detections that survive both steps. Both windows share one partitioning by address."""
    marked = suppress_losers(most_specific_auth(detections, scope), scope)
    return marked.filter(F.col("kept_auth") & ~F.col("suppressed")).drop("kept_auth", "suppressed")
