"""Time correlation of hits: gap sessions and escalations, both safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bastionlog.rules.signatures import DEDUP_WINDOW_SECONDS

KEY = ["stream_id", "source_ip", "threat_type"]
# ---- fixed values: three hits in five minutes escalate -----------------------------------------------
ESCALATION_SECONDS = 300
ESCALATION_HITS = 3
BUCKET_SECONDS = 600


def gap_sessions(hits: DataFrame, gap_seconds: int = DEDUP_WINDOW_SECONDS, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Runs of hits of a key without a longer gap: bounds, hit count, evidence and strongest line.

    Hits are counted per (key, instant), then runs are formed per (key, time bucket); only one row per
    run and bucket takes part in the step that joins runs across buckets, so a key's rows never meet in
    one task.
    """
    gap = gap_seconds * 1_000_000
    strongest = F.struct(F.col("jitter"), (-F.col("line_index")).alias("order"))
    instants = hits.groupBy(*KEY, "severity", "time_us").agg(
        F.count("*").alias("n"), F.bool_or("direct").alias("direct"), F.max(strongest).alias("best")
    )
    bucketed = instants.withColumn("bucket", F.floor(F.col("time_us") / (bucket_seconds * 1_000_000)))
    inside = W.partitionBy(*KEY, "bucket").orderBy("time_us")
    starts = (F.col("time_us") - F.lag("time_us").over(inside) > gap).cast("int")
    runs = (
        bucketed.withColumn("starts", F.coalesce(starts, F.lit(0)))
        .withColumn("run", F.sum("starts").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*KEY, "bucket", "run")
        .agg(
            F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"), F.sum("n").alias("hits"),
            F.bool_or("direct").alias("any_direct"), F.max("best").alias("strongest"),
            F.first("severity").alias("severity"),
        )
    )
    across = W.partitionBy(*KEY).orderBy("first_us")
    joins = (F.col("first_us") - F.lag("last_us").over(across) > gap).cast("int")
    return (
        runs.withColumn("starts", F.coalesce(joins, F.lit(0)))
        .withColumn("session", F.sum("starts").over(across.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*KEY, "session")
        .agg(
            F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("hits").alias("hits"),
            F.bool_or("any_direct").alias("any_direct"), F.max("strongest").alias("strongest"),
            F.first("severity").alias("severity"),
        )
        .select(
            *KEY, "severity", "hits", "any_direct", "first_us", "last_us",
            F.col("strongest.jitter").alias("jitter"), (-F.col("strongest.order")).alias("line_index"),
        )
    )


def escalations(hits: DataFrame, seconds: int = ESCALATION_SECONDS, least: int = ESCALATION_HITS) -> DataFrame:
    """Instants at which a key reached ``least`` hits within the trailing window.

    Hits are counted per (key, instant) first. Each instant is then sent to its own time bucket and,
    as history only, to the next one, so the range window never spans more than two buckets.
    """
    width = seconds * 1_000_000
    instants = hits.groupBy(*KEY, "time_us").agg(F.count("*").alias("n"))
    own = F.floor(F.col("time_us") / width)
    placed = instants.select(
        *KEY, "time_us", "n", own.alias("own"), F.explode(F.array(own, own + 1)).alias("bucket")
    )
    trailing = W.partitionBy(*KEY, "bucket").orderBy("time_us").rangeBetween(-width, 0)
    return (
        placed.withColumn("recent", F.sum("n").over(trailing))
        .filter((F.col("own") == F.col("bucket")) & (F.col("recent") >= least))
        .select(*KEY, "time_us", "recent", F.lit("CONFIRMED").alias("threat_status"))
    )
