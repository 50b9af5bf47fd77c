"""Micro-batch ingestion: lines to alerts and weaknesses, idempotent per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from bastionlog.operators.alerts import alert_rows, minute_counts
from bastionlog.operators.features import extract_features
from bastionlog.operators.vulnerabilities import assess
from bastionlog.plans.detect import detect
from bastionlog.sources.sinks import log_entries, replace_batch, upsert_vulnerabilities

POLL = "10 seconds"
HEALTH_POLL = "15 seconds"


def ingest_batch(root: str, source: str = "stream") -> Callable[[DataFrame, int], None]:
    """Handler that stores entries and alerts of a batch and merges its weaknesses.

    Each batch is one call of the detector: nothing correlates across batches. Features are stored
    once and read back by the three consumers; the threats per minute of a batch are kept beside its alerts.
    """

    def handle(lines: DataFrame, batch_id: int) -> None:
        replace_batch(extract_features(lines), f"{root}/features", batch_id)
        features = lines.sparkSession.read.parquet(f"{root}/features/batch={batch_id}").drop("day")
        replace_batch(log_entries(features, source), f"{root}/log_entries", batch_id)
        alerts = alert_rows(detect(features))
        replace_batch(alerts, f"{root}/alerts", batch_id)
        written = lines.sparkSession.read.schema(alerts.schema).parquet(f"{root}/alerts/batch={batch_id}")
        replace_batch(minute_counts(written), f"{root}/minutes", batch_id)
        upsert_vulnerabilities(assess(features, ["stream_id"]), f"{root}/vulnerabilities")

    return handle


def start_ingest(lines: DataFrame, root: str, available_now: bool = False) -> StreamingQuery:
    """Run the ingestion on a stream of lines."""
    writer = lines.writeStream.foreachBatch(ingest_batch(root)).option("checkpointLocation", f"{root}/_ingest")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=POLL)
    return writer.start()


def start_health(snapshots: DataFrame, root: str, available_now: bool = False) -> StreamingQuery:
    """Store health snapshots."""
    writer = snapshots.writeStream.foreachBatch(
        lambda rows, batch_id: replace_batch(rows, f"{root}/system_health", batch_id)
    ).option("checkpointLocation", f"{root}/_health")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=HEALTH_POLL)
    return writer.start()
