"""Typed feature rows from parsed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bastionlog.functions.columns import UNKNOWN, first_filled, imatch, or_all
from bastionlog.operators.parse import (
    event_time, field, normalised, number, parse_lines, timestamp_text, truthy,
)
from bastionlog.rules.signatures import OPERATIONAL_PATTERN

SOURCE_FIELDS = ["remote_addr", "src_ip", "source_ip", "client_ip", "device_ip", "caller"]
#: A word of each alternative of the pattern: a line without any of them need not be searched by it.
OPERATIONAL_WORDS = list(dict.fromkeys(max(a.split(r"\s+"), key=len) for a in OPERATIONAL_PATTERN.strip("()").split("|")))
METRIC_FIELDS = ["cpu", "memory", "disk", "network_tx", "network_rx", "network"]
VECTOR_FIELDS = ["message_length", "status_code", "bytes_sent", "cpu", "memory", "network_tx", "network_rx"]


def source_ip() -> Column:
    return first_filled(*[truthy(f) for f in SOURCE_FIELDS], default=UNKNOWN)


def _as_integer(name: str) -> Column:
    """Whole part of a JSON number, 1 for true; a text only if it is a whole number."""
    return F.coalesce(number(name).try_cast("int"), F.nullif(field(name), F.lit("")).try_cast("int"))


def _integer(name: str) -> Column:
    return F.coalesce(_as_integer(name), F.lit(0))


def _double(name: str) -> Column:
    return F.coalesce(number(name), field(name).try_cast("double"), F.lit(0.0))


def _metric(name: str) -> Column:
    return F.when(field(name).isNotNull(), _double(name))


def operational(text: Column) -> Column:
    """Whether the operational pattern is found, case aside."""
    lowered = F.lower(text)
    return or_all(lowered.contains(w) for w in OPERATIONAL_WORDS) & imatch(text, OPERATIONAL_PATTERN)


def extract_features(lines: DataFrame) -> DataFrame:
    """Feature rows; keeps ``line_index``, ``stream_id`` and the ingest time ``ts``.

    A user name is taken only when the line carries a customer number.
    """
    customer = field("customer_id")
    raw = normalised("raw_message", F.col("line"))
    return parse_lines(lines).select(
        "line_index",
        "stream_id",
        "ts",
        timestamp_text().alias("timestamp"),
        source_ip().alias("source_ip"),
        first_filled(truthy("dst_ip"), truthy("destination_ip"), default=UNKNOWN).alias("destination_ip"),
        F.when(customer.isNotNull(), first_filled(truthy("user"), truthy("username"), customer, default=""))
        .otherwise(UNKNOWN).alias("username"),
        first_filled(truthy("host"), truthy("hostname"), default=UNKNOWN).alias("hostname"),
        first_filled(truthy("pid"), truthy("process"), default=UNKNOWN).alias("process_id"),
        F.coalesce(field("service"), F.lit(UNKNOWN)).alias("service"),
        F.coalesce(field("protocol"), F.lit(UNKNOWN)).alias("protocol"),
        F.coalesce(F.when(field("dst_port").isNotNull(), _as_integer("dst_port")).otherwise(_as_integer("port")), F.lit(0)).alias("dst_port"),
        _double("usage_mbps").alias("usage_mbps"),
        _integer("dropped_packets").alias("dropped_packets"),
        _double("rtt_ms").alias("rtt_ms"),
        first_filled(field("http_method"), default=UNKNOWN).alias("http_method"),
        first_filled(field("request_uri"), field("url"), default="").alias("url"),
        _integer("status").alias("status_code"),
        _integer("body_bytes_sent").alias("bytes_sent"),
        first_filled(field("http_user_agent"), default="").alias("user_agent"),
        F.length(raw).alias("message_length"),
        F.lower(first_filled(field("level"), field("severity"), default="info")).alias("severity"),
        normalised("format", F.col("line_format")).alias("format"),
        first_filled(field("message"), raw, default="").alias("message"),
        *[_metric(m).alias(m) for m in METRIC_FIELDS],
        operational(raw).alias("has_operational"),
        raw.alias("raw_message"),
    )


def with_event_time(features: DataFrame) -> DataFrame:
    """Add ``event_ts``, the line's own time or, failing that, its ingest time."""
    return features.withColumn("event_ts", event_time(F.col("timestamp"), F.col("ts")))


def per_source(features: DataFrame, scope: list) -> DataFrame:
    """Rows reduced per (scope, address, user)."""
    lowered = F.lower("raw_message")
    failed = lowered.contains("failed") & (lowered.contains("password") | lowered.contains("login"))
    return features.groupBy(*scope, "source_ip", "username").agg(
        F.count("*").alias("n"),
        F.sum("message_length").alias("length_sum"),
        F.count_if(failed).alias("failed"),
    )


def totals(reduced: DataFrame, scope: list[str]) -> DataFrame:
    """Totals and distinct counts per scope from reduced rows."""
    known_ip = F.col("source_ip") != UNKNOWN
    return reduced.groupBy(*scope).agg(
        F.sum("n").alias("total_events"),
        F.count_distinct(F.when(known_ip, F.col("source_ip"))).alias("unique_sources"),
        F.count_distinct(F.when(F.col("username") != UNKNOWN, F.col("username"))).alias("unique_users"),
        (F.sum("length_sum") / F.sum("n")).alias("avg_message_length"),
        F.sum("failed").alias("failed_login_count"),
        F.count_distinct(F.when(known_ip & (F.col("failed") > 0), F.col("source_ip"))).alias("suspicious_auth_sources"),
    )


def window_features(features: DataFrame, scope: list[str]) -> DataFrame:
    """Totals and distinct counts per scope.

    Rows are reduced per (scope, address, user) first, so one busy scope never sends its raw rows to
    a single task and the distinct counts run over the reduced rows.
    """
    return totals(per_source(features, scope), scope)


def sliding_features(features: DataFrame, scope: list[str], width: str = "5 minutes", pane: str = "1 minute") -> DataFrame:
    """``window_features`` in windows of ``width`` that start every ``pane``, with ``window_start``.

    Rows are reduced inside panes first; only the reduced rows of a pane are written once per window.
    """
    panes = per_source(features, [*scope, F.window("ts", pane).alias("pane")])
    spread = panes.withColumn("w", F.window(F.col("pane.start"), width, pane)).withColumn("window_start", F.col("w.start"))
    return totals(spread, [*scope, "window_start"])
