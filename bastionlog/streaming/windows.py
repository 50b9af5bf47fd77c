"""Streaming twins of the time-based operators. Event time is ``ts``; late rows wait ten minutes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bastionlog.functions.columns import UNKNOWN
from bastionlog.functions.shipping import ship_by_value
from bastionlog.operators.alerts import is_security_threat
from bastionlog.operators.correlate import ESCALATION_HITS, ESCALATION_SECONDS
from bastionlog.operators.risk import failed_login
from bastionlog.rules.signatures import DEDUP_WINDOW_SECONDS

ship_by_value(__name__)

LATENESS = "10 minutes"
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
FOLD_KEYS = ["stream_id", "source_ip", "threat_type"]
FOLD_DDL = "stream_id bigint, source_ip string, threat_type string, line_index bigint, time_us bigint, score int"
ESCALATION_DDL = "stream_id bigint, source_ip string, threat_type string, time_us bigint, recent bigint"
ESCALATION_COLUMNS = [*FOLD_KEYS, "time_us", "recent"]
FOLD_STATE_DDL = "line_index bigint, time_us bigint, score int"


def watermarked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", LATENESS)


def windowed_totals(features: DataFrame, exact: bool = False) -> DataFrame:
    """Totals per stream in five-minute windows every minute; distinct counts are sketches in streams."""
    known = F.when(F.col("source_ip") != UNKNOWN, F.col("source_ip"))
    user = F.when(F.col("username") != UNKNOWN, F.col("username"))
    distinct = F.count_distinct if exact else F.approx_count_distinct
    rows = features.withColumn("event_time", F.col("ts").cast("timestamp")) if exact else watermarked(features)
    return (
        rows.groupBy("stream_id", F.window("event_time", "5 minutes", "1 minute").alias("w"))
        .agg(
            F.count("*").alias("total_events"), distinct(known).alias("unique_sources"),
            distinct(user).alias("unique_users"), F.avg("message_length").alias("avg_message_length"),
            F.count_if(failed_login()).alias("failed_login_count"),
            distinct(F.when(failed_login(), known)).alias("suspicious_auth_sources"),
        )
        .select("stream_id", F.col("w.start").alias("window_start"), "total_events", "unique_sources", "unique_users",
                "avg_message_length", "failed_login_count", "suspicious_auth_sources")
    )


def pane_sketches(features: DataFrame) -> DataFrame:
    """One row per stream and minute: sums, and mergeable sketches of the distinct sources and users.

    For streams (the watermark is the input's) and for batches alike; expects ``event_time``.
    """
    known = F.when(F.col("source_ip") != UNKNOWN, F.col("source_ip"))
    user = F.when(F.col("username") != UNKNOWN, F.col("username"))
    return features.groupBy("stream_id", F.window("event_time", "1 minute").alias("pane")).agg(
        F.count("*").alias("n"), F.sum("message_length").alias("length_sum"),
        F.count_if(failed_login()).alias("failed"),
        F.hll_sketch_agg(known, F.lit(SKETCH_BITS)).alias("sources"),
        F.hll_sketch_agg(user, F.lit(SKETCH_BITS)).alias("users"),
        F.hll_sketch_agg(F.when(failed_login(), known), F.lit(SKETCH_BITS)).alias("suspicious"),
    )


def totals_of_panes(panes: DataFrame) -> DataFrame:
    """Five-minute windows every minute as unions of their panes: only panes are written five times, not rows.

    Sums are exact; distinct counts are within the sketch's error (``SKETCH_ERROR``, one standard error).
    In a stream both aggregates run behind one watermark, in append mode.
    """
    windows = F.window(F.window_time("pane"), "5 minutes", "1 minute").alias("w")
    joined = panes.groupBy("stream_id", windows).agg(
        F.sum("n").alias("total_events"),
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(name) for c, name in
          (("sources", "unique_sources"), ("users", "unique_users"), ("suspicious", "suspicious_auth_sources"))],
        (F.sum("length_sum") / F.sum("n")).alias("avg_message_length"),
        F.sum("failed").alias("failed_login_count"),
    )
    return joined.select("stream_id", F.col("w.start").alias("window_start"), "total_events", "unique_sources",
                         "unique_users", "avg_message_length", "failed_login_count", "suspicious_auth_sources")


def pane_totals(features: DataFrame) -> DataFrame:
    """``windowed_totals`` by way of one-minute panes."""
    rows = watermarked(features) if features.isStreaming else features.withColumn("event_time", F.col("ts").cast("timestamp"))
    return totals_of_panes(pane_sketches(rows))


def minute_timeline(alerts: DataFrame) -> DataFrame:
    """Threats per minute of a stream of alerts."""
    rows = watermarked(alerts.filter(is_security_threat()))
    return rows.groupBy(F.window("event_time", "1 minute").alias("w")).agg(F.count("*").alias("threats")).select(
        F.col("w.start").alias("minute"), "threats"
    )


class Escalate(StatefulProcessor):
    """Instants of a key that reach the limit within their trailing window, once no earlier hit can still come.

    A map holds how many hits each instant had, back to one window before the watermark; a timer stands
    just behind each instant that waits, and one behind the last window of a quiet key, which clears it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "time_us bigint", "n bigint")
        self.settled = handle.getValueState("settled", "time_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for time, n in batch["time_us"].astype("int64").value_counts().items():
                at = (int(time),)
                held = self.counts.getValue(at)[0] if self.counts.containsKey(at) else 0
                self.counts.updateValue(at, (held + int(n),))
                self.handle.registerTimer(at[0] // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit, width = timerValues.getCurrentWatermarkInMs() * 1000, ESCALATION_SECONDS * 1_000_000
        settled = self.settled.get()[0] if self.settled.exists() else -(2**62)
        counts = {t: n for (t,), (n,) in self.counts.iterator()}
        times = np.array(sorted(counts), dtype=np.int64)
        upto = np.concatenate(([0], np.cumsum([counts[t] for t in times.tolist()])))
        recent = upto[1:] - upto[np.searchsorted(times, times - width)]
        ready = (times > settled) & (times <= limit) & (recent >= ESCALATION_HITS)
        for gone in times[times < limit - width].tolist():
            self.counts.removeKey((gone,))
        kept = times[times >= limit - width].tolist()
        if kept:
            self.settled.update((max(settled, limit),))
            if kept[-1] <= limit:
                self.handle.registerTimer((kept[-1] + width) // 1000 + 1)
        else:
            self.settled.clear()
        if ready.any():
            found = [[*key, int(t), int(n)] for t, n in zip(times[ready], recent[ready])]
            yield pd.DataFrame(found, columns=ESCALATION_COLUMNS)


def escalations(hits: DataFrame) -> DataFrame:
    """Stream of the instants the batch operator finds, each once, when the watermark has passed it."""
    rows = watermarked(hits).select(*FOLD_KEYS, "time_us", "event_time")
    return rows.groupBy(*FOLD_KEYS).transformWithStateInPandas(Escalate(), ESCALATION_DDL, "Append", "EventTime")


def first_hits(hits: DataFrame) -> DataFrame:
    """Cheap deduplication: the first hit of a key stays, repeats within the lateness are dropped."""
    return watermarked(hits).dropDuplicatesWithinWatermark(FOLD_KEYS)


class Fold(StatefulProcessor):
    """The kept hit of a key by the exact rule, whatever batches its hits arrive in.

    Hits wait in a map by line until the watermark passes their time, and are then taken in line order up
    to the first that still waits. The kept hit is three numbers; it goes when the watermark is a window
    past it and nothing waits, as whatever comes then replaces it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "line_index bigint", "time_us bigint, score int")
        self.kept = handle.getValueState("kept", FOLD_STATE_DDL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for line, time, score in zip(batch["line_index"], batch["time_us"], batch["score"]):
                self.waiting.updateValue((int(line),), (int(time), int(score)))
                self.handle.registerTimer(int(time) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit, window = timerValues.getCurrentWatermarkInMs() * 1000, DEDUP_WINDOW_SECONDS * 1_000_000
        kept = before = tuple(self.kept.get()) if self.kept.exists() else None
        held = sorted((line, time, score) for (line,), (time, score) in self.waiting.iterator())
        taken = 0
        for line, time, score in held:
            if time > limit:
                break
            self.waiting.removeKey((line,))
            taken += 1
            if kept is None or abs(time - kept[1]) > window or score > kept[2]:
                kept = (line, time, score)
        if kept is None:
            return
        if taken < len(held) or kept[1] + window >= limit:
            self.kept.update(kept)
            self.handle.registerTimer(max((kept[1] + window) // 1000, limit // 1000) + 1)
        else:
            self.kept.clear()
        if kept != before:
            yield pd.DataFrame([[*key, *kept]], columns=[*FOLD_KEYS, "line_index", "time_us", "score"])


def exact_fold(hits: DataFrame) -> DataFrame:
    """Stream of the kept hit per key, each time another one is kept; the newest row of a key counts.

    It equals the batch fold however hits are dealt to batches, as long as line order and time order
    differ by less than the lateness. What waits is one lateness of hits.
    """
    rows = watermarked(hits).select(*FOLD_KEYS, "line_index", "time_us", "score", "event_time")
    return rows.groupBy(*FOLD_KEYS).transformWithStateInPandas(Fold(), FOLD_DDL, "Update", "EventTime")
