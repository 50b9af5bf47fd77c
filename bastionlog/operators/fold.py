"""Sixty-second deduplication per (scope, address, threat), exact and safe for hot keys.

In line order a hit replaces the kept one when it lies more than the window away from it, or within
the window when its score is strictly higher. The last kept hit is the result. That is a sequential
rule, but a stretch of consecutive hits can be reduced to a short list of *segments*: for the first
hit of the stretch that would replace an earlier kept hit, which hit is kept at the end of the
stretch. Two neighbouring lists compose to one of the same kind, and composing is associative: stretches
are reduced independently, neighbouring stretches are composed ``FAN`` at a time, level by level, and what
is left of a key is walked as it streams by, with one kept hit as the state. No task and no array holds
all hits, or all segments, of a key.

A segment carries its line's text: there are few, and fetching texts by line number at the end would read
and shuffle all lines once more.

Confidence depends on whether the whole key holds direct evidence, which is known only at the end;
both possible scores are folded side by side and the right one is picked last.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bastionlog.functions.shipping import ship_by_value
from bastionlog.rules.signatures import DEDUP_WINDOW_SECONDS

ship_by_value(__name__)

CHUNK_LINES = 1 << 22
#: Stretches composed in one task, and how often: once, a key's part of 2^28 lines is one list.
FAN, LEVELS = 64, 1
MODES = (("plain_score", 0), ("direct_score", 1))
BOTH = 2


class Segment(NamedTuple):
    """Kept hit (``row``, its time and score) for entries that trigger by these running extremes."""

    top: int
    latest: int
    earliest: int
    time: int
    score: int
    row: object


def next_replacer(times: np.ndarray, scores: np.ndarray, window: int) -> np.ndarray:
    """Position of the hit that replaces each hit, or the length when none does."""
    n = len(times)
    higher = np.full(n, n, dtype=np.int64)
    stack: list[int] = []
    for i, s in enumerate(scores.tolist()):
        while stack and scores[stack[-1]] < s:
            higher[stack.pop()] = i
        stack.append(i)
    if np.all(times[1:] >= times[:-1]):
        return np.minimum(higher, np.searchsorted(times, times + window, side="right"))
    away = np.full(n, n, dtype=np.int64)
    for i in range(n):
        limit, start, width = int(higher[i]), i + 1, 64
        while start < limit:
            found = np.flatnonzero(np.abs(times[start : min(limit, start + width)] - times[i]) > window)
            if len(found):
                away[i] = start + int(found[0])
                break
            start, width = start + width, width * 2
    return np.minimum(higher, away)


def summarise(times: np.ndarray, scores: np.ndarray, window: int, rows: list) -> list[Segment]:
    """Segments of one stretch of hits in line order."""
    n = len(times)
    if n == 1:
        t, s = int(times[0]), int(scores[0])
        return [Segment(s, t, t, t, s, rows[0])]
    kept = list(range(n))
    after = next_replacer(times, scores, window).tolist()
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            kept[i] = kept[after[i]]
    top, latest, earliest = (f.accumulate(a) for f, a in
                             ((np.maximum, scores), (np.maximum, times), (np.minimum, times)))
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (top[1:] != top[:-1]) | (latest[1:] != latest[:-1]) | (earliest[1:] != earliest[:-1])
    fresh[1:] &= (latest[:-1] - earliest[:-1]) <= 2 * window
    return merge_equal(
        [
            Segment(int(top[i]), int(latest[i]), int(earliest[i]), int(times[kept[i]]), int(scores[kept[i]]), rows[kept[i]])
            for i in np.flatnonzero(fresh).tolist()
        ]
    )


def merge_equal(segments: list[Segment]) -> list[Segment]:
    """Join neighbours that keep the same hit."""
    merged: list[Segment] = []
    for s in segments:
        if merged and merged[-1].row == s.row:
            merged[-1] = s
        else:
            merged.append(s)
    return merged


def enter(segments: list[Segment], time: int, score: int, window: int) -> Segment | None:
    """Segment an earlier kept hit runs into, or none when it outlives the stretch."""
    for s in segments:
        if s.top > score or s.latest - time > window or time - s.earliest > window:
            return s
    return None


def compose(first: list[Segment], second: list[Segment], window: int) -> list[Segment]:
    """Segments of two neighbouring stretches seen as one."""
    joined = []
    for s in first:
        onward = enter(second, s.time, s.score, window)
        joined.append(s if onward is None else s._replace(time=onward.time, score=onward.score, row=onward.row))
    end = first[-1]
    if end.latest - end.earliest <= 2 * window:
        reach = (end.top, end.latest, end.earliest)
        for s in second:
            wider = (max(s.top, end.top), max(s.latest, end.latest), min(s.earliest, end.earliest))
            if wider != reach:
                joined.append(s._replace(top=wider[0], latest=wider[1], earliest=wider[2]))
                reach = wider
    return merge_equal(joined)


class _Open:
    """The key being read: its segments so far and its counts."""

    def __init__(self, marker: tuple) -> None:
        self.marker, self.key, self.part = marker, marker[:3], marker[3]
        self.hits, self.direct = 0, False
        self.segments: dict[int, list[Segment]] = {0: [], 1: []}

    def extend(self, mode: int, fresh: list[Segment], window: int, payload) -> None:
        """Append a stretch; only segments that stay fetch their payload."""
        old = self.segments[mode]
        joined = compose(old, fresh, window) if old else fresh
        self.segments[mode] = [s if isinstance(s.row, tuple) else s._replace(row=payload(s.row)) for s in joined]

    def rows(self) -> Iterator[tuple]:
        counted = (self.hits, self.direct)
        plain, direct = self.segments[0], self.segments[1]
        if plain and plain[0].row == direct[0].row and len(plain) == len(direct) == 1:
            yield (*self.key, *counted, self.part, 0, BOTH, *_bounds(plain[0], direct[0]), *plain[0].row)
            return
        for mode in (0, 1):
            for number, s in enumerate(self.segments[mode]):
                yield (*self.key, *counted, self.part, number, mode, *_bounds(s, s), *s.row)
                counted = (0, False)
        if not plain:
            yield (*self.key, *counted, self.part, 0, BOTH, *[None] * 11)


def _bounds(plain: Segment, direct: Segment) -> tuple:
    return plain.top, direct.top, plain.latest, plain.earliest, plain.score, direct.score


def make_reducer(window_us: int, schema: pa.Schema):
    """Arrow function over batches sorted by (scope, source_ip, rule_no, chunk, line_index)."""

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: _Open | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(name) for name in batch.schema.names}
            changed = np.zeros(batch.num_rows, dtype=bool)
            for name in ("stream_id", "source_ip", "rule_no", "chunk"):
                changed[1:] |= pc.not_equal(col[name][1:], col[name][:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(changed).tolist()]
            ends = [*starts[1:], batch.num_rows]
            first = pa.array(starts)
            markers = zip(*[col[name].take(first).to_pylist() for name in ("stream_id", "source_ip", "rule_no", "chunk")])
            lines, times, jitter, model = (col[name].to_numpy() for name in ("line_index", "time_us", "jitter", "model"))
            fit, direct = (col[name].to_numpy(zero_copy_only=False) for name in ("eligible", "direct"))
            scores = {mode: col[name].to_numpy() for name, mode in MODES}
            fit_list, direct_list = fit.tolist(), direct.tolist()
            done: list[tuple] = []

            def payload(i: int) -> tuple:
                return (int(lines[i]), int(times[i]), int(jitter[i]), int(model[i]), col["raw_message"][i].as_py())

            for marker, a, b in zip(markers, starts, ends):
                if open_key is None or open_key.marker != marker:
                    if open_key is not None:
                        done.extend(open_key.rows())
                    open_key = _Open(marker)
                open_key.hits += b - a
                open_key.direct = open_key.direct or any(direct_list[a:b])
                where = [i for i in range(a, b) if fit_list[i]]
                if not where:
                    continue
                for mode, values in scores.items():
                    open_key.extend(mode, summarise(times[where], values[where], window_us, where), window_us, payload)
            if done:
                yield _as_batch(done, schema)
        if open_key is not None:
            yield _as_batch(list(open_key.rows()), schema)

    return reduce_batches


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


SEGMENT_SCHEMA = pa.schema(
    [
        ("stream_id", pa.int64()), ("source_ip", pa.string()), ("rule_no", pa.int32()),
        ("hits", pa.int64()), ("any_direct", pa.bool_()),
        ("part", pa.int64()), ("number", pa.int32()), ("mode", pa.int32()),
        ("plain_top", pa.int32()), ("direct_top", pa.int32()), ("latest", pa.int64()), ("earliest", pa.int64()),
        ("plain_score", pa.int32()), ("direct_score", pa.int32()),
        ("line_index", pa.int64()), ("time_us", pa.int64()), ("jitter", pa.int32()), ("model", pa.int32()), ("raw_message", pa.string()),
    ]
)
SEGMENT_DDL = (
    "stream_id bigint, source_ip string, rule_no int, hits bigint, any_direct boolean, part bigint, number int, "
    "mode int, plain_top int, direct_top int, latest bigint, earliest bigint, plain_score int, direct_score int, "
    "line_index bigint, time_us bigint, jitter int, model int, raw_message string"
)


def reduce_hits(hits: DataFrame, window_seconds: int = DEDUP_WINDOW_SECONDS, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Segments of every (scope, address, threat, chunk of lines).

    ``hits`` needs stream_id, source_ip, rule_no, line_index, time_us, jitter, direct, eligible,
    plain_score, direct_score and raw_message; ``model`` is 0 where there is none. The chunk is part of the shuffle key, which spreads a
    hot key over tasks.
    """
    keys = ["stream_id", "source_ip", "rule_no", "chunk"]
    if "model" not in hits.columns:
        hits = hits.withColumn("model", F.lit(0))
    return (
        hits.withColumn("chunk", F.expr(f"line_index div {chunk_lines}"))
        .repartition(*keys)
        .sortWithinPartitions(*keys, "line_index")
        .mapInArrow(make_reducer(window_seconds * 1_000_000, SEGMENT_SCHEMA), SEGMENT_DDL)
    )


def segments_of(rows: list[dict], mode: int) -> list[Segment]:
    """The segments a mode sees among the rows of one part."""
    top, score = ("direct_top", "direct_score") if mode else ("plain_top", "plain_score")
    return [
        Segment(r[top], r["latest"], r["earliest"], r["time_us"], r[score], (r["line_index"], r["time_us"], r["jitter"], r["model"], r["raw_message"]))
        for r in rows
        if r["line_index"] is not None and r["mode"] in (mode, BOTH)
    ]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """(key and part, rows) of batches sorted by key, part, mode and number."""
    marker, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = (row["stream_id"], row["source_ip"], row["rule_no"], row["part"])
            if at != marker and rows:
                yield marker, rows
                rows = []
            marker = at
            rows.append(row)
    if rows:
        yield marker, rows


def make_composer(window_us: int, fan: int, schema: pa.Schema):
    """Arrow function that composes the lists of ``fan`` neighbouring parts to one."""

    def compose_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: _Open | None = None
        done: list[tuple] = []
        for marker, rows in parts(batches):
            above = (*marker[:3], marker[3] // fan)
            if open_key is None or open_key.marker != above:
                if open_key is not None:
                    done.extend(open_key.rows())
                open_key = _Open(above)
            open_key.hits += sum(r["hits"] for r in rows)
            open_key.direct = open_key.direct or any(r["any_direct"] for r in rows)
            for mode in (0, 1):
                if fresh := segments_of(rows, mode):
                    open_key.extend(mode, fresh, window_us, None)
            if len(done) >= 10_000:
                yield _as_batch(done, schema)
                done = []
        if open_key is not None:
            done.extend(open_key.rows())
        if done:
            yield _as_batch(done, schema)

    return compose_parts


KEPT_SCHEMA = pa.schema(
    [
        ("stream_id", pa.int64()), ("source_ip", pa.string()), ("rule_no", pa.int32()), ("hits", pa.int64()),
        ("any_direct", pa.bool_()), ("segment_count", pa.int64()), ("line_index", pa.int64()), ("time_us", pa.int64()),
        ("jitter", pa.int32()), ("model", pa.int32()), ("raw_message", pa.string()),
    ]
)
KEPT_DDL = (
    "stream_id bigint, source_ip string, rule_no int, hits bigint, any_direct boolean, segment_count bigint, "
    "line_index bigint, time_us bigint, jitter int, model int, raw_message string"
)


def make_walker(window_us: int):
    """Arrow function that walks a key's lists in order; its state is the kept hit by either score."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def row() -> tuple:
            hits, direct, count, kept = state
            return (*key, hits, direct, count, *(kept[int(direct)].row if kept[int(direct)] else (None,) * 5))

        for marker, rows in parts(batches):
            if marker[:3] != key:
                if key is not None:
                    done.append(row())
                key, state = marker[:3], (0, False, 0, (None, None))
            hits, direct, count, kept = state
            moved = []
            for mode, now in enumerate(kept):
                own = segments_of(rows, mode)
                count += len(own)
                entered = (own[0] if own else None) if now is None else enter(own, now.time, now.score, window_us)
                moved.append(entered or now)
            state = (hits + sum(r["hits"] for r in rows), direct or any(r["any_direct"] for r in rows), count, tuple(moved))
            if len(done) >= 10_000:
                yield _as_batch(done, KEPT_SCHEMA)
                done = []
        if key is not None:
            done.append(row())
        if done:
            yield _as_batch(done, KEPT_SCHEMA)

    return walk


def compose_level(segments: DataFrame, window_seconds: int = DEDUP_WINDOW_SECONDS, fan: int = FAN) -> DataFrame:
    """Segments with the lists of ``fan`` neighbouring parts of a key composed to one.

    The part above is in the shuffle key, so a hot key stays spread over tasks.
    """
    keys = ["stream_id", "source_ip", "rule_no"]
    return (
        segments.withColumn("above", F.expr(f"part div {fan}"))
        .repartition(*keys, "above")
        .sortWithinPartitions(*keys, "above", "part", "mode", "number")
        .drop("above")
        .mapInArrow(make_composer(window_seconds * 1_000_000, fan, SEGMENT_SCHEMA), SEGMENT_DDL)
    )


def keep_one(
    segments: DataFrame, window_seconds: int = DEDUP_WINDOW_SECONDS, levels: int = LEVELS, fan: int = FAN
) -> DataFrame:
    """One row per (scope, address, threat): hit count, evidence mark and the kept hit.

    ``segment_count`` is zero where no hit was eligible; the kept hit is null there.
    """
    for _ in range(levels):
        segments = compose_level(segments, window_seconds, fan)
    keys = ["stream_id", "source_ip", "rule_no"]
    return (
        segments.repartition("stream_id", "source_ip")
        .sortWithinPartitions(*keys, "part", "mode", "number")
        .mapInArrow(make_walker(window_seconds * 1_000_000), KEPT_DDL)
    )
