import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from bastionlog.operators.correlate import escalations, gap_sessions
from bastionlog.operators.disambiguate import disambiguate, most_specific_auth, suppress_losers
from bastionlog.operators.features import extract_features
from bastionlog.operators.fold import compose, compose_level, enter, keep_one, reduce_hits, summarise
from bastionlog.operators.ipfill import resolve_source_ip
from bastionlog.plans.detect import detect, scored_hits
from bastionlog.rules.signatures import AUTH_PRIORITY, SUPPRESSION_PAIRS

WINDOW = 60


def plain_fold(hits, window=WINDOW):
    """Sequential rule, spelled out."""
    kept = None
    for i, (t, s) in enumerate(hits):
        if kept is None or abs(t - kept[1]) > window or s > kept[2]:
            kept = (i, t, s)
    return kept


def segment_fold(parts, window=WINDOW):
    """Summaries of parts, composed pairwise, walked from nothing."""
    offset, whole = 0, None
    for part in parts:
        t, s = (np.array([h[k] for h in part], dtype=np.int64) for k in (0, 1))
        own = summarise(t, s, window, list(range(offset, offset + len(part))))
        whole = own if whole is None else compose(whole, own, window)
        offset += len(part)
    return whole[0].row


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 6)), min_size=1, max_size=40), st.data(), st.booleans())
def test_segments_equal_sequential_fold(hits, data, ordered):
    if ordered:
        hits = sorted(hits, key=lambda h: h[0])
    cuts = sorted(data.draw(st.sets(st.integers(1, max(1, len(hits) - 1)), max_size=5)))
    parts = [p for p in (hits[a:b] for a, b in zip([0, *cuts], [*cuts, len(hits)])) if p]
    assert segment_fold(parts) == plain_fold(hits)[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 5)), min_size=1, max_size=30),
       st.tuples(st.integers(-100, 400), st.integers(0, 5)))
def test_segments_answer_every_entry(hits, entry):
    t, s = (np.array([h[k] for h in hits], dtype=np.int64) for k in (0, 1))
    found = enter(summarise(t, s, WINDOW, list(range(len(hits)))), *entry, WINDOW)
    kept = plain_fold([entry, *hits])[0] - 1
    assert (found.row if found else -1) == kept


def test_dense_hot_part_stays_short():
    n = 50_000
    t = np.sort(np.random.default_rng(1).integers(0, 6000, n)) * 1
    s = np.full(n, 700)
    assert len(summarise(t, s, WINDOW, list(range(n)))) <= 2 * WINDOW + 2


HITS_DDL = ("stream_id bigint, source_ip string, rule_no int, line_index bigint, time_us bigint, jitter int, direct boolean, "
            "eligible boolean, plain_score int, direct_score int, raw_message string")


@pytest.mark.parametrize("chunk_lines,levels,fan", [(16, 3, 4), (16, 0, 2), (1, 4, 3), (700, 1, 64), (1 << 22, 1, 64)])
def test_fold_over_chunks_and_batches(spark, chunk_lines, levels, fan):
    rng = random.Random(3)
    rows, line = [], 0
    for _ in range(3000):
        hot = rng.random() < 0.4
        ip, rule = ("hot", 1) if hot else (f"ip{rng.randrange(40)}", rng.randrange(3))
        time = line // 3 + (rng.randrange(-90, 90) if rng.random() < 0.05 else 0)
        jit = rng.randrange(1000)
        direct = rule == 2 and rng.random() < 0.5
        rows.append((0, ip, rule, line, time * 1_000_000, jit, direct, rule != 2 or direct, max(650, jit // 2 + 400),
                     max(700, jit // 2 + 500), f"m{line}"))
        line += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = keep_one(reduce_hits(spark.createDataFrame(rows, HITS_DDL), WINDOW, chunk_lines), WINDOW, levels, fan).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2]), []).append(r)
    assert len(got) == len(groups)
    for r in got:
        all_hits = groups[(r.source_ip, r.rule_no)]
        any_direct = any(h[6] for h in all_hits)
        fit = [h for h in all_hits if h[7]]
        assert (r.hits, r.any_direct) == (len(all_hits), any_direct)
        if not fit:
            assert r.line_index is None
            continue
        kept = fit[plain_fold([(h[4] // 1_000_000, h[9] if any_direct else h[8]) for h in fit])[0]]
        assert (r.line_index, r.jitter, r.raw_message) == (kept[3], kept[5], kept[10])


def test_fold_spreads_a_hot_key(spark):
    """One key in a third of the lines: no array of a key in the plan, and each task composes its own parts."""
    rows = [(0, "hot" if i % 3 == 0 else f"ip{i % 50}", 1, i, i * 40_000_000, i % 1000, False, True, 650, 700, f"m{i}") for i in range(6000)]
    segments = reduce_hits(spark.createDataFrame(rows, HITS_DDL), WINDOW, 16)
    kept = keep_one(segments, WINDOW, 2, 8)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "above" in plan
    composed = compose_level(segments, WINDOW, 8).filter("source_ip = 'hot'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a_task = composed.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(a_task) > 1 and composed.select("part").distinct().count() == -(-6000 // (16 * 8))
    hot = [r for r in rows if r[1] == "hot"]
    want = hot[plain_fold([(r[4] // 1_000_000, r[8]) for r in hot])[0]]
    assert kept.filter("source_ip = 'hot'").first().line_index == want[3]


@pytest.mark.parametrize("chunk_lines", [1, 3, 7, 1000])
def test_ip_fill(spark, chunk_lines):
    rng = random.Random(chunk_lines)
    rows = [(s, i, rng.choice(["unknown", "unknown", "unknown", f"ip{i}"])) for s in range(3) for i in range(60)]
    rows += [(9, i, "unknown") for i in range(5)]
    got = resolve_source_ip(spark.createDataFrame(rows, "stream_id bigint, line_index bigint, source_ip string"),
                            ["stream_id"], chunk_lines).collect()
    assert len(got) == len(rows)
    for r in got:
        lines = [x for x in rows if x[0] == r.stream_id]
        before = [x[2] for x in lines if x[1] < r.line_index and x[2] != "unknown"]
        after = [x[2] for x in lines if x[1] > r.line_index and x[2] != "unknown"]
        want = r.source_ip if r.source_ip != "unknown" else (before[-1] if before else after[0] if after else "unknown")
        assert r.resolved_ip == want


def one_address(spark, threats, ip="a"):
    return spark.createDataFrame([(0, ip, t) for t in threats], "stream_id bigint, source_ip string, threat_type string")


def test_auth_specificity(spark):
    rows = one_address(spark, AUTH_PRIORITY + ["Spam Campaign"]).union(one_address(spark, AUTH_PRIORITY[2:], "b"))
    kept = {(r.source_ip, r.threat_type) for r in most_specific_auth(rows, ["stream_id"]).filter("kept_auth").collect()}
    assert kept == {("a", AUTH_PRIORITY[0]), ("a", "Spam Campaign"), ("b", AUTH_PRIORITY[2])}


def test_every_suppression_pair(spark):
    for winner, loser in SUPPRESSION_PAIRS:
        kept = {r.threat_type for r in disambiguate(one_address(spark, [winner, loser]), ["stream_id"]).collect()}
        assert kept == {winner}
    apart = one_address(spark, [SUPPRESSION_PAIRS[0][0]]).union(one_address(spark, [SUPPRESSION_PAIRS[0][1]], "b"))
    assert disambiguate(apart, ["stream_id"]).count() == 2


def test_suppression_does_not_wait_for_the_winner(spark):
    chain = ["C2 Beacon / Command & Control", "Tor / Anonymous Proxy Detected", "Proxy Abuse"]
    kept = {r.threat_type for r in disambiguate(one_address(spark, chain), ["stream_id"]).collect()}
    assert kept == {chain[0]}
    gone = ["Credential Stuffing", "Brute-Force Authentication", "SIP Registration Attack"]
    marked = suppress_losers(most_specific_auth(one_address(spark, gone), ["stream_id"]), ["stream_id"])
    assert {r.threat_type for r in marked.filter("kept_auth and not suppressed").collect()} == {gone[0], gone[2]}


def test_incident_text(make_lines):
    rows = detect(extract_features(make_lines(
        [f"2024-05-01 10:00:{i:02d} gw WARN src_ip=5.5.5.5 failed login for root" for i in range(10)]
        + ["gateway note: failed login again", "latency_ms=3"]
    ))).collect()
    assert [(r.source_ip, r.threat_type, r.corroborating_count) for r in rows] == [
        ("5.5.5.5", "Brute-Force Authentication", 11)]
    assert "11 corroborating log entries from same source" in rows[0].evidence


def hits_frame(make_lines, seconds):
    return scored_hits(extract_features(make_lines([("a=1 b=2 src_ip=7.7.7.7 xmrig", 0, s) for s in seconds])))


@pytest.mark.parametrize("bucket", [5, 60, 3600])
def test_gap_sessions(make_lines, bucket):
    seconds = [0, 30, 90, 151, 152, 152, 400, 460, 521]
    rows = gap_sessions(hits_frame(make_lines, seconds), 60, bucket).orderBy("first_us").collect()
    base = rows[0].first_us
    assert [((r.first_us - base) // 10**6, (r.last_us - base) // 10**6, r.hits) for r in rows] == [
        (0, 90, 3), (151, 152, 3), (400, 460, 2), (521, 521, 1)]


def test_escalations(make_lines):
    seconds = [0, 299, 300, 301, 700, 950, 1000, 1301, 5000]
    rows = escalations(hits_frame(make_lines, seconds)).orderBy("time_us").collect()
    base = 1714521600
    want = [s for s in seconds if sum(1 for x in seconds if s - 300 <= x <= s) >= 3]
    assert [r.time_us // 10**6 - base for r in rows] == want
    assert {r.threat_status for r in rows} == {"CONFIRMED"}


def test_hot_key_never_meets_in_one_window(make_lines):
    plan = gap_sessions(hits_frame(make_lines, [0, 1]))._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and "Join Cross" not in plan
