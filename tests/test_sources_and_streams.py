import gzip
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bastionlog.operators.alerts import alert_rows, since_last, since_last_by_day, timeline, timeline_of_counts
from bastionlog.operators.correlate import escalations
from bastionlog.operators.features import extract_features
from bastionlog.operators.vulnerabilities import assess
from bastionlog.plans.detect import detect, scored_hits
from bastionlog.session import materialise
from bastionlog.sources import readers, sinks
from bastionlog.streaming import ingest, windows

T0 = datetime(2024, 5, 1)


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def collect_stream(spark, frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run(query)
    return spark.table(name)


@pytest.fixture(scope="module")
def stored(spark, make_lines, tmp_path_factory):
    """Lines in three files, one per micro-batch."""
    texts = []
    for i in range(90):
        kind = ["xmrig at work", "failed login for bob password", "deserialize request", "all fine"][i % 4]
        texts.append((f"a=1 b=2 src_ip=9.9.9.{i % 3} {kind}", i % 2, i * 7))
    path = str(tmp_path_factory.mktemp("lines"))
    lines = make_lines(texts)
    for part in range(3):
        lines.filter((F.col("line_index") >= part * 30) & (F.col("line_index") < part * 30 + 30)).coalesce(1).write.mode(
            "append").parquet(path)
    return path, lines


def test_text_logs_number_lines(spark, tmp_path):
    """Splits of 64 kB, a compressed file and an empty one: every line has its number in its file."""
    texts = [f"line {i} " + "x" * (i * 7 % 400) for i in range(20_000)]
    (tmp_path / "a.log").write_text("\n".join(texts) + "\n")
    (tmp_path / "b.log").write_text("one\n\ntwo")
    (tmp_path / "c.log").write_text("")
    with gzip.open(tmp_path / "d.log.gz", "wt") as packed:
        packed.write("\n".join(texts[:5000]))
    settings = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = readers.text_logs(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = rows.orderBy("stream_id", "line_index").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_stream = {}
    for r in got:
        by_stream.setdefault(r.stream_id, []).append((r.line_index, r.raw_message))
    want = [["one", "", "two"], texts[:5000], texts]
    assert sorted(by_stream.values(), key=len) == [list(enumerate(w)) for w in want]


def test_labelled_lines(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("log_entry,label\nsyn flood,threat\n")
    bad.write_text("text,label\nx,y\n")
    assert [tuple(r) for r in readers.labelled_lines(spark, str(good)).collect()] == [("syn flood", "threat")]
    with pytest.raises(ValueError):
        readers.labelled_lines(spark, str(bad))


def test_source_tree(spark, tmp_path):
    for name in ("a.py", "sub/b.JS", "sub/c.txt", ".git/d.py", "skip.py"):
        target = tmp_path / name
        os.makedirs(target.parent, exist_ok=True)
        target.write_text("eval(x)\n")
    rows = readers.source_tree(spark, str(tmp_path), ("skip.py",)).collect()
    assert sorted((os.path.basename(r.path), r.extension) for r in rows) == [("a.py", ".py"), ("b.JS", ".js")]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("x", "1.0")], ["CVE ID", "CVSS Score"])
    sinks.write_csv(rows, str(tmp_path / "csv"))
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["CVE ID", "CVSS Score"]
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_append_by_day(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0), (2, T0 + timedelta(days=1))], "id bigint, ts timestamp_ntz")
    sinks.append_by_day(rows, str(tmp_path / "t"))
    sinks.append_by_day(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.filter("day = '2024-05-02'").count() == 2


def test_time_range_reads_its_days(spark, capsys):
    """The range crosses midnight; the plan filters partitions, and other days' files are not read."""
    rows = [(i, T0 + timedelta(hours=i), "critical", None, None) for i in range(0, 24 * 30)]
    rows += [(900, T0 + timedelta(hours=719, minutes=50), "high", None, None), (901, None, "high", None, None)]
    alerts = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, severity string, threat_status string, mitre_tactic string")
    by_day = materialise(alerts.withColumn("day", F.to_date("ts")), "alerts", "day")
    got = since_last_by_day(by_day, 25 * 60)
    assert sorted(got.select("id").collect()) == sorted(since_last(alerts, 25 * 60).select("id").collect())
    assert got.count() == 26
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan.split("PartitionFilters", 1)[1].split("\n", 1)[0]
    assert len({r[0] for r in got.select(F.input_file_name()).collect()}) <= 3
    empty = materialise(alerts.limit(0).withColumn("day", F.to_date("ts")), "alerts", "day")
    assert since_last_by_day(empty, 60).count() == 0


def test_vulnerability_versions(spark, make_lines, tmp_path):
    path = str(tmp_path / "v")
    found = assess(extract_features(make_lines(["log4j seen"])), ["stream_id"])
    assert sinks.upsert_vulnerabilities(found, path)
    assert not sinks.upsert_vulnerabilities(found, path)
    more = assess(extract_features(make_lines(["xxe seen"])), ["stream_id"])
    assert sinks.upsert_vulnerabilities(more, path)
    table, version = sinks.read_version(spark, path)
    assert version == 1 and table.count() == 2


def test_interleaved_writers_lose_nothing(spark, make_lines, tmp_path, monkeypatch):
    """A writer whose version number is taken between its read and its commit merges again."""
    path = str(tmp_path / "v")
    one, two = (assess(extract_features(make_lines([t])), ["stream_id"]) for t in ("log4j seen", "xxe seen"))
    commit, taken = sinks.commit_version, []

    def late(spark, staged, path, version):
        if not taken:
            taken.append(version)
            monkeypatch.setattr(sinks, "commit_version", commit)
            assert sinks.upsert_vulnerabilities(two, path)
        return commit(spark, staged, path, version)

    monkeypatch.setattr(sinks, "commit_version", late)
    assert sinks.upsert_vulnerabilities(one, path)
    table, version = sinks.read_version(spark, path)
    assert taken == [0] and version == 1 and table.count() == 2
    assert sorted(os.listdir(path)) == ["version=0", "version=1"]


def test_old_versions_go(spark, make_lines, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "KEPT_VERSIONS", 1)
    path = str(tmp_path / "v")
    for text in ("log4j seen", "xxe seen"):
        assert sinks.upsert_vulnerabilities(assess(extract_features(make_lines([text])), ["stream_id"]), path)
    assert sinks.versions(spark, path) == [1] and sinks.read_version(spark, path)[0].count() == 2


def test_ingest_equals_batch(spark, stored, tmp_path):
    path, lines = stored
    root = str(tmp_path / "store")
    run(ingest.start_ingest(readers.log_stream(spark, path, 1), root, available_now=True))
    entries = spark.read.parquet(f"{root}/log_entries")
    assert entries.count() == 90 and entries.select("batch").distinct().count() == 3
    got = {(r.batch, r.id, r.confidence) for r in spark.read.parquet(f"{root}/alerts").collect()}
    want = set()
    for (batch,) in entries.select("batch").distinct().collect():
        ids = [r.id for r in entries.filter(F.col("batch") == batch).collect()]
        alone = alert_rows(detect(extract_features(lines.filter(F.col("line_index").isin(ids)))))
        want |= {(batch, r.id, r.confidence) for r in alone.collect()}
    assert got == want and got
    alerts = spark.read.parquet(f"{root}/alerts").drop("batch", "day")
    counts = spark.read.parquet(f"{root}/minutes").drop("batch")
    assert {tuple(r) for r in timeline_of_counts(counts, 10_000).collect()} == {tuple(r) for r in timeline(alerts).collect()}
    whole = [tuple(r) for r in timeline(alerts).collect()]
    newest = max(minute for minute, _ in whole)
    recent = sorted(r for r in whole if r[0] >= newest - timedelta(minutes=5))
    assert sorted(map(tuple, timeline_of_counts(counts, 5).collect())) == recent and len(recent) < len(whole)
    table, _ = sinks.read_version(spark, f"{root}/vulnerabilities")
    assert {r.cve_id for r in table.collect()} >= {"CWE-502"}


def test_health_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0, T0, 1.0, 2.0, 3.0, 4.0, 5) for i in range(6)], readers.HEALTH_DDL)
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    run(ingest.start_health(readers.health_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), available_now=True))
    assert spark.read.parquet(str(tmp_path / "out/system_health")).count() == 6


def test_window_stream_equals_batch(spark, stored):
    path, lines = stored
    streamed = collect_stream(spark, windows.windowed_totals(extract_features(readers.log_stream(spark, path, 1))), "w", "complete")
    batch = windows.windowed_totals(extract_features(lines), exact=True)
    order = ["stream_id", "window_start"]
    assert [tuple(r) for r in streamed.orderBy(*order).collect()] == [tuple(r) for r in batch.orderBy(*order).collect()]


def test_timeline_and_escalation_streams(spark, stored, tmp_path):
    path, lines = stored
    alerts = alert_rows(detect(extract_features(lines)))
    alerts.write.parquet(str(tmp_path / "alerts"))
    stream = spark.readStream.schema(alerts.schema).parquet(str(tmp_path / "alerts"))
    minutes = {r.minute: r.threats for r in collect_stream(spark, windows.minute_timeline(stream), "m", "complete").collect()}
    assert sum(minutes.values()) == alerts.filter("threat_status in ('SUSPICIOUS', 'CONFIRMED')").count()
    hits = scored_hits(extract_features(lines)).withColumn("ts", F.col("event_ts"))
    hits.coalesce(1).write.parquet(str(tmp_path / "hits"))
    # A last hit of another key lets the watermark pass all others.
    last = hits.orderBy(F.desc("ts")).limit(1).withColumns({"source_ip": F.lit("end"), "ts": F.expr("ts + interval 1 hour"), "time_us": F.col("time_us") + 3_600_000_000})
    last.write.mode("append").parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "hits"))
    got = collect_stream(spark, windows.escalations(stream), "e", "append")
    want = escalations(hits).select(*got.columns)
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_escalation_stream_sees_windows_across_minutes(spark, tmp_path):
    """0:30, 3:00 and 5:20 lie within 290 s; a row out of order counts; ten minutes later nothing is left."""
    ddl = "stream_id bigint, source_ip string, threat_type string, time_us bigint, ts timestamp_ntz"
    micros = lambda second: int((T0 - datetime(1970, 1, 1)).total_seconds() + second) * 10**6
    path = str(tmp_path / "x")
    for part in ((30, 320), (180, 900), (901, 5000)):
        rows = [(0, "a", "t", micros(s), T0 + timedelta(seconds=s)) for s in part]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)
    got = collect_stream(spark, windows.escalations(stream), "e2", "append").collect()
    assert [(r.time_us, r.recent) for r in got] == [(micros(320), 3)]


def plain_fold(hits, window=60_000_000):
    """The kept (line, time, score) of one key by the rule, in line order."""
    kept = None
    for line, time, score in sorted(hits):
        if kept is None or abs(time - kept[1]) > window or score > kept[2]:
            kept = (line, time, score)
    return kept


def test_fold_stream_equals_plain_rule_on_shuffled_batches(spark, tmp_path):
    rng = random.Random(7)
    start = int((T0 - datetime(1970, 1, 1)).total_seconds())
    ddl = "stream_id bigint, source_ip string, threat_type string, line_index bigint, time_us bigint, score int, ts timestamp_ntz"
    rows = []
    for line in range(300):
        # Times mostly follow the lines and step back by up to 40 seconds now and then.
        t = line * 13 - rng.choice([0, 0, 0, 40])
        rows.append((0, rng.choice("ab"), "t", line, (start + t) * 10**6, rng.randrange(4), T0 + timedelta(seconds=t)))
    path = str(tmp_path / "h")
    parts = [rows[i : i + 40] for i in range(0, 300, 40)]
    for i in range(len(parts) - 1):  # a third of each part comes with the next one
        rng.shuffle(parts[i])
        parts[i + 1] += parts[i][27:]
        parts[i] = parts[i][:27]
    for part in parts:
        rng.shuffle(part)
    parts.append([(0, "end", "t", 999, (start + 9000) * 10**6, 1, T0 + timedelta(seconds=9000))])
    for part in parts:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)
    query = windows.exact_fold(stream).writeStream.format("memory").queryName("f").outputMode("update").trigger(availableNow=True).start()
    run(query)
    newest = {}
    for r in spark.table("f").orderBy("line_index").collect():
        newest[r.source_ip] = (r.line_index, r.time_us, r.score)
    for ip in "ab":
        assert newest[ip] == plain_fold([(r[3], r[4], r[5]) for r in rows if r[1] == ip])
    # Only the last hit still waits; what was folded has left the state.
    held = query.recentProgress[-1].stateOperators[0].numRowsTotal
    assert held <= 6


def test_first_hits(spark, tmp_path):
    ddl = "stream_id bigint, source_ip string, threat_type string, ts timestamp_ntz"
    path = str(tmp_path / "h")
    spark.createDataFrame([(0, "a", "t", T0 + timedelta(seconds=s)) for s in (0, 30, 95)], ddl).write.parquet(path)
    first = collect_stream(spark, windows.first_hits(spark.readStream.schema(ddl).parquet(path)), "d", "append")
    assert first.count() == 1


def test_escalation_stream_on_shuffled_batches(spark, tmp_path):
    """The batch operator's instants, each once, however the hits are dealt; quiet keys leave the state."""
    rng = random.Random(3)
    start = int((T0 - datetime(1970, 1, 1)).total_seconds())
    ddl = "stream_id bigint, source_ip string, threat_type string, time_us bigint, ts timestamp_ntz"
    times = sorted(rng.choices(range(0, 4000, 10), k=120))
    rows = [(0, rng.choice("ab"), "t", (start + t) * 10**6, T0 + timedelta(seconds=t)) for t in times]
    parts = [rows[i : i + 20] for i in range(0, 120, 20)]
    for part in parts:
        rng.shuffle(part)
    parts[2], parts[3] = parts[2][:10] + parts[3][:10], parts[2][10:] + parts[3][10:]
    parts.append([(0, "end", "t", (start + 9000) * 10**6, T0 + timedelta(seconds=9000))])
    path = str(tmp_path / "x")
    for part in parts:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)
    query = windows.escalations(stream).writeStream.format("memory").queryName("e3").outputMode("append").trigger(availableNow=True).start()
    run(query)
    got = spark.table("e3")
    want = escalations(spark.createDataFrame(rows, ddl)).select(*got.columns)
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal <= 6


def test_panes_equal_windows(spark, stored, tmp_path):
    """Sums of unions of panes are those of the windows, in a batch and in a stream; sketches within three errors."""
    _, lines = stored
    exact = ["total_events", "avg_message_length", "failed_login_count"]
    distinct = ["unique_sources", "unique_users", "suspicious_auth_sources"]
    features = extract_features(lines)
    want = {(r.stream_id, r.window_start): r for r in windows.windowed_totals(features, exact=True).collect()}
    batch = {(r.stream_id, r.window_start): r for r in windows.pane_totals(features).collect()}
    lines.filter("line_index % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    lines.filter("line_index % 2 = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = lines.filter("line_index = 0").withColumn("ts", F.expr("ts + interval 1 day"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream_rows = extract_features(readers.log_stream(spark, str(tmp_path / "in"), 1))
    streamed = {(r.stream_id, r.window_start): r for r in collect_stream(spark, windows.pane_totals(stream_rows), "p", "append").collect()}
    assert set(batch) == set(want) and set(streamed) == set(want)
    for found in (batch, streamed):
        for key, row in found.items():
            assert all(row[c] == want[key][c] for c in exact)
            assert all(abs(row[c] - want[key][c]) <= 3 * windows.SKETCH_ERROR * want[key][c] for c in distinct)


def test_sketch_error(spark):
    """Five panes of 20,000 sources each, a quarter of them shared, in one window."""
    rows = spark.range(100_000).select(
        F.lit(0).cast("bigint").alias("stream_id"),
        F.expr("timestamp_ntz'2024-05-01 00:00:00' + make_dt_interval(0, 0, int(id div 20000), 1)").alias("ts"),
        F.concat(F.lit("s"), F.expr("IF(id % 4 = 0, id % 20000, id)")).alias("source_ip"), F.lit("u").alias("username"),
        F.lit(10).alias("message_length"), F.lit("failed password").alias("raw_message"),
    )
    whole = windows.pane_totals(rows).filter("total_events = 100000").collect()
    true = rows.select("source_ip").distinct().count()
    assert len(whole) == 1 and whole[0].unique_users == 1
    assert abs(whole[0].unique_sources - true) <= 3 * windows.SKETCH_ERROR * true
    assert whole[0].suspicious_auth_sources == whole[0].unique_sources
