"""What keeps the work of a task small: no shuffle, one pass, tasks by the number of rows."""

from datetime import datetime

from pyspark.sql import functions as F

from bastionlog.functions.columns import imatch
from bastionlog.operators import classify, codescan
from bastionlog.operators.features import OPERATIONAL_WORDS, extract_features, operational
from bastionlog.operators.parse import KEY_VALUE, MIN_PAIRS, parse_lines
from bastionlog.plans.detect import resolved_hits
from bastionlog.rules.signatures import OPERATIONAL_PATTERN
from bastionlog.sources.derive import EVENTS_PER_TASK, given_lines, log_lines, source_files


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().toString()


def test_lines_are_scored_where_they_lie(spark, monkeypatch):
    texts = ["DDoS flood detected at edge detected", "lease assigned to customer", "zzz yyy", "- ! -", "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "DDoS flood")]
    lines = spark.createDataFrame(rows, "line_index bigint, message string")
    model = classify.train(classify.built_in_examples(spark))
    near = classify.predict(lines, model, "message", "line_index")
    assert "Exchange" not in plan_of(near).split("== Physical Plan ==")[1]
    monkeypatch.setattr(classify, "SENT_TOKENS", 0)
    joined = classify.predict(lines, model, "message", "line_index")
    assert sorted(map(repr, near.collect())) == sorted(map(repr, joined.collect()))
    assert near.filter("line_index = 0 AND ml_label = 'threat'").count() == 2
    assert near.filter("line_index IS NULL").first().confidence == 0.0


def test_a_model_without_tokens(spark):
    model = classify.train(spark.createDataFrame([], "text string, label string"))
    lines = spark.createDataFrame([(0, "some words")], "line_index bigint, message string")
    assert classify.predict(lines, model, "message", "line_index").first().ml_label == "benign"


def test_events_of_one_file_go_to_many_tasks(spark, tmp_path):
    n = 2 * EVENTS_PER_TASK + 1
    events = spark.range(0, n, 1, 1).select(
        F.when(F.col("id") % 1000 != 1, F.col("id")).alias("event_id"), F.lit(datetime(2024, 1, 1)).alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    texts = spark.createDataFrame([], "doc_id bigint, page_id bigint, conv_id bigint, turn bigint, text string, html string")
    for name in ("documents", "pages", "conversations"):
        texts.write.parquet(f"{tmp_path}/{name}.parquet")
    lines = log_lines(spark, str(tmp_path))
    sizes = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and sum(sizes) == n and max(sizes) < 1.5 * EVENTS_PER_TASK
    for other in (given_lines(spark, str(tmp_path)), source_files(spark, str(tmp_path))):
        sizes = [r["count"] for r in other.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) < 1.5 * EVENTS_PER_TASK


def test_hits_are_read_back_not_parsed_again(make_lines):
    lines = make_lines([("a=1 b=2 src_ip=7.7.7.7 fine", 0, 0), ("xmrig at work", 0, 1), ("xmrig at work", 1, 2), ("failed", 1, 3)])
    hits = resolved_hits(extract_features(lines))
    assert "from_json" not in plan_of(hits)
    found = {(r.line_index, r.source_ip) for r in hits.collect()}
    assert found == {(1, "7.7.7.7"), (2, "unknown")}


def test_operational_words_decide_nothing(spark):
    texts = ["HIGH   Latency", "high\tlatency", "latency", "routing\nchanges", "Service DEGRADATION", "performance", "JITTER", "plain", "", None,
             "connection  unstable", "degraded performance", "RTT_MS=3", "İjitter", "linK response_time_ms"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        operational(F.col("t")).alias("got"), imatch(F.col("t"), OPERATIONAL_PATTERN).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert len(OPERATIONAL_WORDS) == OPERATIONAL_PATTERN.count("|") + 1


def test_pairs_are_counted_where_there_are_signs(make_lines):
    texts = ["a=1 b=2 c=3", "a=1 b=2", "a=b=c d==e f=", "x = y = z = w", "===", "a=1\tb=2  c=3", "word " * 50]
    lines = make_lines(texts)
    rows = parse_lines(lines).select("line_format", F.regexp_count("line", F.lit(KEY_VALUE)).alias("n")).collect()
    assert [r.line_format == "key_value" for r in rows] == [r.n >= MIN_PAIRS for r in rows]


def test_files_are_read_once_for_their_counts(spark):
    files = spark.createDataFrame([
        ("a.py", ".py", " \t# one\n\x0b // two\nx # three\n"), ("a.py", ".py", "# again"), ("empty.py", ".py", ""), ("none.py", ".py", None),
        ("break.py", ".py", "\n"),
    ], "path string, extension string, content string")
    counts = codescan.issue_counts(files)
    assert plan_of(counts).split("== Physical Plan ==")[1].count("ExistingRDD") == 1
    got = {r.path: (r.total_lines, r.maintainability_issues, r.issues) for r in counts.collect()}
    assert got == {"a.py": (5, 1, 1), "empty.py": (0, 0, 0), "break.py": (1, 0, 0)}
