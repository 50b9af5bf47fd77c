import pytest
from pyspark.sql import functions as F

from bastionlog.operators.features import extract_features, window_features, with_event_time
from bastionlog.operators.parse import csv_fields, field, parse_lines, simple_line, split_text
from bastionlog.rules.line_classifier import SIMPLE_LINE_PATTERN

FORMATS = [
    ('{"timestamp":"2024-05-01T10:00:00Z","level":"INFO","message":"ok"}', "isp"),
    ('{"timestamp":"2024-05-01T10:00:00Z","service":"dns","message":"ok"}', "isp"),
    ('{"timestamp":"2024-05-01T10:00:00Z","message":"no level"}', "json"),
    ('{"ts":"x","msg":"y"}', "json"),
    ('{"a":1,"a":2}', "json"),
    ('{"a":1} trailing {"b":2}', "text"),
    ("{'a': 1}", "text"),
    ('{"cut', "text"),
    ('["a","b"]', "text"),
    ('1.2.3.4 - - [01/May/2024:10:00:00 +0000] "GET /x HTTP/1.1" 200 12', "apache_or_nginx"),
    ("May  1 10:00:00 gw sshd[2]: Failed password", "syslog"),
    ("2024-05-01 10:00:00 FW alert src_ip=1.1.1.1 x", "plain_ts"),
    ("a=1 b=2 c=3", "key_value"),
    ("a=1 b=2", "text"),
    ("a,b,c,d,e", "csv"),
    ("a,b,c,d", "text"),
    ("a,b,{c,d,e", "text"),
    ("", "text"),
    ("   \t ", "text"),
]


def test_formats(make_lines):
    rows = parse_lines(make_lines([t for t, _ in FORMATS])).orderBy("line_index").collect()
    assert [(r["raw_message"], r["line_format"]) for r in rows] == FORMATS


def test_access_log_fields(make_lines):
    lines = make_lines([
        '9.9.9.9 - bob [01/May/2024:10:00:00 +0000] "POST /login HTTP/1.1" 401 512 "http://r/" "agent/1"',
        '9.9.9.9 - - [01/May/2024:10:00:00 +0000] "GET / HTTP/1.1" 503 7',
    ])
    a, b = extract_features(lines).orderBy("line_index").collect()
    assert (a.source_ip, a.http_method, a.url, a.status_code, a.bytes_sent, a.user_agent) == (
        "9.9.9.9", "POST", "/login", 401, 512, "agent/1")
    assert a.timestamp == "2024-05-01T10:00:00+00:00"
    assert (b.status_code, b.user_agent) == (503, "")


def test_pairs_first_and_last_value(make_lines):
    lines = make_lines(["k=1 k=2 other=3", "2024-05-01 10:00:00 H INFO k=1 k=2 level=9 hostname=z"])
    a, b = parse_lines(lines).select("line_index", field("k").alias("k"), field("level").alias("level"),
                                     field("hostname").alias("hostname")).orderBy("line_index").collect()
    assert a.k == "2"
    assert (b.k, b.level, b.hostname) == ("1", "INFO", "H")


def test_feature_rules(make_lines):
    lines = make_lines([
        '{"remote_addr":"","src_ip":"2.2.2.2","user":"bob","usage_mbps":"12.5","dropped_packets":"12.5","status":"abc"}',
        '{"customer_id":7,"user":"bob","level":"WARN","dropped_packets":" 12 ","cpu":"91.5","port":"99"}',
        '{"customer_id":7,"format":"mine","raw_message":"replaced","cpu":"bad"}',
        '{"username":"x","customer_id":null,"status":"critical"}',
    ])
    a, b, c, d = extract_features(lines).orderBy("line_index").collect()
    assert (a.source_ip, a.username, a.usage_mbps, a.dropped_packets, a.status_code) == ("2.2.2.2", "unknown", 12.5, 0, 0)
    assert (b.username, b.severity, b.dropped_packets, b.cpu, b.memory, b.dst_port) == ("bob", "warn", 12, 91.5, None, 99)
    assert (c.username, c.format, c.raw_message, c.message_length, c.cpu) == ("7", "mine", "replaced", 8, 0.0)
    assert (d.username, d.status_code, d.severity) == ("unknown", 0, "info")


def test_event_time(make_lines):
    lines = make_lines([
        '{"timestamp":"2024-01-02T03:04:05Z","level":"x","message":"m"}',
        '{"timestamp":"2024-01-02T03:04:05+02:00","level":"x","message":"m"}',
        '{"timestamp":"2024-01-02T03:04:05+00:00Z","level":"x","message":"m"}',
        "no time at all",
    ])
    rows = with_event_time(extract_features(lines)).orderBy("line_index").collect()
    assert [str(r.event_ts) for r in rows] == [
        "2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-05-01 00:00:02", "2024-05-01 00:00:03"]


def test_csv_and_simple_lines(make_lines):
    lines = make_lines([' a , "b,c" ,d,e,', "2024 INFO dns - all - good", "nothing here"])
    assert csv_fields(lines).first().csv_fields == ["a", '"b', 'c"', "d", "e", ""]
    rows = simple_line(lines, SIMPLE_LINE_PATTERN).orderBy("line_index").collect()
    assert (rows[1].line_time, rows[1].level, rows[1].source, rows[1].message) == ("2024", "INFO", "dns", "all - good")
    assert (rows[2].level, rows[2].message) == (None, "nothing here")


@pytest.mark.parametrize("numbering,expected", [(False, [(1, "a"), (2, "b")]), (True, [(1, "a"), (3, "b")])])
def test_split_text(spark, numbering, expected):
    docs = spark.createDataFrame([(1, "\n  a \r\n\n b\n\n")], "doc_id bigint, text string")
    rows = split_text(docs, "doc_id", "text", numbering).orderBy("line_number").collect()
    assert [(r.line_number, r.line) for r in rows] == expected


def test_blank_text_yields_itself(spark):
    docs = spark.createDataFrame([(1, " \n ")], "doc_id bigint, text string")
    assert [tuple(r) for r in split_text(docs, "doc_id", "text").collect()] == [(1, 1, "")]


def test_window_features(make_lines):
    lines = make_lines([
        ("a=1 src_ip=1.1.1.1 b=failed_login_password", 0, 0),
        ("a=1 src_ip=2.2.2.2 b=ok", 0, 1),
        ("failed login", 0, 2),
        ("other", 1, 3),
    ])
    rows = {r.stream_id: r for r in window_features(extract_features(lines), ["stream_id"]).collect()}
    r = rows[0]
    assert (r.total_events, r.unique_sources, r.failed_login_count, r.suspicious_auth_sources) == (3, 2, 2, 1)
    assert rows[1].total_events == 1


def test_parsing_needs_no_shuffle(make_lines):
    plan = extract_features(make_lines(["x"]).filter(F.col("stream_id") >= 0))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_json_values_keep_their_types(make_lines):
    """Hand-derived: the last of equal names counts, numbers are cut, texts must be whole, zero and false name nothing."""
    cases = [
        ('{"src_ip":"1.1.1.1","src_ip":"2.2.2.2"}', {"source_ip": "2.2.2.2"}),
        ('{"status":500.0,"body_bytes_sent":12.5,"dropped_packets":true}', {"status_code": 500, "bytes_sent": 12, "dropped_packets": 1}),
        ('{"status":"500.0","body_bytes_sent":"12","rtt_ms":true}', {"status_code": 0, "bytes_sent": 12, "rtt_ms": 1.0}),
        ('{"src_ip":0,"host":false,"dst_port":"x"}', {"source_ip": "unknown", "hostname": "unknown", "dst_port": 0}),
        ('{"src_ip":false,"client_ip":"3.3.3.3","status":null}', {"source_ip": "3.3.3.3", "status_code": 0}),
        ('{"msg":{"a":[1,"b"]},"cpu":7}', {"cpu": 7.0, "format": "json"}),
    ]
    rows = extract_features(make_lines([c for c, _ in cases])).orderBy("line_index").collect()
    for row, (text, want) in zip(rows, cases):
        assert {k: row[k] for k in want} == want, text


def test_filters_reach_the_scan(spark, tmp_path, make_lines):
    path = str(tmp_path / "lines")
    make_lines([("a", 0, 1), ("b", 1, 2)]).write.partitionBy("stream_id").parquet(path)
    plan = extract_features(spark.read.parquet(path)).filter("stream_id = 1 and line_index = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(stream_id" in plan and "EqualTo(line_index,3)" in plan
