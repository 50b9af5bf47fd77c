from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from bastionlog.functions.scoring import badge_status, confidence_thousandths, threat_status
from bastionlog.operators import alerts as al
from bastionlog.operators import anomaly, classify, codescan, quality, risk, strict
from bastionlog.operators import vulnerabilities as vu
from bastionlog.operators.features import VECTOR_FIELDS, extract_features
from bastionlog.plans import dashboard, queries, scan
from bastionlog.rules.narratives import DEFAULT_MITIGATION

T0 = datetime(2024, 5, 1, 12, 0, 0)
ALERT_DDL = ("id bigint, ts timestamp_ntz, alert_type string, severity string, description string, source_ip string, "
             "confidence double, mitre_tactic string, ai_summary string, domain string, classification_type string, "
             "threat_status string")


def alert(i, status="CONFIRMED", mitre="T1110", severity="high", seconds=0, kind=None, confidence=0.9, ip="1.1.1.1"):
    return (i, T0 + timedelta(seconds=seconds), kind or f"type{i}", severity, "d", ip, confidence, mitre, None,
            "SECURITY_THREATS", "Threat", status)


def test_confidence_and_status(spark):
    cases = [  # base, spread, direct, corroborated -> thousandths
        (9400, 0, False, False, 700), (9400, 999, True, True, 858), (7500, 0, False, True, 650),
        (7500, 500, False, False, 700), (6000, 999, True, False, 700), (9400, 999, False, True, 708),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, b int, s int, d boolean, c boolean, want int")
    for r in rows.select("want", confidence_thousandths(F.col("b"), F.col("s"), F.col("d"), F.col("c")).alias("got")).collect():
        assert r.got == r.want
    levels = spark.createDataFrame([(399,), (400,), (699,), (700,), (849,), (850,)], "t int")
    got = levels.orderBy("t").select(threat_status(F.col("t")), badge_status(F.col("t"), F.lit("medium"), F.lit("SECURITY_THREATS")),
                        badge_status(F.col("t"), F.lit("high"), F.lit("SERVICE_HEALTH"))).collect()
    assert [r[0] for r in got] == ["NONE", "MONITOR", "MONITOR", "SUSPICIOUS", "SUSPICIOUS", "CONFIRMED"]
    assert [r[1] for r in got] == ["MONITOR_ONLY"] * 3 + ["SUSPICIOUS"] * 3
    assert [r[2] for r in got] == ["MONITOR_ONLY"] * 3 + ["CRITICAL"] * 3


@pytest.mark.parametrize("status,mitre,severity,want", [
    ("SUSPICIOUS", None, "low", True), ("CONFIRMED", "", "low", True), ("MONITOR", "T1", "critical", False),
    ("NONE", None, "critical", False), (None, "T1046", "low", True), (None, "NOT APPLICABLE", "critical", False),
    (None, "", "critical", False), (None, None, "high", True), (None, None, "medium", False), (None, None, None, False),
])
def test_stored_alert_kind(spark, status, mitre, severity, want):
    row = spark.createDataFrame([alert(1, status, mitre, severity)], ALERT_DDL)
    assert row.select(al.is_security_threat()).first()[0] is want


def test_dashboard_views(spark):
    rows = [alert(i, seconds=i) for i in range(40)]
    rows += [alert(100, kind="type39", seconds=60), alert(101, "NONE", "NOT APPLICABLE", "low", 61, "cond")]
    alerts = spark.createDataFrame(rows, ALERT_DDL)
    threats = dashboard.live_threats(alerts).collect()
    assert len(threats) == 15 and threats[0].id == 100 and 39 not in {r.id for r in threats}
    assert [r.id for r in dashboard.live_conditions(alerts).collect()] == [101]
    assert al.latest(alerts, 3).count() == 3
    health = spark.createDataFrame([(1, T0, 10.0, 20.0, 5), (2, T0 + timedelta(1), 30.0, 40.0, 6)],
                                   "id bigint, ts timestamp_ntz, cpu_usage double, memory_usage double, active_connections int")
    r = dashboard.key_figures(alerts, health).first()
    assert (r.cpu_usage, r.active_connections, r.security_threat_count, r.condition_count) == (30.0, 6, 40, 1)
    assert (r.security_status, r.network_status, r.service_status) == ("CONFIRMED", "DEGRADED", "IMPACTED")
    assert r.aggregate_threat_probability == 90.0
    empty = dashboard.key_figures(alerts.limit(0), health.limit(0)).first()
    assert (empty.cpu_usage, empty.security_threat_count, empty.security_status) == (0.0, 0, "NORMAL")


def test_timeline(spark):
    alerts = spark.createDataFrame(
        [alert(1, seconds=-3601), alert(2, seconds=-3600), alert(3, seconds=-1), alert(4), alert(5, "NONE", seconds=0)], ALERT_DDL)
    rows = al.timeline(al.since_last(alerts, 60)).orderBy("minute").collect()
    assert [(str(r.minute), r.threats) for r in rows] == [
        ("2024-05-01 11:00:00", 1), ("2024-05-01 11:59:00", 1), ("2024-05-01 12:00:00", 1)]
    assert al.timeline_entries(al.since_last(alerts, 60)).count() == 3


def test_attack_timeline_has_every_threat(spark, monkeypatch):
    """Each minute's count and all threats behind it, equal ones too, oldest minute first; other alerts are left out."""
    rows = [alert(5, seconds=1), alert(4, seconds=2, ip=None, mitre=None, severity="low"), alert(4, seconds=2, ip=None, mitre=None, severity="low"),
            alert(1, seconds=-1), alert(2, "NONE", seconds=3), alert(3, seconds=-3700)]
    alerts = spark.createDataFrame(rows, ALERT_DDL)
    monkeypatch.setattr(queries, "alerts_by_day", lambda *_: alerts.withColumn("day", F.to_date("ts")))
    made = queries.REGISTRY["attack_timeline"](spark, "")
    assert made.columns == ["minute", "threats", "alert_type", "severity", "source_ip", "mitre_tactic"]
    before, now = T0 - timedelta(minutes=1), T0
    assert [tuple(r) for r in made.collect()] == [
        (before, 1, "type1", "high", "1.1.1.1", "T1110"), (now, 3, "type4", "low", None, None), (now, 3, "type4", "low", None, None),
        (now, 3, "type5", "high", "1.1.1.1", "T1110")]
    nowhere = spark.createDataFrame([(*alert(9)[:1], None, *alert(9)[2:])], ALERT_DDL)
    assert [(r.minute, r.threats) for r in al.whole_timeline(nowhere).collect()] == [(None, 1)]
    assert al.whole_timeline(alerts.limit(0)).collect() == []


def test_summaries_and_export(spark):
    rows = al.with_summary(spark.createDataFrame([("SQL Injection",), ("never heard of",)], "alert_type string"))
    got = {r.alert_type: r.summary for r in rows.collect()}
    assert got["SQL Injection"].startswith("SQL fragments")
    assert "never heard of" in got["never heard of"] and DEFAULT_MITIGATION in got["never heard of"]
    exported = al.export_rows(spark.createDataFrame([alert(1, confidence=0.815), alert(2, seconds=5, confidence=0.9)], ALERT_DDL)).collect()
    assert [r["Confidence"] for r in exported] == ["0.90", f"{0.815:.2f}"]
    assert exported[0]["AI Analysis"] == "N/A" and exported[1]["Timestamp"] == "2024-05-01T12:00:00Z"


@pytest.mark.parametrize("failed,cpu,net,want", [
    (5, 0, 0, (0, risk.CATEGORY_NONE, "Low", 0.0)), (6, 0, 0, (20, risk.CATEGORY_SOME, "Low", 0.3)),
    (30, 5, 6, (20, risk.CATEGORY_SOME, "Low", 0.3)),
    (31, 0, 0, (40, risk.CATEGORY_MANY, "Medium", 0.5)),
    (0, 6, 6, (45, risk.CATEGORY_SPIKES, "Medium", 0.55)),
    (31, 6, 6, (85, risk.CATEGORY_MANY + risk.CATEGORY_SUFFIX, "High", 0.95)),
])
def test_risk_forecast(spark, failed, cpu, net, want):
    lines = spark.createDataFrame([(0, T0, "Failed password")] * failed + [(0, T0, "fine")],
                                  "stream_id bigint, ts timestamp_ntz, raw_message string")
    calm = (0, T0, 85.0, 20000.0, 20000.0)
    health = spark.createDataFrame([(0, T0, 85.1, 0.0, 0.0)] * cpu + [(0, T0, 1.0, 0.0, 20000.5)] * net + [calm] * 9,
                                   "stream_id bigint, ts timestamp_ntz, cpu_usage double, network_tx double, network_rx double")
    r = risk.predict(lines, health).first()
    assert (r.risk_score, r.predicted_attack_category, r.forecasted_likelihood, r.confidence_score) == want
    assert (r.cpu_spikes, r.network_spikes) == (cpu, net)


def test_vulnerabilities(spark, make_lines):
    features = extract_features(make_lines([
        "2024-05-01 10:00:00 web1 INFO payload rO0ABx seen",
        "2024-05-01 10:00:00 web2 INFO deserialize again, apache/2.4.49",
        '1.1.1.1 - - [01/May/2024:10:00:00 +0000] "GET /a HTTP/1.1" 500 1',
        '1.1.1.1 - - [01/May/2024:10:00:00 +0000] "GET /a HTTP/1.1" 499 1',
    ]))
    found = vu.assess(features, ["stream_id"])
    rows = {r.rule_key: r for r in found.collect()}
    assert set(rows) == {"deserialization", "apache_2.4.49", "server_error"}
    assert rows["deserialization"].affected_asset == "web1"
    assert rows["server_error"].risk_contribution == 10.0
    r = vu.risk_score(found, ["stream_id"]).first()
    assert (r.overall_risk_score, r.risk_level) == (round(9.8 * 3 + 7.5 * 3 + 10, 1), "High")


def test_upsert(spark):
    ddl = "cve_id string, description string, cvss_score double, severity string, mitigation string"
    old = spark.createDataFrame([("A", "d", 1.0, "Low", "m"), ("B", "d", 2.0, "Low", "m"), ("C", "d", 3.0, "Low", "m")], ddl)
    new = spark.createDataFrame([("B", "d", 2.5, "Low", "m"), ("C", "d", 3.0, "Low", "m"), ("D", None, 4.0, "Low", "m")], ddl)
    got = {r.cve_id: (r.cvss_score, r.change) for r in vu.upsert(old, new).collect()}
    assert got == {"A": (1.0, "unchanged"), "B": (2.5, "updated"), "C": (3.0, "unchanged"), "D": (4.0, "inserted")}
    exported = [tuple(r) for r in vu.export_rows(vu.upsert(old, new)).collect()]
    assert exported[0] == ("D", "", "4.0", "Low", "m") and [r[0] for r in exported] == ["D", "C", "B", "A"]


def detection(kind, ip, message, confidence, severity="medium", line=0, domain="SECURITY_THREATS"):
    return (0, kind, ip, message, confidence, severity, line, domain, T0, ["e"], "x", "i", "m")


DETECTION_DDL = ("stream_id bigint, threat_type string, source_ip string, raw_message string, confidence double, severity string, "
                 "line_index bigint, domain string, event_ts timestamp_ntz, evidence array<string>, explanation string, "
                 "impact string, mitigation string")


def test_strict_pass(spark):
    rows = spark.createDataFrame([
        detection("Data Exfiltration", "a", "bulk download", 0.8, "critical", 1),
        detection("Data Exfiltration", "b", "exfiltration detected, blocked", 0.8, "critical", 2),
        detection("Spam Campaign", "c", "timeout while sending", 0.9, "high", 3),
        detection("Spam Campaign", "d", "timeout under attack", 0.75, "high", 4),
        detection("Account Sharing", "e", "failed, blocked", 0.75, "medium", 5),
    ], DETECTION_DDL)
    got = {r.source_ip: (r.strict_status, r.percent, r.operational) for r in strict.assess(rows).collect()}
    assert got == {
        "a": ("Monitor", int(0.8 * 0.7 * 100), False), "b": ("Confirmed", int(0.8 * 1.2 * 100), False),
        "c": ("Confirmed", 90, True), "d": ("Suspicious", 75, False), "e": ("Confirmed", int(0.75 * 1.2 * 100), False),
    }
    r = strict.summary(strict.assess(rows)).first()
    assert (r.total_findings, r.confirmed_threats, r.suspicious_threats, r.monitor_items, r.operational_conditions) == (4, 2, 1, 1, 1)
    assert strict.findings(strict.assess(rows)).count() == 4


def test_strict_informational_is_dropped(spark):
    rows = strict.assess(spark.createDataFrame([detection("Account Sharing", "a", "x", 0.39)], DETECTION_DDL))
    assert rows.first().strict_status == "Informational" and strict.findings(rows).count() == 0


def test_scan_summary(spark):
    ddl = ("stream_id bigint, threat_type string, source_ip string, severity string, threat_status string, domain string, "
           "classification_type string, line_index bigint, confidence double, mitre_attack string")
    threats = spark.createDataFrame([
        (0, "B", "x", "high", "SUSPICIOUS", "SECURITY_THREATS", "Threat", 5, 0.75, "T1"),
        (0, "A", "x", "high", "MONITOR", "COMPLIANCE", "Classification", 9, 0.86, "T1"),
        (0, "B", "y", "high", "CONFIRMED", "SECURITY_THREATS", "Threat", 7, 0.9, "T1"),
        (0, "B", "y", "high", "CONFIRMED", "SECURITY_THREATS", "Threat", 8, 0.7, "T1"),
    ], ddl)
    calm = spark.createDataFrame([(s, "N", "x", "low", "NONE", "NETWORK_PERFORMANCE", "Condition", 1, 0.6, "NA") for s in (0, 1)], ddl)
    rows = {r.stream_id: r for r in scan.threat_summary(scan.split_findings(threats, calm)).collect()}
    r = rows[0]
    assert (r.security_threat_count, r.condition_count, r.probability, r.status) == (3, 1, 84, "threat")
    assert r.reason == "Multiple security threats detected: B, A."
    assert (r.top_threat, r.top_confidence) == ("B", 0.9)
    assert (rows[1].status, rows[1].probability) == ("clean", 0)


SAMPLE = [
    ("benign", "lease assigned to customer by dhcp"), ("benign", "query resolved for a host"),
    ("benign", "route update received from peer"), ("threat", "DDoS flood detected at edge"),
    ("threat", "DNS tunneling detected"), ("threat", "beacon callback from botnet"),
]


def test_line_classifier(spark):
    model = classify.train(classify.built_in_examples(spark))
    lines = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(SAMPLE)] + [(99, "- ! -")], "line_index bigint, message string")
    inline = classify.predict(lines, model, "message", "line_index").orderBy("line_index").collect()
    assert [r.ml_label for r in inline[:-1]] == [x for x, _ in SAMPLE]
    assert (inline[-1].ml_label, inline[-1].confidence) == ("benign", 0.0)
    tokens, counts = ["ddos", "syn"], {"benign": (16, 0), "vulnerability": (0, 0), "threat": (12, 1)}
    vocabulary = model.vocabulary
    scores = {x: np.log((n + 1) / 31) + sum(np.log((c + 1) / (model.words.get(x, 0) + vocabulary)) for _ in tokens)
              for x, (n, c) in counts.items()}
    best = max(scores.values())
    one = classify.predict(spark.createDataFrame([(0, "DDoS SYN")], "line_index bigint, message string"), model, "message", "line_index").first()
    assert one.confidence == pytest.approx(round(1 / sum(np.exp(v - best) for v in scores.values()), 2))


def test_indicator_summary(spark):
    lines = spark.createDataFrame([(0, "syn flood and nmap", "threat"), (1, "backdoors", "benign")],
                                  "line_index bigint, message string, ml_label string")
    r = classify.summarise(classify.with_indicators(lines, "message")).first()
    assert (r.total_lines, r.indicator_count, r.ml_threat_count, r.ml_benign_count) == (2, 2, 1, 1)


def test_quality(spark):
    pairs = spark.createDataFrame([("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "b")], "label string, prediction string")
    rows = {r["class"]: r for r in quality.class_metrics(quality.confusion(pairs)).collect()}
    assert (rows["a"].precision, rows["a"].recall, rows["a"].support) == (1.0, 0.75, 4)
    assert (rows["c"].precision, rows["c"].recall, rows["c"].f1) == (0.0, 0.0, 0.0)
    r = quality.overall_metrics(quality.confusion(pairs)).first()
    assert r.accuracy == pytest.approx(5 / 7)


def test_code_scan(spark):
    files = spark.createDataFrame([
        ("a.py", ".py", "def f(x=[]):\n    eval(y)\r\n    # TODO\n" + "z" * 120 + "\n"),
        ("b.js", ".js", "if (a == b) {}\nx === y\neval(1)\n"),
        ("c.java", ".java", "new Random(1)\n"), ("d.ts", ".ts", "// a\n// b\nx\n"),
        ("long.py", ".py", "x\n" * 501), ("edge.py", ".py", "x\n" * 500), ("empty.py", ".py", ""),
    ], "path string, extension string, content string")
    issues = {(r.path, r.line, r.severity, r.category) for r in codescan.all_issues(files).collect()}
    assert {("a.py", 1, "Major", "Bug"), ("a.py", 1, "Minor", "Maintainability"), ("a.py", 2, "Critical", "Bug"),
            ("a.py", 3, "Minor", "Maintainability"), ("a.py", 4, "Minor", "Maintainability"), ("b.js", 1, "Major", "Bug"),
            ("b.js", 3, "High", "Vulnerability"), ("c.java", 1, "High", "Vulnerability"), ("d.ts", 1, "Minor", "Maintainability"),
            ("long.py", 1, "Major", "Maintainability")} <= issues
    assert not [i for i in issues if i[0] in ("edge.py", "empty.py") or i[:2] == ("b.js", 2)]
    counts = {r.path: r for r in codescan.issue_counts(files).collect()}
    assert (counts["long.py"].total_lines, counts["empty.py"].total_lines, counts["empty.py"].issues) == (501, 0, 0)
    assert {r.path for r in codescan.critical_files(files).collect()} == {"a.py", "b.js"}


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *[float(v) for v in rng.normal(0, 1, len(VECTOR_FIELDS))]) for i in range(2000)]
    rows += [(10_000 + i, *[25.0 + i] * len(VECTOR_FIELDS)) for i in range(5)]
    frame = spark.createDataFrame(rows, "line_index bigint, " + ", ".join(f"{c} double" for c in VECTOR_FIELDS)).repartition(5)
    def scores(rows):
        scaled = anomaly.standardise(rows)
        return anomaly.anomaly_scores(anomaly.raw_scores(scaled, anomaly.fit_forest(scaled, "line_index"))).collect()

    scored, again = scores(frame), scores(frame.repartition(2))
    assert sorted(map(tuple, scored)) == sorted(map(tuple, again))
    top = sorted(scored, key=lambda r: -r.anomaly_score)[:5]
    assert {r.line_index for r in top} == {10_000 + i for i in range(5)}
    assert 0.03 <= sum(r.is_anomaly for r in scored) / len(scored) <= 0.051
    assert min(r.anomaly_score for r in scored) == 0.0 and max(r.anomaly_score for r in scored) == 1.0


def test_random_forest(spark):
    rows = [(i, "x" if i % 2 else "y", *[float(i % 2) * 10 + (i % 7) / 10] * len(VECTOR_FIELDS)) for i in range(80)]
    frame = spark.createDataFrame(rows, "line_index bigint, label string, " + ", ".join(f"{c} double" for c in VECTOR_FIELDS))
    model = anomaly.fit_threat_classifier(frame.filter("line_index % 2 = 0 or line_index % 5 > 0"), trees=5)
    got = anomaly.classify_threats(frame.filter("line_index % 5 = 0"), model).collect()
    assert "label" not in anomaly.classify_threats(frame.drop("label"), model).columns
    assert all(r.label == r.prediction and 0.5 <= r.probability <= 1 and len(r.probabilities) == 2 for r in got)


def test_every_line_is_classified_by_a_model_that_has_not_seen_it(spark):
    """Line 0 alone is labelled z: a model that had seen it could answer z."""
    rows = [(i, "z" if not i else "x" if i % 2 else "y", *[100.0 if not i else float(i % 2) * 10] * len(VECTOR_FIELDS)) for i in range(200)]
    frame = spark.createDataFrame(rows, "line_index bigint, label string, " + ", ".join(f"{c} double" for c in VECTOR_FIELDS))
    got = {r.line_index: r for r in anomaly.cross_fitted(frame, "line_index", trees=5).collect()}
    assert sorted(got) == list(range(200)) and got[0].prediction != "z"
    assert all(got[i].prediction == got[i].label for i in range(1, 200))


def test_each_tree_draws_for_itself(spark):
    names = ", ".join(f"{c} double" for c in VECTOR_FIELDS)
    for rows, least, most in ((100, 100, 100), (4000, 256, 600)):
        frame = spark.createDataFrame([(i, *[float(i)] * len(VECTOR_FIELDS)) for i in range(rows)], f"line_index bigint, {names}")
        sizes = [r["count"] for r in anomaly.draw_samples(frame, "line_index").groupBy("tree").count().collect()]
        assert len(sizes) == anomaly.TREES and min(sizes) >= least and max(sizes) <= most


def test_blanks_and_ends_of_rules():
    """Hand-written expectations: the rules' dialect takes more blanks than the linear engine's."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from bastionlog.functions.matching import for_linear_engine

    cases = [(r"syn\s+flood", "SYN\x0bflood", True), (r"syn\s+flood", "SYN\u2003flood", True), (r"syn\s+flood", "SYNflood", False),
             (r"a[\s,]b", "a\x1cb", True), (r"a\Sb", "a\u00a0b", False), (r"a\Sb", "a.b", True), (r"end$", "end\n", True), (r"end$", "end\n\n", False),
             (r"a\$b[$]", "a$b$", True)]
    for pattern, text, hit in cases:
        assert pc.match_substring_regex(pa.array([text]), for_linear_engine(pattern), ignore_case=True)[0].as_py() is hit, (pattern, text)


def test_labelled_csv_to_metrics(spark, tmp_path):
    """Own lines with hand-counted outcomes: one attack is missed by the rules."""
    from bastionlog.plans import evaluate
    from bastionlog.sources.readers import labelled_lines

    rows = ["xmrig started on host 4,Cryptominer / Coin Miner", "beacon with odd words,C2 Beacon", "lease renewed,benign", "lease renewed,benign"]
    path = tmp_path / "labelled.csv"
    path.write_text("\n".join(["log_entry,label", *rows]) + "\n")
    labelled = labelled_lines(spark, str(path))
    counts = evaluate.rule_confusion(labelled)
    assert {tuple(r) for r in counts.collect()} == {
        ("Cryptominer / Coin Miner", "Cryptominer / Coin Miner", 1), ("C2 Beacon", "benign", 1), ("benign", "benign", 2)}
    r = evaluate.attack_metrics(counts).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.precision, r.recall) == (1, 0, 2, 1, 1.0, 0.5)
    model = classify.train(classify.built_in_examples(spark))
    lines = spark.createDataFrame([(t, x) for x, t in SAMPLE] * 2, "log_entry string, label string")
    assert {tuple(r) for r in evaluate.classifier_confusion(lines, model).collect()} == {("benign", "benign", 6), ("threat", "threat", 6)}


def test_confidence_with_model_terms(spark):
    """Both branches against plain fractions, ties up; without models the weight is 0."""
    from fractions import Fraction
    from itertools import product

    from bastionlog.functions.scoring import confidence_thousandths, model_share, weak_thousandths

    rows = list(product([9500, 6000], [0, 999], [None, 0.0, 0.3333, 1.0], [0.25, None], [True, False], [True, False]))
    df = spark.createDataFrame(rows, "base int, spread int, anomaly double, clf double, direct boolean, many boolean")
    share = model_share(F.col("anomaly"), F.col("clf"))
    got = df.select(
        "*", confidence_thousandths(F.col("base"), F.col("spread"), F.col("direct"), F.col("many"), share).alias("strong"),
        weak_thousandths(F.col("base"), F.col("spread"), share).alias("weak"),
    ).collect()
    up = lambda x: int((x * 1000 + Fraction(1, 2)) // 1)
    for r in got:
        base, spread = Fraction(r.base, 10_000), Fraction(r.spread - 500, 10_000)
        models = Fraction(str(r.anomaly or 0)) + Fraction(str(r.clf or 0))
        raw = Fraction(70, 100) * base + Fraction(15, 100) * models + spread + (Fraction(15, 100) if r.direct else 0)
        floor = Fraction(65, 100) if r.many and not r.direct else Fraction(70, 100)
        assert r.strong == up(min(Fraction(99, 100), max(raw, floor)))
        weak = Fraction(1, 2) * base + Fraction(1, 4) * models + spread
        assert r.weak == up(min(Fraction(55, 100), max(Fraction(30, 100), weak)))


def test_line_models_raise_the_confidence(spark, make_lines):
    """A line far from what the model was fitted on is rated higher, and unseen groups score 0."""
    from bastionlog.operators import line_models
    from bastionlog.operators.features import extract_features
    from bastionlog.plans.detect import detect

    usual = make_lines([f"10.0.0.{i} - - [01/May/2024:10:00:00 +0000] \"GET /a HTTP/1.1\" 200 {100 + i}" for i in range(60)])
    attack = "10.9.9.9 - - [01/May/2024:10:00:00 +0000] \"GET /?q=1 UNION SELECT password FROM users HTTP/1.1\" 200 99999999 ransomware encrypted files port scan"
    fitted = extract_features(usual)
    moments, shares = line_models.fit_moments(fitted), line_models.fit_shares(fitted)
    seen = extract_features(make_lines([attack, "free words only"]))
    scored = line_models.score_lines(seen, moments, shares)
    rows = {r.line_index: r for r in scored.select("line_index", "anomaly", "clf").collect()}
    assert rows[0].anomaly == 1.0 and rows[1].clf == 0.0 and len(rows) == 2
    plain, rated = (max(r.confidence for r in detect(x).collect()) for x in (seen, scored))
    assert rated > plain


def random_vectors(spark, rows):
    import random

    draw = random.Random(5)
    return [(i, *(round(draw.gauss(0, 1 + (i % 7 == 0) * 5), 3) for _ in VECTOR_FIELDS)) for i in range(rows)]


def test_forest_scores_equal_a_plain_walk(spark):
    """Each row walked node by node through the written-out forest gives the library's score."""
    import math

    rows = random_vectors(spark, 300)
    scaled = spark.createDataFrame(rows, "line_index long, " + ", ".join(f"{c} double" for c in VECTOR_FIELDS))
    nodes = anomaly.fit_forest(scaled, "line_index").cache()
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n.tree, {})[n.node] = n
    got = {r.line_index: r.raw_score for r in anomaly.raw_scores(scaled, nodes).collect()}
    assert len(trees) == anomaly.TREES and len(got) == 300
    for line, *values in rows:
        shares = []
        for tree in trees.values():
            at = tree[0]
            while at.feature >= 0:
                at = tree[at.left if values[at.feature] <= at.threshold else at.right]
            shares.append(at.depth / max(tree[0].depth, 1.0))
        assert got[line] == pytest.approx(2.0 ** -(math.fsum(shares) / len(shares)), abs=1.1e-6)


def test_classifier_votes_equal_a_plain_walk(spark):
    """Leaf shares of every tree, averaged, are the library's probabilities."""
    rows = [(*r, "threat" if r[1] + r[2] > 0 else "benign") for r in random_vectors(spark, 200)]
    frame = spark.createDataFrame(rows, "line_index long, " + ", ".join(f"{c} double" for c in VECTOR_FIELDS) + ", label string")
    model = anomaly.fit_threat_classifier(frame, trees=5)

    def walked(node):
        if not node.getClass().getSimpleName().startswith("Internal"):
            return [float(x) for x in node.impurityStats().stats()]
        split = node.split()
        return split.featureIndex(), split.threshold(), walked(node.leftChild()), walked(node.rightChild())

    trees = [walked(t._java_obj.rootNode()) for t in model.stages[2].trees]
    names = model.stages[0].labels
    by_line = {r[0]: r[1:-1] for r in rows}
    got = anomaly.classify_threats(frame, model).collect()
    assert len(got) == 200
    for r in got:
        votes = [0.0, 0.0]
        for at in trees:
            while isinstance(at, tuple):
                at = at[2] if by_line[r.line_index][at[0]] <= at[1] else at[3]
            votes = [v + x / sum(at) / len(trees) for v, x in zip(votes, at, strict=True)]
        assert list(r.probabilities) == pytest.approx(votes) and r.prediction == names[votes.index(max(votes))]
