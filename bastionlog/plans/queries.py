"""Named queries over the supplied tables. Each takes (spark, sf_dir) and returns a flat table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bastionlog.functions.columns import imatch, strip
from bastionlog.functions.scoring import confidence_thousandths, jitter
from bastionlog.operators import alerts as al
from bastionlog.operators import anomaly, classify, codescan, correlate, line_models, quality, risk, strict
from bastionlog.operators import vulnerabilities as vu
from bastionlog.operators.disambiguate import most_specific_auth, suppress_losers
from bastionlog.operators.features import VECTOR_FIELDS, extract_features, sliding_features, window_features, with_event_time
from bastionlog.operators.fold import keep_one, reduce_hits
from bastionlog.operators.ipfill import resolve_source_ip
from bastionlog.operators.parse import field, parse_lines, simple_line, split_text, timestamp_text
from bastionlog.operators.signatures import conditions, explode_hits, line_flags, match_lines
from bastionlog.plans import dashboard, detect, scan
from bastionlog.rules.line_classifier import SIMPLE_LINE_PATTERN
from bastionlog.rules.signatures import CVE_MENTION_PATTERN
from bastionlog.session import materialise, prepare
from bastionlog.sources.derive import expected_threats, given_lines, log_lines, source_files, system_health, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepare(spark), sf_dir)

    REGISTRY[build.__name__] = run
    return build


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_features(log_lines(spark, sf_dir))


def found_conditions(rows: DataFrame) -> DataFrame:
    """Conditions of a feature table."""
    return conditions(line_flags(match_lines(rows)))


def stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection and condition alerts; some carry the empty status or technique of older records."""
    parsed = features(spark, sf_dir)
    rows = al.alert_rows(detect.detect(parsed)).unionByName(al.condition_alerts(found_conditions(parsed)))
    number = F.col("id")
    return rows.withColumns(
        {
            "threat_status": F.when(number % 5 != 0, F.col("threat_status")),
            "mitre_tactic": F.when(number % 15 == 0, "").when(number % 10 != 0, F.col("mitre_tactic")),
        }
    )


# ---- sources ---------------------------------------------------------------------------------------


@query
def raw_lines(spark, sf_dir):
    return lines(spark, sf_dir)


@query
def health_snapshots(spark, sf_dir):
    return system_health(spark, sf_dir)


@query
def text_lines(spark, sf_dir):
    return split_text(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def given_text(spark, sf_dir):
    return given_lines(spark, sf_dir)


@query
def numbered_text_lines(spark, sf_dir):
    return split_text(table(spark, sf_dir, "documents"), "doc_id", "text", keep_numbering=True)


# ---- parsing ---------------------------------------------------------------------------------------


@query
def log_format_counts(spark, sf_dir):
    return parse_lines(lines(spark, sf_dir)).groupBy("line_format").agg(F.count("*").alias("n"))


def _fields_of(spark, sf_dir, formats: list[str], names: list[str]) -> DataFrame:
    parsed = parse_lines(lines(spark, sf_dir))
    return parsed.filter(F.col("line_format").isin(*formats)).select("line_index", *[field(n).alias(n) for n in names])


@query
def json_fields(spark, sf_dir):
    names = ["timestamp", "level", "severity", "service", "src_ip", "message", "msg", "ts", "format"]
    return _fields_of(spark, sf_dir, ["isp", "json"], names)


@query
def event_properties(spark, sf_dir):
    """The JSON text of every event, parsed by the same rule as JSON lines."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("raw_message"))
    return parse_lines(events).select("event_id", "line_format", field("k").alias("k"))


@query
def access_log(spark, sf_dir):
    names = ["remote_addr", "time_local", "http_method", "request_uri", "status", "body_bytes_sent"]
    optional = [F.coalesce(field(n), F.lit("")).alias(n) for n in ("http_referer", "http_user_agent")]
    parsed = parse_lines(lines(spark, sf_dir)).filter(F.col("line_format") == "apache_or_nginx")
    return parsed.select("line_index", *[field(n).alias(n) for n in names], *optional)


@query
def syslog_fields(spark, sf_dir):
    return _fields_of(spark, sf_dir, ["syslog"], ["time_local", "hostname", "process", "message"])


@query
def plain_ts_fields(spark, sf_dir):
    names = ["timestamp", "hostname", "level", "message", "src_ip", "signature", "packet_loss", "action"]
    return _fields_of(spark, sf_dir, ["plain_ts"], names)


@query
def kv_pairs(spark, sf_dir):
    """Every name of a pair list with the value that counts."""
    parsed = parse_lines(lines(spark, sf_dir)).filter(F.col("line_format") == "key_value")
    names = parsed.select("line_index", "names", "values", F.explode(F.array_distinct("names")).alias("name"))
    value = F.get("values", F.expr("array_position(names, name)").cast("int") - 1)
    return names.select("line_index", "name", value.alias("value"))


@query
def csv_fields(spark, sf_dir):
    parsed = parse_lines(lines(spark, sf_dir)).filter(F.col("line_format") == "csv")
    parts = F.transform(F.split("line", ",", -1), strip)
    return parsed.select("line_index", F.posexplode(parts).alias("position", "value")).select(
        "line_index", F.col("position").cast("bigint").alias("position"), "value"
    )


@query
def parsed_timestamps(spark, sf_dir):
    parsed = parse_lines(lines(spark, sf_dir)).withColumn("timestamp", timestamp_text())
    return with_event_time(parsed).select("line_index", "timestamp", "event_ts")


@query
def simple_line_fields(spark, sf_dir):
    return simple_line(lines(spark, sf_dir), SIMPLE_LINE_PATTERN)


@query
def log_features(spark, sf_dir):
    return features(spark, sf_dir)


@query
def given_features(spark, sf_dir):
    return extract_features(given_lines(spark, sf_dir))


@query
def given_formats(spark, sf_dir):
    parsed = parse_lines(given_lines(spark, sf_dir))
    return parsed.groupBy("line_format").agg(F.count("*").alias("n"), F.count_distinct("stream_id").alias("streams"))


@query
def given_totals(spark, sf_dir):
    """Totals per user, document, page and conversation."""
    return window_features(extract_features(given_lines(spark, sf_dir)), ["stream_id"])


@query
def window_totals(spark, sf_dir):
    return window_features(features(spark, sf_dir), ["stream_id"])


@query
def sliding_window_totals(spark, sf_dir):
    """Batch twin of the streaming window aggregate: five-minute windows every minute."""
    return sliding_features(features(spark, sf_dir), ["stream_id"])


# ---- signatures and predicates ------------------------------------------------------------------------


@query
def signature_hits(spark, sf_dir):
    return explode_hits(match_lines(lines(spark, sf_dir))).select("line_index", "threat_type", "severity")


@query
def signature_counts(spark, sf_dir):
    hits = explode_hits(match_lines(lines(spark, sf_dir)))
    return hits.groupBy("threat_type", "severity").agg(F.count("*").alias("n"), F.count_if("direct").alias("direct_hits"))


@query
def document_signatures(spark, sf_dir):
    """Signature counts over the lines of the text corpus."""
    split = split_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    hits = explode_hits(match_lines(split.select("doc_id", F.col("line").alias("raw_message"))))
    return hits.groupBy("threat_type", "severity").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents")
    )


@query
def given_signatures(spark, sf_dir):
    """Signature counts over events and all texts, and the streams they were seen in."""
    hits = explode_hits(match_lines(given_lines(spark, sf_dir)))
    return hits.groupBy("threat_type", "severity").agg(
        F.count("*").alias("n"), F.count_if("direct").alias("direct_hits"), F.count_distinct("stream_id").alias("streams")
    )


@query
def direct_hits(spark, sf_dir):
    return explode_hits(match_lines(lines(spark, sf_dir))).filter("direct").select("line_index", "threat_type")


@query
def operational_flag(spark, sf_dir):
    flags = line_flags(match_lines(features(spark, sf_dir)))
    return flags.select("line_index", "has_operational", "operational_only", "malicious_context")


@query
def passive_vuln_flag(spark, sf_dir):
    return line_flags(match_lines(features(spark, sf_dir))).select("line_index", "passive_vulnerability_only")


@query
def network_conditions(spark, sf_dir):
    return found_conditions(features(spark, sf_dir))


@query
def cve_mentions(spark, sf_dir):
    found = F.upper(F.regexp_extract("raw_message", "(?i)" + CVE_MENTION_PATTERN, 1))
    return lines(spark, sf_dir).filter(imatch(F.col("raw_message"), CVE_MENTION_PATTERN)).select(
        "line_index", found.alias("cve_id")
    )


# ---- correlation ----------------------------------------------------------------------------------------


@query
def ip_resolution(spark, sf_dir):
    rows = features(spark, sf_dir).select("stream_id", "line_index", "source_ip")
    return resolve_source_ip(rows, ["stream_id"])


@query
def threat_occurrences(spark, sf_dir):
    return detect.occurrences(features(spark, sf_dir))


@query
def confidence_jitter(spark, sf_dir):
    hits = explode_hits(match_lines(lines(spark, sf_dir)))
    spread_of = jitter(F.col("raw_message"), F.col("threat_type"), F.col("line_index"))
    return hits.select("line_index", "threat_type", (spread_of - 500).alias("jitter"))


@query
def dedup_fold(spark, sf_dir):
    hits = detect.scored_hits(features(spark, sf_dir))
    kept = keep_one(reduce_hits(hits)).filter("segment_count > 0")
    return kept.select("stream_id", "source_ip", "rule_no", "hits", "any_direct", "line_index", "jitter")


@query
def dedup_sessions(spark, sf_dir):
    sessions = correlate.gap_sessions(detect.scored_hits(features(spark, sf_dir)))
    score = confidence_thousandths(
        detect.severity_base("severity"), F.col("jitter"), F.col("any_direct"), F.col("hits") >= 2
    )
    return sessions.withColumn("confidence", score / 1000).drop("severity")


@query
def session_peers(spark, sf_dir):
    sessions = correlate.gap_sessions(detect.scored_hits(features(spark, sf_dir)))
    return strict.with_peers(sessions).select("stream_id", "source_ip", "threat_type", "first_us", "peers")


@query
def escalations(spark, sf_dir):
    return correlate.escalations(detect.scored_hits(features(spark, sf_dir)))


@query
def auth_disambiguation(spark, sf_dir):
    marked = most_specific_auth(detect.kept_hits(features(spark, sf_dir)), ["stream_id"])
    return marked.select("stream_id", "source_ip", "threat_type", "kept_auth")


@query
def category_suppression(spark, sf_dir):
    marked = most_specific_auth(detect.kept_hits(features(spark, sf_dir)), ["stream_id"])
    return suppress_losers(marked, ["stream_id"]).filter("kept_auth").select(
        "stream_id", "source_ip", "threat_type", "suppressed"
    )


@query
def detections(spark, sf_dir):
    rows = detect.detect(features(spark, sf_dir))
    return rows.withColumns(
        {"mitre_tactics": F.array_join("mitre_tactics", "|"), "evidence": F.array_join("evidence", "|")}
    )


@query
def given_detections(spark, sf_dir):
    """Detections in events and all texts; each user, document, page and conversation is a scope of its own."""
    rows = detect.detect(extract_features(given_lines(spark, sf_dir)))
    return rows.select(
        "stream_id", "line_index", "source_ip", "threat_type", "severity", "confidence", "threat_status",
        "corroborating_count", "event_ts",
    )


@query
def model_detections(spark, sf_dir):
    """Detections whose confidence takes in the scores of models fitted on the same lines."""
    rows = materialise(features(spark, sf_dir), "features")
    moments, shares = line_models.fit_moments(rows), materialise(line_models.fit_shares(rows), "shares")
    found = detect.detect(line_models.score_lines(rows, moments, shares))
    return found.select("stream_id", "line_index", "source_ip", "threat_type", "confidence", "threat_status", "status", "corroborating_count")


@query
def evidence(spark, sf_dir):
    rows = detect.detect(features(spark, sf_dir))
    return rows.select("line_index", "threat_type", F.posexplode("evidence").alias("position", "evidence")).withColumn(
        "position", F.col("position").cast("bigint")
    )


# ---- alerts, scan and dashboard ------------------------------------------------------------------------------


@query
def alerts_projection(spark, sf_dir):
    return al.alert_rows(detect.detect(features(spark, sf_dir)))


@query
def alert_summaries(spark, sf_dir):
    """Narrative of every threat seen, and of event types, which fall back to the general text."""
    seen = explode_hits(match_lines(lines(spark, sf_dir))).select(F.col("threat_type").alias("alert_type"))
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("alert_type"))
    counted = seen.unionByName(kinds).groupBy("alert_type").agg(F.count("*").alias("n"))
    return al.with_summary(counted)


@query
def alert_export(spark, sf_dir):
    return al.export_rows(al.alert_rows(detect.detect(features(spark, sf_dir))))


@query
def latest_alerts(spark, sf_dir):
    return al.latest(stored_alerts(spark, sf_dir)).select("id", "ts", "alert_type", "severity", "source_ip", "confidence")


def alerts_by_day(spark, sf_dir) -> DataFrame:
    """Stored alerts as a table written by day, for queries that read a time range of it."""
    return materialise(stored_alerts(spark, sf_dir).withColumn("day", F.to_date("ts")), "alerts", "day")


@query
def attack_timeline(spark, sf_dir):
    """Threats of the last hour by minute: how many a minute has, and each of them."""
    return al.whole_timeline(al.since_last_by_day(alerts_by_day(spark, sf_dir), 60))


@query
def attack_timeline_threats(spark, sf_dir):
    return al.timeline_entries(al.since_last_by_day(alerts_by_day(spark, sf_dir), 60))


DASHBOARD_COLUMNS = ["id", "ts", "alert_type", "severity", "description", "source_ip", "mitre_tactic", "domain",
                     "classification_type", "threat_status"]


@query
def dashboard_threats(spark, sf_dir):
    return dashboard.live_threats(stored_alerts(spark, sf_dir)).select(*DASHBOARD_COLUMNS)


@query
def dashboard_conditions(spark, sf_dir):
    return dashboard.live_conditions(stored_alerts(spark, sf_dir)).select(*DASHBOARD_COLUMNS)


@query
def dashboard_kpis(spark, sf_dir):
    return dashboard.key_figures(stored_alerts(spark, sf_dir), system_health(spark, sf_dir))


@query
def predictive_risk(spark, sf_dir):
    return risk.predict(lines(spark, sf_dir), system_health(spark, sf_dir))


@query
def scan_split(spark, sf_dir):
    parsed = features(spark, sf_dir)
    return scan.split_findings(detect.detect(parsed), found_conditions(parsed))


@query
def threat_summary(spark, sf_dir):
    return scan.threat_summary(scan_split(spark, sf_dir))


# ---- vulnerabilities -------------------------------------------------------------------------------------------


@query
def vulnerability_hits(spark, sf_dir):
    return vu.vulnerability_hits(features(spark, sf_dir))


@query
def vulnerability_findings(spark, sf_dir):
    return vu.assess(features(spark, sf_dir), ["stream_id"]).drop("risk_tenths")


@query
def risk_score(spark, sf_dir):
    return vu.risk_score(vu.assess(features(spark, sf_dir), ["stream_id"]), ["stream_id"])


def stored_vulnerabilities(spark, sf_dir) -> DataFrame:
    """What an earlier run stored: the findings of stream 0, some with an outdated score."""
    old = vu.assess(features(spark, sf_dir).filter("stream_id = 0"), ["stream_id"])
    stale = F.when(F.col("cvss_score") > 8, F.col("cvss_score") - 1).otherwise(F.col("cvss_score"))
    return old.select("cve_id", "description", stale.alias("cvss_score"), "severity", "mitigation")


@query
def vulnerability_upsert(spark, sf_dir):
    return vu.upsert(stored_vulnerabilities(spark, sf_dir), vu.assess(features(spark, sf_dir), ["stream_id"]))


@query
def vulnerability_export(spark, sf_dir):
    return vu.export_rows(vulnerability_upsert(spark, sf_dir))


@query
def stored_risk(spark, sf_dir):
    return vu.stored_summary(vulnerability_upsert(spark, sf_dir))


# ---- strict pass -------------------------------------------------------------------------------------------------


@query
def strict_findings(spark, sf_dir):
    rows = strict.findings(strict.assess(detect.detect(features(spark, sf_dir))))
    return rows.withColumn("evidence", F.array_join("evidence", "|"))


@query
def strict_summary(spark, sf_dir):
    return strict.summary(strict.assess(detect.detect(features(spark, sf_dir))))


# ---- classification and quality ------------------------------------------------------------------------------------


@query
def coarse_indicators(spark, sf_dir):
    parsed = simple_line(lines(spark, sf_dir), SIMPLE_LINE_PATTERN)
    return classify.with_indicators(parsed, "message").select("line_index", F.inline("indicators"))


@query
def token_counts(spark, sf_dir):
    return classify.token_counts(table(spark, sf_dir, "documents"), "text")


def predicted_lines(spark, sf_dir) -> DataFrame:
    parsed = simple_line(lines(spark, sf_dir).filter(strip(F.col("raw_message")) != ""), SIMPLE_LINE_PATTERN)
    model = classify.train(classify.built_in_examples(spark))
    return classify.with_indicators(classify.predict(parsed, model, "message", "line_index"), "message")


@query
def nb_predictions(spark, sf_dir):
    names = F.array_join(F.transform("indicators", lambda s: s["indicator"]), "|")
    return predicted_lines(spark, sf_dir).withColumn("indicators", names)


@query
def nb_summary(spark, sf_dir):
    return classify.summarise(predicted_lines(spark, sf_dir))


def predicted_threats(spark, sf_dir) -> DataFrame:
    """Label of each line beside its first signature hit."""
    matched = match_lines(lines(spark, sf_dir)).select("line_index", "codes")
    first = explode_hits(matched).groupBy("line_index").agg(F.min_by("threat_type", "rule_no").alias("prediction"))
    return (
        expected_threats(spark, sf_dir).join(first, "line_index", "left")
        .select("line_index", "label", F.coalesce("prediction", F.lit("benign")).alias("prediction"))
    )


@query
def confusion_matrix(spark, sf_dir):
    return quality.confusion(predicted_threats(spark, sf_dir))


@query
def class_metrics(spark, sf_dir):
    return quality.class_metrics(quality.confusion(predicted_threats(spark, sf_dir))).drop("hit")


@query
def overall_metrics(spark, sf_dir):
    rows = quality.overall_metrics(quality.confusion(predicted_threats(spark, sf_dir)))
    return rows.select("support", *[F.round(c, 9).alias(c) for c in rows.columns if c != "support"])


@query
def label_confusion(spark, sf_dir):
    """Quality labels against their toxicity marks, read as label and prediction."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("quality").cast("string").alias("label"), (1 - F.col("toxic")).cast("string").alias("prediction")
    )
    return quality.confusion(labels)


@query
def detection_quality(spark, sf_dir):
    rows = predicted_threats(spark, sf_dir)
    return quality.binary_metrics(
        rows.select((F.col("label") != "benign").alias("is_attack"), (F.col("prediction") != "benign").alias("detected"))
    )


# ---- anomaly models --------------------------------------------------------------------------------------------------


def vectors(spark, sf_dir) -> DataFrame:
    return features(spark, sf_dir).select("line_index", *anomaly.vector_columns())


@query
def feature_vectors(spark, sf_dir):
    return vectors(spark, sf_dir)


@query
def standardised_vectors(spark, sf_dir):
    scaled = anomaly.standardise(materialise(vectors(spark, sf_dir), "vectors"))
    return scaled.select("line_index", *[F.round(c, 5).alias(c) for c in VECTOR_FIELDS])


@query
def unusual_lines(spark, sf_dir):
    scaled = anomaly.standardise(materialise(vectors(spark, sf_dir), "vectors"))
    return anomaly.unusual_by_deviation(scaled)


@query
def anomaly_scores(spark, sf_dir):
    scaled = anomaly.standardise(materialise(vectors(spark, sf_dir), "vectors"))
    nodes = materialise(anomaly.fit_forest(scaled, "line_index"), "forest")
    return anomaly.anomaly_scores(materialise(anomaly.raw_scores(scaled, nodes), "scores"))


@query
def rf_threat_class(spark, sf_dir):
    """Every line, scored by a classifier fitted on the three quarters of the lines that it is not in."""
    labelled = materialise(vectors(spark, sf_dir).join(expected_threats(spark, sf_dir), "line_index"), "labelled")
    return anomaly.cross_fitted(labelled, "line_index").drop("probabilities")


# ---- code corpus -----------------------------------------------------------------------------------------------------


def corpus(spark, sf_dir) -> DataFrame:
    return source_files(spark, sf_dir)


@query
def code_issues(spark, sf_dir):
    return codescan.line_issues(corpus(spark, sf_dir))


@query
def code_file_issues(spark, sf_dir):
    return codescan.file_issues(corpus(spark, sf_dir))


@query
def code_issue_counts(spark, sf_dir):
    return codescan.issue_counts(corpus(spark, sf_dir))


@query
def code_critical_files(spark, sf_dir):
    return codescan.critical_files(corpus(spark, sf_dir))
