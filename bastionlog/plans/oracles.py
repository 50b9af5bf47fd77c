"""DuckDB SQL for the named queries, written from the definitions rather than from the Spark plans.

Rule catalogues are shared data; everything else (parsing, fill, fold, joins) is spelled out again as
SQL over the supplied tables. Common stages are CTEs that each statement starts with as needed.
"""

from __future__ import annotations

from bastionlog.functions.scoring import (
    CAP,
    DIRECT_BONUS,
    FLOOR_CONFIRMED,
    FLOOR_CORROBORATED,
    JITTER_CENTRE,
)
from bastionlog.operators import codescan, parse, risk
from bastionlog.operators.features import METRIC_FIELDS, SOURCE_FIELDS, VECTOR_FIELDS
from bastionlog.plans.scan import CLEAN_SUMMARY
from bastionlog.rules import signatures as sig
from bastionlog.rules.code_rules import CODE_RULES, COMMENT_DENSITY, LARGE_FILE, OPEN_TODO
from bastionlog.rules.line_classifier import COARSE_INDICATORS, LABELS, SIMPLE_LINE_PATTERN, TOKEN_PATTERN, TRAINING_LINES
from bastionlog.rules.narratives import (
    DEFAULT_IMPACT,
    DEFAULT_MITIGATION,
    NETWORK_CONDITION_NOTE,
    SERVICE_CONDITION_NOTE,
    narrative_rows,
)
from bastionlog.rules.vulnerabilities import FACTS, SERVER_ERROR, SIGNALS
from bastionlog.sources.derive import LINES_PER_TURN
from bastionlog.sources.templates import (
    BURST_EVENTS,
    BURST_SECONDS,
    EXPECTED,
    HOT_HOSTS,
    LINES_PER_SECOND,
    LONG_SNIPPET_EVERY,
    LONG_SNIPPET_LINES,
    SNIPPETS,
    STREAMS,
    TEMPLATES,
)

LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c]"
BLANKS = r"E' \t\n\r\x0B\x0C'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: list[str], alias: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{alias}({', '.join(names)}) AS (VALUES {body})"


def search(column: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({column}, {q(pattern)}, {q(flags)})"


def has_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---- log lines ---------------------------------------------------------------------------------------------


def _log_lines() -> str:
    shapes = ", ".join(q(t) for t in TEMPLATES)
    fields = {
        "ip": f"'10.' || (user_id % {STREAMS}) || '.' || (host // 256) || '.' || (host % 256)",
        "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')",
        "plain": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
        "clf": "strftime(ts, '%d/%b/%Y:%H:%M:%S +0000')",
        "syslog": "strftime(ts, '%b %-d %H:%M:%S')",
        "n": "CAST(event_id % 97 AS VARCHAR)",
        "u": "CAST(user_id AS VARCHAR)",
    }
    message = f"([{shapes}])[event_id % {len(TEMPLATES)} + 1]"
    for name, value in fields.items():
        message = f"replace({message}, '{{{name}}}', {value})"
    return f"""log_lines AS (
  SELECT event_id AS line_index, user_id % {STREAMS} AS stream_id, ts, {message} AS raw_message
  FROM (SELECT event_id, user_id,
          TIMESTAMP '2024-01-01 00:00:00' + to_seconds((event_id // {BURST_EVENTS}) * {BURST_SECONDS}
            + (event_id % {BURST_EVENTS}) // {LINES_PER_SECOND}) AS ts,
          CASE WHEN user_id % 3 = 0 THEN user_id % {HOT_HOSTS} ELSE user_id END AS host
        FROM events))"""


def _given_lines() -> str:
    texts = " UNION ALL ".join(
        f"SELECT {key} * 4 + {place} AS s, {order}::BIGINT AS t, {text} AS text FROM {name}"
        for place, (name, key, text, order) in enumerate(
            [("documents", "doc_id", "text", "0"), ("pages", "page_id", "html", "0"), ("conversations", "conv_id", "text", "turn")], 1)
    )
    return f"""log_lines AS (
  SELECT event_id AS line_index, user_id * 4 AS stream_id, ts, '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","level":"'
      || coalesce(event_type, '') || '","customer_id":' || coalesce(CAST(user_id AS VARCHAR), 'null') || ',"usage_mbps":'
      || coalesce(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), 'null') || ',"message":"' || coalesce(event_type, '')
      || '","props":' || coalesce(props, 'null') || '}}' AS raw_message FROM events
  UNION ALL SELECT t * {LINES_PER_TURN} + i, s, TIMESTAMP '2024-01-01 00:00:00', l FROM
    (SELECT s, t, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM
      (SELECT s, t, CASE WHEN len(kept) = 0 THEN [trim(text, {BLANKS})] ELSE kept END AS lines FROM
        (SELECT s, t, text, list_filter(list_transform(regexp_split_to_array(text, {q(LINE_BREAKS)}),
           lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS kept FROM ({texts})))))"""


def given(ctes: list[str]) -> list[str]:
    """The same stages over the lines of the supplied texts."""
    return [_given_lines() if c == _log_lines() else c for c in ctes]


def field(name: str) -> str:
    pos = f"list_position(names, {q(name)})"
    return f"(CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.{name}') WHEN {pos} > 0 THEN vals[{pos}] END)"


def _parsed() -> list[str]:
    access_names = [*parse.ACCESS_FIELDS, "http_method"]

    def groups(pattern: str, numbers: list[int]) -> str:
        return "[" + ", ".join(f"regexp_extract(line, {q(pattern)}, {n})" for n in numbers) + "]"

    def names(items: list[str]) -> str:
        return "[" + ", ".join(q(i) for i in items) + "]"

    kv = q(parse.KEY_VALUE)
    commas = "(length(line) - length(replace(line, ',', '')))"
    return [
        f"trimmed AS (SELECT *, trim(raw_message, {BLANKS}) AS line FROM log_lines)",
        """objects AS (SELECT *, CASE WHEN starts_with(line, '{') AND ends_with(line, '}') AND json_valid(line)
            THEN CAST(line AS JSON) END AS j FROM trimmed)""",
        f"""formatted AS (SELECT *, CASE
            WHEN j IS NOT NULL AND json_exists(j, '$.timestamp') AND json_exists(j, '$.message')
              AND (json_exists(j, '$.level') OR json_exists(j, '$.severity') OR json_exists(j, '$.service')) THEN 'isp'
            WHEN j IS NOT NULL THEN 'json'
            WHEN {search('line', parse.ACCESS_LOG, '')} THEN 'apache_or_nginx'
            WHEN {search('line', parse.SYSLOG, '')} THEN 'syslog'
            WHEN {search('line', parse.PLAIN_TIMESTAMP, '')} THEN 'plain_ts'
            WHEN len(regexp_extract_all(line, {kv})) > 2 THEN 'key_value'
            WHEN {commas} > 3 AND NOT contains(line, '{{') THEN 'csv'
            ELSE 'text' END AS line_format FROM objects)""",
        f"""grouped AS (SELECT *, CASE line_format WHEN 'plain_ts' THEN regexp_extract(line, {q(parse.PLAIN_TIMESTAMP)}, 4)
            WHEN 'key_value' THEN line END AS pair_text FROM formatted)""",
        f"""parsed AS (SELECT *, CASE line_format
              WHEN 'apache_or_nginx' THEN {names(access_names)}
              WHEN 'syslog' THEN {names(parse.SYSLOG_FIELDS)}
              WHEN 'plain_ts' THEN {names(parse.PLAIN_FIELDS)} || regexp_extract_all(pair_text, {kv}, 1)
              WHEN 'key_value' THEN list_reverse(regexp_extract_all(pair_text, {kv}, 1)) END AS names,
            CASE line_format
              WHEN 'apache_or_nginx' THEN {groups(parse.ACCESS_LOG, [1, 2, 3, 4, 5, 6, 7, 8, 3])}
              WHEN 'syslog' THEN {groups(parse.SYSLOG, [1, 2, 3, 4])}
              WHEN 'plain_ts' THEN {groups(parse.PLAIN_TIMESTAMP, [1, 2, 3, 4])} || regexp_extract_all(pair_text, {kv}, 2)
              WHEN 'key_value' THEN list_reverse(regexp_extract_all(pair_text, {kv}, 2)) END AS vals
            FROM grouped)""",
    ]


TIMESTAMP_TEXT = f"""CASE
  WHEN line_format = 'apache_or_nginx' THEN
    strftime(try_strptime({field('time_local')}, '%d/%b/%Y:%H:%M:%S +0000'), '%Y-%m-%dT%H:%M:%S+00:00')
  WHEN line_format = 'plain_ts' THEN
    strftime(try_strptime(vals[1], '%Y-%m-%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%S')
  WHEN line_format IN ('isp', 'json', 'key_value') THEN {field('timestamp')} END"""
EVENT_TS = "coalesce(TRY_CAST(timestamp AS TIMESTAMP), ts)"


def filled(*names: str, default: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({field(n)}, '')" for n in names) + f", {q(default)})"


def _features() -> str:
    def number(name: str, kind: str) -> str:
        return f"coalesce(TRY_CAST({field(name)} AS {kind}), 0)"

    def whole(name: str) -> str:
        return f"CAST(CASE WHEN {field(name)} LIKE '%.%' THEN 0 ELSE {number(name, 'INTEGER')} END AS INTEGER)"

    def metric(name: str) -> str:
        return f"CASE WHEN {field(name)} IS NOT NULL THEN coalesce(TRY_CAST({field(name)} AS DOUBLE), 0.0::DOUBLE) END AS {name}"

    def overwritten(name: str, default: str) -> str:
        return f"coalesce(CASE WHEN line_format IN ('isp', 'json', 'key_value') THEN {field(name)} END, {default})"

    raw = overwritten("raw_message", "line")
    return f"""features AS (SELECT line_index, stream_id, ts, {TIMESTAMP_TEXT} AS timestamp,
      {filled(*SOURCE_FIELDS, default='unknown')} AS source_ip,
      {filled('dst_ip', 'destination_ip', default='unknown')} AS destination_ip,
      CASE WHEN {field('customer_id')} IS NOT NULL THEN {filled('user', 'username', 'customer_id', default='')}
        ELSE 'unknown' END AS username,
      {filled('host', 'hostname', default='unknown')} AS hostname,
      {filled('pid', 'process', default='unknown')} AS process_id,
      coalesce({field('service')}, 'unknown') AS service, coalesce({field('protocol')}, 'unknown') AS protocol,
      coalesce(TRY_CAST(coalesce({field('dst_port')}, {field('port')}) AS INTEGER), 0) AS dst_port,
      {number('usage_mbps', 'DOUBLE')} AS usage_mbps, {whole('dropped_packets')} AS dropped_packets,
      {number('rtt_ms', 'DOUBLE')} AS rtt_ms, {filled('http_method', default='unknown')} AS http_method,
      {filled('request_uri', 'url', default='')} AS url, {whole('status')} AS status_code,
      {whole('body_bytes_sent')} AS bytes_sent, {filled('http_user_agent', default='')} AS user_agent,
      CAST(length({raw}) AS INTEGER) AS message_length,
      lower({filled('level', 'severity', default='info')}) AS severity, {overwritten('format', 'line_format')} AS format,
      coalesce(nullif({field('message')}, ''), nullif({raw}, ''), '') AS message,
      {', '.join(metric(m) for m in METRIC_FIELDS)},
      {search(raw, sig.OPERATIONAL_PATTERN)} AS has_operational, {raw} AS raw_message FROM parsed)"""


def lines_ctes() -> list[str]:
    return [_log_lines()]


def parsed_ctes() -> list[str]:
    return [_log_lines(), *_parsed()]


def feature_ctes() -> list[str]:
    return [*parsed_ctes(), _features()]


# ---- signatures ----------------------------------------------------------------------------------------------


def _rule_numbers(column: str, patterns: list[str], flags: str = "i") -> str:
    cases = ", ".join(f"CASE WHEN {search(column, p, flags)} THEN {i} END" for i, p in enumerate(patterns))
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _coded(source: str) -> str:
    return f"coded AS (SELECT *, {_rule_numbers('raw_message', [s.pattern for s in sig.SIGNATURES])} AS codes FROM {source})"


def _rules() -> str:
    rows = [(i, s.name, s.severity, s.mitre, s.category, sig.SEVERITY_BASE[s.severity] * 7 // 10)
            for i, s in enumerate(sig.SIGNATURES)]
    return values(rows, ["rule_no", "threat_type", "severity", "mitre", "category", "base"], "rules")


def hit_ctes(source: str = "log_lines") -> list[str]:
    base = lines_ctes() if source == "log_lines" else feature_ctes()
    slim = f"slim AS (SELECT line_index, stream_id, {'ts, source_ip, timestamp,' if source == 'features' else ''} raw_message FROM {source})"
    direct = " ".join(
        f"WHEN {i} THEN {has_any('lower(raw_message)', [w.lower() for w in sig.DIRECT_INDICATORS[s.name]])}"
        for i, s in enumerate(sig.SIGNATURES) if s.name in sig.DIRECT_INDICATORS
    )
    return [
        *base, slim, _coded("slim"), _rules(),
        "exploded AS (SELECT * EXCLUDE (codes), unnest(codes) AS rule_no FROM coded)",
        f"""hits AS (SELECT e.*, r.* EXCLUDE (rule_no), CASE rule_no {direct} ELSE FALSE END AS direct
            FROM exploded e JOIN rules r USING (rule_no))""",
    ]


JITTER = "(CAST(('0x' || substr(md5(raw_message || ':' || threat_type || ':' || line_index), 1, 8)) AS BIGINT) % 1000)"


def confidence(base: str, spread: str, direct: str, corroborated: str, model: str = "0") -> str:
    raw = f"(({base} + {spread} - {JITTER_CENTRE} + CASE WHEN {direct} THEN {DIRECT_BONUS} ELSE 0 END) * 100 + 15 * {model})"
    floor = f"CASE WHEN {corroborated} AND NOT {direct} THEN {FLOOR_CORROBORATED} ELSE {FLOOR_CONFIRMED} END"
    return f"((least({CAP * 100}, greatest({raw}, ({floor}) * 100)) + 500) // 1000)"


def _detection_ctes(models: bool = False) -> list[str]:
    needs_direct = ", ".join(q(t) for t in sig.DIRECT_EVIDENCE_REQUIRED)
    auth = " ".join(f"WHEN {q(t)} THEN {i}" for i, t in enumerate(sig.AUTH_PRIORITY))
    pairs = values(sig.SUPPRESSION_PAIRS, ["winner", "loser"], "pairs")
    first = " ".join(
        f"WHEN {q(t)} THEN coalesce(" + ", ".join(
            f"CASE WHEN contains(lower(raw_message), {q(w.lower())}) THEN {q(w)} END" for w in words) + ")"
        for t, words in sig.DIRECT_INDICATORS.items()
    )
    compliance = ", ".join(q(t) for t in sig.COMPLIANCE_THREATS)
    return [
        """known AS (SELECT stream_id, line_index, source_ip,
             CASE WHEN source_ip <> 'unknown' THEN source_ip END AS ip FROM features)""",
        """resolved AS (SELECT stream_id, line_index, source_ip,
             coalesce(ip,
               last_value(ip IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY line_index
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               first_value(ip IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY line_index
                 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 'unknown') AS resolved_ip FROM known)""",
        f"""keyed AS (SELECT h.* EXCLUDE (source_ip), r.resolved_ip AS source_ip, epoch_us({EVENT_TS}) AS time_us,
             {JITTER} AS jitter FROM hits h JOIN resolved r USING (stream_id, line_index))""",
        """stats AS (SELECT stream_id, source_ip, rule_no, count(*) AS hit_count, bool_or(direct) AS any_direct
             FROM keyed GROUP BY ALL)""",
        f"""scored AS (SELECT k.*, s.hit_count, s.any_direct,
             {confidence('k.base', 'k.jitter', 's.any_direct', 's.hit_count >= 2', 'm.model' if models else '0')} AS thousandths
             FROM keyed k JOIN stats s USING (stream_id, source_ip, rule_no)
             {'JOIN line_models m USING (stream_id, line_index)' if models else ''}
             WHERE k.direct OR k.threat_type NOT IN ({needs_direct}))""",
        f"""folded AS (SELECT stream_id, source_ip, rule_no, list_reduce(
               list(struct_pack(l := line_index, t := time_us, c := thousandths) ORDER BY line_index),
               lambda a, x: CASE WHEN abs(x.t - a.t) <= {sig.DEDUP_WINDOW_SECONDS * 1_000_000} AND x.c <= a.c THEN a ELSE x END
             ) AS kept FROM scored GROUP BY ALL)""",
        """kept AS (SELECT s.* FROM scored s JOIN folded f
             ON s.stream_id = f.stream_id AND s.source_ip = f.source_ip AND s.rule_no = f.rule_no AND s.line_index = f.kept.l)""",
        f"""ranked AS (SELECT *, CASE threat_type {auth} END AS place FROM kept)""",
        """auth_marked AS (SELECT *, coalesce(place = min(place) OVER (PARTITION BY stream_id, source_ip), TRUE) AS kept_auth
             FROM ranked)""",
        pairs,
        """survivors AS (SELECT * FROM auth_marked WHERE kept_auth)""",
        """suppressed_keys AS (SELECT DISTINCT w.stream_id, w.source_ip, p.loser AS threat_type
             FROM survivors w JOIN pairs p ON w.threat_type = p.winner)""",
        """marked AS (SELECT s.*, k.threat_type IS NOT NULL AS suppressed FROM survivors s
             LEFT JOIN suppressed_keys k USING (stream_id, source_ip, threat_type))""",
        f"""final AS (SELECT *, CASE WHEN threat_type IN ({compliance}) THEN 'COMPLIANCE' ELSE 'SECURITY_THREATS' END AS domain
             FROM marked WHERE NOT suppressed)""",
        values(narrative_rows(), ["threat_type", "explanation", "impact", "mitigation"], "notes"),
        f"""detections AS (SELECT stream_id, line_index, source_ip, threat_type, domain,
             CASE WHEN domain = 'COMPLIANCE' THEN 'Classification' ELSE 'Threat' END AS classification_type,
             CASE WHEN thousandths < 400 THEN 'NONE' WHEN thousandths < 700 THEN 'MONITOR'
               WHEN thousandths < 850 THEN 'SUSPICIOUS' ELSE 'CONFIRMED' END AS threat_status,
             severity, thousandths / 1000 AS confidence, threat_type AS label,
             CASE WHEN thousandths < 700 THEN 'MONITOR_ONLY'
               WHEN thousandths >= 850 AND severity IN ('high', 'critical') THEN 'CRITICAL' ELSE 'SUSPICIOUS' END AS status,
             category, CASE WHEN domain = 'SECURITY_THREATS' THEN mitre ELSE '{sig.NOT_APPLICABLE}' END AS mitre_attack,
             CASE WHEN domain = 'SECURITY_THREATS' THEN mitre ELSE '{sig.NOT_APPLICABLE}' END AS mitre_tactics,
             list_filter([
               CASE WHEN any_direct THEN coalesce('Direct indicator: ''' || (CASE threat_type {first} END) || '''',
                 'Direct signature match for ''' || threat_type || '''') END,
               CASE WHEN hit_count >= 2 THEN hit_count || ' corroborating log entries from same source' END,
               CASE WHEN NOT any_direct AND hit_count < 2 THEN 'Pattern match for ''' || threat_type || '''' END
             ], lambda x: x IS NOT NULL) AS evidence_list,
             explanation, impact, mitigation, make_timestamp(time_us) AS event_ts,
             coalesce(nullif(upper(regexp_extract(raw_message, {q(sig.CVE_MENTION_PATTERN)}, 1, 'i')), ''), 'N/A') AS cve_id,
             hit_count AS corroborating_count, raw_message
             FROM final LEFT JOIN notes USING (threat_type))""",
    ]


def detection_ctes() -> list[str]:
    return [*hit_ctes("features"), *_detection_ctes()]


def model_ctes(deviation: str, vector: str, moments: str) -> list[str]:
    """Detections with the scores of both line models, in ten-thousandths."""
    return [
        *hit_ctes("features"),
        f"vectors AS (SELECT stream_id, line_index, {vector} FROM features)",
        f"moments AS (SELECT {moments} FROM vectors)",
        """shares AS (SELECT format, severity, (sum(CASE WHEN len(codes) > 0 THEN 1 ELSE 0 END) * 20000 + count(*)) // (2 * count(*)) AS share
            FROM coded JOIN features USING (stream_id, line_index) GROUP BY ALL)""",
        f"""line_models AS (SELECT v.stream_id, v.line_index,
            floor(least({deviation}, 10.0::DOUBLE) * 1000 + 0.5)::BIGINT + share AS model
            FROM vectors v CROSS JOIN moments JOIN features f USING (stream_id, line_index) JOIN shares USING (format, severity))""",
        *_detection_ctes(models=True),
    ]


def _flags() -> str:
    exploit = next(i for i, s in enumerate(sig.SIGNATURES) if s.name == sig.EXPLOIT_THREAT)
    return f"""flags AS (SELECT c.*, {search('raw_message', sig.OPERATIONAL_PATTERN)} AND len(codes) = 0 AS operational_only,
        {search('raw_message', sig.MALICIOUS_CONTEXT_PATTERN)} AS malicious_context,
        {search('raw_message', sig.PASSIVE_VULNERABILITY_PATTERN)} AND NOT {search('raw_message', sig.ACTIVE_EXPLOIT_PATTERN)}
          AND len(list_filter(codes, lambda x: x <> {exploit})) = 0 AS passive_vulnerability_only FROM coded c)"""


def flag_ctes() -> list[str]:
    return [*hit_ctes("features"), _flags()]


def _conditions() -> str:
    text = "raw_message"
    high, loss, dns, band = (q(x) for x in sig.NETWORK_LABELS)
    outage, infra, route = (q(x) for x in sig.SERVICE_LABELS)
    net = [q(t) for t in NETWORK_CONDITION_NOTE]
    svc = [q(t) for t in SERVICE_CONDITION_NOTE]

    def either(a: str, b: str) -> str:
        return f"CASE WHEN network THEN {a} ELSE {b} END"

    return f"""conditions AS (SELECT stream_id, line_index, ts, source_ip, {either(high, "'Service Health Degraded'")} AS threat_type,
        {either("'NETWORK_PERFORMANCE'", "'SERVICE_HEALTH'")} AS domain, 'Condition' AS classification_type,
        'NONE' AS threat_status, 'low' AS severity, 0.6::DOUBLE AS confidence,
        CASE WHEN network THEN CASE WHEN {search(text, 'packet[ ]*loss|dropped_packets')} THEN {loss}
            WHEN {search(text, 'dns|nxdomain')} THEN {dns} WHEN {search(text, 'bandwidth|throughput')} THEN {band} ELSE {high} END
          ELSE CASE WHEN {search(text, 'rout(e|ing)')} THEN {route}
            WHEN {search(text, 'outage|unavailable|unstable')} THEN {outage}
            WHEN {search(text, 'fail|degradation')} THEN {infra} ELSE 'Service Health Degraded' END END AS label,
        'MONITOR_ONLY' AS status, '{sig.NOT_APPLICABLE}' AS mitre_attack,
        {either(net[0], svc[0])} AS explanation, {either(net[1], svc[1])} AS impact, {either(net[2], svc[2])} AS mitigation,
        raw_message FROM (SELECT *, {search(text, sig.NETWORK_CONDITION_PATTERN)} AS network FROM flags WHERE operational_only))"""


def everything_ctes() -> list[str]:
    return [*detection_ctes(), _flags(), _conditions()]


def _alerts() -> list[str]:
    number = "list_position([" + ", ".join(q(s.name) for s in sig.SIGNATURES) + "], threat_type)"
    return [
        f"""alerts AS (SELECT line_index * 64 + {number} AS id, stream_id, event_ts AS ts, threat_type AS alert_type, severity,
             'Detected ' || threat_type || ': ' || substr(raw_message, 1, 100) AS description, source_ip, confidence,
             mitre_attack AS mitre_tactic, domain, classification_type, threat_status,
             CASE WHEN severity IN ('high', 'critical') THEN explanation || ' Potential Impact: ' || impact
               || ' Recommended Mitigation: ' || mitigation END AS ai_summary FROM detections)""",
    ]


def _stored_alerts() -> list[str]:
    return [
        *_alerts(),
        """all_alerts AS (SELECT * FROM alerts UNION ALL BY NAME SELECT line_index * 64 AS id, stream_id, ts,
             threat_type AS alert_type, severity, 'Detected ' || threat_type || ': ' || substr(raw_message, 1, 100) AS description,
             source_ip, confidence, mitre_attack AS mitre_tactic, domain, classification_type, threat_status,
             NULL AS ai_summary FROM conditions)""",
        """stored AS (SELECT * REPLACE (CASE WHEN id % 5 <> 0 THEN threat_status END AS threat_status,
             CASE WHEN id % 15 = 0 THEN '' WHEN id % 10 <> 0 THEN mitre_tactic END AS mitre_tactic) FROM all_alerts)""",
        f"""judged AS (SELECT *, CASE WHEN threat_status IS NOT NULL THEN threat_status IN ('SUSPICIOUS', 'CONFIRMED')
             WHEN mitre_tactic IS NOT NULL THEN mitre_tactic NOT IN ('', '{sig.NOT_APPLICABLE}')
             ELSE severity IN ('high', 'critical') END AS is_threat FROM stored)""",
        "latest AS (SELECT * FROM judged ORDER BY ts DESC, id DESC LIMIT 50)",
        """recent AS (SELECT * FROM latest QUALIFY row_number() OVER
             (PARTITION BY alert_type, source_ip, severity ORDER BY ts DESC, id DESC) = 1)""",
        "ranged AS (SELECT * FROM judged WHERE ts >= (SELECT max(ts) FROM judged) - INTERVAL 60 MINUTE)",
    ]


def stored_alert_ctes() -> list[str]:
    return [*everything_ctes(), *_stored_alerts()]


def _vulnerabilities() -> list[str]:
    cases = ", ".join(f"CASE WHEN {has_any('lower(raw_message)', words)} THEN {q(key)} END" for key, words in SIGNALS)
    level = "CASE WHEN tenths > 800 THEN 'Critical' WHEN tenths > 600 THEN 'High' WHEN tenths > 300 THEN 'Medium' ELSE 'Low' END"
    return [
        values(FACTS, ["rule_key", "cve_id", "cvss_tenths", "severity", "description", "mitigation"], "facts"),
        f"""vuln_hits AS (SELECT * FROM (SELECT stream_id, line_index, hostname, unnest([{cases},
             CASE WHEN status_code >= 500 THEN '{SERVER_ERROR}' END]) AS rule_key FROM features) WHERE rule_key IS NOT NULL)""",
        f"""findings AS (SELECT v.stream_id, rule_key,
             CASE WHEN rule_key = '{SERVER_ERROR}' THEN 'Server Error Response (5xx)'
               ELSE 'Vulnerable Component Detected: ' || replace(rule_key, '_', ' ') END AS title,
             f.severity, f.cve_id, f.description, f.mitigation, f.cvss_tenths / 10 AS cvss_score,
             arg_min(hostname, line_index) AS affected_asset, min(line_index) AS first_line,
             CASE WHEN rule_key = '{SERVER_ERROR}' THEN 100 ELSE f.cvss_tenths * 3 END AS risk_tenths
             FROM vuln_hits v JOIN facts f USING (rule_key) GROUP BY ALL)""",
        f"""risks AS (SELECT *, {level} AS risk_level FROM (SELECT stream_id, count(*) AS findings,
             least(1000, sum(risk_tenths)) AS tenths FROM findings GROUP BY stream_id))""",
        """old_rows AS (SELECT cve_id, description, CASE WHEN cvss_score > 8 THEN cvss_score - 1 ELSE cvss_score END AS cvss_score,
             severity, mitigation FROM findings WHERE stream_id = 0)""",
        "new_rows AS (SELECT DISTINCT cve_id, description, cvss_score, severity, mitigation FROM findings)",
        """upserted AS (SELECT cve_id, coalesce(n.description, o.description) AS description,
             coalesce(n.cvss_score, o.cvss_score) AS cvss_score, coalesce(n.severity, o.severity) AS severity,
             coalesce(n.mitigation, o.mitigation) AS mitigation,
             CASE WHEN o.severity IS NULL THEN 'inserted' WHEN n.severity IS NULL THEN 'unchanged'
               WHEN (o.description, o.cvss_score, o.severity, o.mitigation) IS DISTINCT FROM
                    (n.description, n.cvss_score, n.severity, n.mitigation) THEN 'updated' ELSE 'unchanged' END AS change
             FROM old_rows o FULL JOIN new_rows n USING (cve_id))""",
    ]


def vulnerability_ctes() -> list[str]:
    return [*feature_ctes(), *_vulnerabilities()]


def _strict() -> list[str]:
    low = "lower(raw_message)"
    types = ", ".join(q(t) for t in sig.STRICT_EVIDENCE_TYPES)
    return [
        f"""strict0 AS (SELECT d.*, r.mitre AS technique,
             count(*) OVER (PARTITION BY stream_id, source_ip, threat_type) - 1 AS peers,
             d.threat_type IN ({types}) AS strict_type,
             {has_any(low, sig.STRICT_PERFORMANCE_WORDS)} AND NOT {has_any(low, sig.STRICT_MALICIOUS_WORDS)} AS operational
             FROM detections d JOIN (SELECT threat_type, mitre FROM rules) r USING (threat_type))""",
        f"""strict1 AS (SELECT *, CASE WHEN strict_type AND NOT {has_any(low, sig.STRICT_EXPLICIT_WORDS)}
               THEN confidence * 0.7::DOUBLE ELSE confidence END AS weakened,
             (peers >= 1)::INT + {has_any(low, sig.STRICT_BLOCK_WORDS)}::INT + {has_any(low, sig.STRICT_AUTH_WORDS)}::INT
               + (severity IN ('high', 'critical'))::INT AS support FROM strict0)""",
        """strict2 AS (SELECT *, CASE WHEN support >= 2 THEN least(1.0::DOUBLE, weakened * 1.2::DOUBLE) ELSE weakened END AS score
             FROM strict1)""",
        """strict3 AS (SELECT *, CASE WHEN score >= 0.85::DOUBLE THEN 'Confirmed' WHEN score >= 0.7::DOUBLE THEN 'Suspicious'
               WHEN score >= 0.4::DOUBLE OR strict_type THEN 'Monitor' ELSE 'Informational' END AS strict_status,
             CAST(floor(score * 100) AS INTEGER) AS percent FROM strict2)""",
        """reported AS (SELECT *, CASE strict_status WHEN 'Confirmed' THEN 'Critical' WHEN 'Suspicious' THEN 'High'
               ELSE 'Medium' END AS strict_severity FROM strict3 WHERE NOT operational AND strict_status <> 'Informational'
             QUALIFY row_number() OVER (PARTITION BY stream_id, threat_type, source_ip, strict_status ORDER BY line_index) = 1)""",
    ]


def _simple() -> str:
    hit = search("line", SIMPLE_LINE_PATTERN, "")
    parts = [f"CASE WHEN {hit} THEN regexp_extract(line, {q(SIMPLE_LINE_PATTERN)}, {i}) END" for i in range(1, 5)]
    return f"""simple AS (SELECT line_index, stream_id, line, {parts[0]} AS line_time, {parts[1]} AS level, {parts[2]} AS source,
        coalesce({parts[3]}, line) AS message FROM (SELECT *, trim(raw_message, {BLANKS}) AS line FROM log_lines))"""


def _tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), {q(TOKEN_PATTERN)}), lambda t: length(t) > 1)"


def _bayes() -> list[str]:
    sums = []
    for x in LABELS:
        prior = f"ln((coalesce((SELECT n FROM examples WHERE label = '{x}'), 0) + 1)::DOUBLE / ((SELECT sum(n) FROM examples) + 3))"
        sums.append(f"{prior} + coalesce(sum(ln((coalesce(m.n_{x}, 0) + 1)::DOUBLE / (w.w_{x} + w.v))), 0) AS score_{x}")
    counts = ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS n_{x}" for x in LABELS)
    totals = ", ".join(f"sum(n_{x}) AS w_{x}" for x in LABELS)
    label = " ".join(f"WHEN score_{x} = top THEN '{x}'" for x in LABELS)
    total = " + ".join(f"exp(score_{x} - top)" for x in LABELS)
    indicators = _rule_numbers("message", [p for *_, p in COARSE_INDICATORS])
    return [
        values(TRAINING_LINES, ["text", "label"], "training"),
        "examples AS (SELECT label, count(*) AS n FROM training GROUP BY label)",
        f"model AS (SELECT token, {counts} FROM (SELECT label, unnest({_tokens('text')}) AS token FROM training) GROUP BY token)",
        f"words AS (SELECT {totals}, count(*) AS v FROM model)",
        f"filled AS (SELECT * FROM simple WHERE line <> '')",
        f"bags AS (SELECT line_index, unnest({_tokens('message')}) AS token FROM filled)",
        f"""scores AS (SELECT line_index, {', '.join(sums)} FROM bags LEFT JOIN model m USING (token) CROSS JOIN words w
             GROUP BY line_index)""",
        f"""predicted AS (SELECT f.* EXCLUDE (line), CASE WHEN s.line_index IS NULL THEN 'benign' {label} END AS ml_label,
             CASE WHEN s.line_index IS NULL THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE / ({total}), 2) END AS confidence,
             {indicators} AS found FROM filled f LEFT JOIN
             (SELECT *, greatest({', '.join(f'score_{x}' for x in LABELS)}) AS top FROM scores) s USING (line_index))""",
    ]


def quality_ctes() -> list[str]:
    expected = " ".join(f"WHEN {n} THEN {q(t)}" for n, t in EXPECTED.items())
    return [
        *hit_ctes(),
        """first_hit AS (SELECT line_index, arg_min(threat_type, rule_no) AS prediction FROM hits GROUP BY line_index)""",
        f"""judged AS (SELECT event_id AS line_index, CASE event_id % {len(TEMPLATES)} {expected} ELSE 'benign' END AS label,
             coalesce(prediction, 'benign') AS prediction FROM events LEFT JOIN first_hit ON event_id = line_index)""",
        "confused AS (SELECT label, prediction, count(*) AS n FROM judged GROUP BY ALL)",
        """per_class AS (SELECT class, sum(support)::BIGINT AS support, sum(predicted) AS predicted, sum(hit) AS hit FROM (
             SELECT label AS class, n AS support, 0 AS predicted, CASE WHEN label = prediction THEN n ELSE 0 END AS hit FROM confused
             UNION ALL SELECT prediction, 0, n, 0 FROM confused) GROUP BY class)""",
        """measured AS (SELECT class, support, hit, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END::DOUBLE AS precision,
             CASE WHEN support > 0 THEN hit / support ELSE 0 END::DOUBLE AS recall,
             CASE WHEN predicted + support > 0 THEN 2 * hit / (predicted + support) ELSE 0 END::DOUBLE AS f1 FROM per_class)""",
    ]


def _files() -> list[str]:
    breaks = q(codescan.LINE_BREAK)
    return [
        """files AS (SELECT 'docs/' || doc_id || e AS path, e AS extension, text AS content FROM
             (SELECT *, (['.py', '.js', '.java', '.ts'])[doc_id % 4 + 1] AS e FROM documents)
             UNION ALL SELECT 'pages/' || page_id || e, e, html FROM
             (SELECT *, CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.js' END AS e FROM pages)
             UNION ALL SELECT 'src/' || event_id || e, e, CASE WHEN event_id % """ + str(LONG_SNIPPET_EVERY) + """ = 0
               THEN repeat(E'x = 1\\n', """ + str(LONG_SNIPPET_LINES) + """) ELSE replace(t, '{n}', event_id::VARCHAR) END FROM
             (SELECT event_id, ([""" + ", ".join(q(e) for e, _ in SNIPPETS) + f"""])[event_id % {len(SNIPPETS)} + 1] AS e,
                ([""" + ", ".join(q(t) for _, t in SNIPPETS) + f"""])[event_id % {len(SNIPPETS)} + 1] AS t FROM events))""",
        f"""pieces AS (SELECT *, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS kept FROM
             (SELECT *, string_split_regex(content, {breaks}) AS parts FROM files))""",
        "code_lines AS (SELECT path, extension, unnest(kept) AS text, unnest(range(1, len(kept) + 1)) AS line FROM pieces)",
    ]


def code_ctes() -> list[str]:
    cases = []
    for i, r in enumerate(CODE_RULES):
        guard = f"extension IN ({', '.join(q(e) for e in r.extensions)}) AND " if r.extensions else ""
        cases.append(f"CASE WHEN {guard}{search('text', r.pattern, 'c')} THEN {i} END")
    rules = values([(i, r.category, r.severity, r.description) for i, r in enumerate(CODE_RULES)],
                   ["rule", "category", "severity", "description"], "code_rules")
    comment = f"(starts_with(ltrim(text, {BLANKS}), '#') OR starts_with(ltrim(text, {BLANKS}), '//'))"
    facts = {"large": (LARGE_FILE, "lines > 500"), "todo": (OPEN_TODO, "todo AND extension = '.py'"),
             "dense": (COMMENT_DENSITY, "comments / lines > 0.35::DOUBLE")}
    file_rows = " UNION ALL ".join(
        f"SELECT path, 1::BIGINT AS line, {', '.join(f'{q(v)} AS {n}' for v, n in zip(f, ('category', 'severity', 'description', 'snippet')))} "
        f"FROM sizes WHERE {condition}" for f, condition in facts.values()
    )
    return [
        *_files(), rules,
        f"""line_found AS (SELECT path, line, category, severity, description, trim(text, {BLANKS}) AS snippet FROM
             (SELECT *, unnest([{', '.join(cases)}]) AS rule FROM code_lines) JOIN code_rules USING (rule))""",
        f"""sizes AS (SELECT path, extension, count(*) AS lines, count(*) FILTER (WHERE {comment}) AS comments,
             bool_or(contains(text, 'TODO') OR contains(text, 'FIXME')) AS todo FROM code_lines GROUP BY ALL)""",
        f"file_found AS ({file_rows})",
        "all_found AS (SELECT * FROM line_found UNION ALL BY NAME SELECT * FROM file_found)",
    ]


def _split_documents(numbered: bool) -> str:
    body = f"trim(text, {BLANKS})" if numbered else "text"
    parts = f"list_transform(string_split_regex({body}, {q(LINE_BREAKS)}), lambda x: trim(x, {BLANKS}))"
    if numbered:
        return f"""SELECT doc_id, n AS line_number, line FROM (SELECT doc_id, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS n
            FROM (SELECT doc_id, {parts} AS p FROM documents)) WHERE line <> ''"""
    return f"""SELECT doc_id, unnest(range(1, len(p) + 1)) AS line_number, unnest(p) AS line FROM (
        SELECT doc_id, CASE WHEN len(p) = 0 THEN [trim(text, {BLANKS})] ELSE p END AS p FROM (
          SELECT doc_id, text, list_filter({parts}, lambda x: x <> '') AS p FROM documents))"""


def _window_totals(keys: str, source: str) -> str:
    low = "lower(raw_message)"
    failed = f"(contains({low}, 'failed') AND (contains({low}, 'password') OR contains({low}, 'login')))"
    return f"""SELECT {keys}, count(*) AS total_events,
        count(DISTINCT CASE WHEN source_ip <> 'unknown' THEN source_ip END) AS unique_sources,
        count(DISTINCT CASE WHEN username <> 'unknown' THEN username END) AS unique_users,
        sum(message_length) / count(*) AS avg_message_length,
        count(*) FILTER (WHERE {failed}) AS failed_login_count,
        count(DISTINCT CASE WHEN {failed} AND source_ip <> 'unknown' THEN source_ip END) AS suspicious_auth_sources
        FROM {source} GROUP BY {keys}"""


def _risk() -> str:
    low = "lower(raw_message)"
    many, some = "failed_logins > 30", "failed_logins > 5"
    spiking = "cpu_spikes > 5 AND network_spikes > 5"
    by_logins = f"CASE WHEN {many} THEN {q(risk.CATEGORY_MANY)} WHEN {some} THEN {q(risk.CATEGORY_SOME)} END"
    return with_ctes(
        *lines_ctes(), _health(),
        f"""a AS (SELECT stream_id, date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE contains({low}, 'failed')
             AND (contains({low}, 'password') OR contains({low}, 'login'))) AS failed_logins FROM log_lines GROUP BY ALL)""",
        """b AS (SELECT stream_id, date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE cpu_usage > 85) AS cpu_spikes,
             count(*) FILTER (WHERE network_tx > 20000 OR network_rx > 20000) AS network_spikes FROM health GROUP BY ALL)""",
        """c AS (SELECT stream_id, hour, coalesce(failed_logins, 0) AS failed_logins, coalesce(cpu_spikes, 0) AS cpu_spikes,
             coalesce(network_spikes, 0) AS network_spikes FROM a FULL JOIN b USING (stream_id, hour))""",
        f"""d AS (SELECT *, CASE WHEN {many} THEN 40 WHEN {some} THEN 20 ELSE 0 END + CASE WHEN {spiking} THEN 45 ELSE 0 END
             AS risk_score FROM c)""",
    ) + f"""SELECT stream_id, hour, failed_logins, cpu_spikes, network_spikes, risk_score,
        CASE WHEN {spiking} THEN coalesce({by_logins} || {q(risk.CATEGORY_SUFFIX)}, {q(risk.CATEGORY_SPIKES)})
          ELSE coalesce({by_logins}, {q(risk.CATEGORY_NONE)}) END AS predicted_attack_category,
        CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS forecasted_likelihood,
        CASE WHEN risk_score > 0 THEN least(100, risk_score + 10) / 100 ELSE 0 END::DOUBLE AS confidence_score,
        CASE WHEN {many} THEN {q(risk.TARGET_MANY)} WHEN {some} THEN {q(risk.TARGET_SOME)}
          WHEN {spiking} THEN {q(risk.TARGET_SPIKES)} ELSE 'None' END AS predicted_target,
        CASE WHEN {spiking} THEN {q(risk.ACTION_SPIKES)} WHEN {many} THEN {q(risk.ACTION_MANY)}
          ELSE {q(risk.ACTION_NONE)} END AS recommended_action FROM d"""


def _health() -> str:
    cents = "CAST(round(value * 100) AS BIGINT)"
    shown = "event_type IN ('view', 'click')"
    return f"""health AS (SELECT min(event_id) AS id, user_id % {STREAMS} AS stream_id, date_trunc('hour', ts) AS ts,
        least(100.0::DOUBLE, max({cents})::DOUBLE / 100) AS cpu_usage,
        least(100.0::DOUBLE, sum({cents})::DOUBLE / count({cents}) / 100) AS memory_usage,
        coalesce(sum({cents}) FILTER (WHERE {shown}), 0)::DOUBLE / 100 AS network_tx,
        coalesce(sum({cents}) FILTER (WHERE NOT {shown}), 0)::DOUBLE / 100 AS network_rx,
        count(DISTINCT user_id)::INTEGER AS active_connections FROM events GROUP BY user_id % {STREAMS}, date_trunc('hour', ts))"""


def _fields(formats: list[str], names: list[str]) -> str:
    picked = ", ".join(f"{field(n)} AS {n}" for n in names)
    return with_ctes(*parsed_ctes()) + (
        f"SELECT line_index, {picked} FROM parsed WHERE line_format IN ({', '.join(q(f) for f in formats)})"
    )


DASHBOARD = "id, ts, alert_type, severity, description, source_ip, mitre_tactic, domain, classification_type, threat_status"


def oracles() -> dict[str, str]:
    """SQL by query name."""
    vector = ", ".join(
        f"coalesce({c}::DOUBLE, 0) AS {c}" for c in VECTOR_FIELDS
    )
    scaled = ", ".join(
        f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 5) AS {c}" for c in VECTOR_FIELDS
    )
    deviation = "round(greatest(" + ", ".join(
        f"abs(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)" for c in VECTOR_FIELDS
    ) + "), 4)"
    moments = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in VECTOR_FIELDS)
    coarse = values([(i, n, s, k) for i, (n, s, k, _) in enumerate(COARSE_INDICATORS)],
                    ["rule", "indicator", "severity", "type"], "coarse")
    indicator_names = "array_to_string(list_transform(found, lambda i: ([" + ", ".join(
        q(n) for n, *_ in COARSE_INDICATORS) + "])[i + 1]), '|')"
    summary_case = f"""CASE WHEN n.threat_type IS NOT NULL THEN n.explanation || ' Potential Impact: ' || n.impact
        || ' Recommended Mitigation: ' || n.mitigation ELSE 'Activity of type ''' || alert_type || ''' was seen. Potential Impact: '
        || {q(DEFAULT_IMPACT)} || ' Recommended Mitigation: ' || {q(DEFAULT_MITIGATION)} END"""
    detection = detection_ctes()
    strict_all = [*detection, *_strict()]
    sessions = [
        *detection,
        """gaps AS (SELECT *, CASE WHEN time_us - lag(time_us) OVER w > 60000000 THEN 1 ELSE 0 END AS starts FROM keyed
             WINDOW w AS (PARTITION BY stream_id, source_ip, threat_type ORDER BY time_us, line_index))""",
        """runs AS (SELECT *, sum(starts) OVER (PARTITION BY stream_id, source_ip, threat_type ORDER BY time_us, line_index
             ROWS UNBOUNDED PRECEDING) AS run FROM gaps)""",
        """sessions AS (SELECT stream_id, source_ip, threat_type, run, base, count(*) AS hits, bool_or(direct) AS any_direct,
             min(time_us) AS first_us, max(time_us) AS last_us, max(jitter) AS jitter,
             arg_min(line_index, -jitter * 1000000000 + line_index) AS line_index FROM runs GROUP BY ALL)""",
    ]
    scan = [
        *everything_ctes(),
        """findings AS (SELECT stream_id, threat_type, source_ip, severity, threat_status, line_index, domain,
             classification_type, confidence, mitre_attack FROM detections UNION ALL BY NAME
             SELECT stream_id, threat_type, source_ip, severity, threat_status, line_index, domain, classification_type,
             confidence, mitre_attack FROM conditions)""",
        """split AS (SELECT *, (threat_status IN ('SUSPICIOUS', 'CONFIRMED') AND domain = 'SECURITY_THREATS')
             OR (classification_type IN ('Threat', 'Classification') AND domain IN ('SECURITY_THREATS', 'COMPLIANCE')) AS is_threat
             FROM findings QUALIFY row_number() OVER (PARTITION BY stream_id, threat_type, source_ip, severity, threat_status
               ORDER BY line_index) = 1)""",
    ]
    clean = CLEAN_SUMMARY
    return {
        "raw_lines": with_ctes(*lines_ctes()) + "SELECT * FROM log_lines",
        "given_text": with_ctes(_given_lines()) + "SELECT * FROM log_lines",
        "given_features": with_ctes(*given(feature_ctes())) + "SELECT * FROM features",
        "given_formats": with_ctes(*given(parsed_ctes())) + """SELECT line_format, count(*) AS n, count(DISTINCT stream_id) AS streams
            FROM parsed GROUP BY 1""",
        "given_totals": with_ctes(*given(feature_ctes())) + _window_totals("stream_id", "features"),
        "given_signatures": with_ctes(*given(hit_ctes())) + """SELECT threat_type, severity, count(*) AS n,
            count(*) FILTER (WHERE direct) AS direct_hits, count(DISTINCT stream_id) AS streams FROM hits GROUP BY ALL""",
        "given_detections": with_ctes(*given(detection)) + """SELECT stream_id, line_index, source_ip, threat_type, severity,
            confidence, threat_status, corroborating_count, event_ts FROM detections""",
        "health_snapshots": with_ctes(_health()) + "SELECT * FROM health",
        "text_lines": _split_documents(False),
        "numbered_text_lines": _split_documents(True),
        "log_format_counts": with_ctes(*parsed_ctes()) + "SELECT line_format, count(*) AS n FROM parsed GROUP BY 1",
        "json_fields": _fields(["isp", "json"], ["timestamp", "level", "severity", "service", "src_ip", "message", "msg", "ts", "format"]),
        "event_properties": "SELECT event_id, CASE WHEN json_valid(props) THEN 'json' ELSE 'text' END AS line_format, "
                            "json_extract_string(props, '$.k') AS k FROM events",
        "access_log": _fields(["apache_or_nginx"], ["remote_addr", "time_local", "http_method", "request_uri", "status",
                                                    "body_bytes_sent", "http_referer", "http_user_agent"]),
        "syslog_fields": _fields(["syslog"], ["time_local", "hostname", "process", "message"]),
        "plain_ts_fields": _fields(["plain_ts"], ["timestamp", "hostname", "level", "message", "src_ip", "signature",
                                                  "packet_loss", "action"]),
        "kv_pairs": with_ctes(*parsed_ctes()) + """SELECT line_index, name, vals[list_position(names, name)] AS value FROM
            (SELECT line_index, names, vals, unnest(list_distinct(names)) AS name FROM parsed WHERE line_format = 'key_value')""",
        "csv_fields": with_ctes(*parsed_ctes()) + f"""SELECT line_index, unnest(range(0, len(p))) AS position, unnest(p) AS value FROM
            (SELECT line_index, list_transform(string_split(line, ','), lambda x: trim(x, {BLANKS})) AS p FROM parsed
             WHERE line_format = 'csv')""",
        "parsed_timestamps": with_ctes(*parsed_ctes()) + f"""SELECT line_index, timestamp, {EVENT_TS} AS event_ts FROM
            (SELECT line_index, ts, {TIMESTAMP_TEXT} AS timestamp FROM parsed)""",
        "simple_line_fields": with_ctes(*lines_ctes(), _simple()) + "SELECT * EXCLUDE (line) FROM simple",
        "log_features": with_ctes(*feature_ctes()) + "SELECT * FROM features",
        "window_totals": with_ctes(*feature_ctes()) + _window_totals("stream_id", "features"),
        "sliding_window_totals": with_ctes(*feature_ctes()) + _window_totals(
            "stream_id, window_start", """(SELECT *, date_trunc('minute', ts) - to_minutes(unnest(range(0, 5))) AS window_start
            FROM features)"""),
        "signature_hits": with_ctes(*hit_ctes()) + "SELECT line_index, threat_type, severity FROM hits",
        "signature_counts": with_ctes(*hit_ctes()) + """SELECT threat_type, severity, count(*) AS n,
            count(*) FILTER (WHERE direct) AS direct_hits FROM hits GROUP BY ALL""",
        "document_signatures": with_ctes(
            f"split AS ({_split_documents(False)})",
            "texts AS (SELECT doc_id, line AS raw_message FROM split)", _coded("texts"), _rules(),
        ) + """SELECT threat_type, severity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM
            (SELECT doc_id, unnest(codes) AS rule_no FROM coded) JOIN rules USING (rule_no) GROUP BY ALL""",
        "direct_hits": with_ctes(*hit_ctes()) + "SELECT line_index, threat_type FROM hits WHERE direct",
        "operational_flag": with_ctes(*flag_ctes()) + """SELECT line_index, f.has_operational, operational_only, malicious_context
            FROM flags JOIN features f USING (line_index)""",
        "passive_vuln_flag": with_ctes(*flag_ctes()) + "SELECT line_index, passive_vulnerability_only FROM flags",
        "network_conditions": with_ctes(*flag_ctes(), _conditions()) + "SELECT * FROM conditions",
        "cve_mentions": with_ctes(*lines_ctes()) + f"""SELECT line_index,
            upper(regexp_extract(raw_message, {q(sig.CVE_MENTION_PATTERN)}, 1, 'i')) AS cve_id FROM log_lines
            WHERE {search('raw_message', sig.CVE_MENTION_PATTERN)}""",
        "ip_resolution": with_ctes(*detection) + "SELECT stream_id, line_index, source_ip, resolved_ip FROM resolved",
        "threat_occurrences": with_ctes(*detection) + """SELECT stream_id, source_ip, threat_type, count(*) AS occurrences,
            bool_or(direct) AS any_direct FROM keyed GROUP BY ALL""",
        "confidence_jitter": with_ctes(*hit_ctes()) + f"SELECT line_index, threat_type, CAST({JITTER} - 500 AS INTEGER) AS jitter FROM hits",
        "dedup_fold": with_ctes(*detection) + """SELECT stream_id, source_ip, rule_no, hit_count AS hits, any_direct, line_index,
            jitter::INTEGER AS jitter FROM kept""",
        "dedup_sessions": with_ctes(*sessions) + f"""SELECT stream_id, source_ip, threat_type, hits, any_direct, first_us, last_us,
            jitter::INTEGER AS jitter, line_index, {confidence('base', 'jitter', 'any_direct', 'hits >= 2')} / 1000 AS confidence
            FROM sessions""",
        "session_peers": with_ctes(*sessions) + """SELECT stream_id, source_ip, threat_type, first_us,
            count(*) OVER (PARTITION BY stream_id, source_ip, threat_type) - 1 AS peers FROM sessions""",
        "escalations": with_ctes(*detection) + """SELECT stream_id, source_ip, threat_type, time_us, recent,
            'CONFIRMED' AS threat_status FROM (SELECT DISTINCT stream_id, source_ip, threat_type, time_us,
              count(*) OVER (PARTITION BY stream_id, source_ip, threat_type ORDER BY time_us
                RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS recent FROM keyed) WHERE recent >= 3""",
        "auth_disambiguation": with_ctes(*detection) + "SELECT stream_id, source_ip, threat_type, kept_auth FROM auth_marked",
        "category_suppression": with_ctes(*detection) + "SELECT stream_id, source_ip, threat_type, suppressed FROM marked",
        "detections": with_ctes(*detection) + """SELECT * EXCLUDE (evidence_list), array_to_string(evidence_list, '|') AS evidence
            FROM detections""",
        "model_detections": with_ctes(*model_ctes(deviation.replace("abs((", "abs((v."), vector, moments)) + """SELECT stream_id, line_index,
            source_ip, threat_type, confidence, threat_status, status, corroborating_count FROM detections""",
        "evidence": with_ctes(*detection) + """SELECT line_index, threat_type, unnest(range(0, len(evidence_list))) AS position,
            unnest(evidence_list) AS evidence FROM detections""",
        "alerts_projection": with_ctes(*detection, *_alerts()) + "SELECT * FROM alerts",
        "alert_summaries": with_ctes(*hit_ctes(), values(narrative_rows(), ["threat_type", "explanation", "impact", "mitigation"], "notes"))
        + f"""SELECT alert_type, c.n, {summary_case} AS summary FROM (SELECT alert_type, count(*) AS n FROM
            (SELECT threat_type AS alert_type FROM hits UNION ALL SELECT event_type FROM events) GROUP BY 1) c
            LEFT JOIN notes n ON n.threat_type = alert_type""",
        "alert_export": with_ctes(*detection, *_alerts()) + """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "Timestamp",
            alert_type AS "Threat Type", severity AS "Severity", source_ip AS "Source IP", printf('%.2f', confidence) AS "Confidence",
            mitre_tactic AS "MITRE Tactic", coalesce(ai_summary, 'N/A') AS "AI Analysis", description AS "Raw Description" FROM alerts""",
        "latest_alerts": with_ctes(*stored_alert_ctes()) + "SELECT id, ts, alert_type, severity, source_ip, confidence FROM latest",
        "attack_timeline": with_ctes(*stored_alert_ctes()) + """SELECT date_trunc('minute', ts) AS minute,
            count(*) OVER (PARTITION BY date_trunc('minute', ts)) AS threats, alert_type, severity, source_ip, mitre_tactic
            FROM ranged WHERE is_threat ORDER BY minute, id""",
        "attack_timeline_threats": with_ctes(*stored_alert_ctes()) + """SELECT date_trunc('minute', ts) AS minute, alert_type, severity,
            source_ip, mitre_tactic FROM ranged WHERE is_threat""",
        "dashboard_threats": with_ctes(*stored_alert_ctes()) + f"SELECT {DASHBOARD} FROM recent WHERE is_threat ORDER BY ts DESC, id DESC LIMIT 15",
        "dashboard_conditions": with_ctes(*stored_alert_ctes()) + f"SELECT {DASHBOARD} FROM recent WHERE NOT is_threat ORDER BY ts DESC, id DESC LIMIT 10",
        "dashboard_kpis": with_ctes(*stored_alert_ctes(), _health()) + """SELECT h.cpu_usage, h.memory_usage, h.active_connections, k.* FROM
            (SELECT count(*) FILTER (WHERE is_threat) AS security_threat_count, count(*) FILTER (WHERE NOT is_threat) AS condition_count,
              coalesce(round(sum(round(confidence * 1000)) FILTER (WHERE is_threat) / nullif(count(*) FILTER (WHERE is_threat), 0) / 10, 1), 0)
                AS aggregate_threat_probability,
              CASE WHEN bool_or(is_threat AND threat_status IS NOT DISTINCT FROM 'CONFIRMED') THEN 'CONFIRMED'
                WHEN bool_or(is_threat) THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS security_status,
              CASE WHEN bool_or(NOT is_threat) THEN 'DEGRADED' ELSE 'NORMAL' END AS network_status,
              CASE WHEN bool_or(is_threat AND severity IN ('high', 'critical')) THEN 'IMPACTED' ELSE 'OPERATIONAL' END AS service_status
             FROM recent) k CROSS JOIN (SELECT * FROM health ORDER BY ts DESC, id DESC LIMIT 1) h""",
        "predictive_risk": _risk(),
        "scan_split": with_ctes(*scan) + "SELECT * FROM split",
        "threat_summary": with_ctes(
            *scan,
            """per_type AS (SELECT stream_id, threat_type, min(line_index) AS first_line FROM split WHERE is_threat GROUP BY ALL)""",
            """named AS (SELECT stream_id, list(threat_type ORDER BY first_line, threat_type) AS threats FROM per_type GROUP BY 1)""",
            """tops AS (SELECT * FROM split WHERE is_threat QUALIFY row_number() OVER
                 (PARTITION BY stream_id ORDER BY confidence DESC, line_index, threat_type DESC) = 1)""",
            """totals AS (SELECT stream_id, count(*) FILTER (WHERE is_threat) AS security_threat_count,
                 count(*) FILTER (WHERE NOT is_threat) AS condition_count,
                 coalesce(round_even(sum(round(confidence * 1000)) FILTER (WHERE is_threat)
                   / count(*) FILTER (WHERE is_threat) / 10, 0), 0)::INTEGER AS probability FROM split GROUP BY 1)""",
        ) + f"""SELECT stream_id, security_threat_count, condition_count, probability,
            CASE WHEN n.threats IS NULL THEN 'clean' ELSE 'threat' END AS status,
            CASE WHEN n.threats IS NULL THEN {q(clean)} WHEN len(n.threats) = 1 THEN 'Security threat ''' || n.threats[1] || ''' detected in logs.'
              ELSE 'Multiple security threats detected: ' || array_to_string(n.threats, ', ') || '.' END AS reason,
            x.threat_type AS top_threat, coalesce(x.confidence, 0) AS top_confidence, coalesce(x.severity, 'LOW') AS top_severity
            FROM totals t LEFT JOIN named n USING (stream_id) LEFT JOIN tops x USING (stream_id)""",
        "vulnerability_hits": with_ctes(*vulnerability_ctes()) + "SELECT * FROM vuln_hits",
        "vulnerability_findings": with_ctes(*vulnerability_ctes()) + """SELECT * EXCLUDE (risk_tenths), risk_tenths / 10 AS risk_contribution
            FROM findings""",
        "risk_score": with_ctes(*vulnerability_ctes()) + """SELECT stream_id, findings, tenths / 10 AS overall_risk_score, risk_level
            FROM risks""",
        "vulnerability_upsert": with_ctes(*vulnerability_ctes()) + "SELECT * FROM upserted",
        "vulnerability_export": with_ctes(*vulnerability_ctes()) + """SELECT cve_id AS "CVE ID", description AS "Description",
            printf('%.1f', cvss_score) AS "CVSS Score", severity AS "Severity", mitigation AS "Mitigation" FROM upserted""",
        "stored_risk": with_ctes(*vulnerability_ctes()) + """SELECT findings, tenths / 10 AS overall_risk_score,
            CASE WHEN tenths > 800 THEN 'Critical' WHEN tenths > 600 THEN 'High' WHEN tenths > 300 THEN 'Medium' ELSE 'Low' END AS risk_level
            FROM (SELECT count(*) AS findings, least(1000, sum(round(cvss_score * 10)::INTEGER * 3)) AS tenths FROM upserted)""",
        "strict_findings": with_ctes(*strict_all) + """SELECT stream_id, threat_type, source_ip, strict_status, line_index, event_ts, domain,
            strict_severity, percent, technique, array_to_string(evidence_list, '|') AS evidence, explanation, impact, mitigation
            FROM reported""",
        "strict_summary": with_ctes(*strict_all) + """SELECT stream_id, count(strict_status) AS total_findings,
            count(*) FILTER (WHERE strict_status = 'Confirmed') AS confirmed_threats,
            count(*) FILTER (WHERE strict_status = 'Suspicious') AS suspicious_threats,
            count(*) FILTER (WHERE strict_status = 'Monitor') AS monitor_items, sum(c)::BIGINT AS operational_conditions,
            coalesce(floor(avg(percent) FILTER (WHERE strict_status = 'Confirmed')), 0)::INTEGER AS threat_score
            FROM (SELECT stream_id, strict_status, percent, 0 AS c FROM reported UNION ALL
                  SELECT stream_id, NULL, NULL, 1 FROM strict3 WHERE operational) GROUP BY stream_id""",
        "coarse_indicators": with_ctes(*lines_ctes(), _simple(), coarse) + f"""SELECT line_index, indicator, severity, type FROM
            (SELECT line_index, unnest({_rule_numbers('message', [p for *_, p in COARSE_INDICATORS])}) AS rule FROM simple)
            JOIN coarse USING (rule)""",
        "token_counts": f"""SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) GROUP BY token""",
        "nb_predictions": with_ctes(*lines_ctes(), _simple(), *_bayes()) + f"SELECT * EXCLUDE (found), {indicator_names} AS indicators FROM predicted",
        "nb_summary": with_ctes(*lines_ctes(), _simple(), *_bayes()) + """SELECT count(*) AS total_lines,
            count(*) FILTER (WHERE ml_label = 'threat') AS ml_threat_count,
            count(*) FILTER (WHERE ml_label = 'vulnerability') AS ml_vulnerability_count,
            count(*) FILTER (WHERE ml_label = 'benign') AS ml_benign_count, sum(len(found))::BIGINT AS indicator_count,
            sum(len(found))::BIGINT AS threat_indicator_count, 0::BIGINT AS vulnerability_indicator_count FROM predicted""",
        "confusion_matrix": with_ctes(*quality_ctes()) + "SELECT * FROM confused",
        "class_metrics": with_ctes(*quality_ctes()) + "SELECT class, support, precision, recall, f1 FROM measured",
        "overall_metrics": with_ctes(*quality_ctes()) + "SELECT sum(support)::BIGINT AS support, round(sum(hit) / sum(support), 9) AS accuracy, "
        + ", ".join(f"round(sum({m} * support) / sum(support), 9) AS weighted_{m}, round(avg({m}), 9) AS macro_{m}"
                    for m in ("precision", "recall", "f1")) + " FROM measured",
        "label_confusion": """SELECT quality::VARCHAR AS label, (1 - toxic)::VARCHAR AS prediction, count(*) AS n FROM labels GROUP BY ALL""",
        "detection_quality": with_ctes(*quality_ctes()) + """SELECT tp, fp, tn, fn, (tp + tn) / (tp + fp + tn + fn) AS accuracy,
            tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (
            SELECT count(*) FILTER (WHERE label <> 'benign' AND prediction <> 'benign') AS tp,
              count(*) FILTER (WHERE label = 'benign' AND prediction <> 'benign') AS fp,
              count(*) FILTER (WHERE label = 'benign' AND prediction = 'benign') AS tn,
              count(*) FILTER (WHERE label <> 'benign' AND prediction = 'benign') AS fn FROM judged)""",
        "feature_vectors": with_ctes(*feature_ctes()) + f"SELECT line_index, {vector} FROM features",
        "standardised_vectors": with_ctes(*feature_ctes(), f"vectors AS (SELECT line_index, {vector} FROM features)",
                                          f"moments AS (SELECT {moments} FROM vectors)")
        + f"SELECT line_index, {scaled} FROM vectors CROSS JOIN moments",
        "unusual_lines": with_ctes(*feature_ctes(), f"vectors AS (SELECT line_index, {vector} FROM features)",
                                   f"moments AS (SELECT {moments} FROM vectors)")
        + f"SELECT line_index, {deviation} AS deviation, CAST({deviation} > 3 AS INTEGER) AS is_anomaly FROM vectors CROSS JOIN moments",
        "code_issues": with_ctes(*code_ctes()) + "SELECT * FROM line_found",
        "code_file_issues": with_ctes(*code_ctes()) + "SELECT * FROM file_found",
        "code_issue_counts": with_ctes(*code_ctes()) + """SELECT path, count(*) FILTER (WHERE category = 'Bug') AS bugs,
            count(*) FILTER (WHERE category = 'Vulnerability') AS vulnerabilities,
            count(*) FILTER (WHERE category = 'Maintainability') AS maintainability_issues, count(category) AS issues,
            any_value(len(kept)) AS total_lines FROM pieces LEFT JOIN all_found USING (path) GROUP BY path""",
        "code_critical_files": with_ctes(*code_ctes()) + """SELECT path, count(*) AS critical_issues FROM all_found
            WHERE severity = 'Critical' GROUP BY path""",
    }
