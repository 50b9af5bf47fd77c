from pyspark.sql import functions as F

from bastionlog.functions.columns import contains_any, imatch
from bastionlog.operators.features import extract_features
from bastionlog.operators.quality import binary_metrics
from bastionlog.operators.signatures import conditions, explode_hits, line_flags, match_lines
from bastionlog.plans.detect import detect
from bastionlog.rules.signatures import DIRECT_INDICATORS, SIGNATURES

# Lines of our own: (expected threat or None, text)
HOLDOUT = [
    ("Brute-Force Authentication", "sshd saw too many failed sign-ins for operator"),
    ("Brute-Force Authentication", "portal says invalid login for subscriber 99"),
    ("Credential Stuffing", "credential_stuffing wave against webmail"),
    ("Password Spraying", "lockout threshold passed by forty mailboxes"),
    ("DDoS / Volumetric Attack", "syn  flood at peering point, packet storm follows"),
    ("DDoS / Volumetric Attack", "host inbound_requests_per_sec=75000 now"),
    ("Amplification Attack", "NTP monlist replies leave customer net"),
    ("Port Scanning / Reconnaissance", "zmap probe seen; 900 ports scanned"),
    ("Network Reconnaissance", "someone is probing hosts on multiple ports"),
    ("DNS Tunneling / Exfiltration", "dnscat session over resolver two"),
    ("DNS Cache Poisoning", "spoofed DNS response dropped"),
    ("DNS Water Torture / NXDOMAIN Flood", "NXDOMAIN flood on anycast node"),
    ("C2 Beacon / Command & Control", "host keeps a c2 beacon alive"),
    ("Tor / Anonymous Proxy Detected", "onion routing by lab machine"),
    ("Cryptominer / Coin Miner", "ethminer eats the gpu"),
    ("Malware Distribution", "EternalBlue probe spreads"),
    ("Ransomware Activity", "share full of report.docx.encrypted files"),
    ("Fileless Malware / LOLBins", "certutil run with -decode switch"),
    ("Data Exfiltration", "covert channel through icmp suspected"),
    ("Database Exfiltration / Dump", "pg_dump by unknown role"),
    ("Phishing Kit", "fake login page on shared host"),
    ("Credential Dumping", "ntdsutil snapshot mounted"),
    ("Credential Exposure in Logs", "config has api_key = abc123"),
    ("BGP Hijacking", "route leak from peer"),
    ("Man-in-the-Middle (MitM)", "tls downgrade on captive portal"),
    ("Router Compromise", "router configuration replaced at night"),
    ("Lateral Movement / Pass-the-Hash", "smbexec from jump box"),
    ("Spam Campaign", "bulk email from dial-in pool"),
    ("Port Forwarding Abuse", "UPnP mapping opened"),
    ("Proxy Abuse", "open proxy on port 3128"),
    ("Copyright Infringement", "DMCA violation notice received"),
    ("Account Sharing", "different IPs stream with same account"),
    ("VoIP Fraud", "SIP trunk abuse to premium numbers"),
    ("TDoS Attack", "three hundred calls per minute hit the PBX"),
    ("SIP Registration Attack", "brute-force SIP credentials attempt"),
    ("Eavesdropping", "call interception reported"),
    ("IoT Botnet", "camera still uses default credentials"),
    ("Smart Home Abuse", "IoT hub answers to strangers"),
    ("CCTV Camera Compromise", "viewer opened feed without authorization"),
    ("Smart Meter Tampering", "unusual power consumption in flat 3"),
    ("Firewall / Security Control Disabled", "admin ran ufw disable"),
    ("SSH Key / Authorized Keys Tampering", "new ssh key added to root"),
    ("API Abuse / Scraping", "automated scan of price pages"),
    ("Exploit Attempt", "jndi:rmi://evil/x in header"),
    (None, "backup job failed, retry at noon"),
    (None, "scan of paper archive done"),
    (None, "proxy cache hit ratio 97"),
    (None, "tls session encrypted with new cipher"),
    (None, "password reset mail sent"),
    (None, "latency_ms=40 jitter=3 on uplink"),
    (None, "VULN_SCAN found CVE-2020-1234 on asset"),
    (None, "lease granted to 10.0.0.4"),
]


def test_arrow_matching_agrees_with_jvm_patterns(make_lines):
    lines = make_lines([t for _, t in HOLDOUT] + ["", "password=a;PASSWD = b", "ends in .enc", ".enc in the middle"])
    jvm = F.array_compact(F.array(*[
        F.when(imatch(F.col("raw_message"), s.pattern),
               F.when(contains_any(F.lower("raw_message"), [w.lower() for w in DIRECT_INDICATORS.get(s.name, [])]), 2 * i + 1)
               .otherwise(2 * i)).cast("smallint")
        for i, s in enumerate(SIGNATURES)
    ]))
    rows = match_lines(lines).withColumn("jvm", jvm).collect()
    assert all(r.codes == r.jvm for r in rows)
    assert sum(len(r.codes) for r in rows) > 40


def test_every_signature_hits_its_line(make_lines):
    hits = explode_hits(match_lines(make_lines([t for _, t in HOLDOUT])))
    found = {(r.line_index, r.threat_type) for r in hits.collect()}
    missed = [t for i, (name, t) in enumerate(HOLDOUT) if name and (i, name) not in found]
    assert not missed
    assert {name for name, _ in HOLDOUT if name} == {s.name for s in SIGNATURES}


def test_quality_gates(spark, make_lines):
    lines = make_lines([(t, i, i) for i, (_, t) in enumerate(HOLDOUT)])
    found = {r.stream_id for r in detect(extract_features(lines)).select("stream_id").collect()}
    flags = spark.createDataFrame([(n is not None, i in found) for i, (n, _) in enumerate(HOLDOUT)],
                                  "is_attack boolean, detected boolean")
    r = binary_metrics(flags).first()
    assert r.precision >= 0.95 and r.recall >= 0.85 and r.f1 >= 0.90


def test_confidence_bounds(make_lines):
    rows = detect(extract_features(make_lines([(t, i, i) for i, (_, t) in enumerate(HOLDOUT)]))).collect()
    assert all(0.65 <= r.confidence <= 0.99 for r in rows)
    assert all(r.corroborating_count >= 1 and r.evidence for r in rows)
    by_type = {r.threat_type: r for r in rows}
    assert by_type["Account Sharing"].domain == "COMPLIANCE"
    assert by_type["Account Sharing"].mitre_attack == "NOT APPLICABLE"
    assert by_type["Account Sharing"].classification_type == "Classification"


def test_rule_that_needs_direct_evidence(make_lines):
    rows = detect(extract_features(make_lines(["botnet activity in cell 5", "botnet activity in cell 6"])))
    assert rows.filter("threat_type like 'C2%'").count() == 0


def test_flags_and_conditions(make_lines):
    lines = make_lines([
        "packet_loss=4 on link", "response_time_ms=900 and service degradation", "latency_ms=4 under syn flood",
        "CVE-2021-1111 unpatched", "CVE-2021-1111 with exploit attempt", "routing changes applied",
    ])
    flags = line_flags(match_lines(extract_features(lines))).orderBy("line_index").collect()
    assert [r.operational_only for r in flags] == [True, True, False, False, False, True]
    assert [r.passive_vulnerability_only for r in flags] == [False, False, False, True, False, False]
    assert flags[2].malicious_context
    rows = conditions(line_flags(match_lines(extract_features(lines)))).orderBy("line_index").collect()
    assert [(r.domain, r.label) for r in rows] == [
        ("NETWORK_PERFORMANCE", "High Latency / Degraded Performance"),
        ("SERVICE_HEALTH", "Infrastructure Failure"),
        ("SERVICE_HEALTH", "Routing Path Change"),
    ]
    assert {(r.threat_status, r.classification_type, r.mitre_attack, r.status) for r in rows} == {
        ("NONE", "Condition", "NOT APPLICABLE", "MONITOR_ONLY")}


def test_own_catalogue_end_to_end(spark, make_lines):
    """A hundred own rules: every detection and alert is named by them, and alert ids are unique."""
    from bastionlog.operators import strict
    from bastionlog.operators.alerts import alert_rows, condition_alerts, ids_per_line
    from bastionlog.operators.features import extract_features
    from bastionlog.operators.signatures import conditions, line_flags, match_lines
    from bastionlog.plans.detect import detect
    from bastionlog.rules.signatures import Signature

    rules = [Signature(f"Own {i}", "high", "probe", f"T9{i:03}", "Own rules", rf"own{i}\b") for i in range(100)]
    texts = [f"a=1 b=2 src_ip=9.9.{i // 10}.{i % 10} own{i} own{(i + 1) % 100} seen" for i in range(100)]
    features = extract_features(make_lines([*texts, "packet loss and high latency on link 4"]))
    found = detect(features, rules)
    assert {r.threat_type for r in found.collect()} <= {s.name for s in rules} and found.count() > 100
    matched = match_lines(features, rules)
    alerts = alert_rows(found, rules).unionByName(condition_alerts(conditions(line_flags(matched, rules)), rules))
    ids = [r.id for r in alerts.collect()]
    assert len(ids) == len(set(ids)) > 100 and ids_per_line(rules) == 128
    techniques = {(r.threat_type, r.technique) for r in strict.assess(found, rules).collect()}
    assert techniques <= {(s.name, s.mitre) for s in rules}
