"""Threat signature catalogue.

Every table in this module holds fixed values: names, patterns, technique ids and
indicator words have to equal the published behaviour for detections to agree.
Operators take the catalogue as a parameter, so deployments can pass their own.
"""

from __future__ import annotations

from typing import NamedTuple


class Signature(NamedTuple):
    """One case-insensitive line signature."""

    name: str
    severity: str
    kind: str
    mitre: str
    category: str
    pattern: str


# ---- fixed values: signature rules, in evaluation order -------------------------------------
SIGNATURES: list[Signature] = [
    Signature(
        "Port Scanning / Reconnaissance", "medium", "reconnaissance", "T1046", "Network Reconnaissance",
        r"(nmap|masscan|zmap|SYN\s+scan|port\s+sweep|\d+\s+port(s)?\s+scanned|OS\s+detection|service\s+detection|"
        r"Nessus|OpenVAS|nikto|service\s+enumeration|DNS\s+zone\s+transfer|AXFR|SNMP\s+brute\s+force|"
        r"SNMP\s+community\s+string\s+brute\s+force|TCP_PORT_SCAN|PORT_SCAN|unique_ports=\d+|inbound_connections=\d+)",
    ),
    Signature(
        "Network Reconnaissance", "high", "network_recon", "T1018", "Network Reconnaissance",
        r"(masscan.*subnet|network\s+recon|targeting\s+ISP\s+subnet|probing.*multiple\s+ports|service\s+enumeration)",
    ),
    Signature(
        "DDoS / Volumetric Attack", "critical", "ddos", "T1498", "DDoS Attack",
        r"(syn\s+flood|udp\s+flood|http[\s_]flood|amplification\s+attack|ddos[\s_]detected|botnet\s+traffic|high\s+pps|"
        r"packet\s+storm|connection[\s_]limit[\s_]reached|rate[\s_]limit[\s_](exceeded|triggered)|volumetric\s+attack|"
        r"ICMP\s+flood|saturating\s+backbone|HTTP_FLOOD_ATTACK|SYN_FLOOD|UDP_FLOOD|DDOS_ATTACK|"
        r"inbound_requests_per_sec=[5-9]\d{4,}|inbound_requests_per_sec=\d{6,}|bandwidth_utilization=9[0-9]%|"
        r"signature=HTTP_FLOOD|signature=SYN_FLOOD|signature=UDP_FLOOD|signature=DDOS|signature=VOLUMETRIC)",
    ),
    Signature(
        "Amplification Attack", "critical", "amplification", "T1498", "DDoS Attack",
        r"(DNS\s+reflection|NTP\s+monlist|amplification\s+factor|UDP\s+amplification|reflection\s+attack)",
    ),
    Signature(
        "DNS Tunneling / Exfiltration", "high", "dns_tunneling", "T1048.003", "DNS Attack",
        r"(dns\s+tunnel|unusually\s+long\s+dns|base64.*\.dns\.|high\s+dns\s+query\s+rate|dns\s+exfil|iodine|dnscat|DNSxD)",
    ),
    Signature(
        "DNS Cache Poisoning", "critical", "dns_poisoning", "T1055", "DNS Attack",
        r"(DNS\s+cache\s+poisoning|spoofed\s+DNS\s+response|DNS\s+rebinding|malicious\s+DNS\s+server)",
    ),
    Signature(
        "DNS Water Torture / NXDOMAIN Flood", "high", "dns_flood", "T1498", "DNS Attack",
        r"(DNS\s+water\s+torture|random\s+subdomain\s+flooding|NXDOMAIN\s+flood|high\s+query\s+rate.*non-existent)",
    ),
    Signature(
        "C2 Beacon / Command & Control", "critical", "c2_beacon", "T1102", "Botnet Activity",
        r"(c2\s+(beacon|callback)|command.*and.*control|reverse\s+shell|backdoor\s+(installed|detected)|"
        r"botnet\s+activity|Mirai\s+botnet|Emotet\s+C2)",
    ),
    Signature(
        "Tor / Anonymous Proxy Detected", "high", "tor_proxy", "T1090.003", "Botnet Activity",
        r"(tor\s+exit\s+node|onion\s+routing|proxy\s+chain|anonymizer\s+detected|darknet\s+traffic|i2p\s+traffic|tor\s+browser)",
    ),
    Signature(
        "Cryptominer / Coin Miner", "critical", "cryptominer", "T1496", "Botnet Activity",
        r"(xmrig|stratum\+tcp|cryptonight|monero\s+miner|coinhive|mining\s+pool|cpu\s+mining\s+detected|cgminer|nicehash|ethminer)",
    ),
    Signature(
        "Malware Distribution", "critical", "malware_dist", "T1105", "Malware",
        r"(malware\s+distribution|serving\s+payload|Emotet\s+payload|Worm\s+propagation|EternalBlue|WannaCry)",
    ),
    Signature(
        "Ransomware Activity", "critical", "ransomware", "T1486", "Malware",
        r"(ransomware|\.encrypted|\.locked|\.enc$|\.crypto$|your\s+files\s+are\s+encrypted|ransom\s+note|"
        r"bitcoin.*decrypt|pay.*recover.*files)",
    ),
    Signature(
        "Fileless Malware / LOLBins", "high", "fileless_malware", "T1059.001", "Malware",
        r"(powershell\s+-enc|-EncodedCommand|regsvr32.*scrobj|mshta.*javascript|certutil.*-decode|wscript.*eval|"
        r"cmstp\s+-ns|rundll32.*shell32|LOLBin\s+abuse)",
    ),
    Signature(
        "Data Exfiltration", "critical", "data_exfiltration", "T1041", "Data Exfiltration",
        r"(large\s+data\s+transfer\s+detected|unusually\s+large\s+upload|sensitive\s+data.*sent|exfiltration\s+detected|"
        r"outbound.*\d{3,}\s*MB|data\s+leak|bulk\s+download|megabytes.*external|covert\s+channel|ICMP\s+tunneling|"
        r"steganography|large\s+file\s+transfer|GB\s+upload.*cloud\s+storage|potential\s+exfiltration)",
    ),
    Signature(
        "Database Exfiltration / Dump", "critical", "db_exfiltration", "T1005", "Data Exfiltration",
        r"(mysqldump|pg_dump|mongodump|SELECT\s+\*\s+FROM\s+\w+\s+INTO\s+OUTFILE|database.*dump\s+detected|"
        r"LOAD\s+DATA\s+INFILE|db\s+credentials\s+exposed)",
    ),
    Signature(
        "Phishing Kit", "high", "phishing", "T1566", "Phishing & Credential Theft",
        r"(phishing\s+kit|credential\s+harvesting|mimicking\s+bank\s+login|fake\s+login\s+page)",
    ),
    Signature(
        "Credential Dumping", "critical", "credential_dumping", "T1003", "Phishing & Credential Theft",
        r"(lsass\.exe.*dump|procdump.*lsass|mimikatz|sekurlsa|wce\.exe|ntdsutil|sam.*hive|/etc/shadow\s+read|"
        r"hashdump|pwdump|credential\s+dumping\s+detected|lsass\.exe\s+memory\s+access)",
    ),
    Signature(
        "Brute-Force Authentication", "high", "brute_force", "T1110", "Phishing & Credential Theft",
        r"\b(failed\s+password|invalid\s+(user|password|login)|authentication\s+failure|login[_\s]failed|failed[_\s]login|"
        r"max\s+auth\s+attempts|too\s+many\s+failed|credential\s+validation\s+failed|SSH\s+login\s+attempts|"
        r"Failed\s+SSH\s+login|Failed\s+login\s+attempt|Brute-force\s+threshold\s+exceeded|Signature=SSH_Brute_Force)",
    ),
    Signature(
        "Credential Stuffing", "high", "credential_stuffing", "T1110.004", "Phishing & Credential Theft",
        r"(signature=CREDENTIAL_STUFFING|credential[_\s]stuffing|multiple_accounts_targeted=\d+)",
    ),
    Signature(
        "Password Spraying", "high", "password_spray", "T1110.003", "Phishing & Credential Theft",
        r"(multiple\s+accounts.*failed|accounts\s+locked|lockout\s+threshold|distributed\s+login\s+failure|spray\s+attack|"
        r"user\s+enumeration|password\s+spraying\s+detected|accounts\s+failed\s+login|account_lockouts=[1-9])",
    ),
    Signature(
        "Credential Exposure in Logs", "critical", "credential_exposure", "T1552", "Phishing & Credential Theft",
        r"\b(password\s*=\s*\S+|passwd\s*=\s*\S+|api[-_]?key\s*=\s*\S+|secret[-_]?token\s*=\s*\S+|aws_access_key|"
        r"private[-_]?key|authorization:\s+bearer\s+\S+)\b",
    ),
    Signature(
        "BGP Hijacking", "critical", "bgp_hijack", "T1565", "Network Infrastructure",
        r"(BGP\s+hijacking|suspicious\s+route\s+announcement|prefix\s+hijack|route\s+leak|unauthorized\s+BGP)",
    ),
    Signature(
        "Man-in-the-Middle (MitM)", "high", "mitm", "T1557", "Network Infrastructure",
        r"(arp\s+poison|arp\s+spoof|ssl\s+strip|ssl\s+intercept|certificate\s+mismatch|invalid\s+certificate|"
        r"tls\s+downgrade|heartbleed|beast\s+attack)",
    ),
    Signature(
        "Router Compromise", "critical", "router_compromise", "T1562", "Network Infrastructure",
        r"(router\s+compromise|unauthorized\s+configuration\s+change|edge\s+router|router\s+configuration)",
    ),
    Signature(
        "Lateral Movement / Pass-the-Hash", "critical", "lateral_movement", "T1550.002", "Network Infrastructure",
        r"(pass.the.hash|pass.the.ticket|wmi\s+exec|psexec|winrm\s+lateral|smbexec|atexec|dcomexec|"
        r"remote\s+registry.*modified|scheduled\s+task.*remote)",
    ),
    Signature(
        "Spam Campaign", "high", "spam_abuse", "T1566", "ISP Abuse",
        r"(spam\s+campaign|spam\s+botnet|sending.*emails.*hour|email\s+abuse|bulk\s+email)",
    ),
    Signature(
        "Port Forwarding Abuse", "medium", "port_forwarding_abuse", "T1090", "ISP Abuse",
        r"(port\s+forwarding\s+abuse|exposing\s+internal\s+services|UPnP)",
    ),
    Signature(
        "Proxy Abuse", "high", "proxy_abuse", "T1090", "ISP Abuse",
        r"(open\s+proxy|proxy\s+abuse|malicious\s+traffic)",
    ),
    Signature(
        "Copyright Infringement", "medium", "copyright_infringement", "T1048", "ISP Abuse",
        r"(copyright\s+infringement|torrent\s+traffic|DMCA\s+violation|P2P\s+file\s+sharing|bittorrent\s+handshake|bittorrent)",
    ),
    Signature(
        "Account Sharing", "medium", "account_sharing", "T1078", "ISP Abuse",
        r"(account\s+sharing|multiple\s+simultaneous\s+logins|different\s+IPs.*same\s+account)",
    ),
    Signature(
        "VoIP Fraud", "critical", "voip_fraud", "T1204", "VoIP & Telephony",
        r"(VoIP\s+fraud|SIP\s+trunk\s+abuse|international\s+toll\s+fraud|SIP\s+abuse|toll\s+fraud)",
    ),
    Signature(
        "TDoS Attack", "critical", "tdos", "T1498", "VoIP & Telephony",
        r"(TDoS|Telephony\s+Denial\s+of\s+Service|calls.*minute.*PBX|SIP\s+flood)",
    ),
    Signature(
        "SIP Registration Attack", "high", "sip_attack", "T1110", "VoIP & Telephony",
        r"(SIP\s+registration\s+attack|brute-force\s+SIP\s+credentials)",
    ),
    Signature(
        "Eavesdropping", "high", "eavesdropping", "T1123", "VoIP & Telephony",
        r"(eavesdropping|SIP\s+INVITE|malformed\s+headers|call\s+interception)",
    ),
    Signature(
        "IoT Botnet", "high", "iot_botnet", "T1190", "IoT & Smart Home",
        r"(IoT\s+botnet|Mirai\s+infection|default\s+credentials|IoT\s+device\s+compromise)",
    ),
    Signature(
        "Smart Home Abuse", "medium", "smart_home_abuse", "T1190", "IoT & Smart Home",
        r"(smart\s+home\s+abuse|unauthorized\s+access.*IoT\s+hub|IoT\s+hub)",
    ),
    Signature(
        "CCTV Camera Compromise", "high", "cctv_compromise", "T1190", "IoT & Smart Home",
        r"(CCTV\s+camera\s+compromise|accessing\s+camera\s+feed|without\s+authorization)",
    ),
    Signature(
        "Smart Meter Tampering", "medium", "meter_tampering", "T1528", "IoT & Smart Home",
        r"(smart\s+meter\s+tampering|unusual\s+power\s+consumption|potential\s+fraud)",
    ),
    Signature(
        "Firewall / Security Control Disabled", "critical", "security_disabled", "T1562", "Defense Evasion",
        r"(iptables\s+-F|ufw\s+disable|firewall\s+disabled|Windows\s+Firewall\s+turned\s+off|"
        r"netsh\s+advfirewall\s+set.*off|setenforce\s+0|apparmor\s+disabled)",
    ),
    Signature(
        "SSH Key / Authorized Keys Tampering", "high", "ssh_tampering", "T1098.004", "Persistence",
        r"(authorized_keys\s+modified|\.ssh.*write|ssh-keygen.*injected|sshd_config.*modified|"
        r"new\s+ssh\s+key\s+added|ssh\s+host\s+key\s+changed)",
    ),
    Signature(
        "API Abuse / Scraping", "medium", "api_abuse", "T1190", "Network Abuse",
        r"(rate\s+limit\s+exceeded|api\s+abuse\s+detected|scraping\s+detected|bot\s+traffic|unusual\s+api\s+pattern|"
        r"\d{3,}\s+requests.*per\s+second|automated\s+scan)",
    ),
    Signature(
        "Exploit Attempt", "high", "exploit_attempt", "T1190", "Initial Access",
        r"(exploit\s+(attempt|confirmed|success|detected)|exploitation\s+(detected|confirmed)|signature=EXPLOIT|"
        r"malicious\s+payload|payload\s+delivered|payload\s+received|remote\s+code\s+execution|rce\s+(confirmed|detected)|"
        r"command\s+execution\s+confirmed|shell\s+spawned|reverse\s+shell|privilege\s+escalation|pkexec\s+privilege|dirtycow|"
        r"abnormal\s+process\s+creation|jndi:(ldap|rmi|dns)://)",
    ),
]

# ---- fixed values: literal direct-evidence words per threat, in evidence order ---------------
# They are compared as lower-cased substrings; entries with regex characters are literals too.
DIRECT_INDICATORS: dict[str, list[str]] = {
    "Brute-Force Authentication": [
        "failed password", "invalid login", "failed login", "login_failed", "failed ssh login", "ssh login attempts",
        "failed login attempt", "invalid password", "authentication failure", "max auth attempts", "too many failed",
        "credential validation failed", "Brute-force threshold exceeded", "Signature=SSH_Brute_Force",
    ],
    "Credential Stuffing": ["signature=CREDENTIAL_STUFFING", "credential stuffing", "credential_stuffing"],
    "Password Spraying": [
        "multiple accounts failed", "accounts locked", "password spraying detected", "account_lockouts",
    ],
    "DDoS / Volumetric Attack": [
        "syn flood", "udp flood", "connection limit reached", "volumetric attack", "ddos detected",
        "saturating backbone", "http flood", "icmp flood", "packets/second",
    ],
    "Amplification Attack": ["DNS reflection", "NTP monlist", "amplification factor"],
    "Port Scanning / Reconnaissance": [
        "nmap", "masscan", "port scanned", "AXFR", "SNMP brute force", "service enumeration",
        "probing multiple ports", "probing.*ports", "SNMP community string", "TCP_PORT_SCAN", "PORT_SCAN",
        "unique_ports", "inbound_connections",
    ],
    "Exploit Attempt": [
        "exploit attempt", "exploit confirmed", "exploit success", "signature=EXPLOIT", "exploitation detected",
        "privilege escalation", "pkexec", "dirtycow", "malicious payload", "command execution confirmed",
        "remote code execution", "rce confirmed", "rce detected", "shell spawned", "reverse shell",
        "payload delivered", "jndi:ldap://", "jndi:rmi://", "jndi:dns://", "abnormal process creation",
    ],
    "Network Reconnaissance": [
        "masscan.*subnet", "network recon", "targeting ISP subnet", "probing.*multiple.*ports", "service enumeration",
    ],
    "DNS Tunneling / Exfiltration": [
        "dns tunnel", "base64.*subdomain", "unusually long dns", "iodine", "dnscat",
        "base64 encoded payload in subdomain",
    ],
    "DNS Cache Poisoning": ["DNS cache poisoning", "spoofed DNS response", "DNS rebinding"],
    "C2 Beacon / Command & Control": [
        "c2 beacon", "reverse shell", "backdoor installed", "Mirai botnet", "Emotet C2", "tor exit node",
    ],
    "Cryptominer / Coin Miner": [
        "xmrig", "stratum+tcp", "cryptonight", "monero miner", "nicehash", "cpu mining detected", "mining pool",
        "cgminer", "ethminer",
    ],
    "Malware Distribution": ["malware distribution", "serving payload", "Worm propagation", "EternalBlue", "WannaCry"],
    "Ransomware Activity": ["ransomware", ".encrypted", ".locked", "your files are encrypted"],
    "Fileless Malware / LOLBins": ["powershell -enc", "-EncodedCommand", "certutil -decode", "LOLBin abuse"],
    "Data Exfiltration": [
        "exfiltration detected", "large data transfer", "outbound.*MB", "bulk download", "ICMP tunneling",
        "large file transfer", "GB upload", "potential exfiltration", "10GB upload", "steganography",
    ],
    "Database Exfiltration / Dump": ["mysqldump", "pg_dump", "mongodump", "database dump detected"],
    "Credential Dumping": [
        "lsass.exe.*dump", "procdump.*lsass", "mimikatz", "hashdump", "pwdump", "lsass.exe memory access",
        "credential dumping detected",
    ],
    "Credential Exposure in Logs": [
        "password=", "passwd=", "api[-_]?key=", "api_key=", "secret[-_]?token=", "aws_access_key",
        "authorization: bearer",
    ],
    "BGP Hijacking": ["BGP hijacking", "suspicious route announcement", "prefix hijack"],
    "Man-in-the-Middle (MitM)": ["arp poison", "arp spoof", "ssl strip", "certificate mismatch"],
    "Router Compromise": ["router compromise", "unauthorized configuration change", "edge router"],
    "Lateral Movement / Pass-the-Hash": ["pass-the-hash", "pass-the-ticket", "psexec", "smbexec"],
    "Spam Campaign": ["spam campaign", "spam botnet", "sending.*emails.*hour"],
    "Proxy Abuse": ["open proxy", "proxy abuse"],
    "VoIP Fraud": ["VoIP fraud", "SIP trunk abuse", "international toll fraud"],
    "TDoS Attack": ["TDoS", "Telephony Denial of Service", "calls.*minute.*PBX"],
    "IoT Botnet": [
        "IoT botnet", "Mirai infection", "default credentials", "unauthorized access.*IoT hub", "IoT hub",
    ],
    "CCTV Camera Compromise": ["CCTV camera compromise", "accessing camera feed"],
    "Phishing Kit": [
        "phishing kit", "credential harvesting", "mimicking bank login", "hosting credential harvesting page",
    ],
    "Port Forwarding Abuse": ["port forwarding abuse", "exposing internal services", "UPnP"],
    "Copyright Infringement": [
        "copyright infringement", "DMCA violation", "torrent traffic", "bittorrent", "bittorrent handshake",
        "tracker connection",
    ],
    "Account Sharing": ["account sharing", "multiple simultaneous logins", "different IPs.*same.*account"],
    "SIP Registration Attack": ["SIP registration attack", "brute-force SIP credentials"],
    "Eavesdropping": ["eavesdropping", "SIP INVITE", "call interception"],
    "Smart Home Abuse": ["smart home abuse", "unauthorized access.*IoT hub", "IoT hub"],
    "Tor / Anonymous Proxy Detected": [
        "tor exit node", "onion routing", "anonymizer", "anonymizer in use", "darknet traffic",
    ],
    "Smart Meter Tampering": ["smart meter tampering", "unusual power consumption"],
    "DNS Water Torture / NXDOMAIN Flood": [
        "DNS water torture", "random subdomain flooding", "NXDOMAIN flood", "NXDOMAIN",
    ],
}

# ---- fixed values: line predicates ----------------------------------------------------------
OPERATIONAL_PATTERN = (
    r"(latency_ms|packet_loss|jitter|congestion|degraded\s+performance|connection\s+unstable|rtt_ms|dropped_packets|"
    r"high\s+latency|routing\s+changes|retransmissions|service\s+degradation|response_time_ms)"
)
MALICIOUS_CONTEXT_PATTERN = (
    r"(ddos|attack|flood|scan|malware|c2|beacon|exfiltration|breach|intrusion|exploit|brute|ransomware|botnet|hijack|"
    r"spoof|tunnel|dump|phish|spam|compromise|credential|exfil|ransom|shell|proxy\s+abuse|toll\s+fraud)"
)
PASSIVE_VULNERABILITY_PATTERN = (
    r"(cve=CVE-\d{4}-\d+|CVE-\d{4}-\d+|VULN_SCAN|vuln_scan|\bunpatched\b|vulnerable\s+(component|version|service)|"
    r"version\s+string|server=\S+/\d+\.\d+)"
)
ACTIVE_EXPLOIT_PATTERN = (
    r"(exploit\s+(attempt|confirmed|success|detected)|exploitation\s+(detected|confirmed)|signature=EXPLOIT|"
    r"malicious\s+payload|payload\s+(delivered|received)|remote\s+code\s+execution|rce\s+(confirmed|detected)|"
    r"command\s+execution\s+confirmed|shell\s+spawned|reverse\s+shell|privilege\s+escalation|pkexec|dirtycow|"
    r"abnormal\s+process\s+creation|jndi:(ldap|rmi|dns)://)"
)
NETWORK_CONDITION_PATTERN = (
    r"(latency|rtt_ms|packet_loss|jitter|dropped_packets|congestion|degraded\s+performance|bandwidth\s+spike|"
    r"high\s+throughput|nxdomain)"
)
CVE_MENTION_PATTERN = r"cve=(CVE-\d{4}-\d+)"

# ---- fixed values: classification ------------------------------------------------------------
EXPLOIT_THREAT = "Exploit Attempt"
COMPLIANCE_THREATS = ["Copyright Infringement", "Smart Meter Tampering", "Account Sharing"]
DIRECT_EVIDENCE_REQUIRED = ["C2 Beacon / Command & Control"]
AUTH_PRIORITY = ["Credential Stuffing", "Password Spraying", "Brute-Force Authentication"]
SUPPRESSION_PAIRS = [
    ("Network Reconnaissance", "Port Scanning / Reconnaissance"),
    ("Amplification Attack", "DDoS / Volumetric Attack"),
    ("Database Exfiltration / Dump", "Data Exfiltration"),
    ("DNS Tunneling / Exfiltration", "Data Exfiltration"),
    ("C2 Beacon / Command & Control", "Tor / Anonymous Proxy Detected"),
    ("C2 Beacon / Command & Control", "IoT Botnet"),
    ("Tor / Anonymous Proxy Detected", "Proxy Abuse"),
    ("SIP Registration Attack", "Brute-Force Authentication"),
]
NETWORK_LABELS = [
    "High Latency / Degraded Performance",
    "Packet Loss / Connection Issues",
    "DNS Resolution Delay",
    "Bandwidth Spike",
]
SERVICE_LABELS = ["Service Outage", "Infrastructure Failure", "Routing Path Change"]
NOT_APPLICABLE = "NOT APPLICABLE"

# ---- fixed values: confidence in ten-thousandths (see functions/scoring.py) -------------------
SEVERITY_BASE = {"critical": 9400, "high": 8600, "medium": 7500, "low": 6000}
DEDUP_WINDOW_SECONDS = 60

# ---- fixed values: strict second-pass engine ---------------------------------------------------
STRICT_EVIDENCE_TYPES = [
    "C2 Beacon / Command & Control", "DNS Tunneling / Exfiltration", "Data Exfiltration",
    "Database Exfiltration / Dump", "Credential Dumping", "Ransomware Activity", "BGP Hijacking", "Router Compromise",
]
STRICT_EXPLICIT_WORDS = ["detected", "signature", "known", "confirmed", "alert"]
STRICT_BLOCK_WORDS = ["blocked", "dropped", "denied", "firewall", "ids", "ips"]
STRICT_AUTH_WORDS = ["lockout", "failed", "authentication failure"]
STRICT_PERFORMANCE_WORDS = [
    "latency", "packet loss", "jitter", "congestion", "dns delay", "retransmission", "routing change",
    "bandwidth spike", "degraded performance", "temporary outage", "high latency", "slow response", "timeout",
]
STRICT_MALICIOUS_WORDS = [
    "ddos", "attack", "flood", "scan", "malware", "c2", "beacon", "exfiltration", "breach", "intrusion", "exploit",
]
