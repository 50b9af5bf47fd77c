"""Coarse indicator rules and training lines of the line classifier."""

from __future__ import annotations

# ---- fixed values: (indicator, severity, type, pattern), case-insensitive, in output order ---------
COARSE_INDICATORS: list[tuple[str, str, str, str]] = [
    ("DDoS Attack", "critical", "threat",
     r"\b(syn flood|udp flood|http flood|ddos detected|amplification attack|volumetric attack)\b"),
    ("DNS Attack", "high", "threat",
     r"\b(dns tunnel|dns cache poisoning|dns water torture|nxdomain flood|dns exfil)\b"),
    ("Botnet Activity", "critical", "threat",
     r"\b(c2 beacon|botnet activity|mirai botnet|reverse shell|backdoor|tor exit node)\b"),
    ("Malware Distribution", "critical", "threat",
     r"\b(malware distribution|ransomware|worm propagation|eternalblue|wannacry|fileless malware)\b"),
    ("Data Exfiltration", "critical", "threat",
     r"\b(data exfiltration|large file transfer|covert channel|steganography|icmp tunneling)\b"),
    ("Phishing Attack", "high", "threat",
     r"\b(phishing kit|credential harvesting|password spraying|credential dumping)\b"),
    ("Network Infrastructure Attack", "critical", "threat",
     r"\b(bgp hijacking|arp poison|arp spoof|router compromise|mitm)\b"),
    ("ISP Abuse", "medium", "threat",
     r"\b(spam campaign|proxy abuse|copyright infringement|account sharing|port forwarding abuse)\b"),
    ("VoIP Attack", "critical", "threat",
     r"\b(voip fraud|tdos attack|sip registration attack|eavesdropping)\b"),
    ("IoT Attack", "high", "threat",
     r"\b(iot botnet|smart home abuse|cctv camera compromise|smart meter tampering)\b"),
    ("Port Scanning", "medium", "threat",
     r"\b(nmap|masscan|port scan|syn scan|service enumeration|snmp brute force)\b"),
]

# ---- fixed values: labels in tie-break order and the built-in training lines -----------------------
LABELS = ["benign", "vulnerability", "threat"]
TRAINING_LINES: list[tuple[str, str]] = [
    ("DHCP lease assigned to customer", "benign"),
    ("DNS query resolved successfully", "benign"),
    ("BGP route update received", "benign"),
    ("Connection allowed by firewall", "benign"),
    ("Bandwidth usage normal", "benign"),
    ("SIP call established", "benign"),
    ("ICMP ping response", "benign"),
    ("HTTP proxy request completed", "benign"),
    ("SMTP connection established", "benign"),
    ("IoT device heartbeat", "benign"),
    ("High latency detected degraded performance", "benign"),
    ("Packet loss detected connection unstable", "benign"),
    ("DNS resolution timeout NXDOMAIN", "benign"),
    ("Bandwidth spike high throughput", "benign"),
    ("Slow response timeout exceeded", "benign"),
    ("Connection intermittent unstable", "benign"),
    ("DDoS SYN flood detected", "threat"),
    ("DNS tunneling detected", "threat"),
    ("C2 beacon callback", "threat"),
    ("Mirai botnet activity", "threat"),
    ("Ransomware encryption detected", "threat"),
    ("Data exfiltration detected", "threat"),
    ("Phishing kit detected", "threat"),
    ("BGP hijacking attempt", "threat"),
    ("Spam campaign detected", "threat"),
    ("VoIP fraud detected", "threat"),
    ("IoT botnet infection", "threat"),
    ("Port scan detected", "threat"),
]
TOKEN_PATTERN = r"[a-zA-Z0-9_]+"
SIMPLE_LINE_PATTERN = r"^(\S+)\s+(\S+)\s+(\S+)\s+-\s+(.*)$"
