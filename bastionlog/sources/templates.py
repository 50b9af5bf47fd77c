"""Line shapes used to turn the ``events`` table into log lines.

The supplied tables hold no log lines, so each event is written as one: ``event_id`` picks the shape,
``user_id`` the source address and stream. Placeholders: ``{ip}``, ``{iso}``, ``{plain}``, ``{clf}``,
``{syslog}`` (times), ``{n}`` (0..96) and ``{u}`` (user number).
"""

from __future__ import annotations

TEMPLATES: list[str] = [
    # JSON with ISP fields
    '{"timestamp":"{iso}","level":"WARN","service":"radius","src_ip":"{ip}","customer_id":"{u}","message":"failed login for subscriber {u}"}',
    '{"timestamp":"{iso}","level":"CRITICAL","service":"edge","src_ip":"{ip}","dst_port":80,"protocol":"tcp","usage_mbps":"{n}.5","message":"SYN flood toward web farm, {n} sources"}',
    '{"timestamp":"{iso}","level":"INFO","service":"dhcp","message":"lease renewed for pool {n}"}',
    '{"timestamp":"{iso}","severity":"HIGH","caller":"{ip}","message":"toll fraud suspected on trunk {n}","port":"5060"}',
    '{"timestamp":"{iso}","service":"metering","device_ip":"{ip}","message":"unusual power consumption at meter {u}"}',
    '{"timestamp":"{iso}","level":"NOTICE","client_ip":"{ip}","customer_id":"{u}","user":"user{u}","message":"multiple simultaneous logins on one account"}',
    '{"timestamp":"{iso}","level":"INFO","service":"probe","rtt_ms":"{n}","dropped_packets":"{n}","message":"rtt_ms and dropped_packets above target on link {n}"}',
    '{"timestamp":"{iso}+00:00Z","level":"INFO","service":"cpe","src_ip":"{ip}","cpu":"{n}.25","memory":"41.5","network_tx":"{n}00","message":"heartbeat"}',
    # other JSON
    '{"ts":"{iso}","sev":"LOW","host":"scanner{n}","msg":"VULN_SCAN found cve=CVE-2021-44228 unpatched on asset {n}"}',
    '{"ts":"{iso}","src_ip":"{ip}","sev":"HIGH","msg":"phishing kit hosted, fake login page served"}',
    '{"ts":"{iso}","src_ip":"{ip}","sev":"HIGH","msg":"jndi:ldap://{ip}/a requested, exploit attempt"}',
    '{"ts":"{iso}","format":"vendor","src_ip":"{ip}","msg":"ransom note dropped, files renamed to .locked"}',
    '["not","an","object","{n}"]',
    '{"ts":"{iso}","msg":"cut short',
    # access log
    '{ip} - - [{clf}] "GET /index.html HTTP/1.1" 200 {n}12 "http://portal.example/" "Mozilla/5.0"',
    '{ip} - - [{clf}] "POST /login HTTP/1.1" 401 {n}',
    '{ip} - - [{clf}] "GET /search?q=union select HTTP/1.1" 503 {n} "-" "sqlmap"',
    '{ip} - - [{clf}] "GET /../../etc/passwd HTTP/1.1" 404 {n}',
    '{ip} - - [{clf}] "GET /api/v1/items HTTP/1.1" 500 {n} "-" "client/{n}"',
    # syslog
    '{syslog} gw{n} sshd[{n}]: Failed password for invalid user admin from {ip}',
    '{syslog} gw{n} kernel: link up on port {n}',
    '{syslog} fw{n} audit: iptables -F executed by uid {u}',
    '{syslog} host{n} sshd[{u}]: authorized_keys modified for root',
    # timestamped device lines
    '{plain} IDS1 ALERT signature=CREDENTIAL_STUFFING src_ip={ip} attempts={n} action=blocked',
    '{plain} IDS1 ALERT src_ip={ip} multiple accounts failed login account_lockouts={n} accounts locked',
    '{plain} CORE{n} WARN latency_ms={n} packet_loss=3 jitter=7 path=core',
    '{plain} CORE{n} INFO routing changes applied, bgp session stable',
    '{plain} FW2 ERROR src_ip={ip} unique_ports={n} nmap SYN scan detected action=dropped',
    '{plain} FW2 CRITICAL src_ip={ip} masscan over subnet {n}, targeting ISP subnet',
    '{plain} RTR1 WARNING src_ip={ip} unauthorized configuration change on edge router {n}',
    '{plain} DB3 notice src_ip={ip} mysqldump started, database dump detected',
    '{plain} DB3 ALERT src_ip={ip} large file transfer, {n}00 MB bulk download',
    # key=value
    'ts={iso} src_ip={ip} user=u{u} event=login_failed reason=bad_password',
    'ts={iso} src_ip={ip} inbound_requests_per_sec=9{n}000 bandwidth_utilization=97%',
    'src_ip={ip} proto=udp proto=tcp status=200 level=debug',
    'host=node{n} password=hunter{n} level=error src_ip={ip}',
    'host=node{n} cpu=9{n} memory=12',
    'a={n} b={n}',
    # CSV
    '{iso},{ip},SIP,REGISTER,SIP registration attack',
    '{n},alpha, beta ,gamma,delta',
    'one,two,three,{n}',
    '"{n},1","quoted, text",x,y',
    # plain text
    'c2 beacon from {ip} every {n} s, reverse shell open',
    'tor exit node contacted by {ip}',
    'open proxy relaying malicious traffic, host {ip}',
    'Mirai infection on camera, default credentials still set',
    'NTP monlist abused, amplification factor {n}',
    'dns tunnel through resolver, iodine handshake {n}',
    'NXDOMAIN flood: random subdomain flooding at {n} thousand qps',
    'bittorrent handshake from subscriber {u}',
    'BGP hijacking: suspicious route announcement for prefix {n}',
    'arp spoof on access switch {n}, certificate mismatch reported',
    'pass-the-hash with psexec between hosts {n} and {u}',
    'spam campaign: sending {n}000 emails per hour',
    'xmrig connected to mining pool, stratum+tcp in use',
    'powershell -enc launched by office process {n}',
    'WannaCry worm propagation, serving payload to {n} hosts',
    'mimikatz and lsass.exe memory access on host {n}',
    'scraping detected: {n}00 requests seen per second',
    'password reset completed for user {u}',
    'scan of backup tapes finished in {n} minutes',
    '  padded line with nothing of note {n}  ',
    '',
    '{iso} INFO dns - DNS query resolved for host{n}',
    '{iso} CRITICAL botnet - C2 beacon callback, Mirai botnet activity {n}',
    '{iso} WARN perf - Packet loss detected connection unstable {n}',
    'command execution confirmed, shell spawned by worker {n}',
]

BURST_EVENTS = 512
BURST_SECONDS = 3600
LINES_PER_SECOND = 4
HOT_HOSTS = 8
STREAMS = 4

# Threat each shape is meant to show; shapes not listed are harmless.
EXPECTED: dict[int, str] = {
    0: "Brute-Force Authentication",
    1: "DDoS / Volumetric Attack",
    3: "VoIP Fraud",
    4: "Smart Meter Tampering",
    5: "Account Sharing",
    9: "Phishing Kit",
    10: "Exploit Attempt",
    11: "Ransomware Activity",
    19: "Brute-Force Authentication",
    21: "Firewall / Security Control Disabled",
    22: "SSH Key / Authorized Keys Tampering",
    23: "Credential Stuffing",
    24: "Password Spraying",
    27: "Port Scanning / Reconnaissance",
    28: "Network Reconnaissance",
    29: "Router Compromise",
    30: "Database Exfiltration / Dump",
    31: "Data Exfiltration",
    32: "Brute-Force Authentication",
    33: "DDoS / Volumetric Attack",
    35: "Credential Exposure in Logs",
    38: "SIP Registration Attack",
    42: "C2 Beacon / Command & Control",
    43: "Tor / Anonymous Proxy Detected",
    44: "Proxy Abuse",
    45: "IoT Botnet",
    46: "Amplification Attack",
    47: "DNS Tunneling / Exfiltration",
    48: "DNS Water Torture / NXDOMAIN Flood",
    49: "Copyright Infringement",
    50: "BGP Hijacking",
    51: "Man-in-the-Middle (MitM)",
    52: "Lateral Movement / Pass-the-Hash",
    53: "Spam Campaign",
    54: "Cryptominer / Coin Miner",
    55: "Fileless Malware / LOLBins",
    56: "Malware Distribution",
    57: "Credential Dumping",
    58: "API Abuse / Scraping",
    64: "C2 Beacon / Command & Control",
    66: "Exploit Attempt",
}

# Source snippets for the code corpus, one per event in turn; ``{n}`` as above.
SNIPPETS: list[tuple[str, str]] = [
    (".py", "import os\n\ndef run(items=[]):\n    os.system('ls {n}')\n    # TODO tidy\n"),
    (".py", "class Worker:\n    def go(self):\n        try:\n            pass\n        except:\n            pass\n"),
    (".js", "if (a == b) { eval(code{n}) }\r\nconst token = 'abc{n}'\r\n"),
    (".java", "int pick() { return new Random({n}).nextInt(); }\n// FIXME\n"),
    (".ts", "// one\n// two\n// three\nconst n = {n}\n"),
    (".html", "<a href=\"http://host{n}.example/\">x</a>\n<p>plain</p>"),
    (".py", "# all\n# notes {n}\n"),
    (".css", "body { color: red }\n"),
]
LONG_SNIPPET_LINES = 501
LONG_SNIPPET_EVERY = 100
