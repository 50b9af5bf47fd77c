"""Analyst texts. Wording is this project's own; pass other tables to the operators to change it.

A threat's full narrative is its own explanation plus the impact and advice of its category.
"""

from __future__ import annotations

from bastionlog.rules.signatures import SIGNATURES

CATEGORY_NOTES: dict[str, tuple[str, str, str]] = {
    "Network Reconnaissance": (
        "Hosts or services are being mapped from outside.",
        "The actor learns which services are open and can pick a target.",
        "Block the scanning address at the edge and reduce exposed services."),
    "DDoS Attack": (
        "Traffic meant to exhaust a service or a link was seen.",
        "Customers lose service and shared links fill up.",
        "Start upstream scrubbing, rate-limit the protocol and drop the target prefix if needed."),
    "DNS Attack": (
        "Name resolution is being abused.",
        "Resolvers slow down, answers may be forged or data may leave through queries.",
        "Limit query rates per client, validate answers and inspect long query names."),
    "Botnet Activity": (
        "A device talks to infrastructure used by botnets.",
        "The device can be steered from outside and used against others.",
        "Block the remote address, tell the customer and clean the device."),
    "Malware": (
        "Malicious code is being delivered or run.",
        "Files may be lost and more hosts may be infected.",
        "Isolate the host, restore from clean copies and update detection."),
    "Data Exfiltration": (
        "Data leaves the network in an unusual way.",
        "Confidential records may be disclosed.",
        "Stop the transfer, keep the evidence and review access rights."),
    "Phishing & Credential Theft": (
        "Sign-in data is being guessed, collected or exposed.",
        "Accounts may be taken over.",
        "Lock and reset the accounts, require a second factor and limit sign-in rates."),
    "Network Infrastructure": (
        "Routing, switching or administration of the network is under attack.",
        "Traffic can be diverted, read or cut off.",
        "Check device configurations against known good copies and restrict administration access."),
    "ISP Abuse": (
        "A subscriber connection is used against the terms of service.",
        "Address reputation suffers and complaints follow.",
        "Notify the subscriber and filter the abusive traffic."),
    "VoIP & Telephony": (
        "Telephony signalling is being abused.",
        "Toll charges, blocked lines or overheard calls may result.",
        "Restrict signalling to known peers and cap call rates and destinations."),
    "IoT & Smart Home": (
        "A connected device behaves as if it were taken over.",
        "The device can spy on its owner or join an attack.",
        "Change default passwords, update firmware and separate the device network."),
    "Defense Evasion": (
        "A protective control was switched off.",
        "Later steps of an intrusion may pass unseen.",
        "Turn the control back on and find out who changed it."),
    "Network Abuse": (
        "An interface is called far more often than intended.",
        "Capacity is used up and content may be harvested.",
        "Throttle the caller and require keys."),
    "Persistence": (
        "A way to return to the host was planted.",
        "The actor can come back after a clean-up.",
        "Remove the change, rotate keys and review the host."),
}

THREAT_NOTES: dict[str, str] = {
    "Port Scanning / Reconnaissance": "Many ports or services were probed one after another.",
    "Network Reconnaissance": "A whole subnet is being surveyed.",
    "DDoS / Volumetric Attack": "A flood of packets or requests is aimed at one target.",
    "Amplification Attack": "Open servers are used to reflect enlarged answers at a victim.",
    "DNS Tunneling / Exfiltration": "Query names are long or encoded enough to carry data.",
    "DNS Cache Poisoning": "Forged answers are offered to a resolver.",
    "DNS Water Torture / NXDOMAIN Flood": "Random names that do not exist are queried at a high rate.",
    "C2 Beacon / Command & Control": "A device calls back to a controller or opens a remote shell.",
    "Tor / Anonymous Proxy Detected": "Traffic runs through an anonymising network.",
    "Cryptominer / Coin Miner": "Mining software or a mining pool protocol is in use.",
    "Malware Distribution": "A host serves or spreads malicious payloads.",
    "Ransomware Activity": "Files are being encrypted for ransom.",
    "Fileless Malware / LOLBins": "System tools are used to run hidden code.",
    "Data Exfiltration": "A large or hidden outbound transfer took place.",
    "Database Exfiltration / Dump": "A database was exported in bulk.",
    "Phishing Kit": "A page imitates a sign-in form to collect passwords.",
    "Credential Dumping": "Stored credentials were read from memory or disk.",
    "Brute-Force Authentication": "Sign-ins fail again and again from one source.",
    "Credential Stuffing": "Leaked name and password pairs are tried on many accounts.",
    "Password Spraying": "A few passwords are tried on many accounts.",
    "Credential Exposure in Logs": "A secret is written in clear text to the log.",
    "BGP Hijacking": "A prefix is announced by a network that should not announce it.",
    "Man-in-the-Middle (MitM)": "Someone sits between two parties and alters or downgrades traffic.",
    "Router Compromise": "A router was changed without approval.",
    "Lateral Movement / Pass-the-Hash": "Stolen credentials are used to move between hosts.",
    "Spam Campaign": "Bulk mail is sent from a subscriber.",
    "Port Forwarding Abuse": "Internal services are exposed by port mappings.",
    "Proxy Abuse": "An open proxy forwards traffic for others.",
    "Copyright Infringement": "Protected works are shared by peer-to-peer transfer.",
    "Account Sharing": "One account is used from several places at once.",
    "VoIP Fraud": "Calls are placed at the cost of someone else.",
    "TDoS Attack": "A flood of calls ties up a telephone system.",
    "SIP Registration Attack": "SIP registrations are guessed.",
    "Eavesdropping": "Call signalling is being intercepted.",
    "IoT Botnet": "A connected device joined a botnet.",
    "Smart Home Abuse": "A home hub is controlled without permission.",
    "CCTV Camera Compromise": "A camera feed is viewed without permission.",
    "Smart Meter Tampering": "Meter readings do not fit the consumption.",
    "Firewall / Security Control Disabled": "A firewall or access control was disabled.",
    "SSH Key / Authorized Keys Tampering": "SSH keys or server settings were altered.",
    "API Abuse / Scraping": "An interface is scraped or overloaded by automation.",
    "Exploit Attempt": "A known exploit or its payload was seen in action.",
    "SQL Injection": "SQL fragments were placed in request input.",
}
THREAT_CATEGORY: dict[str, str] = {s.name: s.category for s in SIGNATURES} | {"SQL Injection": "Data Exfiltration"}

DEFAULT_EXPLANATION = "Signature '{}' matched."
DEFAULT_IMPACT = "Possible exposure or loss of service."
DEFAULT_MITIGATION = "Review the logs, block the source and check the affected system."

NETWORK_CONDITION_NOTE = (
    "The network is slower or less reliable than usual; this is not an attack.",
    "Higher delay, loss or jitter.",
    "Check link load, routes and queues.")
SERVICE_CONDITION_NOTE = (
    "A service is less available than usual; this is not an attack.",
    "Slower answers, timeouts or changed routes.",
    "Check resolvers, routing sessions and device logs.")


def narrative_rows() -> list[tuple[str, str, str, str]]:
    """(threat, explanation, impact, mitigation) for every described threat."""
    return [
        (name, note, *CATEGORY_NOTES[THREAT_CATEGORY[name]][1:])
        if THREAT_CATEGORY[name] in CATEGORY_NOTES
        else (name, note, DEFAULT_IMPACT, DEFAULT_MITIGATION)
        for name, note in THREAT_NOTES.items()
    ]


def category_rows() -> list[tuple[str, str, str, str]]:
    """(category, explanation, impact, mitigation)."""
    return [(name, *texts) for name, texts in CATEGORY_NOTES.items()]
