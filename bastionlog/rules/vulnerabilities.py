"""Known-weakness catalogue: line signals, identifiers, scores and advice."""

from __future__ import annotations

# ---- fixed values: rule key -> lower-cased substrings of the line --------------------------------
# The Java serialisation magic is written in lower case because lines are lower-cased first.
SIGNALS: list[tuple[str, list[str]]] = [
    ("apache_2.4.49", ["apache/2.4.49"]),
    ("log4j", ["jndi:ldap", "jndi:dns", "log4shell", "log4j", "cve-2021-44228"]),
    ("nginx_1.18", ["nginx/1.18"]),
    ("sql_injection", ["union select", "sql injection", "' or 1=1", "or 1=1--"]),
    ("xss", ["<script>", "javascript:alert", "document.cookie"]),
    ("path_traversal", ["../", "..\\", "path traversal", "/etc/passwd", "/etc/shadow"]),
    ("ssrf", ["169.254.169.254", "ssrf", "metadata abuse", "imdsv1"]),
    ("xxe", ["<!doctype", "<!entity", "xxe", "system 'file:///"]),
    ("deserialization", ["deserialize", "insecure deserialization", "ro0ab"]),
    ("credential_exposure", ["password=", "credential exposure", "credential dumping", "lsass.exe"]),
    ("auth_weakness", ["failed password", "password spraying", "oauth token reuse", "forged jwt"]),
    ("container_escape", ["container escape", "docker.sock", "dirtycow", "pkexec privilege escalation"]),
    ("cloud_misconfig", ["kubectl exec", "assume role", "public-read", "clusterrolebinding", "iam policy abuse"]),
]
SERVER_ERROR = "server_error"

# ---- fixed values: rule key -> (id, score x 10, severity); texts are this project's own ----------
FACTS: list[tuple[str, str, int, str, str, str]] = [
    ("apache_2.4.49", "CVE-2021-41773", 75, "High",
     "Apache HTTP Server 2.4.49 lets a crafted path leave the document root.",
     "Move to Apache HTTP Server 2.4.51 or later."),
    ("log4j", "CVE-2021-44228", 100, "Critical",
     "Log4j message lookups resolve attacker-supplied JNDI addresses and can run remote code.",
     "Move to Log4j 2.15.0 or later, or switch message lookups off."),
    ("nginx_1.18", "CVE-2021-23017", 81, "High",
     "The NGINX resolver can be made to write one byte past its buffer.",
     "Move to NGINX 1.20.1 or later."),
    ("sql_injection", "CWE-89", 86, "High",
     "Request text carries SQL fragments, so a query is probably assembled from raw input.",
     "Bind query parameters, validate input and put a web application firewall in front."),
    ("xss", "CWE-79", 61, "Medium",
     "Script fragments from user input reach the application log.",
     "Escape output, set a Content Security Policy and clean user input."),
    ("path_traversal", "CWE-22", 75, "High",
     "Parent-directory sequences point to unsafe handling of file names.",
     "Normalise paths, confine file access to known folders and patch the service."),
    ("ssrf", "CWE-918", 82, "High",
     "The server was asked to call internal addresses such as the cloud metadata service.",
     "Block metadata addresses, check outbound targets and limit egress."),
    ("xxe", "CWE-611", 75, "High",
     "An XML payload declares external entities.",
     "Switch external entities off in XML parsers and check uploads."),
    ("deserialization", "CWE-502", 98, "Critical",
     "Serialised objects from outside reach a deserialiser.",
     "Do not deserialise outside data; keep a strict list of allowed types."),
    ("credential_exposure", "CWE-532", 71, "High",
     "Secrets are written to the application log.",
     "Mask secrets in logs and replace the exposed ones."),
    ("auth_weakness", "CWE-307", 59, "Medium",
     "Repeated failed sign-ins or reused tokens point to weak sign-in controls.",
     "Lock accounts after failures, require a second factor and watch sign-in anomalies."),
    ("container_escape", "CWE-250", 88, "High",
     "A container reaches for the host or its control socket.",
     "Cut container privileges and remove mounts of host sockets."),
    ("cloud_misconfig", "CWE-284", 80, "High",
     "Cloud or cluster rights are wider than needed and are being used.",
     "Grant least privilege, review role bindings and close public resources."),
    (SERVER_ERROR, "SYS-5XX", 33, "Medium",
     "The application answered with a 5xx status: instability, a bad setup or overload.",
     "Check the stack traces and keep them out of responses."),
]
SERVER_ERROR_RISK = 100  # tenths of a risk point
RISK_PER_SCORE = 3
RISK_LEVELS = [(80, "Critical"), (60, "High"), (30, "Medium")]
