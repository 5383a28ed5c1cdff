"""Word lists, lookup tables, patterns and thresholds that results depend on."""

# --- severity ---------------------------------------------------------------------------
SEVERITY_LEVELS = {
    "trace": 0, "debug": 1, "info": 2, "warn": 3, "warning": 3, "error": 4, "err": 4,
    "fatal": 5, "critical": 5, "crit": 5, "emerg": 5, "emergency": 5,
}
SEVERITY_NAMES = {0: "TRACE", 1: "DEBUG", 2: "INFO", 3: "WARN", 4: "ERROR", 5: "FATAL"}
MODEL_SEVERITY_NAMES = {0: "DEBUG", 1: "DEBUG", 2: "INFO", 3: "WARNING", 4: "ERROR", 5: "CRITICAL"}
SEVERITY_WORD = r"\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|ERR|FATAL|CRIT(?:ICAL)?|EMERG(?:ENCY)?)\b"
DEFAULT_SEVERITY = 2

# --- input field names ------------------------------------------------------------------
TIMESTAMP_FIELDS = ["timestamp", "time", "datetime", "@timestamp", "ts", "date", "created_at"]
SEVERITY_FIELDS = ["severity", "level", "log_level", "loglevel", "priority"]
MESSAGE_FIELDS = ["message", "msg", "body", "log", "text", "content"]
SERVICE_FIELDS = ["service", "service_name", "serviceName", "app", "application"]
HOST_FIELDS = ["host", "hostname", "server", "machine", "node"]
TRACE_FIELDS = ["trace_id", "traceId", "trace", "request_id", "requestId"]
SPAN_FIELDS = ["span_id", "spanId", "span"]

CSV_MESSAGE = ["Content", "content", "Message", "message", "RawLog"]
CSV_DATE = ["Date", "date"]
CSV_TIME = ["Time", "time"]
CSV_LEVEL = ["Level", "level", "Severity", "severity"]
CSV_SERVICE = ["Component", "component", "Service", "service"]
CSV_HOST = ["Node", "node", "Host", "host"]
CSV_KNOWN = [
    "lineid", "date", "time", "content", "message", "level", "severity", "component", "service",
    "node", "host", "eventtemplate", "eventid", "parameterlist", "rawlog",
]

LOG_SUFFIXES = [".log", ".txt", ".jsonl", ".csv"]
# A file of more estimated lines than this is mined in the fast mode.
FAST_MODE_LINES, BYTES_PER_LINE = 50_000, 100
MAX_FILE_BYTES = 500 * 1024 * 1024

# --- timestamps: tried in this order ----------------------------------------------------
TIMESTAMP_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    r"\[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\]",
    r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"^\d{10}(?:\.\d+)?$",
    r"^\d{13}$",
    r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}",
]

# --- word lists for labels --------------------------------------------------------------
CATEGORY_WORDS = [
    ("error", ["error", "exception", "failed", "failure", "fatal"]),
    ("warning", ["warning", "warn", "caution"]),
    ("security", ["attack", "malicious", "intrusion", "unauthorized", "denied"]),
    ("performance", ["slow", "timeout", "latency", "performance"]),
]
DOMAIN_WORDS = [
    ("web_server", ["http", "apache", "nginx", "request", "response"]),
    ("database", ["sql", "database", "query", "mysql", "postgres"]),
    ("authentication", ["auth", "login", "password", "credential", "ssh"]),
    ("system", ["kernel", "systemd", "service", "daemon"]),
    ("network", ["network", "socket", "connection", "tcp", "udp"]),
    ("distributed", ["hadoop", "spark", "kubernetes", "container"]),
]
LABEL_SEVERITY_WORDS = [
    ("critical", ["fatal", "critical", "emergency", "panic"]),
    ("high", ["error", "failed", "failure"]),
    ("medium", ["warning", "warn"]),
    ("low", ["info", "notice"]),
]
TEXT_DOMAIN_WORDS = [
    ("web_server", ["apache", "nginx", "http", "200", "404", "500"]),
    ("database", ["mysql", "postgres", "database", "query", "sql"]),
    ("authentication", ["ssh", "login", "auth", "password"]),
    ("network", ["network", "socket", "connection", "tcp", "udp"]),
    ("system", ["kernel", "systemd", "boot", "shutdown"]),
]
DATASET_DOMAINS = {
    "Android": "mobile", "Apache": "web_server", "BGL": "system", "Hadoop": "distributed",
    "HDFS": "distributed", "HealthApp": "application", "HPC": "system", "Linux": "system",
    "Mac": "system", "OpenSSH": "authentication", "OpenStack": "distributed",
    "Proxifier": "network", "Spark": "distributed", "Thunderbird": "system",
    "Windows": "system", "Zookeeper": "distributed",
}
MESSAGE_SEVERITY_WORDS = [
    ("CRITICAL", ["fatal", "critical", "emergency", "panic"]),
    ("ERROR", ["error", "failed", "failure", "exception"]),
    ("WARNING", ["warning", "warn"]),
    ("DEBUG", ["debug"]),
]
ERROR_WORDS = ["error", "failed", "failure", "exception", "crash", "fatal", "critical", "panic", "abort"]
SECURITY_WORDS = [
    "attack", "malicious", "intrusion", "unauthorized", "denied", "blocked", "violation",
    "exploit", "injection", "breach",
]
# Words that mark a row as a threat when the threat model is tuned.
THREAT_TRUTH_WORDS = [
    "attack", "malicious", "unauthorized", "breach", "exploit", "injection", "xss", "csrf", "sql injection", "brute force",
    "ddos", "dos", "flood", "intrusion", "vulnerability", "failed login", "authentication failed", "access denied",
    "permission denied", "invalid password", "root", "sudo", "shell", "exec", "eval", "script", "../", "etc/passwd",
]
ANOMALY_WORDS = [
    "exception", "failed", "error", "crash", "timeout", "refused", "denied", "unauthorized", "invalid",
]
BOOST_WORDS = ["failed", "error", "exception", "timeout", "refused", "denied"]
FREQUENCY_WORDS = ["spike", "surge", "flood", "burst"]
NOVELTY_WORDS = ["unusual", "unexpected", "unknown", "new"]

EVENT_SIGNATURES = [
    ("AUTH", ["login", "auth"]),
    ("FAIL", ["failed", "error"]),
    ("SUCCESS", ["success"]),
    ("REQUEST", ["request", "get", "post"]),
    ("ACCESS", ["access"]),
    ("DENIED", ["denied", "blocked"]),
]
AUTH_FAILURE_WORDS = ["failed", "failure", "invalid", "denied", "rejected"]
AUTH_WORDS = ["auth", "login", "password", "credential"]
ATTACK_WORDS = ["attack", "malicious", "exploit", "intrusion"]

# --- patterns ---------------------------------------------------------------------------
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
USER_PATTERN = r"(?i)user[=:\s]+([^\s,;]+)"
PORT_PATTERN = r"(?i)port[=:\s]+(\d+)"
PATH_PATTERN = r"(?i)(?:GET|POST|PUT|DELETE)\s+(/[^\s]*)"

ENTITY_PATTERNS = {  # name -> (pattern, group)
    "ip_address": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0),
    "file_path": (r"(?:/[^\s/:]+)+", 0),
    "url": (r"https?://[^\s<>\"{}|\\^`\[\]]+", 0),
    "error_code": (r"\b[A-Z]{2,10}[_-]?\d{3,5}\b", 0),
    "timestamp": (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", 0),
    "user": (r"(?i)\buser[=:\s]+([^\s,;]+)", 1),
    "pid": (r"(?i)\bpid[=:\s]+(\d+)", 1),
    "port": (r"(?i)\bport[=:\s]+(\d+)", 1),
}

TOKEN_PLACEHOLDERS = [
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", " IP_ADDR "),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", " TIMESTAMP "),
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", " UUID "),
    (r"0x[0-9a-f]+", " HEX_NUM "),
    (r"\b\d+\b", " NUM "),
    (r"/[^\s]+", " PATH "),
]
TOKEN_PATTERN = r"\b[a-z_][a-z_0-9]*\b"

BEHAVIOUR_FEATURES = [
    "http_4xx", "http_5xx", "path_traversal", "sensitive_paths", "script_extensions",
    "url_encoded", "special_char_ratio", "high_numbers", "base64_patterns", "hex_patterns",
    "ip_count", "cmd_patterns", "longest_word", "auth_context",
]

# --- keyword security rules -------------------------------------------------------------
SECURITY_RULES = {
    "authentication_failures": (2, [
        "failed password", "authentication fail", "login fail", "invalid credential",
        "access denied", "unauthorized", "permission denied", "auth fail", "bad password",
        "invalid password", "wrong password", "login denied", "auth error", "authfail",
        "login_error", "invalid user", "invalid login", "authentication error", "login failed",
        "session expired", "invalid token", "token expired",
    ]),
    "brute_force_indicators": (3, [
        "too many", "repeated fail", "blocked", "rate limit", "lockout", "multiple fail",
        "max attempt", "account locked", "throttl", "ban", "consecutive fail", "attempt limit",
        "bruteforce", "brute force",
    ]),
    "suspicious_access": (5, [
        "injection", "malicious", "exploit", "attack", "suspicious", "forbidden", "violation",
        "intrusion", "hack", "threat", "vulnerability", "sql injection", "xss", "csrf",
        "malware", "phishing", "scanner", "directory traversal", "../", "shell", "cmd=", "exec(",
    ]),
    "network_issues": (1, [
        "connection refused", "timeout", "unreachable", "connection reset", "port scan",
        "network error", "dns fail", "socket error", "connection fail", "host not found",
        "no route", "connection timed out", "connection closed", "reset by peer", "broken pipe",
        "network unreachable", "proxy error",
    ]),
    "system_errors": (2, [
        "error state", "error]", "[error", "critical", "fatal", "panic", "crash", "segfault",
        "out of memory", "oom", "kernel", "core dump", "stack trace", "exception",
        "null pointer", "500 ", "502 ", "503 ", "504 ", "internal server error",
        "service unavailable", "mod_jk", "worker",
    ]),
}
CRITICAL_COUNTS = {"suspicious_access": 10, "brute_force_indicators": 20}
RISK_FLOORS = [("LOW", 90), ("MEDIUM", 70), ("HIGH", 50), ("CRITICAL", 0)]
RECOMMENDATION_COUNTS = [
    ("review_authentication", "authentication_failures", 10),
    ("lock_out_brute_force", "brute_force_indicators", 5),
    ("review_suspicious_access", "suspicious_access", 0),
    ("check_network", "network_issues", 50),
    ("check_system_errors", "system_errors", 100),
]

# --- domains, examples and transfer rules for questions ---------------------------------
DOMAIN_KEYWORDS = {
    "web_server": ["apache", "nginx", "http", "request", "response", "status", "url", "GET", "POST"],
    "authentication": ["login", "auth", "password", "failed", "success", "user", "session",
                       "credential", "ssh", "kerberos"],
    "system": ["kernel", "systemd", "service", "daemon", "process", "memory", "cpu", "disk", "cron"],
    "network": ["connection", "timeout", "refused", "socket", "port", "tcp", "udp", "network", "firewall"],
    "database": ["query", "database", "sql", "transaction", "deadlock", "replication", "index"],
    "application": ["exception", "error", "warning", "stack", "trace", "null", "failed", "success"],
    "security": ["attack", "malicious", "intrusion", "blocked", "violation", "unauthorized", "exploit"],
    "distributed": ["hadoop", "spark", "kubernetes", "container", "pod", "node", "cluster", "replica"],
}
EXAMPLES = [  # id, source domain, applicable domains, question
    ("auth_failure_analysis", "authentication", ["web_server", "system", "security", "network"],
     "Why are there so many authentication failures?"),
    ("connection_timeout_analysis", "network", ["web_server", "database", "distributed", "application"],
     "What's causing the connection timeouts?"),
    ("error_spike_analysis", "application", ["web_server", "database", "system", "distributed"],
     "Why did errors suddenly spike?"),
    ("resource_exhaustion", "system", ["database", "web_server", "application", "distributed"],
     "What's causing out of memory errors?"),
    ("security_intrusion", "security", ["authentication", "web_server", "network", "system"],
     "Are we under attack?"),
    ("distributed_failure", "distributed", ["database", "application", "network", "system"],
     "Why are jobs failing in the cluster?"),
    ("performance_degradation", "web_server", ["database", "application", "network", "system"],
     "Why is the system slow?"),
    ("log_pattern_anomaly", "application", ["web_server", "system", "database", "distributed"],
     "What unusual patterns should I look for?"),
]
TRANSFER_RULES = [  # rule, source, target, pattern
    ("authentication_to_web", "authentication", "web_server",
     "If SSH auth failures increase, check web login endpoints"),
    ("network_to_database", "network", "database",
     "Network issues manifest as database connection pool exhaustion"),
    ("system_to_application", "system", "application",
     "OOM/CPU issues cause application exceptions and timeouts"),
    ("web_to_database", "web_server", "database", "Request spikes cause database query queuing"),
    ("security_to_all", "security", "all", "Attacks create correlated anomalies in multiple log types"),
]
QUESTION_TYPES = [
    ("why", ["why", "cause", "reason"]),
    ("what", ["what", "which", "describe"]),
    ("how", ["how", "explain"]),
    ("when", ["when", "time", "occurred"]),
    ("unusual", ["unusual", "anomaly", "strange", "weird"]),
    ("attack", ["attack", "security", "breach", "malicious"]),
    ("slow", ["slow", "performance", "latency", "timeout"]),
    ("error", ["error", "fail", "crash", "exception"]),
]

# --- question tagging -------------------------------------------------------------------
SEARCH_PHRASES = [
    ("incorrect password", ["authentication failed", "invalid password", "wrong password", "login failed", "access denied"]),
    ("wrong password", ["authentication failed", "invalid password", "login failed", "access denied"]),
    ("not correct pass", ["authentication failed", "invalid password", "login failed", "access denied"]),
    ("bad password", ["authentication failed", "invalid password", "login failed"]),
    ("password fail", ["authentication failed", "invalid password", "login failed"]),
    ("auth fail", ["authentication failed", "login failed", "unauthorized", "access denied"]),
    ("login fail", ["login failed", "authentication failed", "access denied"]),
    ("cant login", ["login failed", "authentication failed", "access denied"]),
    ("access denied", ["access denied", "permission denied", "unauthorized", "forbidden"]),
    ("connection refused", ["connection refused", "ECONNREFUSED", "could not connect"]),
    ("timeout", ["timeout", "timed out", "connection timeout", "request timeout"]),
    ("network error", ["network error", "connection failed", "unreachable", "host down"]),
    ("out of memory", ["out of memory", "OOM", "memory allocation", "cannot allocate"]),
    ("disk full", ["disk full", "no space left", "disk space", "ENOSPC"]),
    ("file not found", ["file not found", "ENOENT", "no such file", "does not exist"]),
    ("sql injection", ["SQL injection", "SQLi", "SELECT FROM", "UNION SELECT", "1=1"]),
    ("xss", ["XSS", "cross-site scripting", "<script>", "javascript:"]),
    ("brute force", ["brute force", "multiple failed", "too many attempts", "rate limit"]),
]
SERVICE_ALIASES = [
    ("health app", "health"), ("access log", "access"), ("open ssh", "ssh"), ("open stack", "openstack"),
]
SERVICE_MENTIONS = [
    r"logs?\s+(?:from|of|for|related to)\s+(\w+)",
    r"(\w+)\s+logs?",
    r"related to\s+(\w+)",
    r"from\s+(\w+)",
    r"show me\s+(\w+)",
]
NOT_A_SERVICE = [
    "the", "all", "any", "some", "error", "warning", "failed", "logs", "log", "show", "find",
    "get", "give", "me", "please", "can", "you", "with", "recent", "latest", "last", "first",
    "more", "less", "many", "few",
]
SEARCH_MENTIONS = [
    r"where (?:is|are|can i find)(?: the)? (.+?)(?:\?|$)",
    r"show me (.+?)(?:\?|$)",
    r"find (.+?)(?:\?|$)",
    r"search for (.+?)(?:\?|$)",
    r"look(?:ing)? for (.+?)(?:\?|$)",
    r"logs? (?:with|containing|about|related to) (.+?)(?:\?|$)",
]
MENTION_STOP_WORDS = ["the", "and", "for", "are", "was", "logs", "log", "with", "not", "that", "this", "any", "all"]
SEARCH_KEYWORDS = [
    "failed", "error", "login", "password", "authentication", "timeout", "connection", "denied",
    "unauthorized", "exception", "crash", "warning", "success", "blocked", "invalid", "expired",
    "refused", "forbidden", "critical", "fatal", "panic", "alert", "emergency",
]
NOUN_STOP_WORDS = ["show", "find", "give", "look", "search", "logs", "where", "what", "when", "correct", "incorrect"]
SEARCH_INDICATORS = [
    "where is", "where are", "show me", "find", "search", "look for", "looking for",
    "can you find", "can i see", "give me", "list", "logs with", "logs containing",
    "in the logs", "from the logs", "in my logs", "examples of",
]
GENERIC_TERMS = ["related", "logs", "log", "show", "find", "give"]

# --- threat actions ---------------------------------------------------------------------
THREAT_ACTIONS = {
    "brute_force": ["account_lockout", "login_captcha", "block_source", "review_accounts"],
    "injection": ["validate_input", "parameterize_queries", "add_waf_rules", "review_validation"],
    "reconnaissance": ["monitor_source", "review_firewall", "enable_ids", "block_scanners"],
    "attack_pattern": ["investigate_chain", "review_systems", "collect_forensics", "alert_security_team"],
}
URGENT_ACTION = "urgent_review"
INJECTION_ACTION_TYPES = ["sql_injection", "command_injection", "xss"]
RECON_ACTION_TYPES = ["port_scan", "directory_enum", "user_enum", "reconnaissance"]

CAPACITY_LIMITS = {"log_volume": 1_000_000.0, "storage_gb": 100.0, "requests_per_minute": 10_000.0}

# --- words left out of the term weights of the retraining job ---------------------------
ENGLISH_STOP_WORDS = """
    a about above across after afterwards again against all almost alone along already also although always am among amongst
    amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became because become
    becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call
    can cannot cant co con could couldnt cry de describe detail do done down due during each eg eight either eleven else
    elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first
    five for former formerly forty found four from front full further get give go had has hasnt have he hence her here
    hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is
    it its itself keep last latter latterly least less ltd made many may me meanwhile might mill mine more moreover most
    mostly move much must my myself name namely neither never nevertheless next nine no nobody none noone nor not nothing
    now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per
    perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six
    sixty so some somehow someone something sometime sometimes somewhere still such system take ten than that the their them
    themselves then thence there thereafter thereby therefore therein thereupon these they thick thin third this those
    though three through throughout thru thus to together too top toward towards twelve twenty two un under until up upon us
    very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever
    whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself
    yourselves
""".split()
