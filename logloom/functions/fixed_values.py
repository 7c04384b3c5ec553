"""Values that decide results: word lists, lookup tables, constants, patterns.

They are fixed by the log formats and by the agreed results, so they stand
here as plain text and nothing else in the package repeats them.
"""

# --- Fixed values: patterns by which a line's format is told -----------------
FORMAT_PATTERNS = {
    "custom": r"\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\] \[\w+\] \[.*?\] .*",
    "syslog": r"^[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2} .+",
    "apache": r"\d+\.\d+\.\d+\.\d+ - - \[.*?\] \".*?\" \d{3} \d+",
    "apache_modjk": r"^\[\w{3}\s+\w{3}\s+\d{2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}\] \[\w+\]",
    "tomcat_connector": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[.,]\d{3}\s+\[\w+\]",
    "json": r"^\{.*\}$",
    "docker_json": r"^\{.*\"log\":.*\"time\":.*\}$",
    "kubernetes_json": r"^\{.*\"kubernetes\"\s*:\s*\{.*\}.*\}$",
    "cloudwatch_export": r"^\{.*\"logGroup\".*\"logStream\".*\"message\".*\}$",
    "gcp_cloud_logging": r"^\{.*(\"textPayload\"|\"jsonPayload\"|\"protoPayload\").*\}$",
    "windows_event_xml": r"^\s*<Event[ >].*",
}
FALLBACK_FORMAT = "generic"
DETECTION_LINES = 51
STRUCTURED_FORMATS = (
    "json",
    "docker_json",
    "kubernetes_json",
    "cloudwatch_export",
    "gcp_cloud_logging",
    "windows_event_xml",
)

# --- Fixed values: how a record starts in a file of stitched lines -----------
RECORD_START = (
    r"^(\[?\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}|"
    r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}|"
    r"\d+\.\d+\.\d+\.\d+ - - \[|"
    r"\[\w{3}\s+\w{3}\s+\d{2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}\]|"
    r"<Event|\{)"
)
XML_EVENT_START = r"^\s*<Event[ >]"
XML_EVENT = r"(?s)<Event[ >].*?</Event>"

# --- Fixed values: connector and servlet connector logs ----------------------
CONNECTOR_LINE = r"^\[([^\]\n]+)\]\s+\[(\w+)\]\s+(?s:(.*))$"
CONNECTOR_TIME = r"\[(\w{3}\s+\w{3}\s+\d{2}\s+\d{2}:\d{2}:\d{2}\s+\d{4})\]"
CONNECTOR_ISO_TIME = r"\[(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\]"
CONNECTOR_SEVERITY = r"\[(\w+)\]"
SERVLET_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})[.,]\d{3}\s+\[([\w \t]+)\]\s+(?s:(.*))$"
SERVLET_LINE_ANY_TIME = r"^(.*?)\s+\[([\w \t]+)\]\s+(?s:(.*))$"
# Kind of worker and its mark, first match wins.
WORKER_TYPES = (
    ("child_process", "Found child"),
    ("environment", "workerEnv"),
)
# Field, the mark a message must hold, and the pattern of the field's value.
WORKER_FACTS = (
    ("error_state", "workerEnv", r"error state (\d+)"),
    ("child_pid", "Found child", r"Found child (\d+)"),
    ("slot", "Found child", r"slot (\d+)"),
    ("config_file", ".properties", r"(/[^\s]+\.properties)"),
)

# --- Fixed values: syslog and web access lines -------------------------------
SYSLOG_LINE = r"^(\w{3} +\d+ \d{2}:\d{2}:\d{2}) (\S+) (.+?): (?s:(.*))$"
ACCESS_LINE = (
    r"^(\S+) \S+ \S+ \[([^\]\n]+)\] "
    r'"(([A-Z]+) ([^\s]+) [^"\n]+)" (\d{3}) \S+'
    r'(?: "[^"\n]*" "([^"\n]*)(")|(?!\S))(?s:.*)$'
)

# --- Fixed values: Windows events; attributes in either kind of quotes -------
EVENT_TIME = r"""<TimeCreated[^>]*SystemTime=["']([^"']+)["']"""
EVENT_LEVEL = r"<Level>(\d+)</Level>"
EVENT_PROVIDER = r"""<Provider[^>]*Name=["']([^"']+)["']"""
EVENT_DATA = r"(?s)<Data>(.*?)</Data>"
EVENT_NAMED_DATA = r"(?s)<Data\s[^>]*>(.*?)</Data>"

# --- Fixed values: line types, first match wins ------------------------------
LINE_TYPES = (
    ("HTTP_ACCESS", r"\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b .* HTTP/\d"),
    ("EXCEPTION", r"Traceback|Exception:|Error:|Caused by:|\bat\s+\w+\."),
    ("DB_ERROR", r"SQLSTATE|ORA-\d+|psql:|Sequelize|MongoError|jdbc|Deadlock"),
    ("TIMEOUT", r"timed? out|timeout|deadline exceeded"),
    ("AUTH", r"unauthorized|forbidden|invalid token|auth|login failed"),
    ("NETWORK", r"connection (reset|refused|closed)|ECONN|socket|TLS|SSL"),
    ("RESOURCE", r"out of memory|OOM|disk\s(full|quota)|cpu (throttle|limit)"),
    ("CONFIG", r"config|configuration|env var|missing key"),
    ("STARTUP_SHUTDOWN", r"(service|server) (starting|started|stopping|stopped)"),
    ("GC", r"GC \(|Garbage Collector|Allocation Failure"),
)
LINE_TYPE_OTHER = "OTHER"
LINE_TYPE_UNKNOWN = "UNKNOWN"

# --- Fixed values: HTTP, personal data, timings, user ids --------------------
HTTP_PATH = r"\b(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+([^\s\"]+)"
HTTP_STATUS = r"\s(\d{3})(?:\s|$)"
HTTP_METHOD = r"\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"
LEVEL_IS_STATUS = r"^(\d{3})$"
HTTP_MARK = "HTTP/"

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = (
    r"\b"
    r"(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)\.){3}"
    r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)"
    r"\b"
)
UUID = (
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-"
    r"[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
)
TOKEN = r"\b(?:eyJ[\w-]+\.[\w-]+\.[\w-]+|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z-_]{35})\b"
USER_ID = r"user[_-]?id\s*[:=]\s*([A-Za-z0-9_-]+)"
RESPONSE_TIME = (
    r"(?:latency|response[_-]?time|request[_-]?time|duration|time)"
    r"\s*[:=]\s*([0-9]*\.?[0-9]+)\s*(ms|s|sec|seconds)?"
)

# --- Fixed values: user agents, first match wins -----------------------------
UA_BROWSERS = (
    ("Chrome", r"Chrome\/[0-9]+"),
    ("Firefox", r"Firefox\/[0-9]+"),
    ("Safari", r"Version\/[0-9].*Safari"),
    ("Edge", r"Edg\/[0-9]+"),
    ("IE", r"MSIE|Trident"),
)
UA_SYSTEMS = (
    ("Windows", r"Windows NT"),
    ("macOS", r"Mac OS X"),
    ("Linux", r"Linux"),
    ("Android", r"Android"),
    ("iOS", r"iPhone|iPad"),
)
UA_DEVICES = (
    ("Mobile", r"Mobile|Android|iPhone|iPad"),
    ("Desktop", r"Windows NT|Mac OS X|X11; Linux"),
)
UA_OTHER = "Other"

# --- Fixed values: free text -------------------------------------------------
TIMESTAMP_IN_TEXT = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}|\d{2}:\d{2}:\d{2})"
LEVEL_IN_TEXT = r"\b(INFO|ERROR|WARN|WARNING|DEBUG|CRITICAL)\b"

# --- Fixed values: severity words and the levels they stand for --------------
SYSLOG_SEVERITY = r"\b(emerg|alert|crit|critical|err|error|warn|warning|notice|info|debug)\b"
SYSLOG_LEVELS = {
    "emerg": "CRITICAL", "alert": "CRITICAL", "crit": "CRITICAL",
    "critical": "CRITICAL", "err": "ERROR", "error": "ERROR",
    "warn": "WARNING", "warning": "WARNING", "notice": "INFO",
    "info": "INFO", "debug": "DEBUG",
}
CONNECTOR_LEVELS = {
    "emerg": "CRITICAL", "alert": "CRITICAL", "crit": "CRITICAL",
    "critical": "CRITICAL", "error": "ERROR", "warn": "WARNING",
    "warning": "WARNING", "notice": "INFO", "info": "INFO", "debug": "DEBUG",
}

# --- Fixed values: thresholds and sizes of the reports -----------------------
ROLLING_HOURS = 24
ROLLING_MIN_HOURS = 6
SPIKE_Z = 3
SPIKE_ERROR_RATIO = 0.5
TOP_PATHS = 20
TOP_MODULES = 20
TOP_ERROR_RATE_MODULES = 15
MIN_MODULE_VOLUME = 20
LOOKBACK_ROWS = 50
CLUSTER_VOCABULARY = 1000
CLUSTER_RESTARTS = 10
CLUSTER_SEED = 42
WEEKDAYS = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
)

# --- Fixed values: the characters text trimming removes ----------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: Spark's public list of English stop words, in its order ----
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd",
    "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've",
    "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't",
    "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't",
    "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's",
    "when's", "where's", "who's", "why's", "would",
)
