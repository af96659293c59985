"""Word lists, patterns, formats and limits that decide results.

Everything here is data that must keep exactly these values for results to be
right; the code that uses it lives elsewhere.
"""

# --- fixed values: default limits -------------------------------------------
QUERY_LIMIT = 500
AROUND_LIMIT = 200
REMOTE_QUERY_LIMIT = 100
STREAMS_LIMIT = 20
GROUPS_LIMIT = 50
RETENTION_LIMIT = 100
FIELD_SAMPLE = 20
HISTORY_KEEP = 50
DETECT_LINES = 10
SAMPLE_VALUE_CHARS = 60
SHORT_PTR_CHARS = 12
FULL_PTR_CHARS = 50
SIMILAR_DISTANCE = 3
SIMILAR_KEEP = 3
SPIKE_BAR_WIDTH = 40
SPIKE_HIGH = 0.8
SPIKE_MEDIUM = 0.5
SCAN_PRICE_PER_GIB = 0.005
BUCKET = "5 minutes"
CONTEXT_LOOKBACK = "30m"

# --- fixed values: JSON keys, in the order they are tried ---------------------
JSON_TIMESTAMP_KEYS = [
    "timestamp", "time", "@timestamp", "ts", "datetime", "date",
    "Timestamp", "Time", "DateTime", "Date",
]
JSON_MESSAGE_KEYS = [
    "message", "msg", "log", "text", "body",
    "Message", "Msg", "Log", "Text", "Body",
]

# --- fixed values: plain-text time stamp prefixes, in the order they are tried --
# (name, pattern of the prefix, how its groups spell the time, zone is in text)
PLAIN_PREFIXES = [
    ("iso_zoned", r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:(\.\d{1,6})\d*)?(Z|[+-]\d{2}:\d{2})\s+", "$1 $2$3$4", True),
    ("iso", r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:(\.\d{1,6})\d*)?\s+", "$1 $2$3", False),
    ("millis", r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})[,.](\d{3})\s+", "$1 $2.$3", False),
    ("seconds", r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+", "$1 $2", False),
    ("bracketed", r"^\[(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\]\s*", "$1 $2", False),
    ("program", r"^\S+\s+(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}):\s*", "$1 $2", False),
    ("us", r"^(\d{2})/(\d{2})/(\d{4})\s+(\d{2}:\d{2}:\d{2})\s+", "$3-$1-$2 $4", False),
    ("eu", r"^(\d{2})-(\d{2})-(\d{4})\s+(\d{2}:\d{2}:\d{2})\s+", "$3-$2-$1 $4", False),
]
PLAIN_UNIX = r"^[\[(](\d{10,13})[\])]\s*"
EPOCH_MILLIS_ABOVE = 1_000_000_000_000

# --- fixed values: syslog -------------------------------------------------------
SYSLOG_5424 = r"(?s)^<(\d+)>1\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$"
SYSLOG_3164 = r"(?s)^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\s+(\S+)\s+(.*)$"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# --- fixed values: Java layouts, in the order they are tried ----------------------
# (pattern, order in which its groups give date, time, level, thread, logger, message)
JAVA_LAYOUTS = [
    (r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}[,.]\d{3})\s+(\w+)\s+\[([^\]]+)\]\s+(\S+)\s+-\s+(.*)$", (1, 2, 3, 4, 5, 6)),
    (r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}\.\d{3})\s+\[([^\]]+)\]\s+(\w+)\s+(\S+)\s+-\s+(.*)$", (1, 2, 4, 3, 5, 6)),
    (r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+\[([^\]]+)\]\s+(\w+)\s+(\S+)\s+-\s+(.*)$", (1, 2, 4, 3, 5, 6)),
    (r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}[,.]\d{3})\s+(\w+)\s+(.*)$", (1, 2, 3, 0, 0, 4)),
    (r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+(\w+)\s+(.*)$", (1, 2, 3, 0, 0, 4)),
    (r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2}\.\d{3})Z?\s+(\w+)\s+(.*)$", (1, 2, 3, 0, 0, 4)),
    (r"^(\d{2}:\d{2}:\d{2}[,.]\d{3})\s+\|-(\w+)\s+in\s+(.*)$", (0, 1, 2, 0, 0, 3)),
    (r"^(\d{2}:\d{2}:\d{2}[,.]\d{3})\s+(\w+)\s+(.*)$", (0, 1, 2, 0, 0, 3)),
]
ANSI_CODE = r"\x1b\[[0-9;]*m"
TRACE_LINE = (
    r"^(?:[ \t]+(?:at |\.\.\. )|[ \t]*(?:Caused by:|Suppressed:"
    r"|[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)*\.[A-Z][A-Za-z0-9_]*(?:Exception|Error|Throwable)))"
)
JAVA_LEVEL_WORD = r" (?:INFO|DEBUG|WARN|ERROR|TRACE|FATAL) "

# --- fixed values: statistics -----------------------------------------------------
STATISTICS = ["Sum", "Average", "Minimum", "Maximum", "SampleCount"]
STAT_ALIASES = {
    "Sum": ["Sum", "sum", "SUM"],
    "Average": ["Average", "average", "avg", "AVG"],
    "Minimum": ["Minimum", "minimum", "min", "MIN"],
    "Maximum": ["Maximum", "maximum", "max", "MAX"],
    "SampleCount": ["SampleCount", "samplecount", "count", "COUNT"],
}
STATS_COLUMN_RANK = {"time_bucket": 0, "count": 1, "blocks": 1, "sum": 2, "avg": 3, "min": 4, "max": 5}

# --- fixed values: field names ------------------------------------------------------
ENVELOPE_FIELDS = ["@timestamp", "@logStream", "@message", "@ptr"]
REPORTED_FIELDS = ["@message", "@timestamp", "@logStream", "@logGroup", "@ptr"]
