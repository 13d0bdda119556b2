"""Fixed values of the data model. They define results, so they are stated literally."""

# Message types the platform knows.
VALID_TYPES = (
    "temperature_sensor",
    "climate_sensor",
    "ev_charger",
    "grid_meter",
    "motion_sensor",
    "financial_stream",
    "energy_meter",
    "solar_panel",
    "battery",
)
UNKNOWN_TYPE = "unknown"

ENTITY_TYPES = ("device", "sensor", "actuator", "gateway", "other", "unknown")

SCHEMA_VERSION = "1.0.0"
DEFAULT_SCHEMA_VERSION = "1.0"
DEFAULT_SOURCE = "unknown"

# Stages a message can fail in.
STAGE_PROCESS = "process"
STAGE_TRANSFORM = "transform"
STAGE_STORE = "store"

# Error types.
ERROR_TYPES = (
    "validating_message",
    "storing_message",
    "processing_message",
    "polling_message",
    "validating_data",
    "marshaling_message",
    "unmarshalling_message",
)

# Reasons.
REASON_POLL = "failed to poll message"
REASON_PROCESS = "failed to process message"
REASON_VALIDATE_MESSAGE = "failed to validate message"
REASON_STORE = "failed to store message"
REASON_UNMARSHAL = "failed to unmarshal message"
REASON_MARSHAL = "failed to marshal message"
REASON_VALIDATE_DATA = "failed to validate data"

# Plain error texts.
MISSING_DEVICE_ID = "missing required field DeviceId"
MISSING_TYPE = "missing field Type"
MISSING_TIMESTAMP = "missing field Timestamp"
UNKNOWN_DATA_TYPE = "unknown data type"
NIL_MESSAGE = "message is nil"
EVENT_NOT_FOUND = "event not found"
INVALID_CURSOR = "invalid cursor"

# Paging.
MIN_PAGE_SIZE = 1
MAX_PAGE_SIZE = 100
DEFAULT_PAGE_SIZE = 20

# Log redaction.
REDACTED = "[REDACTED]"
TRUNCATED_SUFFIX = "…[truncated]"
REDACT_KEYS = ("token", "password", "secret", "authorization")
MAX_VALUE_BYTES = 512

# Characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Formats.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
# Spellings a stored id may have: plain, without dashes, in braces, as a URN.
READABLE_UUID_PATTERN = (
    r"^(?:(?i:urn:uuid:)?H{8}-H{4}-H{4}-H{4}-H{12}|\{H{8}-H{4}-H{4}-H{4}-H{12}\}|H{32})\z".replace("H", "[0-9a-fA-F]")
)
ZERO_UUID = "00000000-0000-0000-0000-000000000000"
RFC3339_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)\z"
)
SEMVER_PATTERN = (
    r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)"
    r"(?:-((?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*))*))?"
    r"(?:\+([0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*))?\z"
)
ERROR_LINE_PATTERN = "(?i)error|failed|panic"

# Quality thresholds.
STALE_AFTER_SECONDS = 120
THROUGHPUT_TIERS = ((100, "Excellent"), (50, "Good"), (25, "Moderate"))
LOWEST_TIER = "Poor"
REGRESSION_PERCENT = 10
PEAK_BACKLOG_LOW = 100
PEAK_BACKLOG_MEDIUM = 1000
AVERAGE_BACKLOG_MEDIUM = 500
PEAK_BACKLOG_HIGH = 10000
FINAL_BACKLOG_HIGH = 1000
# Default explicit bucket boundaries of a duration histogram.
LATENCY_BOUNDARIES = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)
