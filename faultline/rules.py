"""Word lists, thresholds, patterns and column contracts.

These are plain values that results depend on, kept in their natural order.
"First match wins" wherever a list is ordered.
"""

# ---------------------------------------------------------------- fixed values
# Error phrases, in order of priority, with the error type each one names.
ERROR_PHRASES = [
    ("SLA MISS DETECTED", "SLAMiss"),
    ("SLA breach", "SLAMiss"),
    ("sla_missed=True", "SLAMiss"),
    ("SLA MISSED", "SLAMiss"),
    ("did not complete within", "SLAMiss"),
    ("SLA threshold", "SLAMiss"),
    ("UniqueViolation", "UniqueViolation"),
    ("duplicate key value", "UniqueViolation"),
    ("unique constraint", "UniqueViolation"),
    ("OperationalError", "OperationalError"),
    ("could not connect", "OperationalError"),
    ("connection refused", "OperationalError"),
    ("FileNotFoundError", "FileNotFoundError"),
    ("No such file or directory", "FileNotFoundError"),
    ("NullValueError", "NullValueError"),
    ("null value in column", "NullValueError"),
    ("DataError", "DataError"),
    ("invalid input syntax", "DataError"),
    ("IntegrityError", "IntegrityError"),
    ("ForeignKeyViolation", "ForeignKeyViolation"),
    ("foreign key constraint", "ForeignKeyViolation"),
    ("DivisionByZero", "DivisionByZero"),
    ("division by zero", "DivisionByZero"),
    ("Intentional failure", "PipelineTestError"),
    ("Task failed with exception", "PipelineTestError"),
]

# Words that make a line the fallback error message.
ERROR_LINE_WORDS = ["duplicate key", "violation", "failed", "exception", "traceback"]

# Error message patterns, tried in this order, ignoring case.
ERROR_MESSAGE_PATTERNS = [
    r"Exception:\s*(.+)",
    r"Caused by:\s*(.+)",
    r"Failure caused by\s*(.+)",
    r"ERROR.*?-\s*(.+)",
]

# Lower-case text that any match of the pattern at the same place holds.
ERROR_MESSAGE_LITERALS = ["exception:", "caused by:", "failure caused by", "error"]
PRODUCT_ID_LITERAL = "product_id"

# Product id patterns, tried in this order, ignoring case.
PRODUCT_ID_PATTERNS = [
    r"Key \(product_id\)=\((\d+)\)",
    r"product_id\)=\((\d+)\)",
    r"product_id\s*[=:]\s*(\d+)",
    r'"product_id":\s*(\d+)',
]

ISO_TIMESTAMP_PATTERN = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"
ERROR_MESSAGE_CHARS = 300
TRACEBACK_WORD = "Traceback"
TRACEBACK_CHARS = 2000

# Log line layout: [yyyy-MM-dd HH:mm:ss] `LEVEL` - message
LOG_HEADER_PATTERN = r"\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]\s+`([A-Z]+)`\s+-\s+(.*)"
LOG_SOURCE_PATTERN = r"source=([\w.]+)"
LOG_LOC_PATTERN = r"loc=([\S]+)"
LOG_EVENT_COLUMNS = [
    "dag_id", "run_id", "task_id", "attempt",
    "timestamp", "level", "event_type",
    "message", "source", "loc", "traceback",
]

# Event types by (field, phrases that must all occur, event type), in order.
EVENT_RULES = [
    ("message", ["sla miss detected"], "SLA_MISS"),
    ("message", ["failure detected"], "FAILURE_TRIGGER"),
    ("message", ["autorca"], "AUTORCA"),
    ("message", ["task failed"], "TASK_ERROR"),
    ("traceback", ["uniqueviolation"], "DB_DUPLICATE_KEY"),
    ("traceback", ["not all arguments"], "DB_TYPE_ERROR"),
    ("message", ["task instance is in running"], "TASK_START"),
    ("message", ["task instance in failure"], "TASK_END_FAILURE"),
    ("message", ["inserted"], "INSERT_SUCCESS"),
    ("message", ["read", "rows"], "DATA_READ"),
    ("message", ["exported"], "EXPORT"),
]
EVENT_LEVELS = ["ERROR", "WARNING"]
EVENT_DEFAULT = "INFO"

# Case id columns: the first with a value is chosen; lookups go in this order too.
CASE_ID_CANDIDATES = [
    "incident_id", "incident_number", "plim_incident_id", "case_id", "ticket_id",
    "ticket_number", "issue_id", "jira_id", "id",
]
CASE_LOOKUP_COLUMNS = [
    "incident_id", "incident_number", "plim_incident_id", "case_id", "ticket_id",
    "issue_id", "id",
]
HIT_ID_KEYS = [
    "incident_id", "incident_number", "plim_incident_id", "case_id", "ticket_id", "id",
]

# Columns that the case store adds and that are no source content.
INTERNAL_COLUMNS = [
    "case_document", "comment_length", "source_dataset", "source_schema_json",
    "source_column_mapping_json", "raw_fields_json", "rag_case_id_source_column",
    "schema_signature",
]
CASE_FIRST_COLUMNS = [
    "incident_id", "incident_number", "plim_incident_id", "source_dataset",
    "schema_signature", "rag_case_id_source_column", "comment_length",
    "case_document", "raw_fields_json", "source_schema_json",
    "source_column_mapping_json",
]
GENERATED_ID_SOURCE = "generated_from_row_hash"
GENERATED_ID_PREFIX = "GENERATED_CASE_"

# Order of the lines of a case document: columns whose name holds the token.
DOCUMENT_TOKENS = [
    "incident_id", "case_id", "ticket_id", "issue_title", "title", "summary",
    "scenario_type", "priority", "severity", "status", "dag_id", "task_id",
    "execution_date", "failure_time", "resolved_time", "duration",
    "error_message", "log", "root_cause", "fix", "resolution",
    "business_impact", "preventive_action",
]
DOCUMENT_INLINE_CHARS = 120

# Chunk metadata: preferred columns, then columns whose name holds a token.
METADATA_HINTS = [
    "priority", "severity", "status", "scenario_type", "category",
    "failure_pattern", "dag_id", "task_id", "source_system", "target_system",
    "target_table", "owner", "team", "environment", "service", "database",
    "table", "recurrence_flag",
]
METADATA_TOKENS = [
    "id", "status", "priority", "severity", "type", "category", "system",
    "table", "source", "target", "owner", "team", "env", "service",
]
METADATA_MAX_COLUMNS = 20
METADATA_MAX_CHARS = 300

CHUNK_CHARS = 1200
CHUNK_OVERLAP = 200
TOP_K_CASES = 5
EVIDENCE_TOP_K = 7
CANDIDATE_MULTIPLIER = 4
SOURCE_DATASET = "retail_product_incident_history"

# Incident record fields read from a case.
INCIDENT_TEXT_FIELDS = [
    "incident_id", "issue_title", "priority", "scenario_type", "dag_id", "task_id",
    "root_cause", "fix_applied", "business_impact", "recurrence_flag",
    "failure_pattern", "similar_incident_ids", "insert_method",
    "airflow_worker_memory", "postgres_shared_buffers", "postgres_work_mem",
    "case_document",
]
INCIDENT_WHOLE_FIELDS = [
    "record_volume", "batch_size", "sla_threshold_seconds", "recurrence_count",
]
INCIDENT_DECIMAL_FIELDS = [
    "elapsed_seconds", "rows_per_second", "sla_breached_by_seconds",
    "fix_reduced_time_by_pct", "estimated_improvement_pct",
]
SIMILARITY_STEP = 0.05
VOLUME_TOLERANCE = 0.5
BEST_FIX_CHARS = 300

# Products and loads.
PRODUCT_SCHEMA = (
    "product_id bigint, product_name string, category string, brand string, "
    "collection string, color string, size string, gender string, "
    "supplier_id string, supplier_name string, cost_price decimal(12,2), "
    "selling_price decimal(12,2), discount_pct double, inventory_qty int, "
    "reorder_level int, rating double, review_count int, status string, "
    "created_date date"
)
LOAD_CHUNK_ROWS = 10000
LOAD_INSERT_METHOD = "execute_values"
LOADS = {
    "1M": {"total_rows": 1_000_000, "sla_seconds": 30},
    "2M": {"total_rows": 2_000_000, "sla_seconds": 60},
    "3M": {"total_rows": 3_000_000, "sla_seconds": 90},
}
SLA_RUN_ID = "sla_miss"

# Health thresholds.
TREND_SAMPLES = 10
TREND_BAND = 5.0
LONG_ACTIVE_SECONDS = 30
SLOW_QUERY_SECONDS = 1
QUERY_EXCERPT_CHARS = 200
CPU_CRITICAL = {"percent": 90.0, "load_per_core": 2.0, "iowait": 25.0}
CPU_WARNING = {"percent": 70.0, "load_per_core": 1.2, "iowait": 10.0}
MEMORY_CRITICAL = {"ram": 90.0, "swap": 40.0}
MEMORY_WARNING = {"ram": 85.0, "swap": 10.0}
ACTIVITY_CRITICAL = {"connections": 90.0, "locks": 5, "slow": 5}
ACTIVITY_WARNING = {"connections": 70.0, "locks": 0, "slow": 0}
BUFFER_HIT_LOW = 90.0
OOM_PHRASES = ["Out of memory", "oom-killer"]
HEALTH_RANKS = {"CRITICAL": 3, "WARNING": 2, "MONITOR": 1}

# Confidence weights, in hundredths: base for a successful source, then extras.
CONFIDENCE = {
    "log": 20, "log_type": 10, "log_product": 10,
    "audit": 10, "audit_message": 10,
    "product": 10, "product_exists": 10,
    "history_many": 20, "history_one": 10, "history_benchmarks": 5,
    "host": 5, "host_alarm": 5,
    "performance": 5,
    "runtime": 5, "runtime_counters": 5, "runtime_alarm": 5,
}
GAP_BAND = 10.0

REPORT_TAGS = [
    "summary", "evidence_analysis", "root_cause", "sla_analysis",
    "performance_insights", "business_impact", "resolution",
    "preventive_actions", "confidence_score",
]
DEFAULT_CONFIDENCE = 0.5

SEVERITY = {
    "UniqueViolation": "P1",
    "OperationalError": "P1",
    "FileNotFoundError": "P2",
    "NullValueError": "P2",
    "SLAMiss": "P2",
    "Unknown": "P3",
}
SEVERITY_DEFAULT = "P3"

CONSTRAINT_PATTERNS = [
    r"""(?i)unique constraint ["']?([a-zA-Z0-9_]+)["']?""",
    r"""(?i)constraint ["']?([a-zA-Z0-9_]+)["']?""",
]

RESOLUTION_DEFAULTS = ["Manual investigation required", "Review logs", "Re-trigger DAG"]
RESOLUTION_PADDING = "See full resolution in RCA report"
PREVENTION_DEFAULTS = [
    "Add data quality checks", "Implement UPSERT logic", "Add staging validation",
]
PREVENTION_PADDING = "Review and implement best practices"

IMPACT_SLA = ("Delayed", "Delayed", "Impacted")
IMPACT_FAILED = ("Failed", "Delayed", "Impacted")
IMPACT_NONE = ("OK", "OK", "Not impacted")
SLA_ERROR_TYPES = ["SLAMiss", "sla_miss"]

HISTORY_START = ["HISTORICAL BENCHMARK"]
HISTORY_STOP = [
    "BOTTLENECK", "OPTIMIZATION", "INFRASTRUCTURE", "MOST SUCCESSFUL", "CURRENT RUN",
]
COMPARISON_WORDS = [
    "historical average", "performance gap", "trend:", "faster than", "slower than",
    "improving", "degrading",
]
BEST_FIX_WORDS = ["most successful", "historical fix", "historical improvement"]
HISTORY_LINES = 6
SECTION_LINES = 4
LINE_CHARS = 200
SUMMARY_CHARS = 400
VERDICT_CHARS = 900

# Sentences that are results; a name in braces stands for a value.
SLA_MESSAGE = (
    "Task '{task}' in DAG '{dag}' exceeded its configured SLA threshold. "
    "Task did not complete within the allowed time window."
)
CHECK_SLA_ROWS = "SLA Miss — {rows} rows being processed. No product lookup required."
CHECK_SLA = "SLA Miss — no product lookup required."
CHECK_FOUND = "Product ID {id} exists — {name}"
CHECK_NOT_FOUND = "Product ID {id} not found in product_master"
CHECK_UNAVAILABLE = "DB check unavailable"
CLOSEST_CASE = "{found} similar case(s) found — closest: {id}"
NO_CLOSEST_CASE = "No similar historical cases found"
ISSUE_SLOW = "{n} slow/active query(s) >= {seconds}s"
ISSUE_LOCKS = "{n} waiting lock(s) — possible contention"
ISSUE_DEADLOCKS = "{n} deadlock(s) recorded since stats reset"
ISSUE_TEMP_FILES = "{n} temp file(s) used — possible work_mem pressure"
ISSUE_BUFFER_HIT = "Buffer hit ratio low at {n}% — possible insufficient shared_buffers"
# ------------------------------------------------------------ end fixed values
