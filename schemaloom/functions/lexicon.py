"""Word lists, suffixes and thresholds that rules must share for equal results."""


PII = {
    "contact": ["email", "phone", "mobile", "fax", "telephone"],
    "name": [
        "first_name", "last_name", "full_name", "middle_name", "maiden_name", "given_name", "family_name", "nickname",
        "display_name", "legal_name", "preferred_name",
    ],
    "gov_id": [
        "ssn", "social_security", "passport", "license", "driver_license", "national_id", "tax_id", "ein", "tin",
        "citizen_id", "resident_id",
    ],
    "financial": [
        "salary", "wage", "income", "compensation", "credit_card", "bank_account", "routing_number", "iban", "swift",
        "account_number",
    ],
    "personal_date": ["birth_date", "birthdate", "dob", "date_of_birth"],
    "location": ["address", "street", "home_address", "residence", "location", "zip_code", "postal_code", "postcode"],
    "medical": ["medical", "health", "diagnosis", "prescription", "patient", "hipaa"],
    "biometric": ["fingerprint", "retina", "facial", "biometric", "photo", "image", "picture"],
    "device_user_id": ["ip_address", "mac_address", "device_id", "imei", "uuid", "username", "login"],
}
PII_EXCLUDE_EXACT = ["id", "uuid", "guid", "key", "index", "order", "position", "rank"]
PII_EXCLUDE_SUFFIXES = ["_id", "_uuid", "_guid", "_key", "_ref", "_index"]
SECRETS = [
    "password", "pwd", "secret", "token", "api_key", "apikey", "private_key", "access_token", "refresh_token",
    "auth_token", "session_token", "bearer_token",
]
SECRET_SUFFIXES = ["_secret", "_token", "_private_key"]
GENERIC = ["data", "value", "info", "details", "metadata", "content"]
ABBREVIATIONS = [
    "id", "uid", "uuid", "guid", "url", "uri", "api", "ip", "mac", "http", "https", "ftp", "ssh", "ssl", "tls", "os",
    "cpu", "gpu", "ram", "ssd", "db", "pk", "fk", "pdf", "jpg", "png", "gif", "svg", "html", "css", "js", "min",
    "max", "avg", "sum", "std", "var", "ssn", "ein", "vat", "gst", "sku", "upc", "isbn", "at", "by", "to", "ts", "no",
    "ui", "ux", "qa", "ci", "cd", "etl",
]
RESERVED = [
    "all", "and", "any", "array", "as", "asc", "assert_rows_modified", "at", "between", "by", "case", "cast",
    "collate", "contains", "create", "cross", "cube", "current", "default", "define", "desc", "distinct", "else",
    "end", "enum", "escape", "except", "exclude", "exists", "extract", "false", "fetch", "following", "for", "from",
    "full", "group", "grouping", "groups", "hash", "having", "if", "ignore", "in", "inner", "intersect", "interval",
    "into", "is", "join", "lateral", "left", "like", "limit", "lookup", "merge", "natural", "new", "no", "not",
    "null", "nulls", "of", "on", "or", "order", "outer", "over", "partition", "preceding", "proto", "range",
    "recursive", "respect", "right", "rollup", "rows", "select", "set", "some", "struct", "tablesample", "then", "to",
    "treat", "true", "unbounded", "union", "unnest", "using", "when", "where", "window", "with", "within",
]
BLOBS = [
    "json", "metadata", "properties", "config", "data", "payload", "content", "details", "attributes", "extra", "raw",
    "blob", "params", "options", "settings",
]
DATE_ONLY = [
    "birth_date", "birthdate", "date_of_birth", "dob", "hire_date", "hired_date", "start_date", "end_date",
    "expiry_date", "expiration_date", "due_date", "publish_date", "published_date", "release_date",
]
NUMERIC_WORDS = [
    "count", "total", "sum", "quantity", "amount", "price", "cost", "fee", "balance", "num", "qty", "score", "rating",
    "rank",
]
STRING_EXCLUSIONS = ["iso_", "iso", "_code", "country", "region", "state", "province"]
BOOLEAN_PREFIXES = ["is_", "has_", "can_", "should_", "will_", "was_", "were_"]
BOOLEAN_WORDS = ["enabled", "disabled", "active"]
FLOAT_MONEY = ["price", "cost", "amount", "balance", "tax", "fee", "payment", "salary", "revenue", "total"]
MONEY = ["amount", "price", "cost", "fee", "revenue", "balance", "payment", "total"]
ENUMS = ["status", "state", "type", "category", "level", "priority", "role", "kind"]
TYPE_SUFFIXES = ["_string", "_str", "_int", "_integer", "_bool", "_boolean", "_array", "_list", "_dict", "_map"]
BINARY = ["hash", "digest", "signature", "checksum", "image_data", "file_content", "binary", "hex", "base64"]
PARTITIONS = ["partition_date", "event_date", "date", "_partitiontime"]
EPOCHS = ["_epoch", "_ts", "_ms", "_seconds", "epoch", "unix"]
DURATIONS = ["_duration", "_ttl", "_age", "_latency", "_elapsed"]
INSTANTS = ["_at", "_timestamp", "created", "updated", "occurred", "published", "sent", "received"]
EVENT_TIMES = ["event_time", "event_timestamp", "created_at", "occurred_at", "timestamp"]
LOW_CARDINALITY = ["status", "state", "type", "flag", "is_"]
LATITUDES = ["lat", "latitude"]
LONGITUDES = ["lon", "lng", "longitude"]
ARRAY_KEYS = ["id", "uuid", "guid", "key", "index", "code", "name", "type", "identifier"]
ORDER_FIELDS = ["order", "order_in_profile", "sequence", "position", "index", "sort_order"]
STRING_DATES = ["date", "time", "timestamp", "created", "updated", "modified", "deleted", "_at", "_on"]
RECOMMENDED_AUDIT = ["created_at", "updated_at", "_transform_created_at", "_transform_updated_at"]
AUDIT_PAIRS = [
    ("created_at", "created_by"), ("updated_at", "updated_by"), ("deleted_at", "deleted_by"),
    ("_source_created_at", "_source_updated_at"), ("_transform_created_at", "_transform_updated_at"),
    ("_valid_from", "_valid_to"), ("activated_at", "activated_by_id"),
]
AUDIT = [
    "created_at", "created_on", "creation_time", "create_time", "insert_time", "updated_at", "updated_on",
    "update_time", "modification_time", "modified_at", "deleted_at", "deleted_on", "deletion_time", "delete_time",
    "last_modified", "last_updated", "last_changed", "_source_created_at", "_source_updated_at",
    "_transform_created_at", "_transform_updated_at", "activated_at", "deactivated_at", "premium_activated_at",
    "premium_deactivated_at", "registered_at", "sent_at", "first_active_at", "last_active_at", "expiration_date",
    "default_expiration_date", "created_by", "creator", "creator_id", "created_by_user", "author", "updated_by",
    "updater", "updater_id", "updated_by_user", "modifier", "deleted_by", "deleter", "deleter_id", "deleted_by_user",
    "activated_by_id", "owner_id", "owner_name", "version", "revision", "etag", "row_version", "version_number",
    "_values_hash", "is_deleted", "deleted", "active", "archived", "source", "source_system", "source_id",
    "source_table", "origin", "origin_system", "data_source", "ingested_at", "ingested_on", "ingestion_time",
    "imported_at", "imported_on", "import_time",
]
TEMPORAL = [
    "calendar_date", "interaction_date", "event_date", "activation_date", "graduation_date", "close_date",
    "event_timestamp", "event_time",
]
TRACKING = [
    "session_id", "anonymous_id", "session_type", "feed_tracking_id", "search_id", "request_id", "trace_id",
    "correlation_id",
]
SYSTEMS = [
    "external_id", "external_job_id", "external_job_new_id", "ats_id", "sfdc_account_id", "sfdc_id", "utm_source",
    "utm_medium", "utm_campaign", "utm_content", "utm_term",
]
SCD = [
    "effective_start", "effective_end", "valid_from", "valid_to", "_valid_from", "_valid_to", "start_date",
    "end_date", "is_current", "is_active", "current_flag", "active_flag",
]
CLASS_SUFFIXES = [
    "_type", "_category", "_segment", "_tier", "_level", "_role", "_channel", "_status", "_state", "_phase", "_stage",
]
METRIC_SUFFIXES = [
    "_count", "_total", "_sum", "_avg", "_average", "_mean", "_median", "_min", "_max", "_rate", "_ratio", "_percent",
    "_pct", "_percentage", "_amount", "_quantity", "_qty", "_rank", "_score", "_index", "_weight",
]
FACT_KEYS = ["fact_id", "row_id", "id", "pk", "surrogate_key", "_surrogate_key", "sk"]
FACT_KEY_SUFFIXES = ["_id", "_key", "_sk", "_surrogate_key"]
ADDITIVE = [
    "amount", "price", "cost", "fee", "revenue", "qty", "quantity", "count", "units", "seconds", "minutes", "hours",
    "total", "sum",
]
SEMI_ADDITIVE = ["balance", "snapshot", "on_hand", "end_qty", "inventory", "outstanding", "pending"]
NON_ADDITIVE = ["rate", "ratio", "pct", "percent", "percentage", "avg", "average", "median", "distinct", "margin"]
DATE_DIMENSIONS = ["dim_date", "dim_time", "date_dim", "time_dim"]
ROLE_DATES = ["_date", "_dt", "_timestamp", "_ts", "_time"]
JUNK = ["status", "type", "flag", "indicator", "code"]
BRIDGE_SUFFIXES = ["_bridge", "_xref", "_mapping"]
SNAPSHOTS = ["snapshot", "daily", "weekly", "monthly", "period"]
LINE_ITEMS = ["items", "line_items", "order_items", "details", "lines"]
PARENTS = ["parent_id", "parent_key", "manager_id", "superior_id", "parent"]
HELPERS = ["level", "depth", "path", "lineage", "is_leaf", "leaf_flag"]
HIERARCHIES = ["department", "category", "location", "territory", "region"]
MILESTONES = ["order", "ship", "deliver", "start", "end", "complete", "cancel", "approve"]
DEGENERATE = [
    "order_number", "invoice_number", "po_number", "transaction_id", "confirmation_number", "tracking_number",
    "ticket_id", "case_number", "claim_number", "serial_number", "batch_number", "lot_number",
]
DEGENERATE_SUFFIXES = ["_number", "_code", "_id", "_reference", "_ref", "_ticket", "_confirmation", "_tracking"]
DEGENERATE_PREFIXES = [
    "order_", "invoice_", "po_", "ticket_", "transaction_", "confirmation_", "tracking_", "reference_",
]
NATURAL_KEY_SUFFIXES = ["_code", "_number", "_name", "_identifier", "_ref"]
DIM_KEYS = ["id", "key", "sk", "surrogate_key"]
DIM_KEY_SUFFIXES = ["_key", "_sk", "_id"]
SNAPSHOT_DATES = ["as_of_date", "snapshot_date", "valid_on", "report_date", "effective_date"]
RAPID = ["_preference", "_status", "_setting", "_flag", "_option", "_choice", "_state"]
VOLATILE = [
    "status", "state", "phase", "stage", "last_login", "last_activity", "last_updated", "last_accessed", "score",
    "rating", "rank", "level", "tier", "count", "total", "number_of", "balance", "credit", "points", "rewards",
    "is_active", "is_enabled", "is_suspended", "is_locked",
]
UOM_WORDS = [
    "length", "width", "height", "depth", "weight", "amount", "distance", "volume", "mass", "temperature", "duration",
    "speed", "velocity",
]
UOM_SUFFIXES = ["_uom", "_unit", "_units", "_measurement_unit"]
CODE_VALUES = [
    ("status_code", "status_text"), ("status_code", "status_name"), ("status_code", "status_description"),
    ("type_code", "type_text"), ("type_code", "type_name"), ("type_code", "type_description"),
    ("category_code", "category_text"), ("category_code", "category_name"), ("state_code", "state_text"),
    ("state_code", "state_name"),
]
HEADER_IDS = ["order_id", "invoice_id", "document_id", "header_id", "parent_id", "request_id"]
LINE_IDS = ["line_item_id", "line_id", "item_id", "detail_id", "position", "line_number", "sequence_number"]
FISCAL = ["fiscal_year", "fiscal_quarter", "fiscal_month", "fiscal_week", "fiscal_period"]
WEEKS = ["week_of_year", "iso_week", "week_number", "week_start_date", "week_end_date"]
CRITICAL = [
    "id", "key", "uuid", "guid", "primary", "foreign", "email", "phone", "name", "title", "status", "state",
    "created", "updated", "modified", "deleted", "active", "user", "account", "customer", "order", "payment",
]
METADATA = [
    "created", "updated", "modified", "timestamp", "version", "revision", "audit", "log", "trace", "debug", "meta",
    "internal", "system",
]
#: Safe type changes: from, to.
WIDENING = [
    ("int", "float"), ("int", "str"), ("float", "str"), ("bool", "str"), ("date", "str"), ("date", "timestamp"),
    ("time", "str"), ("time", "timestamp"),
]
#: Type names to atoms.
SQL_TYPES = {
    "tinyint": "int", "smallint": "int", "int2": "int", "integer": "int", "int": "int", "int4": "int",
    "bigint": "int", "int8": "int", "serial": "int", "bigserial": "int", "int64": "int", "float": "float",
    "float4": "float", "float8": "float", "double": "float", "double precision": "float", "real": "float",
    "numeric": "float", "decimal": "float", "float64": "float", "bignumeric": "float", "boolean": "bool",
    "bool": "bool", "varchar": "str", "character varying": "str", "char": "str", "character": "str", "text": "str",
    "citext": "str", "uuid": "str", "json": "str", "jsonb": "str", "bytea": "str", "string": "str", "bytes": "str",
    "geography": "str", "date": "date", "time": "time", "time without time zone": "time",
    "time with time zone": "time", "timestamp": "timestamp", "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamp", "timestamptz": "timestamp", "datetime": "timestamp",
}
SPARK_TYPES = {
    "byte": "int", "short": "int", "int": "int", "integer": "int", "long": "int", "bigint": "int", "tinyint": "int",
    "smallint": "int", "float": "float", "double": "float", "decimal": "float", "boolean": "bool", "bool": "bool",
    "string": "str", "binary": "str", "varchar": "str", "char": "str", "timestamp": "timestamp",
    "timestamp_ntz": "timestamp", "timestamp_ltz": "timestamp", "date": "date",
}
BQ_TYPES = {
    "STRING": "str", "INT64": "int", "INTEGER": "int", "FLOAT64": "float", "FLOAT": "float", "NUMERIC": "number",
    "BIGNUMERIC": "number", "BOOL": "bool", "BOOLEAN": "bool", "DATE": "date", "DATETIME": "datetime", "TIME": "time",
    "TIMESTAMP": "timestamp", "BYTES": "bytes", "GEOGRAPHY": "geography", "JSON": "json", "INTERVAL": "interval",
}
PROTO_TYPES = {
    "int32": "int", "int64": "int", "uint32": "int", "uint64": "int", "sint32": "int", "sint64": "int",
    "fixed32": "int", "fixed64": "int", "sfixed32": "int", "sfixed64": "int", "float": "float", "double": "float",
    "bool": "bool", "string": "str", "bytes": "str",
}
