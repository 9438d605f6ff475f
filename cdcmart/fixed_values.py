"""Codes, patterns and limits that results depend on.

They are part of the data contract of the change streams, so they are stated
plainly here and nowhere else.
"""

# Change operations carried by an envelope; every other code is ignored.
ROW_OPERATIONS = ("c", "u", "r", "d")
DELETE_OPERATION = "d"
UNAVAILABLE_VALUE = "__debezium_unavailable_value"

# Status codes.
INBOUND_RECEIVED = "RECEIVED"
INBOUND_ACCEPTED = "ACCEPTED"
PROCESSING_OUTCOMES = ("MATCHED", "ZERO_MATCH", "DUPLICATE")
ENROLMENT_STATUSES = ("ACTIVE", "COMPLETED", "WITHDRAWN", "EXPIRED")
DEVIATION_TYPES = ("OVERDUE", "MISSED", "ORDER_VIOLATION")
STEP_DONE_STATES = ("COMPLETED", "SKIPPED")
DELIVERED = "DELIVERED"

# Referral recognition.
REFERRAL_ACTION_PATTERN = "^(.+-referral|referral)$"
TRANSFER_DISPLAY = "TRANSFER_ENCOUNTER"
ENCOUNTER = "Encounter"
FACILITY_EXTENSION_MARK = "source-facility"

# Value formats.
UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EPOCH = "1970-01-01 00:00:00"

# Retention and windows.
KPI_WINDOW_MONTHS = 12
LOG_RETENTION_DAYS = 90
RETAINED_TABLES = {
    "inbound_event_logs": "received_at",
    "compliance_event_logs": "received_at",
    "intelligence_event_logs": "created_at",
    "intelligence_deliveries": "created_at",
}

# Query-log analytics.
QUERY_FINISHED = "QueryFinish"
QUERY_FAILED = "ExceptionWhileProcessing"
SYSTEM_QUERY_LIKE = "%system.%"
HEAVY_QUERY_BYTES = 500_000_000
