"""Registry of the 14 captured tables.

A column kind says how the wire text becomes a typed value:

=========  =======================================================
uuid       required identifier; a bad one sends the row to dead letters
uuid?      optional identifier; a bad or empty one is NULL
text       '' when absent
ts         timestamp, 1970-01-01 when absent or unreadable
ts?        timestamp, NULL when absent or unreadable
int, long  number, 0 when absent or unreadable
flag       boolean, false when absent or unreadable
=========  =======================================================
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SPARK_TYPES = {
    "uuid": "string",
    "uuid?": "string",
    "text": "string",
    "ts": "timestamp",
    "ts?": "timestamp",
    "int": "int",
    "long": "bigint",
    "flag": "boolean",
}


@dataclass(frozen=True)
class TableSpec:
    name: str
    topic: str
    columns: dict[str, str]
    month_column: str | None = None
    derived: dict[str, str] = field(default_factory=dict)
    keys: tuple[str, ...] = ("id",)

    def wire_type(self, exclude: tuple[str, ...] = ()) -> T.StructType:
        """The row image on the wire; every field is text so one odd value
        cannot void the whole row."""
        return T.StructType([T.StructField(c, T.StringType()) for c in self.columns if c not in exclude])

    def stored_ddl(self) -> str:
        parts = [f"{c} {SPARK_TYPES[k]}" for c, k in self.columns.items()]
        parts += ["_version bigint", "_is_deleted boolean", "_arrival struct<at:bigint,row:bigint>"]
        parts += [f"{c} {t}" for c, t in self.derived.items()]
        return ", ".join(parts)


# fixed values: tables, topics and columns as the connector names them
_SPECS = [
    TableSpec(
        "inbound_event_logs",
        "inbound_event_log",
        {
            "id": "uuid",
            "cloudevents_id": "text",
            "source": "text",
            "correlation_id": "text",
            "raw_payload": "text",
            "status": "text",
            "rejection_reason": "text",
            "error_details": "text",
            "received_at": "ts",
            "updated_at": "ts",
            "event_time": "ts?",
        },
        "received_at",
        {
            "subject": "string",
            "event_type": "string",
            "facility_id": "string",
            "resource_type": "string",
            "practitioner_ref": "string",
            "practitioner_display": "string",
            "is_transfer_encounter": "boolean",
        },
    ),
    TableSpec(
        "protocol_definitions",
        "protocol_definition",
        {
            "id": "uuid",
            "url": "text",
            "version": "text",
            "status": "text",
            "definition": "text",
            "loaded_at": "ts",
            "updated_at": "ts",
        },
        None,
        {"name": "string"},
    ),
    TableSpec(
        "protocol_instances",
        "protocol_instance",
        {
            "id": "uuid",
            "patient_id": "text",
            "protocol_canonical": "text",
            "protocol_definition_id": "uuid",
            "status": "text",
            "enrolled_at": "ts",
            "created_at": "ts",
            "updated_at": "ts",
        },
        "enrolled_at",
    ),
    TableSpec(
        "step_instances",
        "step_instance",
        {
            "id": "uuid",
            "protocol_instance_id": "uuid",
            "action_id": "text",
            "repeat_index": "int",
            "state": "text",
            "due_date": "ts?",
            "overdue_date": "ts?",
            "missed_date": "ts?",
            "completed_at": "ts?",
            "completed_by_source": "text",
            "completion_status": "text",
            "completed_by_event_id": "uuid?",
            "required_behavior": "text",
            "created_at": "ts",
            "updated_at": "ts",
        },
        "created_at",
    ),
    TableSpec(
        "protocol_instance_history",
        "protocol_instance_history",
        {
            "id": "long",
            "protocol_instance_id": "uuid",
            "status": "text",
            "changed_at": "ts",
        },
        "changed_at",
    ),
    TableSpec(
        "step_instance_history",
        "step_instance_history",
        {
            "id": "long",
            "step_instance_id": "uuid",
            "state": "text",
            "completion_status": "text",
            "changed_at": "ts",
        },
        "changed_at",
    ),
    TableSpec(
        "deviations",
        "deviation",
        {
            "id": "uuid",
            "protocol_instance_id": "uuid",
            "step_instance_id": "uuid",
            "deviation_type": "text",
            "detected_at": "ts",
            "intelligence_event_id": "uuid?",
            "metadata": "text",
            "updated_at": "ts",
        },
        "detected_at",
    ),
    TableSpec(
        "compliance_event_logs",
        "compliance_event_log",
        {
            "id": "uuid",
            "cloudevents_id": "text",
            "source": "text",
            "correlation_id": "text",
            "processing_status": "text",
            "data": "text",
            "received_at": "ts",
            "updated_at": "ts",
        },
        "received_at",
    ),
    TableSpec(
        "action_definitions",
        "action_definition",
        {
            "id": "uuid",
            "canonical_url": "text",
            "version": "text",
            "name": "text",
            "title": "text",
            "status": "text",
            "action_type": "text",
            "definition": "text",
            "created_at": "ts",
            "updated_at": "ts",
        },
    ),
    TableSpec(
        "intelligence_event_logs",
        "intelligence_event_log",
        {
            "id": "uuid",
            "action_definition_id": "uuid",
            "protocol_instance_id": "uuid",
            "step_instance_id": "uuid?",
            "deviation_id": "uuid?",
            "subject": "text",
            "action_type": "text",
            "intelligence_destination": "text",
            "step_state": "text",
            "trigger_reason": "text",
            "step_action_id": "text",
            "evaluation_expression": "text",
            "evaluation_context": "text",
            "published": "flag",
            "published_at": "ts?",
            "created_at": "ts",
        },
        "created_at",
    ),
    TableSpec(
        "intelligence_deliveries",
        "intelligence_delivery",
        {
            "id": "uuid",
            "intelligence_event_id": "uuid",
            "action_definition_id": "uuid",
            "destination_adaptor_mapping_id": "uuid?",
            "action_type": "text",
            "status": "text",
            "subject": "text",
            "protocol_canonical": "text",
            "action_id": "text",
            "severity": "text",
            "destination": "text",
            "delivery_result": "text",
            "attempt_count": "int",
            "created_at": "ts",
            "updated_at": "ts",
            "delivered_at": "ts?",
        },
        "created_at",
        {"http_status_code": "int", "error_message": "string"},
    ),
    TableSpec(
        "receiver_adaptor",
        "receiver_adaptor",
        {
            "id": "uuid",
            "name": "text",
            "definition": "text",
            "status": "text",
            "config": "text",
            "created_at": "ts",
            "updated_at": "ts",
        },
        None,
        {"endpoint_url": "string"},
    ),
    TableSpec(
        "destination_adaptor_mapping",
        "destination_adaptor_mapping",
        {
            "id": "uuid",
            "destination": "text",
            "receiver_adaptor_id": "uuid",
            "status": "text",
            "created_at": "ts",
            "updated_at": "ts",
        },
    ),
    TableSpec(
        "facility",
        "facility",
        {
            "id": "uuid",
            "facility_id": "text",
            "facility_name": "text",
            "expected_patients_per_day": "long",
            "district_name": "text",
            "created_at": "ts",
            "updated_at": "ts",
        },
    ),
]

TABLES: dict[str, TableSpec] = {spec.name: spec for spec in _SPECS}
