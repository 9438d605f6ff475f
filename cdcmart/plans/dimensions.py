"""The four lookup dimensions, as current views of their base tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcmart.functions.derive import canonical
from cdcmart.operators.changelog import current
from cdcmart.plans.marts import patient_facility_latest


def dict_protocol_definitions(tables: Mapping[str, DataFrame]) -> DataFrame:
    return current(tables, "protocol_definitions").select(
        "id", "name", "version", "url", canonical(F.col("url"), F.col("version")).alias("canonical"), "status"
    )


def dict_patient_facility(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Patient -> facility last seen at. As many rows as patients, so joins to
    it shuffle on the patient."""
    return patient_facility_latest(tables["inbound_event_logs"])


def dict_action_definitions(tables: Mapping[str, DataFrame]) -> DataFrame:
    return current(tables, "action_definitions").select("id", "canonical_url", "name", "action_type", "status")


def dict_delivery_adaptor(tables: Mapping[str, DataFrame]) -> DataFrame:
    mapping = current(tables, "destination_adaptor_mapping").select(
        F.col("id").alias("destination_adaptor_mapping_id"), "destination", "receiver_adaptor_id"
    )
    adaptor = current(tables, "receiver_adaptor").select(
        F.col("id").alias("receiver_adaptor_id"),
        F.col("name").alias("adaptor_name"),
        "endpoint_url",
        F.col("status").alias("adaptor_status"),
    )
    return mapping.join(adaptor, "receiver_adaptor_id").drop("receiver_adaptor_id")


DIMENSIONS = {
    "dict_protocol_definitions": dict_protocol_definitions,
    "dict_patient_facility": dict_patient_facility,
    "dict_action_definitions": dict_action_definitions,
    "dict_delivery_adaptor": dict_delivery_adaptor,
}
