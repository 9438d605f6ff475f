"""Columns computed once, when a change row is stored, from its JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcmart.fixed_values import FACILITY_EXTENSION_MARK, TRANSFER_DISPLAY
from cdcmart.functions.columns import evaluated_once, text_or_empty

_EVENT_BODY = """
    subject STRING, type STRING, facilityid STRING,
    data STRUCT<
        resourceType: STRING, practitionerRef: STRING, practitionerDisplay: STRING,
        extension: STRING, type: STRING>
"""
_EXTENSIONS = "ARRAY<STRUCT<url: STRING, valueString: STRING>>"
_CODED_TYPES = "ARRAY<STRUCT<coding: ARRAY<STRUCT<display: STRING>>>>"


def strict_text(json: Column, path: str) -> Column:
    """Text at ``path`` only when the JSON value there is a string, else ''."""
    document = F.try_parse_json(json)
    found = F.try_variant_get(document, path, "variant")
    is_text = F.schema_of_variant(found) == F.lit("STRING")
    return F.when(is_text, text_or_empty(F.try_variant_get(document, path, "string"))).otherwise("")


def lenient_text(json: Column, path: str) -> Column:
    """Text at ``path``, numbers and objects as their JSON text, else ''."""
    return text_or_empty(F.get_json_object(json, path))


def derive_inbound(df: DataFrame, strict: bool = False) -> DataFrame:
    """Subject, type, facility, resource and practitioner of an inbound event.

    The body is parsed once into a struct; the two nested lists stay text until
    they are needed, so a wrong type in one of them cannot void the others.
    ``is_transfer_encounter`` is stored too, so the daily referral figures never
    parse the payload again.
    """
    parsed = evaluated_once(df, "_body", F.from_json("raw_payload", _EVENT_BODY))
    extensions = F.from_json("_body.data.extension", _EXTENSIONS)
    source_facility = F.get(
        F.filter(extensions, lambda e: e["url"].contains(FACILITY_EXTENSION_MARK)), F.lit(0)
    )["valueString"]
    coded = F.from_json("_body.data.type", _CODED_TYPES)
    is_transfer = F.exists(
        coded,
        lambda t: F.coalesce(
            F.exists(t["coding"], lambda c: F.coalesce(c["display"] == TRANSFER_DISPLAY, F.lit(False))),
            F.lit(False),
        ),
    )

    def text(field: str, path: str) -> Column:
        if strict:
            return strict_text(F.col("raw_payload"), path)
        return text_or_empty(F.col(f"_body.{field}"))

    envelope_facility = text("facilityid", "$.facilityid")
    return parsed.select(
        *df.columns,
        text("subject", "$.subject").alias("subject"),
        text("type", "$.type").alias("event_type"),
        F.when(envelope_facility != "", envelope_facility)
        .otherwise(text_or_empty(source_facility))
        .alias("facility_id"),
        text("data.resourceType", "$.data.resourceType").alias("resource_type"),
        text("data.practitionerRef", "$.data.practitionerRef").alias("practitioner_ref"),
        text("data.practitionerDisplay", "$.data.practitionerDisplay").alias("practitioner_display"),
        F.coalesce(is_transfer, F.lit(False)).alias("is_transfer_encounter"),
    )


def derive_protocol_definition(df: DataFrame) -> DataFrame:
    title = lenient_text(F.col("definition"), "$.title")
    name = lenient_text(F.col("definition"), "$.name")
    return df.withColumn("name", F.when(title != "", title).otherwise(name))


def derive_delivery(df: DataFrame) -> DataFrame:
    status = F.get_json_object("delivery_result", "$.httpStatus").try_cast("int")
    return df.withColumns(
        {
            "http_status_code": F.nullif(status, F.lit(0)),
            "error_message": lenient_text(F.col("delivery_result"), "$.responseBody"),
        }
    )


def derive_receiver(df: DataFrame) -> DataFrame:
    return df.withColumn("endpoint_url", lenient_text(F.col("definition"), "$.address"))


def with_read_aliases(df: DataFrame, table: str) -> DataFrame:
    """Columns that exist only when a table is read."""
    return df.withColumn("patient_id", F.col("subject")) if table == "inbound_event_logs" else df


def canonical(url: Column, version: Column) -> Column:
    return F.concat(url, F.lit("|"), version)


DERIVATIONS = {
    "inbound_event_logs": derive_inbound,
    "protocol_definitions": derive_protocol_definition,
    "intelligence_deliveries": derive_delivery,
    "receiver_adaptor": derive_receiver,
}


def derive(df: DataFrame, table: str) -> DataFrame:
    """Add the stored derived columns of ``table``; other tables pass through."""
    rule = DERIVATIONS.get(table)
    return rule(df) if rule else df
