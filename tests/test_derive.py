import json

import pytest
from pyspark.sql import functions as F

from cdcmart.functions import columns as C
from cdcmart.functions.derive import derive, derive_inbound
from helpers import as_dicts, at

FACILITY_URL = "http://x/source-facility"


def inbound(spark, *payloads, strict=False):
    rows = [(i, json.dumps(p) if not isinstance(p, str) else p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "n int, raw_payload string")
    return sorted(as_dicts(derive_inbound(df, strict)), key=lambda r: r["n"])


def test_facility_sources(spark):
    second = {"data": {"extension": [{"url": "http://x/o", "valueString": "no"}, {"url": FACILITY_URL, "valueString": "F2"}]}}
    got = inbound(
        spark,
        {"facilityid": "F1", **second},
        second,
        {"data": {"extension": [{"url": "http://x/o"}]}},
        {"data": {"extension": []}},
        "not json",
    )
    assert [r["facility_id"] for r in got] == ["F1", "F2", "", "", ""]


def test_transfer_marker_at_any_position(spark):
    def typed(*types):
        return {"data": {"type": [{"coding": [{"display": d} for d in t]} for t in types]}}

    got = inbound(
        spark,
        typed(["A"], ["B", "TRANSFER_ENCOUNTER"]),
        typed(["A"], []),
        {"data": {}},
        {"data": {"type": [{}]}},
        {"data": {"type": "odd"}},
    )
    assert [r["is_transfer_encounter"] for r in got] == [True, False, False, False, False]


def test_lenient_and_strict_text(spark):
    payload = {"subject": 5, "type": "t", "data": {"resourceType": {"x": 1}}}
    assert inbound(spark, payload)[0]["subject"] == "5"
    strict = inbound(spark, payload, strict=True)[0]
    assert (strict["subject"], strict["event_type"], strict["resource_type"]) == ("", "t", "")


def test_other_tables(spark):
    definitions = spark.createDataFrame([('{"title":"T","name":"N"}',), ('{"title":"","name":"N"}',), ("{}",)], "definition string")
    assert [r["name"] for r in as_dicts(derive(definitions, "protocol_definitions"))] == ["T", "N", ""]
    results = spark.createDataFrame([('{"httpStatus":404,"responseBody":"x"}',), ('{"httpStatus":0}',), ("",)], "delivery_result string")
    got = as_dicts(derive(results, "intelligence_deliveries"))
    assert [(r["http_status_code"], r["error_message"]) for r in got] == [(404, "x"), (None, ""), (None, "")]


def test_seconds_are_boundaries_crossed(spark):
    row = spark.createDataFrame([(at("2024-01-01T00:00:00.900"), at("2024-01-01T00:00:01.100"))], "a timestamp, b timestamp")
    got = row.select(C.seconds_between(F.col("a"), F.col("b")).alias("s"), C.millis_between(F.col("a"), F.col("b")).alias("ms"))
    assert as_dicts(got) == [{"s": 1, "ms": 200}]


@pytest.mark.parametrize(
    "a,b,want", [(1, 3, 33.3), (1, 0, 0.0), (None, 2, 0.0), (1, 8, 12.5), (49, 400, 12.2), (51, 400, 12.8)]
)
def test_percentage_rounds_half_to_even(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a int, b int")
    assert row.select(C.percentage(F.col("a"), F.col("b")).alias("p")).first().p == want


def test_readable_amounts(spark):
    row = spark.createDataFrame([(512, 1536, 1_500_000)], "a long, b long, c long")
    got = row.select(
        C.readable_size(F.col("a")).alias("a"), C.readable_size(F.col("b")).alias("b"), C.readable_quantity(F.col("c")).alias("c")
    ).first()
    assert tuple(got) == ("512.00 B", "1.50 KiB", "1.50 million")


def test_query_shape_hides_literals(spark):
    row = spark.createDataFrame(
        [("SELECT  a1 FROM t WHERE x = 5 AND y='b 7'",), ("SELECT a1 FROM t WHERE x = 17.5 AND y='c'",)], "q string"
    )
    shapes = {r.s for r in row.select(C.query_shape(F.col("q")).alias("s")).collect()}
    assert shapes == {"SELECT a1 FROM t WHERE x = ? AND y=?"}
    assert row.select(C.query_hash(F.col("q")).alias("h")).distinct().count() == 1
