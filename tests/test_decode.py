from pyspark.sql import functions as F

from cdcmart.operators.changelog import latest_by_version
from cdcmart.sources.envelope import dead_letters, decode_envelope, parse_envelope, typed_changes
from cdcmart.sources.readers import snapshot_rows
from cdcmart.sources.schemas import TABLES
from helpers import as_dicts, at, message, messages, uid

ENROLMENT = {"id": uid(1), "patient_id": "P1", "protocol_definition_id": uid(9), "status": "ACTIVE"}


def test_delete_uses_the_old_image_and_removes_the_key_whatever_the_order(spark):
    created = message("c", ENROLMENT, 1)
    updated = message("u", {**ENROLMENT, "status": "COMPLETED"}, 2)
    deleted = message("d", ENROLMENT, 3)
    for order in ((created, updated, deleted), (deleted, created, updated)):
        changes = decode_envelope(messages(spark, *order), "protocol_instances")
        assert changes.count() == 3
        assert latest_by_version(changes).count() == 0


def test_recreated_key_is_present_with_new_values(spark):
    again = message("c", {**ENROLMENT, "status": "EXPIRED"}, 5)
    changes = decode_envelope(
        messages(spark, message("c", ENROLMENT, 1), message("d", ENROLMENT, 3), again), "protocol_instances"
    )
    assert [r["status"] for r in as_dicts(latest_by_version(changes))] == ["EXPIRED"]


def test_truncates_and_unknown_operations_are_ignored_not_dead(spark):
    parsed = parse_envelope(messages(spark, '{"op":"t"}', '{"op":"m"}'), "protocol_instances")
    assert parsed.count() == 0


def test_odd_values(spark):
    row = {
        "id": uid(1).upper(),
        "cloudevents_id": None,
        "source": 5,
        "status": {"a": 1},
        "received_at": "2024-01-01T02:00:00+02:00",
        "updated_at": "",
        "event_time": "garbage",
    }
    (got,) = as_dicts(decode_envelope(messages(spark, message("r", row, 7)), "inbound_event_logs"))
    assert got["id"] == uid(1)
    assert got["cloudevents_id"] == "" and got["correlation_id"] == ""
    assert got["source"] == "5" and got["status"] == '{"a":1}'
    assert got["received_at"] == at("2024-01-01T00:00:00")
    assert got["updated_at"] == at("1970-01-01T00:00:00")
    assert got["event_time"] is None
    assert got["_version"] == 7 and got["_is_deleted"] is False


def test_numbers_flags_and_optional_identifiers(spark):
    row = {"id": uid(1), "action_definition_id": uid(2), "protocol_instance_id": uid(3), "step_instance_id": "", "published": True}
    (got,) = as_dicts(decode_envelope(messages(spark, message("c", row, 1)), "intelligence_event_logs"))
    assert got["published"] is True and got["step_instance_id"] is None
    facility = {"id": uid(1), "facility_id": "F1", "expected_patients_per_day": None}
    (got,) = as_dicts(decode_envelope(messages(spark, message("c", facility, 1)), "facility"))
    assert got["expected_patients_per_day"] == 0


def test_undecodable_messages_go_to_dead_letters_whole(spark):
    bad = message("c", {**ENROLMENT, "id": "nope"}, 1)
    huge = message("c", ENROLMENT, 2**64 - 1)
    df = messages(spark, "{broken", bad, '{"op":"c","after":null}', huge, message("c", ENROLMENT, 2))
    parsed = parse_envelope(df, "protocol_instances")
    problems = {r["value"]: r["_problem"] for r in as_dicts(dead_letters(parsed))}
    assert problems == {
        "{broken": "unreadable message",
        bad: "bad identifier: id",
        '{"op":"c","after":null}': "no row image",
        huge: "version out of range",
    }
    assert typed_changes(parsed, "protocol_instances").count() == 1


def test_equal_versions_are_settled_by_arrival(spark):
    changes = decode_envelope(
        messages(spark, message("c", ENROLMENT, 4), message("u", {**ENROLMENT, "status": "EXPIRED"}, 4)).withColumn(
            "offset", F.when(F.col("value").contains("EXPIRED"), 11).otherwise(10)
        ),
        "protocol_instances",
        keep=("offset",),
    )
    assert [r["status"] for r in as_dicts(latest_by_version(changes, arrival="offset"))] == ["EXPIRED"]


def test_each_message_is_parsed_once(spark):
    df = decode_envelope(messages(spark, message("c", ENROLMENT, 1)), "protocol_instances").where("status = 'ACTIVE'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_snapshot_rows_have_the_shape_of_changes(spark):
    plain = spark.createDataFrame(
        [(uid(1), "F1", None, 4, "d", None, None)],
        "id string, facility_id string, facility_name string, expected_patients_per_day int, district_name string,"
        " created_at timestamp, updated_at timestamp",
    )
    rows = snapshot_rows(plain, "facility", version=3)
    assert rows.columns == [*TABLES["facility"].columns, "_version", "_is_deleted"]
    (got,) = as_dicts(rows)
    assert got["facility_name"] == "" and got["expected_patients_per_day"] == 4 and got["_version"] == 3
