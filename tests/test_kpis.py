import json

import pytest
from pyspark.sql import functions as F

from cdcmart.plans import backfill, dimensions, kpis, marts, quality, reports, rollups
from helpers import as_dicts, as_set, at, tables, uid

AS_OF = "2024-02-01 00:00:00"
DAY = at("2024-01-10T00:00:00").date()


def event(n, status="ACCEPTED", when="2024-01-10T08:00:00", payload=None, **more):
    body = payload if payload is not None else {"subject": f"P{n}", "facilityid": "F1"}
    return {
        "id": uid(n),
        "cloudevents_id": f"ce-{n}",
        "source": "s",
        "status": status,
        "raw_payload": json.dumps(body),
        "received_at": at("2024-01-10T09:00:00"),
        "event_time": at(when) if when else None,
        "_version": n,
        **more,
    }


def outcome(n, ce, status, received="2024-01-10T09:00:05", **more):
    return {"id": uid(n), "cloudevents_id": ce, "processing_status": status, "received_at": at(received), "_version": n, **more}


def test_event_outcomes_and_pipeline_loss(spark):
    t = tables(
        spark,
        inbound_event_logs=[event(1), event(2), event(3), event(4), event(5, "REJECTED"), event(6, when=None),
                            event(7, when="2022-01-01T00:00:00"), event(1, "ACCEPTED", _version=50)],
        compliance_event_logs=[
            outcome(11, "ce-1", "MATCHED"),
            outcome(12, "ce-2", "MATCHED"),
            outcome(13, "ce-2", "DUPLICATE", "2024-01-10T10:00:00"),
            outcome(14, "ce-3", "ODD"),
        ],
    )
    (row,) = as_dicts(kpis.mv_daily_event_kpis(t, AS_OF))
    assert (row["snapshot_date"], row["facility_id"], row["total_events"]) == (DAY, "F1", 4)
    parts = [row[c] for c in ("matched_count", "zero_match_count", "duplicate_count", "pipeline_loss_count")]
    assert parts == [1, 0, 1, 2] and sum(parts) == row["total_events"]
    (head,) = as_dicts(reports.event_header(kpis.mv_daily_event_kpis(t, AS_OF), "2024-01-10"))
    assert head == {"total_events": 4, "matched_rate_pct": 25.0, "zero_match_rate_pct": 0.0, "pipeline_loss_count": 2}


def test_adoption_with_expected_zero_and_unlisted_facility(spark):
    other = {"subject": "P9", "facilityid": "F9"}
    zero = {"subject": "P3", "facilityid": "F0"}
    t = tables(
        spark,
        inbound_event_logs=[event(1), event(2), event(3, payload=zero), event(4, payload=other),
                            event(5, payload={"subject": "P1", "facilityid": "F1"})],
        facility=[
            {"id": uid(1), "facility_id": "F1", "expected_patients_per_day": 3},
            {"id": uid(2), "facility_id": "F0", "expected_patients_per_day": 0},
            {"id": uid(3), "facility_id": "F5", "facility_name": "Five", "expected_patients_per_day": 5},
        ],
    )
    adoption = kpis.mv_daily_adoption_kpis(t, AS_OF)
    got = {r["facility_id"]: (r["actual_patients"], round(r["adoption_rate_pct"], 1), r["reporting_gap"]) for r in as_dicts(adoption)}
    assert got == {"F1": (2, 66.7, 1), "F0": (1, 0.0, -1)}
    filled = reports.adoption_fill_zero(adoption, t, "2024-01-10", "2024-01-11")
    assert {(r["snapshot_date"].day, r["facility_id"]): r["actual_patients"] for r in as_dicts(filled)} == {
        (10, "F1"): 2, (10, "F0"): 1, (10, "F5"): 0, (11, "F1"): 0, (11, "F0"): 0, (11, "F5"): 0,
    }


def transfer(subject="P1"):
    return {
        "subject": subject,
        "facilityid": "F1",
        "data": {"resourceType": "Encounter", "type": [{"coding": []}, {"coding": [{"display": "x"}, {"display": "TRANSFER_ENCOUNTER"}]}]},
    }


def test_referrals_count_once_and_by_pattern(spark):
    actions = {20: "x-referral", 21: "referral", 22: "-referral", 23: "referral-x"}
    t = tables(
        spark,
        inbound_event_logs=[event(1, payload=transfer()), event(2), event(3), event(4), event(5, payload=transfer("P5"))],
        compliance_event_logs=[outcome(10 + n, f"ce-{n}", "MATCHED") for n in (1, 2, 3, 4)],
        step_instances=[
            {"id": uid(n), "protocol_instance_id": uid(90), "action_id": a, "completed_by_event_id": uid(n - 9)}
            for n, a in actions.items()
        ]
        + [{"id": uid(30), "protocol_instance_id": uid(90), "action_id": "referral", "completed_by_event_id": uid(11)}],
    )
    (row,) = as_dicts(kpis.mv_daily_referral_kpis(t, AS_OF))
    assert (row["referral_count"], row["matched_count"]) == (3, 2)
    (more,) = as_dicts(reports.referral_compliance(kpis.mv_daily_referral_kpis(t, AS_OF)))
    assert (more["non_compliant_count"], more["compliance_rate_pct"]) == (1, 66.7)


def enrolment(n, status="ACTIVE", **more):
    return {"id": uid(n), "patient_id": f"P{n}", "protocol_definition_id": uid(900), "protocol_canonical": "u|1",
            "status": status, "enrolled_at": at("2024-01-01"), **more}


def step(n, parent, state="PENDING", **more):
    return {"id": uid(n), "protocol_instance_id": uid(parent), "state": state, "action_id": "a", **more}


def deviation(n, parent, kind, step_no=100, when="2024-01-12T00:00:00", **more):
    return {"id": uid(n), "protocol_instance_id": uid(parent), "step_instance_id": uid(step_no), "deviation_type": kind,
            "detected_at": at(when), **more}


def test_compliance_snapshot(spark):
    t = tables(
        spark,
        protocol_instances=[enrolment(1), enrolment(2, "COMPLETED"), enrolment(3), enrolment(3, _is_deleted=True, _version=99),
                            {**enrolment(4, "EXPIRED"), "protocol_definition_id": uid(901)}],
        step_instances=[step(100, 1, "COMPLETED", completion_status="LATE"), step(101, 1, "SKIPPED"), step(102, 2, "DUE"),
                        step(103, 3, "MISSED"), step(104, 77, "DUE")],
        deviations=[deviation(200, 1, "OVERDUE"), deviation(201, 1, "MISSED"), deviation(202, 2, "MISSED"),
                    deviation(202, 2, "MISSED", _is_deleted=True, _version=50), deviation(203, 3, "OVERDUE")],
    )
    got = {r["protocol_definition_id"]: r for r in as_dicts(kpis.mv_daily_compliance_kpis(t, AS_OF))}
    row = got[uid(900)]
    assert [row[c] for c in ("total_enrollments", "status_active", "status_completed", "tracked_patients")] == [2, 1, 1, 2]
    assert [row[c] for c in ("compliant_count", "non_compliant_count", "total_deviations", "overdue_deviations")] == [1, 1, 2, 1]
    assert [row[c] for c in ("step_total", "step_completed", "step_due", "step_missed", "step_late")] == [3, 2, 1, 0, 1]
    assert row["compliance_rate_pct"] == 50.0
    bare = got[uid(901)]
    assert (bare["compliant_count"], bare["step_total"], bare["total_deviations"], bare["compliance_rate_pct"]) == (1, 0, 0, 100.0)


def test_deviation_occurrence_falls_back(spark):
    t = tables(
        spark,
        inbound_event_logs=[event(1)],
        protocol_instances=[enrolment(1), enrolment(2)],
        step_instances=[
            step(100, 1, overdue_date=at("2024-01-05"), due_date=at("2024-01-04")),
            step(101, 1, due_date=at("2024-01-06")),
            step(102, 1),
        ],
        deviations=[deviation(200, 1, "OVERDUE", 100), deviation(201, 1, "MISSED", 101), deviation(202, 1, "ORDER_VIOLATION", 102),
                    deviation(203, 2, "ORDER_VIOLATION", 102), deviation(204, 1, "OVERDUE", 999)],
    )
    df = kpis.mv_daily_deviation_kpis(t, AS_OF)
    got = {(r["snapshot_date"].day, r["deviation_type"], r["facility_id"]): r["deviation_count"] for r in as_dicts(df)}
    assert got == {(5, "OVERDUE", "F1"): 1, (6, "MISSED", "F1"): 1, (12, "ORDER_VIOLATION", "F1"): 1, (12, "ORDER_VIOLATION", ""): 1}
    (head,) = as_dicts(reports.deviation_header(df))
    assert head == {"total_deviations": 4, "overdue_count": 1, "missed_count": 1, "order_violation_count": 2}
    stored = kpis.mv_daily_deviation_kpis(t, AS_OF, states=True)
    merged = reports.merged_unique_patients(stored, "2024-01-01", "2024-01-31")
    exact = reports.deviation_unique_patients(kpis.deviation_occurrences(t, AS_OF), "2024-01-01", "2024-01-31")
    assert as_set(merged) == as_set(exact)


def test_window_longer_than_retention_is_refused(spark):
    with pytest.raises(kpis.WindowExceedsRetention):
        kpis.mv_daily_event_kpis(tables(spark), AS_OF, window_months=12, retention_days=90)


def test_changes_and_current_modes_differ_on_updates(spark):
    t = tables(spark, deviations=[deviation(1, 1, "MISSED"), deviation(1, 1, "MISSED", _version=9), deviation(2, 1, "MISSED"),
                                  deviation(2, 1, "MISSED", _is_deleted=True, _version=10)])
    assert as_dicts(marts.build("mv_deviation_trends", t))[0]["deviation_count"] == 4
    assert as_dicts(marts.build("mv_deviation_trends", t, "current"))[0]["deviation_count"] == 1
    with pytest.raises(ValueError):
        marts.build("mv_deviation_trends", t, "both")


def test_patient_facility_ties_go_to_the_later_version(spark):
    a = event(1, payload={"subject": "P", "facilityid": "F1"})
    b = event(2, payload={"subject": "P", "facilityid": "F2"})
    old = event(3, payload={"subject": "P", "facilityid": "F3"}, received_at=at("2024-01-01T00:00:00"))
    (got,) = as_dicts(marts.build("mv_patient_facility_latest", tables(spark, inbound_event_logs=[b, a, old])))
    assert got["facility_id"] == "F2"


def move(n, entity, status, when):
    return {"id": n, "protocol_instance_id": uid(entity), "status": status, "changed_at": at(when)}


def step_move(n, entity, state, when, completion=""):
    return {"id": n, "step_instance_id": uid(entity), "state": state, "completion_status": completion, "changed_at": at(when)}


def history_tables(spark):
    return tables(
        spark,
        protocol_instances=[enrolment(1, "COMPLETED"), enrolment(2), enrolment(3), enrolment(3, _is_deleted=True, _version=99)],
        step_instances=[step(100, 1, "COMPLETED", completion_status="LATE"), step(101, 2, "DUE"), step(102, 3, "DUE")],
        deviations=[deviation(200, 1, "OVERDUE", when="2024-01-02T00:00:00"), deviation(201, 2, "MISSED", when="2023-12-01T00:00:00"),
                    deviation(202, 1, "MISSED", when="2024-01-09T00:00:00")],
        protocol_instance_history=[
            move(1, 1, "ACTIVE", "2023-12-20T00:00:00"), move(2, 1, "EXPIRED", "2024-01-04T08:00:00"),
            move(3, 1, "COMPLETED", "2024-01-04T09:00:00"), move(4, 2, "ACTIVE", "2024-01-03T00:00:00"),
            move(5, 3, "ACTIVE", "2024-01-01T00:00:00"), move(5, 3, "ACTIVE", "2024-01-01T00:00:00"),
        ],
        step_instance_history=[
            step_move(1, 100, "PENDING", "2023-12-21T00:00:00"), step_move(2, 100, "COMPLETED", "2024-01-05T00:00:00", "LATE"),
            step_move(3, 101, "PENDING", "2023-12-01T00:00:00"), step_move(4, 101, "DUE", "2024-01-02T00:00:00"),
            step_move(5, 102, "DUE", "2024-01-02T00:00:00"),
        ],
    )


def test_replay_by_day(spark):
    t = history_tables(spark)
    days = {r["snapshot_date"].day: r for r in as_dicts(backfill.backfill_daily_compliance(t, "2024-01-01", "2024-01-06", AS_OF))}
    assert sorted(days) == [1, 2, 3, 4, 5, 6]

    def column(name):
        return [days[d][name] for d in range(1, 7)]

    assert column("total_enrollments") == [1, 1, 2, 2, 2, 2]
    assert column("status_active") == [1, 1, 2, 1, 1, 1]
    assert column("status_completed") == [0, 0, 0, 1, 1, 1] and column("status_expired") == [0] * 6
    assert column("total_deviations") == [0, 1, 2, 2, 2, 2]
    assert column("non_compliant_count") == [0, 1, 2, 2, 2, 2]
    assert column("step_total") == [1, 1, 2, 2, 2, 2]
    assert column("step_pending") == [1, 1, 1, 1, 0, 0]
    assert column("step_due") == [0, 0, 1, 1, 1, 1]
    assert column("step_late") == [0, 0, 0, 0, 1, 1]


def test_replayed_last_day_equals_the_live_snapshot(spark):
    t = history_tables(spark)
    live = kpis.mv_daily_compliance_kpis(t, "2024-01-20 00:00:00")
    replayed = backfill.backfill_daily_compliance(t, "2024-01-01", "2024-01-20", "2024-01-20 00:00:00")
    assert as_set(replayed.where("snapshot_date = DATE '2024-01-20'")) == as_set(live)


def test_replay_joins_no_ranges(spark):
    plan = backfill.backfill_daily_compliance(history_tables(spark), "2024-01-01", "2024-01-20", AS_OF)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_rollups_and_their_reports(spark):
    t = history_tables(spark)
    steps = rollups.rollup("rollup_step_current", t)
    via_states = rollups.read_rollup("rollup_step_current", rollups.rollup_partials("rollup_step_current", t["step_instances"]))
    assert as_set(steps) == as_set(via_states.drop("is_deleted"))
    rates = {r["protocol_instance_id"]: r["compliance_rate"] for r in as_dicts(rollups.enrollment_compliance_rate(steps))}
    assert rates == {uid(1): 100.0, uid(2): 0.0, uid(3): 0.0}


def test_quality_report_names_what_is_wrong(spark):
    t = tables(
        spark,
        inbound_event_logs=[event(1, received_at=at("2024-01-31T23:55:00")), event(2, source="", received_at=at("2024-02-01T02:00:00"))],
        protocol_instances=[enrolment(1)],
        step_instances=[step(100, 1), step(101, 7)],
        deviations=[deviation(200, 1, "MISSED", 100), deviation(201, 1, "MISSED", 999)],
    )
    report = {r["check"]: (r["value"], r["passed"]) for r in as_dicts(quality.run_checks(t, AS_OF))}
    assert len(report) == 15
    assert report["rows present: inbound_event_logs"] == ("2", True)
    assert report["rows present: protocol_definitions"] == ("0", False)
    assert report["inbound_event_logs: source never blank"] == ("1", False)
    assert report["inbound_event_logs: received_at at most an hour ahead"] == ("1", False)
    assert report["step_instances: every enrolment known"] == ("1", False)
    assert report["deviations: every step known"] == ("1", False)
    assert report["newest inbound_event_logs row within 10 minutes"] == ("ok", True)
    assert report["newest intelligence_event_logs row within an hour"] == ("stale", False)
    stored = {n: marts.build(n, t) for n in ("mv_ingestion_quality", "mv_event_volume_hourly")}
    with_stored = {r["check"]: (r["value"], r["passed"]) for r in as_dicts(quality.run_checks(t, AS_OF, stored))}
    assert with_stored == report


def test_contract(spark):
    t = tables(spark)
    assert quality.contract_problems(t) == []
    del t["facility"]
    t["deviations"] = t["deviations"].drop("detected_at")
    assert quality.contract_problems(t) == ["deviations.detected_at is missing", "table facility is missing"]


def test_dimension_miss_gives_defaults(spark):
    from cdcmart.operators.lookup import lookup

    t = tables(spark, protocol_definitions=[{"id": uid(1), "url": "u", "version": "2", "definition": '{"name":"N"}', "status": "ACTIVE"}])
    facts = spark.createDataFrame([(uid(1),), (uid(2),), (None,)], "d string")
    got = lookup(facts, dimensions.dict_protocol_definitions(t), {"d": "id"}, {"name": "", "canonical": "?"})
    assert as_set(got) == {("u|2", uid(1), "N"), ("?", uid(2), ""), ("?", None, "")}


def test_newest_refresh_wins(spark):
    base = kpis.mv_daily_event_kpis(tables(spark, inbound_event_logs=[event(1)]), AS_OF)
    older = base.withColumns({"refreshed_at": F.col("refreshed_at") - F.expr("INTERVAL 1 DAY"), "total_events": F.lit(7).cast("bigint")})
    assert as_set(kpis.snapshot_latest(older.unionByName(base), "mv_daily_event_kpis")) == as_set(base)
