"""The plans that matter at size, on tables stored as files with broadcasts off."""

import pytest

from cdcmart.plans import kpis, marts
from cdcmart.session import shared_folder
from cdcmart.sources.readers import read_changelog
from cdcmart.sources.schemas import TABLES
from cdcmart.streaming import sinks
from helpers import at, tables, uid

AS_OF = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def stored(spark):
    root = shared_folder(spark, "plans")
    moment = at("2024-01-10T08:00:00")
    small = tables(
        spark,
        inbound_event_logs=[{"id": uid(1), "status": "ACCEPTED", "raw_payload": '{"subject":"P"}', "received_at": moment, "event_time": moment}],
        protocol_instances=[{"id": uid(1), "protocol_definition_id": uid(9), "enrolled_at": moment}],
        step_instances=[{"id": uid(2), "protocol_instance_id": uid(1), "created_at": moment}],
        deviations=[{"id": uid(3), "protocol_instance_id": uid(1), "step_instance_id": uid(2), "detected_at": moment}],
        compliance_event_logs=[{"id": uid(4), "cloudevents_id": "c", "received_at": moment}],
        facility=[{"id": uid(5), "facility_id": "F"}],
    )
    needed = [n for n in TABLES if n.split("_")[0] in ("inbound", "protocol", "step", "deviations", "compliance", "facility") and "history" not in n]
    for name in needed:
        sinks.write_changelog(small[name], f"{root}/{name}", name)
    return {n: read_changelog(spark, f"{root}/{n}", n) for n in needed}


def plan_of(spark, df):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_compliance_joins_add_no_exchange(spark, stored):
    plan = plan_of(spark, kpis.mv_daily_compliance_kpis(stored, AS_OF))
    # Three deduplications, two reductions per enrolment, one per protocol.
    assert plan.count("Exchange hashpartitioning") == 6
    assert "NestedLoop" not in plan


def test_wide_bodies_are_not_read_for_kpis(spark, stored):
    for df in (kpis.mv_daily_event_kpis(stored, AS_OF), kpis.mv_daily_referral_kpis(stored, AS_OF), marts.build("mv_event_volume_hourly", stored)):
        plan = plan_of(spark, df)
        assert "raw_payload" not in plan and "from_json" not in plan


def test_filters_reach_the_scan(spark, stored):
    plan = plan_of(spark, marts.build("mv_event_volume_hourly", stored))
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(status,ACCEPTED)" in pushed and "IsNotNull(event_time)" in pushed


def test_every_deduplication_limits_before_its_exchange(spark, stored):
    plan = plan_of(spark, kpis.mv_daily_event_kpis(stored, AS_OF))
    assert plan.count("row_number(), 1, Partial") == plan.count("row_number(), 1, Final") == 3


def test_adoption_joins_counted_rows_only(spark, stored):
    plan = plan_of(spark, kpis.mv_daily_adoption_kpis(stored, AS_OF))
    join, distinct = plan.index("Join"), plan.index("count(distinct")
    assert join < distinct  # printed top down: the count is below the join
