"""Registered queries against their SQL on the smallest given tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from check import GIVEN, _same_type, rows_of

FOLDER = "/root/testdata/sf0.001"
# Quick ones of every kind; `python check.py` runs all of them.
SAMPLE = """
cdc_decode_envelope cdc_dead_letters cdc_intelligence_event_logs derive_inbound derive_misc latest_by_version
carry_forward_unavailable history_dedup argmax_merge state_merge mv_event_volume_hourly mv_practitioner_summary_current
mv_deviation_by_patient mv_patient_facility_latest mv_daily_compliance_kpis mv_daily_deviation_kpis
mv_daily_adoption_kpis mv_daily_referral_kpis backfill_daily_compliance asof_step_state rank_facilities
e2e_latency_per_minute dict_delivery_adaptor dq_report counter_rate histogram_quantile quantile_of_rates no_data ql_slowest_shapes
ql_latency_percentiles stmt_totals flagship_event_kpis
""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in GIVEN:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_sql_has_its_query():
    """Only training-data operators, which carry tests of their own, may have a query that SQL cannot express."""
    assert set(entry.oracle_sql()) <= set(entry.queries())
    alone = set(entry.queries()) - set(entry.oracle_sql())
    assert all(name == "pipeline" or re.match(r"op\d+_", name) for name in alone)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
    assert [f.name for f in df.schema.fields if not _same_type(f"{f.name}:{f.dataType.simpleString()}/{kinds[f.name]}")] == []
