"""SQL for DuckDB, one per registered query, over the same given tables.

Written from the definitions, not from the Spark plans: state is picked with
window functions, replay joins days to transitions, rates join windows to
samples. Named subqueries are pulled in where a query mentions them.
"""

from __future__ import annotations

import re

from cdcmart.catalog import driver_tables as D
from cdcmart.catalog import queries as Q
from cdcmart.fixed_values import UNAVAILABLE_VALUE
from cdcmart.sources.schemas import TABLES

_PARTS: dict[str, str] = {}


def _id(space: int, number: str) -> str:
    return f"('{space:08d}-0000-4000-8000-' || lpad(CAST({number} AS VARCHAR), 12, '0'))"


def _total(value: str) -> str:
    return f"CAST(sum({value}) AS BIGINT)"


def _count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _pct(a: str, b: str, digits: int = 1) -> str:
    return f"coalesce(round_even(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) * 100, {digits}), 0.0)"


def _pct_float(a: str, b: str) -> str:
    return f"CAST({_pct(a, b)} AS FLOAT)"


# -- given tables with their attributes -------------------------------------------

_PARTS["ev"] = """SELECT event_id, ts, user_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""
_PARTS["ord"] = "SELECT *, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders"
_PARTS["line"] = """SELECT *, l_returnflag || l_linestatus AS code, CAST(l_shipdate AS TIMESTAMP) AS ts,
    l_orderkey * 10 + l_linenumber AS step_no,
    l_orderkey || '|' || l_linenumber || '|' || CAST(l_shipdate AS DATE) || '|' || l_partkey || '|' || l_suppkey
        AS line_text,
    date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) * 1000000000000
        + (l_partkey % 1000000) * 1000000 + l_suppkey % 1000000 AS line_version
    FROM lineitem"""

# -- change tables ----------------------------------------------------------------

_F = "'F' || (user_id % 25)"
_PARTS["inbound_plain"] = f"""
SELECT {_id(D.EVENT, 'event_id')} AS id, 'ce-' || event_id AS cloudevents_id, 'src-' || (user_id % 4) AS source,
    'corr-' || event_id AS correlation_id,
    '{{"subject":"P' || user_id || '","type":"' || event_type || '","facilityid":"'
    || CASE WHEN event_type = 'view' THEN {_F} ELSE '' END
    || '","data":{{"resourceType":"' || CASE WHEN event_type = 'view' THEN 'Encounter' ELSE 'Observation' END
    || '","extension":[' || CASE
        WHEN event_type IN ('click', 'purchase') THEN
            '{{"url":"http://x/other","valueString":"zz"}},{{"url":"http://x/source-facility","valueString":"'
            || {_F} || '"}}'
        WHEN event_type = 'error' THEN '{{"url":"http://x/other","valueString":"zz"}}' ELSE '' END || ']'
    || CASE WHEN k < 20 THEN ''
        WHEN k >= 90 THEN ',"type":[{{"coding":[{{"display":"OTHER"}}]}},{{"coding":[{{"display":"X"}},{{"display":"TRANSFER_ENCOUNTER"}}]}}]'
        ELSE ',"type":[{{"coding":[{{"display":"OTHER"}}]}}]' END
    || ',"practitionerRef":"' || CASE WHEN k < 60 THEN 'D' || (user_id % 12) ELSE '' END
    || '","practitionerDisplay":"Dr ' || (user_id % 12) || '"}}}}' AS raw_payload,
    CASE WHEN n = 1 THEN 'RECEIVED' WHEN k < 5 THEN 'REJECTED' WHEN k < 9 THEN 'DUPLICATE' ELSE 'ACCEPTED' END
        AS status,
    CASE WHEN n > 1 AND k < 3 THEN 'schema' WHEN n > 1 AND k < 5 THEN 'auth' ELSE '' END AS rejection_reason,
    '' AS error_details, ts + to_seconds(k) AS received_at, ts + to_seconds(k + n) AS updated_at,
    CASE WHEN k <> 50 THEN ts END AS event_time, event_id * 4 + n AS _version, n = 3 AS _is_deleted
FROM (SELECT *, unnest(CASE WHEN k = 97 THEN [1, 2, 3] ELSE [1, 2] END) AS n FROM ev)"""

_PARTS["inbound"] = """
SELECT *, coalesce(json_extract_string(raw_payload, '$.subject'), '') AS subject,
    coalesce(json_extract_string(raw_payload, '$.type'), '') AS event_type,
    CASE WHEN coalesce(json_extract_string(raw_payload, '$.facilityid'), '') <> ''
        THEN json_extract_string(raw_payload, '$.facilityid')
        ELSE coalesce(list_filter(CAST(json_extract(raw_payload, '$.data.extension') AS JSON[]),
            lambda x: json_extract_string(x, '$.url') LIKE '%source-facility%')[1] ->> '$.valueString', '') END
        AS facility_id,
    coalesce(json_extract_string(raw_payload, '$.data.resourceType'), '') AS resource_type,
    coalesce(json_extract_string(raw_payload, '$.data.practitionerRef'), '') AS practitioner_ref,
    coalesce(json_extract_string(raw_payload, '$.data.practitionerDisplay'), '') AS practitioner_display,
    coalesce(list_contains(json_extract_string(raw_payload, '$.data.type[*].coding[*].display'),
        'TRANSFER_ENCOUNTER'), false) AS is_transfer_encounter
FROM inbound_plain"""

_PARTS["outcomes"] = f"""
SELECT CASE WHEN n = 1 THEN {_id(D.OUTCOME, 'event_id')} ELSE {_id(D.SECOND_OUTCOME, 'event_id')} END AS id,
    'ce-' || event_id AS cloudevents_id, 'src-' || (user_id % 4) AS source, 'corr-' || event_id AS correlation_id,
    CASE WHEN n = 2 OR k >= 90 THEN 'DUPLICATE' WHEN k < 70 THEN 'MATCHED' ELSE 'ZERO_MATCH' END
        AS processing_status,
    '{{}}' AS data, ts + to_seconds(k + 60 * n) AS received_at, ts + to_seconds(k + 60 * n) AS updated_at,
    event_id * 2 + n AS _version, false AS _is_deleted
FROM (SELECT *, unnest(CASE WHEN k = 42 THEN [1, 2] ELSE [1] END) AS n FROM ev WHERE k NOT BETWEEN 20 AND 29)"""

_NOW = "TIMESTAMP '2024-01-01 00:00:00'"
_PARTS["definitions"] = f"""
SELECT {_id(D.DEFINITION, 'p_partkey')} AS id, 'http://protocols.test/' || p_partkey AS url,
    (p_size % 3) || '.0' AS version, CASE WHEN p_type = 'ECONOMY' THEN 'RETIRED' ELSE 'ACTIVE' END AS status,
    CASE WHEN p_size < 25 THEN '{{"title":"' || p_name || '","name":"n"}}' ELSE '{{"name":"' || p_brand || '"}}' END
        AS definition,
    {_NOW} AS loaded_at, {_NOW} AS updated_at, p_partkey + 1 AS _version, false AS _is_deleted,
    CASE WHEN p_size < 25 THEN p_name ELSE p_brand END AS name
FROM part"""

_FINAL = """CASE WHEN o_orderstatus = 'O' THEN 'ACTIVE' WHEN o_orderstatus = 'F' THEN 'COMPLETED'
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'EXPIRED' ELSE 'WITHDRAWN' END"""
_PARTS["enrolments"] = f"""
SELECT {_id(D.ENROLMENT, 'o_orderkey')} AS id, 'P' || o_custkey AS patient_id,
    'http://protocols.test/' || (o_custkey % 40) || '|1.0' AS protocol_canonical,
    {_id(D.DEFINITION, 'o_custkey % 40')} AS protocol_definition_id,
    CASE WHEN n = 1 THEN 'ACTIVE' ELSE {_FINAL} END AS status, ts AS enrolled_at, ts AS created_at,
    ts + to_days(n) AS updated_at, o_orderkey * 4 + n AS _version, n = 3 AS _is_deleted
FROM (SELECT *, unnest(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN [1, 2, 3]
    ELSE [1, 2] END) AS n FROM ord)"""

_STATE = """CASE code WHEN 'NO' THEN 'PENDING' WHEN 'NF' THEN 'COMPLETED' WHEN 'RO' THEN 'DUE'
    WHEN 'RF' THEN 'OVERDUE' WHEN 'AF' THEN 'SKIPPED' ELSE 'MISSED' END"""
_DONE = """CASE WHEN code <> 'NF' THEN '' WHEN l_suppkey % 3 = 0 THEN 'EARLY' WHEN l_suppkey % 3 = 1
    THEN 'ON_TIME' ELSE 'LATE' END"""
_PARTS["steps"] = f"""
SELECT {_id(D.STEP, 'step_no')} AS id, {_id(D.ENROLMENT, 'l_orderkey')} AS protocol_instance_id,
    CASE l_linenumber WHEN 7 THEN 'anc-referral' WHEN 6 THEN 'referral' WHEN 5 THEN '-referral'
        WHEN 4 THEN 'referral-x' ELSE 'visit-' || l_linenumber END AS action_id,
    CAST(l_suppkey % 5 AS INTEGER) AS repeat_index, {_STATE} AS state,
    CASE WHEN l_suppkey % 10 <> 0 THEN ts END AS due_date,
    CASE WHEN l_partkey % 4 <> 0 THEN ts + to_days(CAST(l_suppkey % 10 AS INTEGER)) END AS overdue_date,
    CASE WHEN l_partkey % 3 <> 0 THEN ts + to_days(20) END AS missed_date,
    CASE WHEN code = 'NF' THEN ts + to_days(1) END AS completed_at,
    CASE WHEN code = 'NF' THEN 'src-0' ELSE '' END AS completed_by_source, {_DONE} AS completion_status,
    CASE WHEN code = 'NF' THEN {_id(D.OUTCOME, 'l_orderkey')} END AS completed_by_event_id,
    CASE WHEN l_linenumber < 4 THEN 'must' ELSE 'could' END AS required_behavior,
    ts AS created_at, ts AS updated_at, line_version AS _version,
    l_tax > 0.075 AND l_returnflag = 'A' AS _is_deleted
FROM line"""

_MD5_ID = "(" + " || '-' || ".join(
    f"substr(md5(line_text), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
) + ")"
_PARTS["devs"] = f"""
SELECT {_MD5_ID} AS id, {_id(D.ENROLMENT, 'l_orderkey')} AS protocol_instance_id,
    {_id(D.STEP, 'step_no')} AS step_instance_id,
    CASE l_linenumber % 3 WHEN 0 THEN 'OVERDUE' WHEN 1 THEN 'MISSED' ELSE 'ORDER_VIOLATION' END AS deviation_type,
    ts + to_days(3) AS detected_at,
    CASE WHEN l_suppkey % 2 = 0 THEN {_id(D.TRIGGER, 'l_orderkey')} END AS intelligence_event_id,
    '{{}}' AS metadata, ts + to_days(3) AS updated_at, line_version * 2 + n AS _version, n = 2 AS _is_deleted
FROM (SELECT *, unnest(CASE WHEN l_tax > 0.075 THEN [1, 2] ELSE [1] END) AS n FROM line WHERE l_returnflag = 'R')"""

_PARTS["enrolment_log"] = f"""
SELECT o_orderkey * 2 + n AS id, {_id(D.ENROLMENT, 'o_orderkey')} AS protocol_instance_id,
    CASE WHEN n = 1 THEN 'ACTIVE' ELSE {_FINAL} END AS status,
    CASE WHEN n = 1 THEN ts ELSE ts + to_days(CAST(o_orderkey % 30 + 1 AS INTEGER)) END AS changed_at,
    o_orderkey * 2 + n AS _version, false AS _is_deleted
FROM (SELECT *, unnest(CASE WHEN o_orderpriority = '1-URGENT' THEN [1, 2, 2] ELSE [1, 2] END) AS n FROM ord)"""
_PARTS["enrolment_moves"] = "SELECT DISTINCT id, protocol_instance_id, status, changed_at, _version FROM enrolment_log"

_PARTS["step_log"] = f"""
SELECT CAST('0x' || substr(md5(line_text || '#' || n), 1, 15) AS BIGINT) AS id,
    {_id(D.STEP, 'step_no')} AS step_instance_id, CASE WHEN n = 1 THEN 'PENDING' ELSE {_STATE} END AS state,
    CASE WHEN n = 1 THEN '' ELSE {_DONE} END AS completion_status,
    CASE WHEN n = 1 THEN ts - to_days(5) ELSE ts END AS changed_at, line_version * 2 + n AS _version,
    false AS _is_deleted
FROM (SELECT *, unnest([1, 2]) AS n FROM line)"""

_PARTS["actions"] = f"""
SELECT {_id(D.ACTION, 'p_partkey')} AS id, 'http://actions.test/' || p_partkey AS canonical_url, '1.0' AS version,
    'action-' || p_partkey AS name, p_name AS title,
    CASE WHEN p_size > 40 THEN 'RETIRED' ELSE 'ACTIVE' END AS status,
    CASE p_partkey % 3 WHEN 0 THEN 'CommunicationRequest' WHEN 1 THEN 'Task' ELSE 'ServiceRequest' END AS action_type,
    '{{}}' AS definition, {_NOW} AS created_at, {_NOW} AS updated_at, p_partkey + 1 AS _version,
    p_size = 50 AS _is_deleted FROM part"""

_KIND = "CASE user_id % 3 WHEN 0 THEN 'CommunicationRequest' WHEN 1 THEN 'Task' ELSE 'ServiceRequest' END"
_PARTS["triggers"] = f"""
SELECT {_id(D.TRIGGER, 'event_id')} AS id, {_id(D.ACTION, 'user_id')} AS action_definition_id,
    {_id(D.ENROLMENT, 'user_id')} AS protocol_instance_id,
    CASE WHEN k % 2 = 0 THEN {_id(D.STEP, 'user_id * 10 + 1')} END AS step_instance_id,
    CAST(NULL AS VARCHAR) AS deviation_id, 'P' || user_id AS subject, {_KIND} AS action_type,
    'dest-' || (user_id % 4) AS intelligence_destination,
    CASE k % 3 WHEN 0 THEN 'OVERDUE' WHEN 1 THEN 'MISSED' ELSE 'COMPLETED' END AS step_state,
    CASE k % 3 WHEN 0 THEN 'overdue' WHEN 1 THEN 'missed' ELSE 'completion' END AS trigger_reason,
    'act-' || (k % 5) AS step_action_id, 'true' AS evaluation_expression, '{{}}' AS evaluation_context,
    n = 2 AS published, CASE WHEN n = 2 THEN ts + to_seconds(1) END AS published_at, ts AS created_at,
    event_id * 2 + n AS _version, false AS _is_deleted
FROM (SELECT *, unnest(CASE WHEN k < 50 THEN [1, 2] ELSE [1] END) AS n FROM ev WHERE event_type = 'error')"""

_PARTS["deliveries"] = f"""
SELECT {_id(D.DELIVERY, 'event_id')} AS id, {_id(D.TRIGGER, 'event_id')} AS intelligence_event_id,
    {_id(D.ACTION, 'user_id')} AS action_definition_id,
    CASE WHEN k >= 5 THEN {_id(D.MAPPING, 'user_id')} END AS destination_adaptor_mapping_id,
    {_KIND} AS action_type,
    CASE WHEN n = 1 THEN 'PENDING' WHEN k < 10 THEN 'FAILED' WHEN k < 15 THEN 'CANCELLED' ELSE 'DELIVERED' END
        AS status,
    'P' || user_id AS subject, 'http://protocols.test/' || (user_id % 40) || '|1.0' AS protocol_canonical,
    'act-' || (k % 5) AS action_id,
    CASE WHEN k > 80 THEN 'CRITICAL' WHEN k > 50 THEN 'HIGH' ELSE 'LOW' END AS severity,
    'dest-' || (user_id % 4) AS destination,
    CASE WHEN n = 1 THEN '{{}}' WHEN k < 10 THEN '{{"httpStatus":500,"responseBody":"failed"}}'
        WHEN k < 15 THEN '{{"httpStatus":0}}' ELSE '{{"httpStatus":200,"responseBody":"ok"}}' END AS delivery_result,
    CASE WHEN n = 1 THEN 0 ELSE k % 4 + 1 END AS attempt_count, ts AS created_at,
    ts + to_seconds(n) AS updated_at,
    CASE WHEN n > 1 AND k >= 15 THEN ts + to_milliseconds(event_id % 5000) END AS delivered_at,
    event_id * 4 + n AS _version, n = 3 AS _is_deleted, k, n
FROM (SELECT *, unnest(CASE WHEN k = 99 THEN [1, 2, 3] ELSE [1, 2] END) AS n FROM ev WHERE event_type = 'error')"""

_PARTS["receivers"] = f"""
SELECT {_id(D.RECEIVER, 's_suppkey')} AS id, s_name AS name,
    '{{"address":"http://receivers.test/' || s_suppkey || '"}}' AS definition,
    CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status, '{{}}' AS config, {_NOW} AS created_at,
    {_NOW} AS updated_at, s_suppkey + 1 AS _version, s_nationkey = 24 AS _is_deleted,
    'http://receivers.test/' || s_suppkey AS endpoint_url
FROM supplier"""
_PARTS["mappings"] = f"""
SELECT {_id(D.MAPPING, 'c_custkey')} AS id, 'dest-' || (c_custkey % 4) AS destination,
    {_id(D.RECEIVER, 'c_custkey % 100')} AS receiver_adaptor_id,
    CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status, {_NOW} AS created_at, {_NOW} AS updated_at,
    c_custkey + 1 AS _version, c_nationkey = 24 AS _is_deleted FROM customer"""
_PARTS["facilities"] = f"""
SELECT {_id(D.FACILITY, 's_suppkey')} AS id, 'F' || s_suppkey AS facility_id, s_name AS facility_name,
    s_suppkey % 5 * 3 AS expected_patients_per_day, 'district-' || s_nationkey AS district_name,
    {_NOW} AS created_at, {_NOW} AS updated_at, s_suppkey + 1 AS _version, s_nationkey = 3 AS _is_deleted
FROM supplier"""

_CHANGES = {
    "inbound_event_logs": "inbound_plain",
    "protocol_definitions": "definitions",
    "protocol_instances": "enrolments",
    "step_instances": "steps",
    "protocol_instance_history": "enrolment_log",
    "step_instance_history": "step_log",
    "deviations": "devs",
    "compliance_event_logs": "outcomes",
    "action_definitions": "actions",
    "intelligence_event_logs": "triggers",
    "intelligence_deliveries": "deliveries",
    "receiver_adaptor": "receivers",
    "destination_adaptor_mapping": "mappings",
    "facility": "facilities",
}


def _current(part: str) -> str:
    return f"""SELECT * EXCLUDE (_pos) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _version DESC) AS _pos
        FROM {part}) WHERE _pos = 1 AND NOT _is_deleted"""


for _part in ("inbound", "outcomes", "definitions", "enrolments", "steps", "devs", "actions", "triggers", "deliveries",
              "receivers", "mappings", "facilities"):
    _PARTS[f"cur_{_part}"] = _current(_part)

_PARTS["pat_fac"] = """
SELECT subject AS patient_id, facility_id, date_trunc('milliseconds', received_at) AS last_seen FROM inbound
WHERE subject <> '' AND facility_id <> '' AND status <> 'RECEIVED'
QUALIFY row_number() OVER (PARTITION BY subject ORDER BY date_trunc('milliseconds', received_at) DESC, _version DESC) = 1"""

# -- KPI tables -------------------------------------------------------------------

_EVENTS_FROM = f"(TIMESTAMP '{D.EVENTS_AS_OF}' - INTERVAL 12 MONTH)"
_ORDERS_FROM = f"(TIMESTAMP '{D.ORDERS_AS_OF}' - INTERVAL 12 MONTH)"
_EVENTS_STAMP = f"TIMESTAMP '{D.EVENTS_AS_OF}' AS refreshed_at"
_ORDERS_STAMP = f"TIMESTAMP '{D.ORDERS_AS_OF}' AS refreshed_at"

_STEP_MEASURES = f"""count(*) AS step_total, {_count("state IN ('COMPLETED', 'SKIPPED')")} AS step_completed,
    {_count("state = 'OVERDUE'")} AS step_overdue, {_count("state = 'MISSED'")} AS step_missed,
    {_count("state = 'DUE'")} AS step_due, {_count("state = 'PENDING'")} AS step_pending,
    {_count("completion_status = 'ON_TIME'")} AS step_on_time, {_count("completion_status = 'EARLY'")} AS step_early,
    {_count("completion_status = 'LATE'")} AS step_late"""
_STEP_NAMES = ("step_total", "step_completed", "step_overdue", "step_missed", "step_due", "step_pending",
               "step_on_time", "step_early", "step_late")
_STATUS_MEASURES = f"""count(*) AS total_enrollments, {_count("status = 'ACTIVE'")} AS status_active,
    {_count("status = 'COMPLETED'")} AS status_completed, {_count("status = 'WITHDRAWN'")} AS status_withdrawn,
    {_count("status = 'EXPIRED'")} AS status_expired"""


def _compliance(stamp: str, enrolment: str, deviation: str, step: str, day: str) -> str:
    """The compliance snapshot over per-day sources that share column names."""
    steps = ", ".join(f"coalesce(s.{n}, 0) AS {n}" for n in _STEP_NAMES)
    return f"""
    WITH ea AS (SELECT snapshot_date, protocol_definition_id, {_STATUS_MEASURES} FROM {enrolment} GROUP BY ALL),
    di AS (SELECT e.snapshot_date, e.protocol_definition_id, e.protocol_instance_id, count(d.id) AS n,
            {_count("d.deviation_type = 'OVERDUE'")} AS o, {_count("d.deviation_type = 'MISSED'")} AS m,
            {_count("d.deviation_type = 'ORDER_VIOLATION'")} AS v
        FROM {enrolment} e LEFT JOIN {deviation} d ON d.protocol_instance_id = e.protocol_instance_id
            AND {day.format('d', 'e')} GROUP BY ALL),
    pa AS (SELECT snapshot_date, protocol_definition_id, count(*) AS tracked_patients,
            {_count('n = 0')} AS compliant_count, {_count('n > 0')} AS non_compliant_count,
            {_total('n')} AS total_deviations, {_total('o')} AS overdue_deviations,
            {_total('m')} AS missed_deviations, {_total('v')} AS order_violation_deviations FROM di GROUP BY ALL),
    sa AS (SELECT e.snapshot_date, e.protocol_definition_id, {_STEP_MEASURES} FROM {step} s
        JOIN {enrolment} e ON e.protocol_instance_id = s.protocol_instance_id AND s.snapshot_date = e.snapshot_date
        GROUP BY ALL)
    SELECT ea.*, {stamp}, tracked_patients, compliant_count, non_compliant_count,
        {_pct_float('compliant_count', 'tracked_patients')} AS compliance_rate_pct, total_deviations,
        overdue_deviations, missed_deviations, order_violation_deviations, {steps}
    FROM ea JOIN pa USING (snapshot_date, protocol_definition_id)
    LEFT JOIN sa s USING (snapshot_date, protocol_definition_id)"""


_PARTS["live_enrolments"] = f"""SELECT DATE '{D.ORDERS_AS_OF[:10]}' AS snapshot_date, id AS protocol_instance_id,
    protocol_definition_id, status FROM cur_enrolments"""
_PARTS["live_steps"] = f"SELECT DATE '{D.ORDERS_AS_OF[:10]}' AS snapshot_date, * FROM cur_steps"
_PARTS["k_compliance"] = _compliance(_ORDERS_STAMP, "live_enrolments", "cur_devs", "live_steps", "true")

_PARTS["occurrences"] = f"""
SELECT *, CAST(occurred_at AS DATE) AS snapshot_date FROM (
    SELECT coalesce(CASE WHEN d.deviation_type = 'OVERDUE' THEN s.overdue_date
            WHEN d.deviation_type = 'MISSED' THEN s.missed_date
            WHEN d.deviation_type = 'ORDER_VIOLATION' THEN s.completed_at END, s.due_date, d.detected_at)
            AS occurred_at,
        e.protocol_definition_id, e.protocol_canonical, coalesce(f.facility_id, '') AS facility_id, s.action_id,
        d.deviation_type, e.patient_id
    FROM cur_devs d JOIN cur_steps s ON s.id = d.step_instance_id
    JOIN cur_enrolments e ON e.id = d.protocol_instance_id LEFT JOIN pat_fac f ON f.patient_id = e.patient_id)
WHERE occurred_at >= {_ORDERS_FROM}"""
_PARTS["k_deviation"] = f"""
SELECT snapshot_date, {_ORDERS_STAMP}, protocol_definition_id, protocol_canonical, facility_id, action_id,
    deviation_type, count(*) AS deviation_count, count(DISTINCT patient_id) AS affected_patients
FROM occurrences GROUP BY ALL"""

_PARTS["accepted"] = f"""SELECT *, CAST(event_time AS DATE) AS snapshot_date FROM cur_inbound
WHERE status = 'ACCEPTED' AND event_time IS NOT NULL AND event_time >= {_EVENTS_FROM}"""
_PARTS["k_event"] = f"""
SELECT a.snapshot_date, {_EVENTS_STAMP}, a.facility_id, count(*) AS total_events,
    {_count("o.st = 'MATCHED'")} AS matched_count, {_count("o.st = 'ZERO_MATCH'")} AS zero_match_count,
    {_count("o.st = 'DUPLICATE'")} AS duplicate_count, {_count('o.st IS NULL')} AS pipeline_loss_count
FROM accepted a LEFT JOIN (SELECT cloudevents_id, arg_max(processing_status, received_at) AS st FROM cur_outcomes
    GROUP BY 1) o ON o.cloudevents_id = a.cloudevents_id GROUP BY ALL"""
_PARTS["k_adoption"] = f"""
SELECT snapshot_date, {_EVENTS_STAMP}, f.facility_id, f.expected_patients_per_day,
    count(DISTINCT a.subject) AS actual_patients,
    {_pct_float('count(DISTINCT a.subject)', 'f.expected_patients_per_day')} AS adoption_rate_pct,
    f.expected_patients_per_day - count(DISTINCT a.subject) AS reporting_gap
FROM accepted a JOIN cur_facilities f ON f.facility_id = a.facility_id
WHERE a.facility_id <> '' AND a.subject <> ''
GROUP BY snapshot_date, f.facility_id, f.expected_patients_per_day"""
_PARTS["referral_ids"] = """SELECT o.cloudevents_id FROM cur_outcomes o JOIN cur_steps s
    ON s.completed_by_event_id = o.id WHERE regexp_full_match(s.action_id, '(.+-referral|referral)')"""
_PARTS["k_referral"] = f"""
SELECT snapshot_date, {_EVENTS_STAMP}, facility_id, count(*) AS referral_count,
    {_count('cloudevents_id IN (SELECT cloudevents_id FROM referral_ids)')} AS matched_count
FROM accepted WHERE (resource_type = 'Encounter' AND is_transfer_encounter)
    OR cloudevents_id IN (SELECT cloudevents_id FROM referral_ids) GROUP BY ALL"""


def _days(first: str, last: str) -> str:
    return f"SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS snapshot_date"


_PARTS["bf_days"] = _days(*Q.BACKFILL_RANGE)
_PARTS["bf_enrolments"] = """SELECT d.snapshot_date, h.protocol_instance_id, e.protocol_definition_id,
    arg_max(h.status, (h.changed_at, h.id)) AS status
FROM bf_days d JOIN enrolment_moves h ON CAST(h.changed_at AS DATE) <= d.snapshot_date
JOIN cur_enrolments e ON e.id = h.protocol_instance_id GROUP BY ALL"""
_PARTS["bf_steps"] = """SELECT d.snapshot_date, h.step_instance_id, s.protocol_instance_id,
    arg_max(h.state, (h.changed_at, h.id)) AS state,
    arg_max(h.completion_status, (h.changed_at, h.id)) AS completion_status
FROM bf_days d JOIN step_log h ON CAST(h.changed_at AS DATE) <= d.snapshot_date
JOIN cur_steps s ON s.id = h.step_instance_id GROUP BY ALL"""
_PARTS["k_backfill"] = _compliance(
    _ORDERS_STAMP, "bf_enrolments", "cur_devs", "bf_steps", "CAST({0}.detected_at AS DATE) <= {1}.snapshot_date"
)

# -- metric samples, query log ----------------------------------------------------

_PARTS["gauges"] = """SELECT ts, 's' || (user_id % 8) AS source, event_type AS kind, CAST(k AS DOUBLE) AS depth,
    (100 - k) * 1000.0::DOUBLE AS avail, k, event_id FROM ev"""
_PARTS["depth_steps"] = """SELECT source, to_timestamp_hour AS ts, arg_max(depth, s_ts) AS value FROM (
    SELECT source, depth, ts AS s_ts,
        CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END
            AS to_timestamp_hour FROM gauges) GROUP BY ALL"""
_PARTS["alerts"] = """SELECT source, min(ts) AS since, max(ts) AS until,
    date_diff('hour', min(ts), max(ts)) >= 2 AS fired, 'warning' AS severity
FROM (SELECT *, ts - to_hours(row_number() OVER (PARTITION BY source ORDER BY ts)) AS run
    FROM depth_steps WHERE value > 50) GROUP BY source, run"""
_PARTS["qlog"] = """SELECT ts AS event_time,
    CASE WHEN event_type = 'error' THEN 'ExceptionWhileProcessing' ELSE 'QueryFinish' END AS type,
    'u' || (user_id % 20) AS "user",
    'SELECT * FROM ' || CASE WHEN k = 77 THEN 'system.parts' ELSE event_type || '_log_' || (user_id % 8) END
        || ' WHERE id = ' || event_id || ' AND tag = ''k' || k || '''' AS query,
    'SELECT * FROM ' || CASE WHEN k = 77 THEN 'system.parts' ELSE event_type || '_log_' || (user_id % 8) END
        || ' WHERE id = ? AND tag = ?' AS query_shape,
    CAST(floor(value * 100) AS BIGINT) AS duration_ms, CAST(k AS BIGINT) * 10000000 AS memory,
    CAST(floor(value * 1000) AS BIGINT) AS read_rows, CAST(floor(value * 1000) AS BIGINT) * 8 AS read_bytes,
    CASE WHEN event_type = 'error' THEN k % 30 ELSE 0 END AS exception_code,
    CASE WHEN event_type = 'error' THEN 'Code: ' || (k % 30) ELSE '' END AS exception FROM ev"""
_PARTS["q_scope"] = "SELECT * FROM qlog WHERE query NOT LIKE '%system.%'"
_PARTS["q_done"] = "SELECT * FROM q_scope WHERE type = 'QueryFinish'"
_PARTS["q_failed"] = "SELECT * FROM q_scope WHERE type = 'ExceptionWhileProcessing'"
_PARTS["stmts"] = f"""SELECT query_shape AS query, count(*) AS calls, CAST(sum(duration_ms) AS DOUBLE) AS total_exec_time,
    avg(duration_ms) AS mean_exec_time, CAST(min(duration_ms) AS DOUBLE) AS min_exec_time,
    CAST(max(duration_ms) AS DOUBLE) AS max_exec_time, {_total('read_rows')} AS rows,
    {_total('read_bytes')} AS blks_hit, {_total('memory')} AS blks_read FROM qlog GROUP BY ALL"""


def _size(value: str) -> str:
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    branches = " ".join(
        f"WHEN {value} >= {1024 ** p} THEN printf('%.2f', CAST({value} AS DOUBLE) / {1024 ** p}.0::DOUBLE) || ' {units[p]}'"
        for p in range(5, 0, -1)
    )
    return f"CASE {branches} ELSE printf('%.2f', CAST({value} AS DOUBLE)) || ' B' END"


def _increase(samples: str, lookback: int, step: int) -> str:
    """Counter increase by joining every window with its samples. ``samples``
    gives source, ts, value, where value is the counter."""
    reach, grid = lookback * 1000000, step * 1000000
    return f"""
    SELECT source, t, raw * (span + CASE WHEN zero IS NOT NULL AND zero < lead THEN zero ELSE lead END
            + CASE WHEN tail >= mean * 1.1 THEN mean / 2 ELSE tail END) / span AS value FROM (
      SELECT *, CASE WHEN head >= mean * 1.1 THEN mean / 2 ELSE head END AS lead,
        CASE WHEN raw > 0 AND fv >= 0 THEN span * (fv / raw) END AS zero FROM (
        SELECT source, t, (max(us) - min(us)) / 1000000.0::DOUBLE AS span,
            (max(us) - min(us)) / 1000000.0::DOUBLE / (count(*) - 1) AS mean,
            (min(us) - (t - {reach})) / 1000000.0::DOUBLE AS head, (t - max(us)) / 1000000.0::DOUBLE AS tail,
            sum(delta) - arg_min(delta, us) AS raw, arg_min(value, us) AS fv
        FROM (SELECT g.source, g.t, d.us, d.delta, d.value
            FROM (SELECT DISTINCT source, unnest(generate_series(
                    CAST(ceil(epoch_us(ts) / {grid}.0::DOUBLE) AS BIGINT) * {grid},
                    CAST(ceil(epoch_us(ts) / {grid}.0::DOUBLE) AS BIGINT) * {grid} + {reach - grid}, {grid})) AS t
                FROM ({samples})) g
            JOIN (SELECT source, epoch_us(ts) AS us, value, CASE WHEN prev IS NULL THEN 0
                    WHEN value < prev THEN value ELSE value - prev END AS delta
                FROM (SELECT *, lag(value) OVER (PARTITION BY source ORDER BY ts) AS prev FROM ({samples}))) d
            ON d.source = g.source AND d.us > g.t - {reach} AND d.us <= g.t)
        GROUP BY source, t HAVING count(*) >= 2))"""


def _counter(amount: str, where: str = "true", per: str = "source") -> str:
    return f"""SELECT source, ts, value FROM (SELECT * EXCLUDE (value), CAST(sum({amount}) OVER (PARTITION BY {per}, CAST(ts AS DATE)
        ORDER BY ts, event_id) AS DOUBLE) AS value FROM (SELECT *, 's' || (user_id % 8) AS source FROM ev))
        WHERE {where}"""


_CENTS = "CAST(floor(value * 100) AS BIGINT)"
_RECEIVED = _counter(_CENTS)
_AT = "make_timestamp(t) AS ts"
_BUCKETS = """SELECT source, ts, value FROM (SELECT 's' || (user_id % 8) || '/' || le AS source, ts,
    CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 8, le, CAST(ts AS DATE)
        ORDER BY ts, event_id) AS DOUBLE) AS value
    FROM ev, (SELECT unnest([5.0::DOUBLE, 10, 25, 50, 100, 200, 'Infinity'::DOUBLE]) AS le)) WHERE value > 0"""


# -- the registered queries -------------------------------------------------------


def _decoders() -> dict[str, str]:
    result = {}
    for table, part in _CHANGES.items():
        columns = ", ".join([*TABLES[table].columns, "_version", "_is_deleted"])
        result[f"cdc_{table}"] = f"SELECT {columns} FROM {part}"
    return result


def _marts() -> dict[str, str]:
    def both(name: str, part: str, sql: str, unit: str = "day") -> dict[str, str]:
        return {name: sql.format(src=part), f"{name}_current": sql.format(src=f"cur_{part}")}

    day = "date_trunc('day', {})"
    received, detected, created = (day.format(c) + " AS day" for c in ("received_at", "detected_at", "created_at"))
    result = {}
    result |= both("mv_event_volume_hourly", "inbound", """SELECT date_trunc('hour', event_time) AS hour, facility_id,
        source, event_type, resource_type, count(*) AS event_count FROM {src}
        WHERE status = 'ACCEPTED' AND event_time IS NOT NULL GROUP BY ALL""")
    result |= both("mv_deviation_trends", "devs",
                   f"SELECT {detected}, deviation_type, count(*) AS deviation_count FROM {{src}} GROUP BY ALL")
    result |= both("mv_deviation_by_protocol", "devs", f"""SELECT {detected}, protocol_instance_id, deviation_type,
        count(*) AS deviation_count FROM {{src}} GROUP BY ALL""")
    result |= both("mv_ingestion_quality", "inbound", f"""SELECT {received}, source, status, rejection_reason,
        count(*) AS event_count FROM {{src}} WHERE status <> 'RECEIVED' GROUP BY ALL""")
    result |= both("mv_intelligence_summary", "triggers", f"""SELECT {created}, action_type, intelligence_destination,
        step_state, trigger_reason, count(*) AS trigger_count, count(DISTINCT subject) AS unique_patients
        FROM {{src}} GROUP BY ALL""")
    result |= both("mv_practitioner_summary", "inbound", f"""SELECT {received}, facility_id, practitioner_ref,
        min(practitioner_display) AS practitioner_display, count(*) AS event_count,
        count(DISTINCT subject) AS unique_patients, count(DISTINCT resource_type) AS resource_type_count FROM {{src}}
        WHERE practitioner_ref <> '' AND status = 'ACCEPTED' GROUP BY ALL""")
    result |= both("mv_facility_summary", "inbound", f"""SELECT {received}, facility_id, resource_type,
        count(*) AS event_count, count(DISTINCT subject) AS unique_patients,
        count(DISTINCT practitioner_ref) AS unique_practitioners FROM {{src}}
        WHERE facility_id <> '' AND status = 'ACCEPTED' GROUP BY ALL""")
    result |= both("mv_intelligence_by_patient", "triggers", f"""SELECT {created}, subject, action_type,
        intelligence_destination, trigger_reason, count(*) AS trigger_count FROM {{src}} GROUP BY ALL""")
    result |= both("mv_intelligence_by_protocol", "triggers", f"""SELECT {created}, protocol_instance_id, action_type,
        intelligence_destination, trigger_reason, count(*) AS trigger_count,
        count(DISTINCT subject) AS unique_patients FROM {{src}} GROUP BY ALL""")
    result |= both("mv_compliance_processing_quality", "outcomes", f"""SELECT {received}, source, processing_status,
        count(*) AS event_count FROM {{src}} GROUP BY ALL""")
    result |= both("mv_deviation_by_patient", "devs", """SELECT date_trunc('day', d.detected_at) AS day,
        coalesce(e.patient_id, '') AS patient_id, d.deviation_type, count(*) AS deviation_count,
        count(DISTINCT d.protocol_instance_id) AS unique_protocols
        FROM {src} d LEFT JOIN cur_enrolments e ON e.id = d.protocol_instance_id GROUP BY ALL""")
    result["mv_patient_facility_latest"] = "SELECT * FROM pat_fac"
    return result


def _between(part: str, bounds: tuple[str, str]) -> str:
    return f"(SELECT * FROM {part} WHERE snapshot_date BETWEEN DATE '{bounds[0]}' AND DATE '{bounds[1]}')"


def _reports() -> dict[str, str]:
    day = f"snapshot_date = DATE '{Q.EVENT_DAY}'"
    named = """SELECT a.snapshot_date, a.facility_id, coalesce(f.facility_name, '') AS facility_name,
        a.expected_patients_per_day, a.actual_patients, a.adoption_rate_pct, a.reporting_gap
        FROM k_adoption a LEFT JOIN cur_facilities f ON f.facility_id = a.facility_id"""
    adoption_day = f"SELECT * EXCLUDE (snapshot_date) FROM ({named}) WHERE {day}"
    header = f"""SELECT coalesce({_total('deviation_count')}, 0) AS total_deviations,
        coalesce(CAST(sum(deviation_count) FILTER (WHERE deviation_type = 'OVERDUE') AS BIGINT), 0) AS overdue_count,
        coalesce(CAST(sum(deviation_count) FILTER (WHERE deviation_type = 'MISSED') AS BIGINT), 0) AS missed_count,
        coalesce(CAST(sum(deviation_count) FILTER (WHERE deviation_type = 'ORDER_VIOLATION') AS BIGINT), 0)
            AS order_violation_count FROM k_deviation"""
    rate = "round_even(CAST({0} AS DOUBLE) / nullif({1}, 0) * 100, 1) AS compliance_rate_pct"
    received_since = "received_at >= TIMESTAMP '{0}' - INTERVAL {1} AND received_at <= TIMESTAMP '{0}'"
    return {
        "outcome_distribution": """SELECT protocol_definition_id, status, count(*) AS enrollments FROM cur_enrolments
            GROUP BY ALL""",
        "enrollment_compliance_rate": f"""SELECT protocol_instance_id, count(*) AS total_steps,
            {_count("state IN ('COMPLETED', 'SKIPPED')")} AS completed_steps,
            {_pct(_count("state IN ('COMPLETED', 'SKIPPED')"), 'count(*)')} AS compliance_rate
            FROM cur_steps GROUP BY ALL""",
        "delivery_success_rate": f"""SELECT destination, count(*) AS total, {_count("status = 'DELIVERED'")} AS delivered,
            {_pct(_count("status = 'DELIVERED'"), 'count(*)')} AS success_rate_pct,
            round_even(avg(attempt_count), 2) AS avg_attempts FROM cur_deliveries GROUP BY ALL""",
        "delivery_latency": """SELECT destination,
            round_even(avg(epoch_ms(delivered_at) - epoch_ms(created_at)), 0) AS avg_latency_ms
            FROM cur_deliveries WHERE delivered_at IS NOT NULL GROUP BY ALL""",
        "dash_compliance_cards": f"""SELECT {_total('tracked_patients')} AS tracked_patients,
            {_total('compliant_count')} AS compliant_count, {_total('non_compliant_count')} AS non_compliant_count,
            {rate.format('sum(compliant_count)', 'sum(tracked_patients)')} FROM k_compliance""",
        "dash_adoption_overview": adoption_day,
        "adoption_table": adoption_day,
        "dash_referrals_by_facility": f"""SELECT facility_id, {_total('referral_count')} AS referrals
            FROM {_between('k_referral', Q.EVENT_RANGE)} GROUP BY ALL""",
        "dash_referrals_total": f"""SELECT coalesce({_total('referral_count')}, 0) AS referrals
            FROM {_between('k_referral', Q.EVENT_RANGE)}""",
        "trend_compliance": f"""SELECT snapshot_date, {_total('tracked_patients')} AS tracked_patients,
            {_total('compliant_count')} AS compliant_count,
            {rate.format('sum(compliant_count)', 'sum(tracked_patients)')} FROM k_backfill
            WHERE snapshot_date >= DATE '{Q.BACKFILL_RANGE[1]}' - 30 GROUP BY ALL""",
        "trend_adoption": f"""SELECT * EXCLUDE (reporting_gap) FROM
            (SELECT * FROM ({named}) WHERE snapshot_date BETWEEN DATE '{Q.EVENT_RANGE[0]}'
            AND DATE '{Q.EVENT_RANGE[1]}')""",
        "compliance_page": f"""SELECT * EXCLUDE (snapshot_date, refreshed_at) FROM k_compliance
            WHERE protocol_definition_id = '{Q.PROTOCOL}'""",
        "deviation_header": header,
        "deviation_header_day": header + " WHERE snapshot_date = DATE '2001-06-15'",
        "event_header": f"""SELECT {_total('total_events')} AS total_events,
            {_pct('sum(matched_count)', 'sum(total_events)')} AS matched_rate_pct,
            {_pct('sum(zero_match_count)', 'sum(total_events)')} AS zero_match_rate_pct,
            {_total('pipeline_loss_count')} AS pipeline_loss_count FROM k_event WHERE {day}""",
        "adoption_period_rate": f"""SELECT facility_id, {_total('actual_patients')} AS total_actual,
            expected_patients_per_day * count(DISTINCT snapshot_date) AS total_expected,
            {_pct('sum(actual_patients)', 'expected_patients_per_day * count(DISTINCT snapshot_date)')} AS period_rate
            FROM {_between('k_adoption', Q.EVENT_RANGE)} GROUP BY facility_id, expected_patients_per_day""",
        "deviation_unique_patients": f"""SELECT protocol_definition_id, deviation_type,
            count(DISTINCT patient_id) AS affected_patients
            FROM {_between('occurrences', ('2001-03-01', '2001-08-31'))} GROUP BY ALL""",
        "merged_unique_patients": f"""SELECT protocol_definition_id, deviation_type,
            count(DISTINCT patient_id) AS affected_patients, true AS estimate_close
            FROM {_between('occurrences', ('2001-03-01', '2001-08-31'))} GROUP BY ALL""",
        "readable_quantities": """SELECT "user", queries, CASE WHEN n >= 1e12 THEN printf('%.2f trillion', n / 1e12)
            WHEN n >= 1e9 THEN printf('%.2f billion', n / 1e9) WHEN n >= 1e6 THEN printf('%.2f million', n / 1e6)
            WHEN n >= 1e3 THEN printf('%.2f thousand', n / 1e3) ELSE printf('%.2f', n) END AS rows_read
            FROM (SELECT "user", count(*) AS queries, sum(read_rows)::DOUBLE AS n FROM qlog GROUP BY ALL)""",
        "referral_compliance": f"""SELECT snapshot_date, facility_id, referral_count, matched_count,
            referral_count - matched_count AS non_compliant_count,
            {_pct('matched_count', 'referral_count')} AS compliance_rate_pct FROM k_referral""",
        "adoption_fill_zero": f"""SELECT d.snapshot_date, f.facility_id, f.expected_patients_per_day,
            coalesce(a.actual_patients, 0) AS actual_patients,
            {_pct_float('coalesce(a.actual_patients, 0)', 'f.expected_patients_per_day')} AS adoption_rate_pct,
            f.expected_patients_per_day - coalesce(a.actual_patients, 0) AS reporting_gap
            FROM ({_days(*Q.EVENT_RANGE)}) d CROSS JOIN cur_facilities f
            LEFT JOIN k_adoption a ON a.snapshot_date = d.snapshot_date AND a.facility_id = f.facility_id""",
        "rank_facilities": """SELECT snapshot_date, facility_id, adoption_rate_pct,
            CAST(rank() OVER (PARTITION BY snapshot_date ORDER BY adoption_rate_pct DESC) AS INTEGER) AS rank_ordinal
            FROM k_adoption""",
        "events_per_minute": f"""SELECT date_trunc('minute', received_at) AS time, count(*) AS events FROM cur_inbound
            WHERE {received_since.format(D.EVENTS_AS_OF, '1 DAY')} GROUP BY ALL""",
        "cdc_freshness_seconds": f"""SELECT date_diff('second', max(received_at), TIMESTAMP '{D.EVENTS_AS_OF}')
            AS seconds_since_last_event FROM cur_inbound""",
        "e2e_latency_per_minute": f"""SELECT date_trunc('minute', received_at) AS time,
            round(quantile_cont(date_diff('second', event_time, received_at), 0.5), 6) AS p50,
            round(quantile_cont(date_diff('second', event_time, received_at), 0.95), 6) AS p95 FROM cur_inbound
            WHERE {received_since.format(D.EVENTS_AS_OF, '1 DAY')} AND event_time IS NOT NULL GROUP BY ALL""",
        "e2e_latency_p95_5min": f"""SELECT round(quantile_cont(date_diff('second', event_time, received_at), 0.95), 6)
            AS p95 FROM cur_inbound WHERE {received_since.format(Q.BUSY_MOMENT, '3 HOUR')}
            AND event_time IS NOT NULL""",
        "merged_latency_quantiles": f"""SELECT date_trunc('minute', received_at) AS time, count(*) AS n,
            true AS p50_close, true AS p95_close FROM cur_inbound
            WHERE {received_since.format(D.EVENTS_AS_OF, '1 DAY')} AND event_time IS NOT NULL GROUP BY ALL""",
        "merged_latency_p95": f"""SELECT count(*) AS n, true AS p95_close FROM cur_inbound
            WHERE {received_since.format(Q.BUSY_MOMENT, '3 HOUR')} AND event_time IS NOT NULL
            AND date_trunc('minute', received_at) > TIMESTAMP '{Q.BUSY_MOMENT}' - INTERVAL 3 HOUR""",
        "insert_stall": f"""SELECT count(*) AS rows_received, count(*) = 0 AS stalled FROM cur_inbound
            WHERE {received_since.format(Q.BUSY_MOMENT, '10 MINUTE')}""",
    }


def _dimensions() -> dict[str, str]:
    return {
        "dict_protocol_definitions": """SELECT e.id, e.protocol_definition_id, coalesce(d.name, '') AS protocol_name,
            coalesce(d.version, '') AS protocol_version, coalesce(d.url, '') AS protocol_url,
            coalesce(d.url || '|' || d.version, '') AS protocol_canonical, coalesce(d.status, '') AS protocol_status
            FROM cur_enrolments e LEFT JOIN cur_definitions d ON d.id = e.protocol_definition_id""",
        "dict_patient_facility": """SELECT e.id, e.patient_id, coalesce(f.facility_id, '') AS facility_id,
            coalesce(f.last_seen, TIMESTAMP '1970-01-01 00:00:00') AS last_seen
            FROM cur_enrolments e LEFT JOIN pat_fac f ON f.patient_id = e.patient_id""",
        "dict_action_definitions": """SELECT t.id, t.action_definition_id,
            coalesce(a.canonical_url, '') AS action_canonical_url, coalesce(a.name, '') AS action_name,
            coalesce(a.action_type, '') AS action_action_type, coalesce(a.status, '') AS action_status
            FROM cur_triggers t LEFT JOIN cur_actions a ON a.id = t.action_definition_id""",
        "dict_delivery_adaptor": """SELECT d.id, d.destination_adaptor_mapping_id,
            coalesce(x.destination, '') AS destination, coalesce(x.adaptor_name, '') AS adaptor_name,
            coalesce(x.endpoint_url, '') AS endpoint_url, coalesce(x.adaptor_status, '') AS adaptor_status
            FROM cur_deliveries d LEFT JOIN (SELECT m.id, m.destination, r.name AS adaptor_name, r.endpoint_url,
                r.status AS adaptor_status FROM cur_mappings m JOIN cur_receivers r ON r.id = m.receiver_adaptor_id) x
            ON x.id = d.destination_adaptor_mapping_id""",
    }


def _state_queries() -> dict[str, str]:
    marts = _marts()
    first, last = Q.ASOF_RANGE
    asof_days = _days(first, last)
    marker = UNAVAILABLE_VALUE
    return {
        "latest_by_version": "SELECT id, protocol_instance_id, action_id, state, _version FROM cur_steps",
        "current_view_sql": """SELECT status, count(*) AS enrollments, min(enrolled_at) AS first_enrolled
            FROM cur_enrolments GROUP BY ALL""",
        "snapshot_latest": "SELECT * FROM k_event",
        "replace_table": "SELECT * FROM k_event",
        "history_dedup": "SELECT * FROM enrolment_moves",
        "carry_forward_unavailable": f"""SELECT id, _version, last_value(nullif(seen, '{marker}') IGNORE NULLS) OVER (
            PARTITION BY id ORDER BY _version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state
            FROM (SELECT id, _version, CASE WHEN repeat_index = 2 THEN '{marker}' ELSE state END AS seen FROM steps)""",
        "rollup_protocol_instance_current": """SELECT protocol_definition_id, id, patient_id, protocol_canonical,
            status, enrolled_at FROM cur_enrolments""",
        "rollup_step_current": """SELECT protocol_instance_id, id, action_id, state, completion_status
            FROM cur_steps""",
        "rollup_deviation_current": "SELECT protocol_instance_id, id, deviation_type FROM cur_devs",
        "rollup_delivery_current": """SELECT id, destination, action_type, subject, status, attempt_count, created_at
            FROM cur_deliveries""",
        "argmax_merge": """SELECT id, destination, action_type, subject, status, attempt_count, created_at,
            _is_deleted AS is_deleted FROM cur_deliveries""",
        "sum_merge": marts["mv_ingestion_quality"],
        "state_merge": f"""SELECT * EXCLUDE (unique_patients), true AS estimate_close
            FROM ({marts['mv_intelligence_summary']})""",
        "backfill_event_volume": marts["mv_event_volume_hourly"],
        "retention_90d": """SELECT CAST(received_at AS DATE) AS day, count(*) AS kept_rows FROM inbound_plain
            WHERE received_at > TIMESTAMP '2024-04-10 12:00:00' - INTERVAL 90 DAY GROUP BY ALL""",
        "compacted_changelog": """SELECT id, status, _version, _is_deleted FROM deliveries
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY _version DESC) = 1""",
        "rebuild_aggregates": marts["mv_deviation_trends_current"],
        "stream_deviation_by_patient": marts["mv_deviation_by_patient"],
        "rebuild_then_ingest": marts["mv_deviation_trends"],
        "committed_batches": """SELECT status, count(*) AS rows, 'changes' AS form FROM deliveries GROUP BY status
            UNION ALL SELECT status, count(*) AS rows, 'rollup' AS form FROM cur_deliveries GROUP BY status""",
        "asof_status": f"""SELECT d.snapshot_date, h.protocol_instance_id,
            arg_max(h.status, (h.changed_at, h.id)) AS status FROM ({asof_days}) d
            JOIN enrolment_moves h ON CAST(h.changed_at AS DATE) <= d.snapshot_date GROUP BY ALL""",
        "asof_step_state": f"""SELECT d.snapshot_date, h.step_instance_id,
            arg_max(h.state, (h.changed_at, h.id)) AS state,
            arg_max(h.completion_status, (h.changed_at, h.id)) AS completion_status FROM ({asof_days}) d
            JOIN step_log h ON CAST(h.changed_at AS DATE) <= d.snapshot_date GROUP BY ALL""",
        "asof_deviation_counts": f"""SELECT d.snapshot_date, v.protocol_instance_id, count(*) AS deviation_count,
            {_count("v.deviation_type = 'OVERDUE'")} AS overdue_count FROM ({asof_days}) d
            JOIN cur_devs v ON CAST(v.detected_at AS DATE) <= d.snapshot_date GROUP BY ALL""",
        "semi_join_referrals": """SELECT id, cloudevents_id FROM cur_inbound
            WHERE cloudevents_id IN (SELECT cloudevents_id FROM referral_ids)""",
        "orphan_deviations": """SELECT deviation_type, count(*) AS orphans FROM cur_devs d
            WHERE NOT EXISTS (SELECT 1 FROM cur_steps s WHERE s.id = d.step_instance_id) GROUP BY ALL""",
        "aggregate_drift": f"""SELECT a, b, CAST(abs(a - b) > greatest(a, 1) * 0.01 AS INTEGER) AS drift FROM (
            SELECT (SELECT count(*) FROM inbound WHERE status = 'ACCEPTED'
                AND CAST(received_at AS DATE) = DATE '{Q.EVENT_DAY}') AS a,
            (SELECT count(*) FROM inbound WHERE status = 'ACCEPTED'
                AND CAST(event_time AS DATE) = DATE '{Q.EVENT_DAY}') AS b)""",
        "stream_event_volume_hourly": marts["mv_event_volume_hourly"],
        "stream_deviation_by_protocol": marts["mv_deviation_by_protocol"],
        "stream_rollup_protocol_instance": """SELECT protocol_definition_id, id, patient_id, protocol_canonical,
            status, enrolled_at, false AS is_deleted FROM cur_enrolments""",
        "stream_rollup_step": """SELECT protocol_instance_id, id, action_id, state, completion_status,
            false AS is_deleted FROM cur_steps""",
        "equal_versions_by_arrival": """SELECT 'SECOND' AS status, count(DISTINCT id) AS rows, form
            FROM deliveries, (VALUES ('state'), ('rollup')) f(form) WHERE NOT _is_deleted GROUP BY ALL""",
        "merged_partials": marts["mv_ingestion_quality"],
        "merged_rollup": """SELECT id, destination, action_type, subject, status, attempt_count, created_at,
            _is_deleted AS is_deleted FROM cur_deliveries""",
        "stream_rollup_delivery": """SELECT id, destination, action_type, subject, status, attempt_count, created_at,
            _is_deleted AS is_deleted FROM cur_deliveries""",
        "stream_patient_facility": "SELECT * FROM pat_fac",
        "stream_current_state": "SELECT id, patient_id, status, enrolled_at, _version FROM cur_enrolments",
        "stream_history_dedup": "SELECT id, protocol_instance_id, status, changed_at FROM enrolment_moves",
        "snapshot_and_live": f"""SELECT status, count(*) AS enrollments FROM (
            SELECT * FROM (SELECT {_id(D.ENROLMENT, 'o_orderkey')} AS id, 'SNAPSHOT' AS status, 0 AS _version,
                false AS _is_deleted FROM ord
              UNION ALL SELECT {_id(D.ENROLMENT, f'(o_orderkey + {Q.SNAPSHOT_ONLY})')}, 'SNAPSHOT', 0, false FROM ord
              UNION ALL SELECT id, status, _version, _is_deleted FROM enrolments)
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY _version DESC) = 1)
            WHERE NOT _is_deleted GROUP BY ALL""",
        "date_series": f"""SELECT snapshot_date, count(o_orderkey) AS orders
            FROM ({_days('1995-01-01', '2001-12-31')}) LEFT JOIN ord ON CAST(ts AS DATE) = snapshot_date GROUP BY ALL""",
        "time_filter": """SELECT "user", count(*) AS queries, max(event_time) AS newest FROM qlog
            WHERE event_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL""",
        "parameter_query": """SELECT o_orderstatus, count(*) AS orders FROM orders
            WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY ALL""",
        "derive_inbound": """SELECT id, _version, subject, event_type, facility_id, resource_type, practitioner_ref,
            practitioner_display, is_transfer_encounter, subject AS patient_id FROM inbound""",
        "derive_misc": """SELECT id, _version,
            CASE WHEN n = 1 OR (k >= 10 AND k < 15) THEN 'none/' WHEN k < 10 THEN '500/failed' ELSE '200/ok' END AS text,
            epoch_ms(delivered_at) - epoch_ms(created_at) AS latency_ms FROM deliveries
            UNION ALL SELECT id, _version, name || '@' || url || '|' || version, NULL FROM definitions
            UNION ALL SELECT id, _version, endpoint_url, NULL FROM receivers""",
        "cdc_exclude_columns": f"""SELECT {', '.join(c for c in TABLES['intelligence_event_logs'].columns
            if c != 'evaluation_context')}, _version, _is_deleted FROM triggers""",
        "cdc_decode_envelope": f"""SELECT {_id(D.EVENT, 'event_id')} AS id,
            CASE WHEN k < 30 THEN 'ce-' || event_id WHEN k < 60 THEN '' ELSE CAST(event_id AS VARCHAR) END
                AS cloudevents_id,
            CASE WHEN k < 50 THEN 's' ELSE '' END AS source, '' AS correlation_id, '' AS raw_payload, 'x' AS status,
            '' AS rejection_reason, '' AS error_details,
            CASE WHEN k < 30 THEN ts WHEN k < 60 THEN ts - INTERVAL 2 HOUR
                WHEN k < 65 THEN date_trunc('millisecond', ts) WHEN k < 70 THEN ts
                WHEN k < 73 THEN date_trunc('second', ts) WHEN k < 76 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
                ELSE TIMESTAMP '1970-01-01 00:00:00' END AS received_at,
            TIMESTAMP '1970-01-01 00:00:00' AS updated_at,
            CASE WHEN k < 70 THEN date_trunc('second', ts) END AS event_time,
            event_id AS _version, k >= 20 AND k < 40 AS _is_deleted FROM ev WHERE k NOT BETWEEN 1 AND 6""",
        "cdc_dead_letters": """SELECT CASE k WHEN 2 THEN 'unreadable message' WHEN 3 THEN 'bad identifier: id'
            WHEN 5 THEN 'no row image' ELSE 'version out of range' END AS problem, count(*) AS messages
            FROM ev WHERE k IN (2, 3, 5, 6) GROUP BY ALL""",
        "dq_drift_found": """SELECT 'marts agree on today''s accepted events' AS "check", '1' AS value, '0' AS expected,
            false AS passed FROM inbound HAVING count(*) > 0""",
        "dq_report": _dq("TIMESTAMP '2024-01-30 23:00:00'"),
    }


def _dq(moment: str) -> str:
    def positive(name: str, part: str) -> str:
        return f"SELECT '{name}' AS \"check\", count(*) AS n, '> 0' AS expected, count(*) > 0 AS passed FROM {part}"

    def zero(name: str, source: str) -> str:
        return f"SELECT '{name}', n, '0', n = 0 FROM (SELECT count(*) AS n FROM {source})"

    def fresh(name: str, part: str, column: str, interval: str) -> str:
        state = f"CASE WHEN max({column}) >= {moment} - INTERVAL {interval} THEN 'ok' ELSE 'stale' END"
        return f"SELECT '{name}', s, 'ok', s = 'ok' FROM (SELECT {state} AS s FROM {part})"

    last_hour = f"received_at >= {moment} - INTERVAL 1 HOUR"
    today = f"CAST({{}} AS DATE) = CAST({moment} AS DATE) AND status = 'ACCEPTED'"

    def drift(name: str, clock: str) -> str:
        return f"""SELECT '{name}', d, '0', d = 0 FROM (SELECT CAST(abs(a - b) > greatest(a, 1) * 0.01 AS INTEGER) AS d
            FROM (SELECT (SELECT count(*) FROM inbound WHERE {today.format('received_at')}) AS a,
            (SELECT count(*) FROM inbound WHERE {today.format(clock)}) AS b))"""

    rows = [
        positive("rows present: inbound_event_logs", "cur_inbound"),
        zero("inbound_event_logs: source never blank", "cur_inbound WHERE source = ''"),
        zero("inbound_event_logs: received_at at most an hour ahead", f"cur_inbound WHERE received_at > {moment} + INTERVAL 1 HOUR"),
        fresh("newest inbound_event_logs row within 10 minutes", "cur_inbound", "received_at", "10 MINUTE"),
        positive("rows present: intelligence_event_logs", "cur_triggers"),
        fresh("newest intelligence_event_logs row within an hour", "cur_triggers", "created_at", "1 HOUR"),
        positive("rows present: protocol_definitions", "cur_definitions"),
        positive("rows present: protocol_instances", "cur_enrolments"),
        positive("rows present: step_instances", "cur_steps"),
        zero("step_instances: every enrolment known",
             "cur_steps s WHERE NOT EXISTS (SELECT 1 FROM cur_enrolments e WHERE e.id = s.protocol_instance_id)"),
        zero("deviations: every step known",
             "cur_devs d WHERE NOT EXISTS (SELECT 1 FROM cur_steps s WHERE s.id = d.step_instance_id)"),
        drift("marts agree on today''s accepted events", "event_time"),
        drift("quality mart agrees with today''s changes by receipt", "received_at"),
        zero("inbound changes: each event once in the last hour",
             f"(SELECT cloudevents_id FROM inbound WHERE {last_hour} GROUP BY 1 HAVING count(*) > 1)"),
        zero("inbound_event_logs: each event once in the last hour",
             f"(SELECT cloudevents_id FROM cur_inbound WHERE {last_hour} GROUP BY 1 HAVING count(*) > 1)"),
    ]
    return " UNION ALL ".join(
        'SELECT "check", CAST(value AS VARCHAR) AS value, expected, passed '
        f'FROM ({r}) AS r("check", value, expected, passed)'
        for r in rows
    )


def _metrics() -> dict[str, str]:
    six, hour, day = Q.SIX_HOURS, Q.HOUR, 4 * Q.SIX_HOURS
    errors = _counter(_CENTS, "event_type = 'error'", "source, event_type")
    clicks = _counter(_CENTS, "event_type = 'click'", "source, event_type")
    latency = _increase(_RECEIVED, six, hour)
    ones = _increase(_counter("1"), six, hour)
    quiet = _increase(_counter("CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"), six, hour)
    return {
        "counter_rate": f"SELECT source, {_AT}, round(value / {six}, 8) AS value FROM ({_increase(_RECEIVED, six, hour)})",
        "counter_increase": f"SELECT source, {_AT}, round(value, 8) AS value FROM ({_increase(_RECEIVED, six, hour)})",
        "ratio_of_rates": f"""SELECT a.source, make_timestamp(a.t) AS ts,
            round((a.value / {day}) / nullif(b.value / {day}, 0) * 100.0::DOUBLE, 8) AS value
            FROM ({_increase(errors, day, hour)}) a JOIN ({_increase(_RECEIVED, day, hour)}) b
            ON a.source = b.source AND a.t = b.t""",
        "mean_latency": f"""SELECT a.source, make_timestamp(a.t) AS ts,
            round((a.value / {six}) / nullif(b.value / {six}, 0), 8) AS value
            FROM ({latency}) a JOIN ({ones}) b ON a.source = b.source AND a.t = b.t""",
        "histogram_quantile": """WITH c AS (SELECT 's' || (user_id % 8) AS source, date_trunc('hour', ts) AS ts, le,
                count(*) AS n FROM ev, (SELECT unnest([5.0::DOUBLE, 10, 25, 50, 100, 200, 'Infinity'::DOUBLE]) AS le)
                WHERE value <= le GROUP BY ALL),
            b AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, lag(le) OVER w AS low,
                0.95::DOUBLE * max(n) OVER (PARTITION BY source, ts) AS rank FROM c
                WINDOW w AS (PARTITION BY source, ts ORDER BY le))
            SELECT source, ts, round(CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0)
                + (le - coalesce(low, 0)) * ((rank - below) / (n - below)) END, 8) AS value
            FROM b WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY source, ts ORDER BY le) = 1""",
        "quantile_of_rates": f"""WITH r AS (SELECT split_part(source, '/', 1) AS source, CAST(split_part(source, '/', 2) AS DOUBLE) AS le,
                t, value / {six} AS n FROM ({_increase(_BUCKETS, six, hour)})),
            c AS (SELECT source, t, le, max(n) OVER (PARTITION BY source, t ORDER BY le) AS n,
                max(n) OVER (PARTITION BY source, t) AS total, max(le) OVER (PARTITION BY source, t) AS top FROM r),
            b AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, lag(le) OVER w AS low, 0.95::DOUBLE * total AS rank
                FROM c WINDOW w AS (PARTITION BY source, t ORDER BY le))
            SELECT source, {_AT}, round(CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0)
                + (le - coalesce(low, 0)) * ((rank - below) / (n - below)) END, 6) AS value
            FROM b WHERE total > 0 AND isinf(top) AND n >= rank
            QUALIFY row_number() OVER (PARTITION BY source, t ORDER BY le) = 1""",
        "sum_by_labels": """SELECT kind, ts, sum(value) AS value FROM (SELECT source, kind,
                CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS ts,
                depth AS value, ts AS s_ts FROM gauges QUALIFY row_number() OVER (PARTITION BY source, kind,
                CASE WHEN date_trunc('hour', gauges.ts) = gauges.ts THEN gauges.ts
                    ELSE date_trunc('hour', gauges.ts) + INTERVAL 1 HOUR END ORDER BY gauges.ts DESC) = 1)
            GROUP BY ALL""",
        "label_match": """SELECT source, kind, count(*) AS samples, sum(depth) AS value FROM gauges
            WHERE source IN ('s0', 's1', 's2', 's3', 's4', 's5') AND kind NOT IN ('view', 'click') GROUP BY ALL""",
        "vector_match_ignoring": """SELECT ts, source, round(avail / 100000.0::DOUBLE * 100.0::DOUBLE, 4) AS value
            FROM gauges""",
        "utilisation": """SELECT source, g AS ts, round((1 - arg_max(avail, ts) / 100000.0::DOUBLE) * 100, 8) AS value
            FROM (SELECT *, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts)
                + INTERVAL 1 HOUR END AS g FROM gauges) GROUP BY source, g""",
        "cpu_utilisation": f"""SELECT {_AT}, round((1 - avg(value / {six})) * 100, 8) AS value
            FROM ({_increase(_counter("(100 - k)"), six, hour)}) GROUP BY t""",
        "sum_of_increases": f"""SELECT a.source, make_timestamp(a.t) AS ts, round(a.value + b.value, 8) AS value
            FROM ({_increase(errors, day, hour)}) a JOIN ({_increase(clicks, day, hour)}) b
            ON a.source = b.source AND a.t = b.t""",
        "uptime": f"""SELECT source, CAST(epoch(TIMESTAMP '{D.EVENTS_AS_OF}') AS BIGINT)
            - CAST(epoch(date_trunc('day', max(ts))) AS BIGINT) AS uptime_seconds FROM gauges GROUP BY ALL""",
        "target_down": "SELECT source, count(*) AS down_samples FROM gauges WHERE k = 13 GROUP BY ALL",
        "sustained_alert": "SELECT * FROM alerts",
        "alert_status": """SELECT 'queue deep' AS alert, CASE WHEN count(*) FILTER (WHERE fired) > 0 THEN 'firing'
            ELSE 'not firing' END AS status, count(*) FILTER (WHERE fired) AS episodes_fired FROM alerts
            UNION ALL SELECT 'queue of nobody', 'no series', 0""",
        "no_data": f"""SELECT source, min(ts) AS since, max(ts) AS until,
            date_diff('hour', min(ts), max(ts)) >= 1 AS fired, 'critical' AS severity
            FROM (SELECT source, ts, ts - to_hours(row_number() OVER (PARTITION BY source ORDER BY ts)) AS run
                FROM (SELECT source, {_AT} FROM ({quiet}) WHERE value = 0)) GROUP BY source, run""",
        "gauge_latest": "SELECT source, max(ts) AS ts, arg_max(depth, ts) AS value FROM gauges GROUP BY ALL",
        "threshold_band": """SELECT *, CASE WHEN value >= 80 THEN 'red' WHEN value >= 40 THEN 'yellow' ELSE 'green' END
            AS band FROM (SELECT source, max(ts) AS ts, arg_max(depth, ts) AS value FROM gauges GROUP BY ALL)""",
        "gauge_series": """SELECT ts AS time, source, depth AS value FROM gauges
            WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""",
    }


def _querylog() -> dict[str, str]:
    minute = "date_trunc('minute', event_time) AS time"
    avg = "round_even(avg(duration_ms), 0)"
    shape = 'query_shape, "user", min(query) AS sample_query'

    def top(select: str, part: str, order: str, limit: int = 10, having: str = "") -> str:
        return f"SELECT {select} FROM {part} GROUP BY query_shape, \"user\" {having} ORDER BY {order}, \"user\", query_shape LIMIT {limit}"

    result = {
        "ql_totals": f"""SELECT {_count("type = 'QueryFinish'")} AS finished,
            {_count("type = 'ExceptionWhileProcessing'")} AS failed,
            round_even(avg(duration_ms) FILTER (WHERE type = 'QueryFinish'), 0) AS avg_ms FROM q_scope""",
        "ql_volume_per_minute": f"""SELECT {minute}, {_count("type = 'QueryFinish'")} AS successful,
            {_count("type = 'ExceptionWhileProcessing'")} AS failed FROM q_scope GROUP BY ALL""",
        "ql_latency_percentiles": f"""SELECT {minute},
            round_even(round(quantile_cont(duration_ms, 0.5), 6), 0) AS p50_ms,
            round_even(round(quantile_cont(duration_ms, 0.95), 6), 0) AS p95_ms,
            round_even(round(quantile_cont(duration_ms, 0.99), 6), 0) AS p99_ms FROM q_done GROUP BY ALL""",
        "ql_slowest_shapes": top(
            f"""{shape}, count(*) AS executions, {avg} AS avg_ms, max(duration_ms) AS max_ms,
            round_even(round(quantile_cont(duration_ms, 0.95), 6), 0) AS p95_ms, {_size('max(memory)')} AS peak_mem""",
            "q_done", f"{avg} DESC"),
        "ql_merged_percentiles": f"""SELECT {minute}, count(*) AS n, true AS p50_ms_close, true AS p95_ms_close,
            true AS p99_ms_close FROM q_done GROUP BY ALL""",
        "ql_merged_slowest_shapes": top(
            f"""{shape}, count(*) AS executions, {avg} AS avg_ms, max(duration_ms) AS max_ms,
            {_size('max(memory)')} AS peak_mem, true AS p95_ms_close""", "q_done", f"{avg} DESC"),
        "ql_by_hash": f"""SELECT query_shape, CAST(1 AS BIGINT) AS shapes, count(*) AS executions,
            {_total('duration_ms')} AS total_ms FROM q_done GROUP BY query_shape""",
        "ql_memory_shapes": top(
            f"""{shape}, count(*) AS executions, {_size('sum(memory)')} AS total_mem,
            {_size('max(memory)')} AS peak_mem, {avg} AS avg_ms""", "q_done", "sum(memory) DESC"),
        "ql_read_volume_shapes": top(
            f"""{shape}, count(*) AS executions, {_size('sum(read_bytes)')} AS total_read_bytes,
            {_total('read_rows')} AS total_read_rows, {avg} AS avg_ms""", "q_done", "sum(read_bytes) DESC"),
        "ql_recent_errors": """SELECT event_time, "user", query, exception FROM q_failed
            ORDER BY event_time DESC, "user", query LIMIT 20""",
        "ql_by_user": f"""SELECT "user", count(*) AS queries, {avg} AS avg_ms, {_size('sum(memory)')} AS total_mem
            FROM q_done GROUP BY "user" """,
        "ql_error_breakdown": """SELECT exception_code, min(exception) AS message, count(*) AS occurrences FROM q_failed
            GROUP BY exception_code ORDER BY occurrences DESC, exception_code LIMIT 15""",
        "ql_over_memory": top(
            f"{shape}, count(*) AS hits, {_size('max(memory)')} AS max_mem, {avg} AS avg_ms",
            "(SELECT * FROM q_scope WHERE memory > 500000000)", "max(memory) DESC"),
        "ql_cache_candidates": top(
            f"{shape}, count(*) AS executions, {avg} AS avg_ms, {_size('sum(memory)')} AS total_mem",
            "q_done", "count(*) DESC", having="HAVING count(*) > 5"),
        "stmt_totals": f"""SELECT count(*) AS statements, {_total('calls')} AS calls,
            round_even(max(mean_exec_time), 2) AS slowest_mean_ms,
            round_even(CAST(sum(blks_hit) AS DOUBLE) / nullif(CAST(sum(blks_hit) + sum(blks_read) AS DOUBLE), 0) * 100, 2)
                AS cache_hit_pct FROM stmts""",
    }
    for order in ("mean_exec_time", "total_exec_time", "calls", "rows"):
        result[f"stmt_top10_by_{order}"] = f"""SELECT query, calls, round_even(mean_exec_time, 2) AS avg_ms,
            round_even(min_exec_time, 2) AS min_ms, round_even(max_exec_time, 2) AS max_ms,
            round_even(total_exec_time, 2) AS total_ms, rows FROM stmts ORDER BY {order} DESC, query LIMIT 10"""
    return result


def _kpis() -> dict[str, str]:
    return {
        "flagship_event_kpis": "SELECT * FROM k_event",
        "mv_daily_compliance_kpis": "SELECT * FROM k_compliance",
        "mv_daily_deviation_kpis": "SELECT * FROM k_deviation",
        "mv_daily_event_kpis": "SELECT * FROM k_event",
        "mv_daily_adoption_kpis": "SELECT * FROM k_adoption",
        "mv_daily_referral_kpis": "SELECT * FROM k_referral",
        "event_kpis_from_state": "SELECT * FROM k_event",
        "adoption_kpis_from_state": "SELECT * FROM k_adoption",
        "referral_kpis_from_state": "SELECT * FROM k_referral",
        "compliance_kpis_from_states": "SELECT * FROM k_compliance",
        "backfill_daily_compliance": "SELECT * FROM k_backfill",
    }


def _needed(sql: str, found: list[str]) -> list[str]:
    """Named subqueries ``sql`` mentions, each after those it mentions itself."""
    for name in _PARTS:
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            _needed(_PARTS[name], found)
            if name not in found:
                found.append(name)
    return found


def complete(sql: str) -> str:
    parts = _needed(sql, [])
    if not parts:
        return sql
    named = ",\n".join(f"{name} AS ({_PARTS[name]})" for name in parts)
    return f"WITH {named}\nSELECT * FROM ({sql}) AS result"


def oracle_sql() -> dict[str, str]:
    all_queries = {
        **_decoders(),
        **_marts(),
        **_kpis(),
        **_state_queries(),
        **_reports(),
        **_dimensions(),
        **_metrics(),
        **_querylog(),
    }
    return {name: complete(sql) for name, sql in all_queries.items()}
