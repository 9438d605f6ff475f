"""The 14 change tables, metric samples and query log, derived from the given
Parquet tables by plain arithmetic, so that a second engine can derive the same.

Business attributes (an event's ``k``, an order's priority, a line's tax) decide
statuses, deletes and losses. Every row of a given table is read; which of them give
rows of a change table is a rule of that table (returned lines are deviations, error
events are intelligence).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcmart.functions.columns import query_shape
from cdcmart.functions.derive import derive
from cdcmart.operators.changelog import running_total
from cdcmart.sources.envelope import encode_envelope
from cdcmart.sources.readers import files_below
from cdcmart.sources.schemas import TABLES

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-12-01 00:00:00"
REFERENCE_TIME = "TIMESTAMP '2024-01-01 00:00:00'"

# Identifier spaces, one per table.
EVENT, OUTCOME, DEFINITION, ENROLMENT, STEP = 1, 2, 3, 4, 5
ACTION, TRIGGER, DELIVERY, RECEIVER, MAPPING, FACILITY, SECOND_OUTCOME = 7, 8, 9, 10, 11, 12, 13


def _id(space: int, number: str) -> str:
    return f"concat('{space:08d}-0000-4000-8000-', lpad(cast({number} AS string), 12, '0'))"


def _md5_id(text: str) -> str:
    digest = f"md5({text})"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "concat_ws('-', " + ", ".join(f"substr({digest}, {a}, {n})" for a, n in cuts) + ")"


def _md5_long(text: str) -> str:
    return f"cast(conv(substr(md5({text}), 1, 15), 16, 10) AS bigint)"


class DriverTables(Mapping[str, DataFrame]):
    """Change tables by name, each a lazy DataFrame over one given table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return self._once(f"table {name}", lambda: derive(self.plain(name), name))

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def plain(self, name: str) -> DataFrame:
        """Change rows of a table without derived columns."""
        spec = TABLES[name]
        return self._once(
            f"plain {name}",
            lambda: getattr(self, f"_{name}")().select(*spec.columns, "_version", "_is_deleted"),
        )

    def _once(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """One logical plan per table, so that its exchanges can be reused."""
        if key not in self._read:
            self._read[key] = build()
        return self._read[key]

    def wire(self, name: str) -> DataFrame:
        """The same rows as envelope messages."""
        return encode_envelope(self.plain(name), name)

    def given(self, name: str) -> DataFrame:
        return self._once(
            f"given {name}",
            lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"),
        )

    def arriving(self, folder: str) -> DriverTables:
        """The same tables as streams, of which a batch reads some files of a given table.

        A table given in fewer files is cut into some below ``folder`` first, so that it arrives in several batches;
        how large a batch is follows from the table, not from the number of its files.
        """
        return _Arriving(self.spark, self.sf_dir, folder)

    # -- given tables with the attributes the rules below use ------------------

    def events(self) -> DataFrame:
        return self.given("events").selectExpr(
            "event_id",
            "cast(ts AS timestamp) AS ts",
            "user_id",
            "event_type",
            "value",
            "cast(get_json_object(props, '$.k') AS int) AS k",
        )

    def orders(self) -> DataFrame:
        return self.given("orders").selectExpr(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "cast(o_orderdate AS timestamp) AS ts"
        )

    def lines(self) -> DataFrame:
        return self.given("lineitem").selectExpr(
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_tax",
            "l_returnflag",
            "concat(l_returnflag, l_linestatus) AS code",
            "cast(l_shipdate AS timestamp) AS ts",
            "l_orderkey * 10 + l_linenumber AS step_no",
            "concat_ws('|', l_orderkey, l_linenumber, cast(l_shipdate AS date), l_partkey, l_suppkey) AS line_text",
            "datediff(l_shipdate, DATE '1990-01-01') * 1000000000000L"
            " + (l_partkey % 1000000) * 1000000 + l_suppkey % 1000000 AS line_version",
        )

    # -- change tables ----------------------------------------------------------

    def _inbound_event_logs(self) -> DataFrame:
        facility = "concat('F', cast(user_id % 25 AS string))"
        payload = f"""concat(
            '{{"subject":"P', cast(user_id AS string), '","type":"', event_type, '","facilityid":"',
            CASE WHEN event_type = 'view' THEN {facility} ELSE '' END,
            '","data":{{"resourceType":"', CASE WHEN event_type = 'view' THEN 'Encounter' ELSE 'Observation' END,
            '","extension":[', CASE
                WHEN event_type IN ('click', 'purchase') THEN concat(
                    '{{"url":"http://x/other","valueString":"zz"}},{{"url":"http://x/source-facility","valueString":"',
                    {facility}, '"}}')
                WHEN event_type = 'error' THEN '{{"url":"http://x/other","valueString":"zz"}}'
                ELSE '' END, ']',
            CASE
                WHEN k < 20 THEN ''
                WHEN k >= 90 THEN ',"type":[{{"coding":[{{"display":"OTHER"}}]}},{{"coding":[{{"display":"X"}},{{"display":"TRANSFER_ENCOUNTER"}}]}}]'
                ELSE ',"type":[{{"coding":[{{"display":"OTHER"}}]}}]' END,
            ',"practitionerRef":"', CASE WHEN k < 60 THEN concat('D', cast(user_id % 12 AS string)) ELSE '' END,
            '","practitionerDisplay":"Dr ', cast(user_id % 12 AS string), '"}}}}')"""
        terminal = "CASE WHEN k < 5 THEN 'REJECTED' WHEN k < 9 THEN 'DUPLICATE' ELSE 'ACCEPTED' END"
        versions = self.events().withColumn(
            "n", F.explode(F.expr("CASE WHEN k = 97 THEN array(1, 2, 3) ELSE array(1, 2) END"))
        )
        return versions.selectExpr(
            f"{_id(EVENT, 'event_id')} AS id",
            "concat('ce-', cast(event_id AS string)) AS cloudevents_id",
            "concat('src-', cast(user_id % 4 AS string)) AS source",
            "concat('corr-', cast(event_id AS string)) AS correlation_id",
            f"{payload} AS raw_payload",
            f"CASE WHEN n = 1 THEN 'RECEIVED' ELSE {terminal} END AS status",
            "CASE WHEN n > 1 AND k < 3 THEN 'schema' WHEN n > 1 AND k < 5 THEN 'auth' ELSE '' END"
            " AS rejection_reason",
            "'' AS error_details",
            "timestampadd(SECOND, k, ts) AS received_at",
            "timestampadd(SECOND, k + n, ts) AS updated_at",
            "CASE WHEN k <> 50 THEN ts END AS event_time",
            "event_id * 4 + n AS _version",
            "n = 3 AS _is_deleted",
        )

    def _compliance_event_logs(self) -> DataFrame:
        # Events with k in 20..29 never reached processing: they are the loss.
        logged = self.events().where("k NOT BETWEEN 20 AND 29")
        outcomes = logged.withColumn("n", F.explode(F.expr("CASE WHEN k = 42 THEN array(1, 2) ELSE array(1) END")))
        return outcomes.selectExpr(
            f"CASE WHEN n = 1 THEN {_id(OUTCOME, 'event_id')} ELSE {_id(SECOND_OUTCOME, 'event_id')} END AS id",
            "concat('ce-', cast(event_id AS string)) AS cloudevents_id",
            "concat('src-', cast(user_id % 4 AS string)) AS source",
            "concat('corr-', cast(event_id AS string)) AS correlation_id",
            "CASE WHEN n = 2 OR k >= 90 THEN 'DUPLICATE' WHEN k < 70 THEN 'MATCHED' ELSE 'ZERO_MATCH' END"
            " AS processing_status",
            "'{}' AS data",
            "timestampadd(SECOND, k + 60 * n, ts) AS received_at",
            "timestampadd(SECOND, k + 60 * n, ts) AS updated_at",
            "event_id * 2 + n AS _version",
            "false AS _is_deleted",
        )

    def _protocol_definitions(self) -> DataFrame:
        key = "cast(p_partkey AS string)"
        return self.given("part").selectExpr(
            f"{_id(DEFINITION, 'p_partkey')} AS id",
            f"concat('http://protocols.test/', {key}) AS url",
            "concat(cast(p_size % 3 AS string), '.0') AS version",
            "CASE WHEN p_type = 'ECONOMY' THEN 'RETIRED' ELSE 'ACTIVE' END AS status",
            "CASE WHEN p_size < 25 THEN concat('{\"title\":\"', p_name, '\",\"name\":\"n\"}')"
            " ELSE concat('{\"name\":\"', p_brand, '\"}') END AS definition",
            f"{REFERENCE_TIME} AS loaded_at",
            f"{REFERENCE_TIME} AS updated_at",
            "p_partkey + 1 AS _version",
            "false AS _is_deleted",
        )

    def _protocol_instances(self) -> DataFrame:
        # Withdrawn low-priority orders are deleted later on.
        versions = self.orders().withColumn(
            "n",
            F.explode(
                F.expr(
                    "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW'"
                    " THEN array(1, 2, 3) ELSE array(1, 2) END"
                )
            ),
        )
        final = """CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'COMPLETED'
            ELSE CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'EXPIRED' ELSE 'WITHDRAWN' END END"""
        return versions.selectExpr(
            f"{_id(ENROLMENT, 'o_orderkey')} AS id",
            "concat('P', cast(o_custkey AS string)) AS patient_id",
            "concat('http://protocols.test/', cast(o_custkey % 40 AS string), '|1.0') AS protocol_canonical",
            f"{_id(DEFINITION, 'o_custkey % 40')} AS protocol_definition_id",
            f"CASE WHEN n = 1 THEN 'ACTIVE' ELSE {final} END AS status",
            "ts AS enrolled_at",
            "ts AS created_at",
            "timestampadd(DAY, n, ts) AS updated_at",
            "o_orderkey * 4 + n AS _version",
            "n = 3 AS _is_deleted",
        )

    _STATE = """CASE code WHEN 'NO' THEN 'PENDING' WHEN 'NF' THEN 'COMPLETED' WHEN 'RO' THEN 'DUE'
        WHEN 'RF' THEN 'OVERDUE' WHEN 'AF' THEN 'SKIPPED' ELSE 'MISSED' END"""
    _COMPLETION = """CASE WHEN code <> 'NF' THEN '' WHEN l_suppkey % 3 = 0 THEN 'EARLY'
        WHEN l_suppkey % 3 = 1 THEN 'ON_TIME' ELSE 'LATE' END"""

    def _step_instances(self) -> DataFrame:
        # Lines that share order and line number are versions of one step.
        action = """CASE l_linenumber WHEN 7 THEN 'anc-referral' WHEN 6 THEN 'referral' WHEN 5 THEN '-referral'
            WHEN 4 THEN 'referral-x' ELSE concat('visit-', cast(l_linenumber AS string)) END"""
        return self.lines().selectExpr(
            f"{_id(STEP, 'step_no')} AS id",
            f"{_id(ENROLMENT, 'l_orderkey')} AS protocol_instance_id",
            f"{action} AS action_id",
            "cast(l_suppkey % 5 AS int) AS repeat_index",
            f"{self._STATE} AS state",
            "CASE WHEN l_suppkey % 10 <> 0 THEN ts END AS due_date",
            "CASE WHEN l_partkey % 4 <> 0 THEN timestampadd(DAY, l_suppkey % 10, ts) END AS overdue_date",
            "CASE WHEN l_partkey % 3 <> 0 THEN timestampadd(DAY, 20, ts) END AS missed_date",
            "CASE WHEN code = 'NF' THEN timestampadd(DAY, 1, ts) END AS completed_at",
            "CASE WHEN code = 'NF' THEN 'src-0' ELSE '' END AS completed_by_source",
            f"{self._COMPLETION} AS completion_status",
            f"CASE WHEN code = 'NF' THEN {_id(OUTCOME, 'l_orderkey')} END AS completed_by_event_id",
            "CASE WHEN l_linenumber < 4 THEN 'must' ELSE 'could' END AS required_behavior",
            "ts AS created_at",
            "ts AS updated_at",
            "line_version AS _version",
            "l_tax > 0.075 AND l_returnflag = 'A' AS _is_deleted",
        )

    def _deviations(self) -> DataFrame:
        kind = "CASE l_linenumber % 3 WHEN 0 THEN 'OVERDUE' WHEN 1 THEN 'MISSED' ELSE 'ORDER_VIOLATION' END"
        found = self.lines().where("l_returnflag = 'R'")
        versions = found.withColumn(
            "n", F.explode(F.expr("CASE WHEN l_tax > 0.075 THEN array(1, 2) ELSE array(1) END"))
        )
        return versions.selectExpr(
            f"{_md5_id('line_text')} AS id",
            f"{_id(ENROLMENT, 'l_orderkey')} AS protocol_instance_id",
            f"{_id(STEP, 'step_no')} AS step_instance_id",
            f"{kind} AS deviation_type",
            "timestampadd(DAY, 3, ts) AS detected_at",
            f"CASE WHEN l_suppkey % 2 = 0 THEN {_id(TRIGGER, 'l_orderkey')} END AS intelligence_event_id",
            "'{}' AS metadata",
            "timestampadd(DAY, 3, ts) AS updated_at",
            "line_version * 2 + n AS _version",
            "n = 2 AS _is_deleted",
        )

    def _protocol_instance_history(self) -> DataFrame:
        # High-priority rows were delivered twice.
        final = """CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'COMPLETED'
            ELSE CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'EXPIRED' ELSE 'WITHDRAWN' END END"""
        rows = self.orders().withColumn(
            "n", F.explode(F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN array(1, 2, 2) ELSE array(1, 2) END"))
        )
        return rows.selectExpr(
            "o_orderkey * 2 + n AS id",
            f"{_id(ENROLMENT, 'o_orderkey')} AS protocol_instance_id",
            f"CASE WHEN n = 1 THEN 'ACTIVE' ELSE {final} END AS status",
            "CASE WHEN n = 1 THEN ts ELSE timestampadd(DAY, o_orderkey % 30 + 1, ts) END AS changed_at",
            "o_orderkey * 2 + n AS _version",
            "false AS _is_deleted",
        )

    def _step_instance_history(self) -> DataFrame:
        rows = self.lines().withColumn("n", F.explode(F.expr("array(1, 2)")))
        number = _md5_long("concat(line_text, '#', cast(n AS string))")
        return rows.selectExpr(
            f"{number} AS id",
            f"{_id(STEP, 'step_no')} AS step_instance_id",
            f"CASE WHEN n = 1 THEN 'PENDING' ELSE {self._STATE} END AS state",
            f"CASE WHEN n = 1 THEN '' ELSE {self._COMPLETION} END AS completion_status",
            "CASE WHEN n = 1 THEN timestampadd(DAY, -5, ts) ELSE ts END AS changed_at",
            "line_version * 2 + n AS _version",
            "false AS _is_deleted",
        )

    def _action_definitions(self) -> DataFrame:
        key = "cast(p_partkey AS string)"
        return self.given("part").selectExpr(
            f"{_id(ACTION, 'p_partkey')} AS id",
            f"concat('http://actions.test/', {key}) AS canonical_url",
            "'1.0' AS version",
            f"concat('action-', {key}) AS name",
            "p_name AS title",
            "CASE WHEN p_size > 40 THEN 'RETIRED' ELSE 'ACTIVE' END AS status",
            "CASE p_partkey % 3 WHEN 0 THEN 'CommunicationRequest' WHEN 1 THEN 'Task' ELSE 'ServiceRequest' END"
            " AS action_type",
            "'{}' AS definition",
            f"{REFERENCE_TIME} AS created_at",
            f"{REFERENCE_TIME} AS updated_at",
            "p_partkey + 1 AS _version",
            "p_size = 50 AS _is_deleted",
        )

    def _errors(self) -> DataFrame:
        return self.events().where("event_type = 'error'")

    _ACTION_TYPE = """CASE user_id % 3 WHEN 0 THEN 'CommunicationRequest' WHEN 1 THEN 'Task'
        ELSE 'ServiceRequest' END"""

    def _intelligence_event_logs(self) -> DataFrame:
        versions = self._errors().withColumn(
            "n", F.explode(F.expr("CASE WHEN k < 50 THEN array(1, 2) ELSE array(1) END"))
        )
        return versions.selectExpr(
            f"{_id(TRIGGER, 'event_id')} AS id",
            f"{_id(ACTION, 'user_id')} AS action_definition_id",
            f"{_id(ENROLMENT, 'user_id')} AS protocol_instance_id",
            f"CASE WHEN k % 2 = 0 THEN {_id(STEP, 'user_id * 10 + 1')} END AS step_instance_id",
            "cast(NULL AS string) AS deviation_id",
            "concat('P', cast(user_id AS string)) AS subject",
            f"{self._ACTION_TYPE} AS action_type",
            "concat('dest-', cast(user_id % 4 AS string)) AS intelligence_destination",
            "CASE k % 3 WHEN 0 THEN 'OVERDUE' WHEN 1 THEN 'MISSED' ELSE 'COMPLETED' END AS step_state",
            "CASE k % 3 WHEN 0 THEN 'overdue' WHEN 1 THEN 'missed' ELSE 'completion' END AS trigger_reason",
            "concat('act-', cast(k % 5 AS string)) AS step_action_id",
            "'true' AS evaluation_expression",
            "'{}' AS evaluation_context",
            "n = 2 AS published",
            "CASE WHEN n = 2 THEN timestampadd(SECOND, 1, ts) END AS published_at",
            "ts AS created_at",
            "event_id * 2 + n AS _version",
            "false AS _is_deleted",
        )

    def _intelligence_deliveries(self) -> DataFrame:
        versions = self._errors().withColumn(
            "n", F.explode(F.expr("CASE WHEN k = 99 THEN array(1, 2, 3) ELSE array(1, 2) END"))
        )
        status = "CASE WHEN n = 1 THEN 'PENDING' WHEN k < 10 THEN 'FAILED' WHEN k < 15 THEN 'CANCELLED' ELSE 'DELIVERED' END"
        return versions.selectExpr(
            f"{_id(DELIVERY, 'event_id')} AS id",
            f"{_id(TRIGGER, 'event_id')} AS intelligence_event_id",
            f"{_id(ACTION, 'user_id')} AS action_definition_id",
            f"CASE WHEN k >= 5 THEN {_id(MAPPING, 'user_id')} END AS destination_adaptor_mapping_id",
            f"{self._ACTION_TYPE} AS action_type",
            f"{status} AS status",
            "concat('P', cast(user_id AS string)) AS subject",
            "concat('http://protocols.test/', cast(user_id % 40 AS string), '|1.0') AS protocol_canonical",
            "concat('act-', cast(k % 5 AS string)) AS action_id",
            "CASE WHEN k > 80 THEN 'CRITICAL' WHEN k > 50 THEN 'HIGH' ELSE 'LOW' END AS severity",
            "concat('dest-', cast(user_id % 4 AS string)) AS destination",
            "CASE WHEN n = 1 THEN '{}' WHEN k < 10 THEN '{\"httpStatus\":500,\"responseBody\":\"failed\"}'"
            " WHEN k < 15 THEN '{\"httpStatus\":0}' ELSE '{\"httpStatus\":200,\"responseBody\":\"ok\"}' END"
            " AS delivery_result",
            "CASE WHEN n = 1 THEN 0 ELSE k % 4 + 1 END AS attempt_count",
            "ts AS created_at",
            "timestampadd(SECOND, n, ts) AS updated_at",
            "CASE WHEN n > 1 AND k >= 15 THEN timestampadd(MILLISECOND, cast(event_id % 5000 AS int), ts) END"
            " AS delivered_at",
            "event_id * 4 + n AS _version",
            "n = 3 AS _is_deleted",
        )

    def _receiver_adaptor(self) -> DataFrame:
        return self.given("supplier").selectExpr(
            f"{_id(RECEIVER, 's_suppkey')} AS id",
            "s_name AS name",
            "concat('{\"address\":\"http://receivers.test/', cast(s_suppkey AS string), '\"}') AS definition",
            "CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status",
            "'{}' AS config",
            f"{REFERENCE_TIME} AS created_at",
            f"{REFERENCE_TIME} AS updated_at",
            "s_suppkey + 1 AS _version",
            "s_nationkey = 24 AS _is_deleted",
        )

    def _destination_adaptor_mapping(self) -> DataFrame:
        return self.given("customer").selectExpr(
            f"{_id(MAPPING, 'c_custkey')} AS id",
            "concat('dest-', cast(c_custkey % 4 AS string)) AS destination",
            f"{_id(RECEIVER, 'c_custkey % 100')} AS receiver_adaptor_id",
            "CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status",
            f"{REFERENCE_TIME} AS created_at",
            f"{REFERENCE_TIME} AS updated_at",
            "c_custkey + 1 AS _version",
            "c_nationkey = 24 AS _is_deleted",
        )

    def _facility(self) -> DataFrame:
        return self.given("supplier").selectExpr(
            f"{_id(FACILITY, 's_suppkey')} AS id",
            "concat('F', cast(s_suppkey AS string)) AS facility_id",
            "s_name AS facility_name",
            "cast(s_suppkey % 5 * 3 AS bigint) AS expected_patients_per_day",
            "concat('district-', cast(s_nationkey AS string)) AS district_name",
            f"{REFERENCE_TIME} AS created_at",
            f"{REFERENCE_TIME} AS updated_at",
            "s_suppkey + 1 AS _version",
            "s_nationkey = 3 AS _is_deleted",
        )

    # -- metric samples and query log -------------------------------------------

    def counter_samples(self, metric: str, per: tuple[str, ...], amount: str) -> DataFrame:
        """A counter per ``per`` label that starts over every day."""
        labelled = self.events().selectExpr(
            "event_id",
            "ts",
            "concat('s', cast(user_id % 8 AS string)) AS source",
            "event_type AS type",
            "to_date(ts) AS day",
            f"cast({amount} AS double) AS amount",
        )
        running = running_total(
            labelled, [*per, "day"], ["ts", "event_id"], F.hour("ts"), {"value": F.col("amount")}
        )
        pairs = [x for label in per for x in (F.lit(label), F.col(label))]
        return running.select("ts", F.lit(metric).alias("metric"), F.create_map(*pairs).alias("labels"), "value")

    def gauge_samples(self) -> DataFrame:
        """Gauges of each source, one sample each per event."""
        source = "map('source', concat('s', cast(user_id % 8 AS string)), 'kind', event_type)"
        gauges = """explode(map(
            'queue_depth', cast(k AS double),
            'memory_avail_bytes', (100 - k) * 1000.0D,
            'memory_total_bytes', 100000.0D,
            'up', CASE WHEN k = 13 THEN 0.0D ELSE 1.0D END,
            'boot_time_seconds', cast(unix_seconds(date_trunc('DAY', ts)) AS double))) AS (metric, value)"""
        return self.events().selectExpr("ts", f"{source} AS labels", gauges).select(
            "ts", "metric", "labels", "value"
        )

    def latency_buckets(self) -> DataFrame:
        """Cumulative latency buckets per source and hour."""
        bounds = "array(5.0D, 10.0D, 25.0D, 50.0D, 100.0D, 200.0D, double('Infinity'))"
        return (
            self.events()
            .selectExpr(
                "concat('s', cast(user_id % 8 AS string)) AS source",
                "date_trunc('HOUR', ts) AS ts",
                "value",
                f"explode(filter({bounds}, b -> value <= b)) AS le",
            )
            .groupBy("source", "ts", "le")
            .agg(F.count(F.lit(1)).cast("double").alias("value"))
        )

    def bucket_samples(self) -> DataFrame:
        """Counters of the cumulative latency buckets of a source; they start over every day, and a bucket appears with its first observation."""
        bounds = "array('5.0', '10.0', '25.0', '50.0', '100.0', '200.0', '+Inf')"
        labelled = self.events().selectExpr(
            "event_id", "ts", "concat('s', cast(user_id % 8 AS string)) AS source", "to_date(ts) AS day", "value", f"explode({bounds}) AS le"
        )
        inside = F.when(F.col("value") <= F.col("le").cast("double"), 1.0).otherwise(0.0)
        running = running_total(labelled, ["source", "le", "day"], ["ts", "event_id"], F.hour("ts"), {"value": inside})
        labels = F.create_map(F.lit("source"), "source", F.lit("le"), "le")
        return running.where("value > 0").select("ts", F.lit("latency_bucket").alias("metric"), labels.alias("labels"), "value")

    def query_log(self) -> DataFrame:
        return self.events().selectExpr(
            "ts AS event_time",
            "CASE WHEN event_type = 'error' THEN 'ExceptionWhileProcessing' ELSE 'QueryFinish' END AS type",
            "concat('u', cast(user_id % 20 AS string)) AS user",
            "concat('SELECT * FROM ', CASE WHEN k = 77 THEN 'system.parts' ELSE concat(event_type, '_log_', cast(user_id % 8 AS string)) END,"
            " ' WHERE id = ', cast(event_id AS string), ' AND tag = ''k', cast(k AS string), '''') AS query",
            "cast(floor(value * 100) AS bigint) AS duration_ms",
            "cast(k AS bigint) * 10000000 AS memory",
            "cast(floor(value * 1000) AS bigint) AS read_rows",
            "cast(floor(value * 1000) AS bigint) * 8 AS read_bytes",
            "CASE WHEN event_type = 'error' THEN k % 30 ELSE 0 END AS exception_code",
            "CASE WHEN event_type = 'error' THEN concat('Code: ', cast(k % 30 AS string)) ELSE '' END AS exception",
        )

    def statements(self) -> DataFrame:
        """Statement statistics of the source database, from the query log."""
        return (
            self.query_log()
            .groupBy(query_shape(F.col("query")).alias("query"))
            .agg(
                F.count(F.lit(1)).alias("calls"),
                F.sum("duration_ms").cast("double").alias("total_exec_time"),
                F.avg("duration_ms").alias("mean_exec_time"),
                F.min("duration_ms").cast("double").alias("min_exec_time"),
                F.max("duration_ms").cast("double").alias("max_exec_time"),
                F.sum("read_rows").alias("rows"),
                F.sum("read_bytes").alias("blks_hit"),
                F.sum("memory").alias("blks_read"),
            )
        )


class _Arriving(DriverTables):
    #: A table is read in so many batches at most.
    BATCHES = 8
    #: Bytes of a batch for each core, unless these would be more than half of the table.
    CORE_BYTES = 16 << 20
    #: A table of fewer files than this is cut into files of so many rows at most, two for each core.
    FILES, ROWS = 4, 4_000_000

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str):
        super().__init__(spark, sf_dir)
        self.folder = folder

    def given(self, name: str) -> DataFrame:
        return self._once(f"given {name}", lambda: self._stream(name))

    def _stream(self, name: str) -> DataFrame:
        path, cores = f"{self.sf_dir}/{name}.parquet", self.spark.sparkContext.defaultParallelism
        whole = self.spark.read.parquet(path)
        if len(whole.inputFiles()) < self.FILES:
            path = f"{self.folder}/{name}"
            rows = min(self.ROWS, max(1, -(-whole.count() // (2 * cores))))
            whole.write.option("maxRecordsPerFile", rows).parquet(path)
        files, size = files_below(self.spark, path)
        per_batch = max(-(-files // self.BATCHES), min(-(-cores * self.CORE_BYTES * files // max(size, 1)), files // 2), 1)
        return self.spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", per_batch).parquet(path)
