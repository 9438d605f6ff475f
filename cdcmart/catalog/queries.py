"""Every registered query: (spark, folder of the given tables) -> DataFrame."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Mapping
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcmart.catalog.driver_tables import ENROLMENT, EVENT, EVENTS_AS_OF, ORDERS_AS_OF, DriverTables, _id
from cdcmart.fixed_values import UNAVAILABLE_VALUE
from cdcmart.functions.columns import as_timestamp, millis_between, query_shape, readable_quantity
from cdcmart.functions.derive import with_read_aliases
from cdcmart.operators import asof, changelog, metrics, quantiles
from cdcmart.operators.lookup import lookup
from cdcmart.plans import backfill, dimensions, kpis, marts, quality, querylog, reports, rollups
from cdcmart.session import configure, shared_folder
from cdcmart.sources import readers
from cdcmart.sources.envelope import dead_letters, decode_envelope, parse_envelope
from cdcmart.sources.schemas import TABLES
from cdcmart.streaming import ingest, maintain, sinks, state

Query = Callable[[SparkSession, str], DataFrame]

EVENT_DAY = "2024-01-15"
#: Added to the numbers of enrolments that only the snapshot has.
SNAPSHOT_ONLY = 10_000_000_000
EVENT_RANGE = ("2024-01-05", "2024-01-20")
BACKFILL_RANGE = ("1998-01-01", "1998-02-28")
ASOF_RANGE = ("1998-01-01", "1998-01-10")
PROTOCOL = "00000003-0000-4000-8000-000000000007"
HOUR = 3600
SIX_HOURS = 6 * HOUR
# Moments inside the event data at which the short look-backs have rows.
BUSY_MOMENT = "2024-01-15 12:00:00"

_REGISTRY: dict[str, Callable[[DriverTables], DataFrame]] = {}


def register(name: str):
    def add(build: Callable[[DriverTables], DataFrame]):
        _REGISTRY[name] = build
        return build

    return add


def _presentable(df: DataFrame) -> DataFrame:
    """Timestamps as zone-less UTC wall-clock times."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name
            for f in df.schema.fields
        ]
    )


def _stored_columns_only(t: DriverTables) -> Mapping[str, DataFrame]:
    """The tables for queries that read no derived column of the inbound log."""
    return ChainMap({"inbound_event_logs": t.plain("inbound_event_logs")}, t)


def _query(build: Callable[[DriverTables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return _presentable(build(DriverTables(spark, sf_dir)))

    return run


def queries() -> dict[str, Query]:
    return {name: _query(build) for name, build in _REGISTRY.items()}


# -- decoding ---------------------------------------------------------------------


def _register_decoders() -> None:
    for table in TABLES:
        register(f"cdc_{table}")(lambda t, table=table: decode_envelope(t.wire(table), table))


_register_decoders()


def _odd_messages(t: DriverTables) -> DataFrame:
    """One message per event, with the oddities a stream can carry."""
    id_text = _id(EVENT, "event_id")
    return t.events().selectExpr(
        "k",
        f"""CASE
        WHEN k = 1 THEN '{{"op":"t"}}'
        WHEN k = 2 THEN '{{"op":"c","after":'
        WHEN k = 3 THEN concat('{{"op":"u","after":{{"id":"not-a-uuid","status":"x"}},"source":{{"lsn":', event_id, '}}}}')
        WHEN k = 4 THEN concat('{{"op":"m","after":null,"source":{{"lsn":', event_id, '}}}}')
        WHEN k = 5 THEN concat('{{"op":"c","before":null,"after":null,"source":{{"lsn":', event_id, '}}}}')
        WHEN k = 6 THEN concat('{{"op":"c","after":{{"id":"', {id_text}, '"}},"source":{{"lsn":99999999999999999999}}}}')
        ELSE concat('{{"op":"', CASE WHEN k < 20 THEN 'r' WHEN k < 40 THEN 'd' ELSE 'c' END,
            '","', CASE WHEN k >= 20 AND k < 40 THEN 'before' ELSE 'after' END,
            '":{{"id":"', upper({id_text}), '","cloudevents_id":',
            CASE WHEN k < 30 THEN concat('"ce-', event_id, '"') WHEN k < 60 THEN 'null' ELSE cast(event_id AS string) END,
            CASE WHEN k < 50 THEN ',"source":"s"' ELSE '' END,
            ',"status":"x","extra":[1,2],"received_at":"',
            CASE WHEN k < 30 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
                 WHEN k < 60 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
                 WHEN k < 65 THEN cast(unix_millis(ts) AS string)
                 WHEN k < 70 THEN cast(unix_micros(ts) AS string)
                 WHEN k < 73 THEN cast(unix_seconds(ts) AS string)
                 WHEN k < 76 THEN date_format(ts, 'yyyyMMdd')
                 WHEN k < 78 THEN '99999999999999999999999'
                 WHEN k < 80 THEN 'garbage' ELSE '' END,
            '","event_time":"',
            CASE WHEN k < 70 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN k < 85 THEN 'garbage' ELSE '' END,
            '"}},"source":{{"lsn":', event_id, '}}}}') END AS value""",
    )


@register("cdc_decode_envelope")
def _(t):
    return decode_envelope(_odd_messages(t), "inbound_event_logs")


@register("cdc_dead_letters")
def _(t):
    parsed = parse_envelope(_odd_messages(t), "inbound_event_logs")
    return dead_letters(parsed).groupBy(F.col("_problem").alias("problem")).agg(F.count(F.lit(1)).alias("messages"))


@register("cdc_exclude_columns")
def _(t):
    return decode_envelope(t.wire("intelligence_event_logs"), "intelligence_event_logs", exclude=("evaluation_context",))


@register("snapshot_and_live")
def _(t):
    live = t["protocol_instances"]
    # every order's enrolment, which live rows supersede, and one more that only the snapshot has
    first = t.orders().selectExpr("*", f"explode(array(o_orderkey, o_orderkey + {SNAPSHOT_ONLY})) AS _key").selectExpr(
        f"{_id(ENROLMENT, '_key')} AS id",
        "concat('P', cast(o_custkey AS string)) AS patient_id",
        "cast(NULL AS string) AS protocol_canonical",
        f"{_id(3, 'o_custkey % 40')} AS protocol_definition_id",
        "'SNAPSHOT' AS status",
        "ts AS enrolled_at",
        "ts AS created_at",
        "ts AS updated_at",
    )
    snapshot = readers.snapshot_rows(first, "protocol_instances", version=0)
    unified = snapshot.unionByName(live)
    return changelog.latest_by_version(unified).groupBy("status").agg(F.count(F.lit(1)).alias("enrollments"))


@register("date_series")
def _(t):
    days = readers.date_series(t.spark, "1995-01-01", "2001-12-31")
    per_day = t.orders().groupBy(F.to_date("ts").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("orders"))
    return days.join(per_day, "snapshot_date", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@register("time_filter")
def _(t):
    log = readers.time_filter(t.query_log(), "event_time", "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return log.groupBy("user").agg(F.count(F.lit(1)).alias("queries"), F.max("event_time").alias("newest"))


@register("parameter_query")
def _(t):
    t.orders().createOrReplaceTempView("cdcmart_orders")
    return t.spark.sql(
        "SELECT o_orderstatus, count(*) AS orders FROM cdcmart_orders"
        " WHERE to_date(ts) BETWEEN :from_date AND :to_date GROUP BY o_orderstatus",
        args={"from_date": date(1998, 1, 1), "to_date": date(1998, 12, 31)},
    )


# -- derived columns --------------------------------------------------------------


@register("derive_inbound")
def _(t):
    read = with_read_aliases(t["inbound_event_logs"], "inbound_event_logs")
    return read.select("id", "_version", *TABLES["inbound_event_logs"].derived, "patient_id")


@register("derive_misc")
def _(t):
    deliveries = t["intelligence_deliveries"].select(
        "id",
        "_version",
        F.concat(F.coalesce(F.col("http_status_code").cast("string"), F.lit("none")), F.lit("/"), "error_message").alias(
            "text"
        ),
        millis_between(F.col("created_at"), F.col("delivered_at")).alias("latency_ms"),
    )
    nothing = F.lit(None).cast("bigint").alias("latency_ms")
    definitions = t["protocol_definitions"].select(
        "id", "_version", F.concat("name", F.lit("@"), dimensions.canonical(F.col("url"), F.col("version"))).alias("text"), nothing
    )
    receivers = t["receiver_adaptor"].select("id", "_version", F.col("endpoint_url").alias("text"), nothing)
    return deliveries.unionByName(definitions).unionByName(receivers)


# -- change log to state ----------------------------------------------------------


@register("latest_by_version")
def _(t):
    return changelog.current(t, "step_instances").select("id", "protocol_instance_id", "action_id", "state", "_version")


@register("current_view_sql")
def _(t):
    changelog.register_current_views({"protocol_instances": t["protocol_instances"]}, suffix="_current")
    return t.spark.sql(
        "SELECT status, count(*) AS enrollments, min(enrolled_at) AS first_enrolled"
        " FROM protocol_instances_current GROUP BY status"
    )


def _two_refreshes(t: DriverTables) -> DataFrame:
    events = kpis.mv_daily_event_kpis(t, EVENTS_AS_OF)
    earlier = events.withColumn("refreshed_at", F.col("refreshed_at") - F.expr("INTERVAL 30 SECONDS")).withColumn(
        "matched_count", F.lit(0).cast("bigint")
    )
    return earlier.unionByName(events)


@register("snapshot_latest")
def _(t):
    path = shared_folder(t.spark, "snapshots")
    refreshes = _two_refreshes(t)
    sinks.append_snapshot(refreshes, path)
    return kpis.snapshot_latest(t.spark.read.parquet(path), "mv_daily_event_kpis")


@register("history_dedup")
def _(t):
    return changelog.dedup(t["protocol_instance_history"]).drop("_is_deleted")


@register("carry_forward_unavailable")
def _(t):
    holes = t.plain("step_instances").select(
        "id",
        "_version",
        F.when(F.col("repeat_index") == 2, UNAVAILABLE_VALUE).otherwise(F.col("state")).alias("state"),
    )
    # One slice per year of versions.
    slices = F.floor(F.col("_version") / F.lit(365 * 10**12))
    return changelog.carry_forward_unavailable(holes, ["state"], slices)


def _register_rollups() -> None:
    for name in rollups.ROLLUPS:
        register(name)(lambda t, name=name: rollups.rollup(name, t))


_register_rollups()


@register("argmax_merge")
def _(t):
    """The delivery rollup through partial states of separate batches."""
    changes = t["intelligence_deliveries"]
    first = rollups.rollup_partials("rollup_delivery_current", changes.where("status = 'PENDING'"))
    second = rollups.rollup_partials("rollup_delivery_current", changes.where("status <> 'PENDING'"))
    return rollups.read_rollup("rollup_delivery_current", first.unionByName(second))


@register("sum_merge")
def _(t):
    """Additive partials of three batches of identifiers, summed again."""
    mart = marts.MARTS["mv_ingestion_quality"]
    path = shared_folder(t.spark, "sum-merge")
    for batch in range(3):
        sinks.write_partials(marts.partials(_part_of(t["inbound_event_logs"], batch, 3), mart), path, batch)
    return changelog.sum_merge(sinks.read_partials(t.spark, path), mart.keys, mart.counts)


def _part_of(rows: DataFrame, part: int, parts: int) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)


@register("merged_partials")
def _(t):
    """Six batches, merged twice; a seventh arrives before and an eighth after the last merge."""
    name = "mv_ingestion_quality"
    mart, layout = marts.MARTS[name], ingest.Layout(shared_folder(t.spark, "merged"))
    for batch in range(8):
        ingest.store_states(t.spark, layout, name, marts.partials(_part_of(t["inbound_event_logs"], batch, 8), mart))
        if batch in (5, 6):
            ingest.merge_aggregate(t.spark, name, layout)
    return ingest.read_aggregate(t.spark, name, layout)


@register("merged_rollup")
def _(t):
    """Arg-max states of four batches, merged into one before they are read."""
    name = "rollup_delivery_current"
    layout = ingest.Layout(shared_folder(t.spark, "merged-rollup"))
    for batch in range(4):
        ingest.store_states(t.spark, layout, name, rollups.rollup_partials(name, _part_of(t["intelligence_deliveries"], batch, 4)))
    ingest.merge_aggregate(t.spark, name, layout)
    return ingest.read_aggregate(t.spark, name, layout)


@register("state_merge")
def _(t):
    """Count states merged over batches; the distinct sketch is within 5 per cent
    of the exact number, which is what is reported."""
    mart = marts.MARTS["mv_intelligence_summary"]
    rows = t["intelligence_event_logs"]
    batches = marts.partials(rows.where("published"), mart).unionByName(marts.partials(rows.where("NOT published"), mart))
    merged = marts.merge(batches, mart).withColumnRenamed("unique_patients", "_estimate")
    exact = marts.aggregate(rows, mart).select(*mart.keys, "unique_patients")
    close = F.abs(F.col("_estimate") - F.col("unique_patients")) <= F.greatest(
        F.col("unique_patients") * 0.05, F.lit(1.0)
    )
    return merged.join(exact, list(mart.keys)).select(*mart.keys, "trigger_count", close.alias("estimate_close"))


# -- aggregates, KPIs -------------------------------------------------------------


def _register_marts() -> None:
    for name in marts.MART_NAMES:
        register(name)(lambda t, name=name: marts.build(name, t))
        if name != "mv_patient_facility_latest":
            register(f"{name}_current")(lambda t, name=name: marts.build(name, t, mode="current"))


_register_marts()


@register("mv_daily_compliance_kpis")
def _(t):
    return kpis.mv_daily_compliance_kpis(t, ORDERS_AS_OF)


def _deviation_kpis(t: DriverTables) -> DataFrame:
    return kpis.mv_daily_deviation_kpis(t, ORDERS_AS_OF)


register("mv_daily_deviation_kpis")(_deviation_kpis)


def _event_kpis(t: DriverTables) -> DataFrame:
    return kpis.mv_daily_event_kpis(t, EVENTS_AS_OF)


def _adoption_kpis(t: DriverTables) -> DataFrame:
    return kpis.mv_daily_adoption_kpis(t, EVENTS_AS_OF)


def _referral_kpis(t: DriverTables) -> DataFrame:
    return kpis.mv_daily_referral_kpis(t, EVENTS_AS_OF)


register("mv_daily_event_kpis")(_event_kpis)
register("mv_daily_adoption_kpis")(_adoption_kpis)
register("mv_daily_referral_kpis")(_referral_kpis)


KEPT = {n: state.Kept(n, c) for n, c in (("inbound_event_logs", "event_time"), ("compliance_event_logs", "received_at"))}


def _kept_tables(t: DriverTables, names: tuple[str, ...]) -> Mapping[str, DataFrame]:
    """Tables of which some come from stored state: three upserts of versions in mixed order, the first of them run twice;
    events of the KPI window only."""
    layout = ingest.Layout(shared_folder(t.spark, "state"))
    for name in names:
        t[name].write.parquet(f"{layout.root}/changes/{name}")
        changes = t.spark.read.schema(t[name].schema).parquet(f"{layout.root}/changes/{name}")
        for part in (2, 0, 0, 1):
            rows = changes.where(F.pmod(F.xxhash64("id", "_version"), F.lit(3)) == part)
            state.upsert(t.spark, layout, KEPT[name], rows)
    earliest = {"inbound_event_logs": t.spark.range(1).select(kpis.months_before(EVENTS_AS_OF, kpis.KPI_WINDOW_MONTHS)).first()[0]}
    return changelog.Resolved(t, {n: state.read_current(t.spark, layout, KEPT[n], earliest.get(n)) for n in names})


@register("compliance_kpis_from_states")
def _(t):
    """Compliance kept up by three refreshes, after loads of the versions in mixed order; the second refresh meets late
    versions and deletes, the third one nothing new."""
    layout = ingest.Layout(shared_folder(t.spark, "compliance"))
    for parts in ((1, 2), (0,), ()):
        for name in maintain.ROLLUPS:
            rows = t[rollups.ROLLUPS[name][0]]
            for part in parts:
                some = rows.where(F.pmod(F.xxhash64("id", "_version"), F.lit(3)) == part)
                ingest.store_states(t.spark, layout, name, rollups.rollup_partials(name, some))
        maintain.refresh_compliance(t.spark, layout, ORDERS_AS_OF)
    return maintain.read_compliance(t.spark, layout)


@register("event_kpis_from_state")
def _(t):
    return kpis.mv_daily_event_kpis(_kept_tables(t, tuple(KEPT)), EVENTS_AS_OF)


@register("adoption_kpis_from_state")
def _(t):
    return kpis.mv_daily_adoption_kpis(_kept_tables(t, ("inbound_event_logs",)), EVENTS_AS_OF)


@register("referral_kpis_from_state")
def _(t):
    return kpis.mv_daily_referral_kpis(_kept_tables(t, tuple(KEPT)), EVENTS_AS_OF)


def _backfilled(t: DriverTables) -> DataFrame:
    return backfill.backfill_daily_compliance(t, *BACKFILL_RANGE, refreshed_at=ORDERS_AS_OF)


register("backfill_daily_compliance")(_backfilled)


@register("asof_status")
def _(t):
    return asof.asof_states(t["protocol_instance_history"], "protocol_instance_id", ["status"], *ASOF_RANGE)


@register("asof_step_state")
def _(t):
    columns = ["state", "completion_status"]
    return asof.asof_states(t["step_instance_history"], "step_instance_id", columns, *ASOF_RANGE)


@register("asof_deviation_counts")
def _(t):
    kinds = {"deviation_count": F.lit(True), "overdue_count": F.col("deviation_type") == "OVERDUE"}
    return asof.asof_event_counts(
        changelog.current(t, "deviations"), "protocol_instance_id", "detected_at", kinds, *ASOF_RANGE
    )


# -- sinks ------------------------------------------------------------------------


@register("backfill_event_volume")
def _(t):
    mart = marts.MARTS["mv_event_volume_hourly"]
    path = shared_folder(t.spark, "backfill")
    for _attempt in range(2):  # running it again changes nothing
        sinks.backfill(marts.partials(t["inbound_event_logs"], mart), path)
    return marts.merge(sinks.read_partials(t.spark, path), mart)


@register("retention_90d")
def _(t):
    kept = sinks.apply_retention(t.plain("inbound_event_logs"), "received_at", "2024-04-10 12:00:00")
    return kept.groupBy(F.to_date("received_at").alias("day")).agg(F.count(F.lit(1)).alias("kept_rows"))


@register("replace_table")
def _(t):
    path = shared_folder(t.spark, "replace")
    sinks.replace_table(_event_kpis(t).withColumn("total_events", F.lit(0).cast("bigint")), path)
    sinks.replace_table(_event_kpis(t), path)
    return sinks.read_table(t.spark, path)


@register("compacted_changelog")
def _(t):
    name, layout = "intelligence_deliveries", ingest.Layout(shared_folder(t.spark, "compact"))
    pending, others = t[name].where("status = 'PENDING'"), t[name].where("status <> 'PENDING'")

    def store(rows: DataFrame) -> None:
        ingest.load(t.spark, layout, name, rows)

    # two loads before, one in mid-compaction, one after it
    store(_part_of(pending, 0, 2))
    store(_part_of(pending, 1, 2))
    ingest.compact(t.spark, layout, name, 202401, before_commit=lambda: store(_part_of(others, 0, 2)))
    store(_part_of(others, 1, 2))
    newest = changelog.latest_by_version(ingest.read_log(t.spark, layout, name), deleted=None)
    return newest.select("id", "status", "_version", "_is_deleted")


@register("rebuild_aggregates")
def _(t):
    """What was stored before the rebuild counts no more, in aggregates and changelogs alike."""
    layout = ingest.Layout(shared_folder(t.spark, "rebuild"))
    stale = t["deviations"].withColumn("deviation_type", F.lit("STALE"))
    ingest.load(t.spark, layout, "deviations", stale)
    ingest.store_states(t.spark, layout, "mv_deviation_trends", marts.partials(stale, marts.MARTS["mv_deviation_trends"]))
    ingest.rebuild(t.spark, layout, {n: changelog.current(t, n) for n in ("deviations", "protocol_instances")})
    return ingest.read_aggregate(t.spark, "mv_deviation_trends", layout)


def _messages(t: DriverTables, table: str, layout: ingest.Layout) -> DataFrame:
    """The messages of a table as text files, as they arrive."""
    t.wire(table).write.text(f"{layout.root}/messages")
    return t.spark.read.schema("value string").text(f"{layout.root}/messages")


@register("rebuild_then_ingest")
def _(t):
    """A rebuild from half of the changes, while a running stream commits a quarter; the last quarter arrives afterwards."""
    name, aggregate = "deviations", "mv_deviation_trends"
    layout = ingest.Layout(shared_folder(t.spark, "rebuild-ingest"))
    messages = _messages(t, name, layout)
    quarter = F.pmod(F.xxhash64("value"), F.lit(4))

    def arrive(number: int) -> None:
        ingest.process_batch(messages.where(quarter == number), number, ingest.Ingest(name, (aggregate,)), layout)

    arrive(0)  # replaced by the rebuild, which holds its changes as well
    snapshot = decode_envelope(messages.where(quarter.isin(0, 1)), name)
    ingest.rebuild(t.spark, layout, {name: snapshot}, before_commit=lambda: arrive(2))
    arrive(3)
    arrive(3)  # delivered again
    return ingest.read_aggregate(t.spark, aggregate, layout)


@register("committed_batches")
def _(t):
    """Micro-batches of which one is delivered again and one ends before its commit, with a merge and a compaction
    in between: change rows of the log against the sum of the aggregate."""
    name, aggregate = "intelligence_deliveries", "rollup_delivery_current"
    layout = ingest.Layout(shared_folder(t.spark, "commits"))
    messages = _messages(t, name, layout)
    part = F.pmod(F.xxhash64("value"), F.lit(3))
    for number in (0, 1, 1):
        ingest.process_batch(messages.where(part == number), number, ingest.Ingest(name, (aggregate,)), layout)
    changes = decode_envelope(messages.where(part == 2), name)
    sinks.write_changelog(changes, layout.changelog(name), name, "ended-early")
    sinks.write_partials(rollups.rollup_partials(aggregate, changes), layout.partials(aggregate), "ended-early")
    ingest.merge_aggregate(t.spark, aggregate, layout)
    ingest.process_batch(messages.where(part == 2), 2, ingest.Ingest(name, (aggregate,)), layout)
    logged = ingest.read_log(t.spark, layout, name).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
    merged = ingest.read_aggregate(t.spark, aggregate, layout).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
    return logged.withColumn("form", F.lit("changes")).unionByName(merged.withColumn("form", F.lit("rollup")))


# -- streaming --------------------------------------------------------------------


def run_stream(t: DriverTables, table: str, aggregates: tuple[str, ...] = ()) -> ingest.Layout:
    """Send a table's messages through the streaming ingest in several batches."""
    layout = ingest.Layout(shared_folder(t.spark, f"stream-{table}"))
    messages = t.arriving(f"{layout.root}/given").wire(table)
    query = ingest.start_ingest(messages, ingest.Ingest(table, aggregates), layout, {"availableNow": True})
    query.awaitTermination()
    return layout


def _register_streams() -> None:
    streamed = {
        "stream_event_volume_hourly": ("inbound_event_logs", "mv_event_volume_hourly"),
        "stream_deviation_by_protocol": ("deviations", "mv_deviation_by_protocol"),
        "stream_rollup_protocol_instance": ("protocol_instances", "rollup_protocol_instance_current"),
        "stream_rollup_step": ("step_instances", "rollup_step_current"),
        "stream_rollup_delivery": ("intelligence_deliveries", "rollup_delivery_current"),
        "stream_patient_facility": ("inbound_event_logs", "mv_patient_facility_latest"),
    }
    for name, (table, aggregate) in streamed.items():

        def build(t, table=table, aggregate=aggregate):
            layout = run_stream(t, table, (aggregate,))
            return ingest.read_aggregate(t.spark, aggregate, layout)

        register(name)(build)


_register_streams()


@register("stream_deviation_by_patient")
def _(t):
    """Deviations find their patients in a snapshot of the enrolments, which were there before."""
    layout = ingest.Layout(shared_folder(t.spark, "stream-by-patient"))
    ingest.load(t.spark, layout, "protocol_instances", t["protocol_instances"])
    messages = t.arriving(f"{layout.root}/given").wire("deviations")
    query = ingest.start_ingest(messages, ingest.Ingest("deviations", (ingest.BY_PATIENT,)), layout, {"availableNow": True})
    query.awaitTermination()
    return ingest.read_aggregate(t.spark, ingest.BY_PATIENT, layout)


@register("stream_current_state")
def _(t):
    layout = run_stream(t, "protocol_instances")
    stored = ingest.read_log(t.spark, layout, "protocol_instances")
    return changelog.latest_by_version(stored).select("id", "patient_id", "status", "enrolled_at", "_version")


@register("equal_versions_by_arrival")
def _(t):
    """Two loads with the same keys and versions: the later one counts, in state and in rollup alike."""
    name, rollup = "intelligence_deliveries", "rollup_delivery_current"
    layout = ingest.Layout(shared_folder(t.spark, "arrival"))
    rows = t[name].where("NOT _is_deleted")
    for status in ("FIRST", "SECOND"):
        ingest.load(t.spark, layout, name, rows.withColumn("status", F.lit(status)))
    stored = ingest.read_log(t.spark, layout, name)
    halves = [stored.where(F.col("status") == s) for s in ("SECOND", "FIRST")]  # the later half comes first
    for half in halves:
        ingest.store_states(t.spark, layout, rollup, rollups.rollup_partials(rollup, half))
    state = changelog.latest_by_version(halves[0].unionByName(halves[1])).groupBy("status").agg(F.count("*").alias("rows"))
    merged = ingest.read_aggregate(t.spark, rollup, layout).groupBy("status").agg(F.count("*").alias("rows"))
    return state.withColumn("form", F.lit("state")).unionByName(merged.withColumn("form", F.lit("rollup")))


@register("stream_history_dedup")
def _(t):
    root = shared_folder(t.spark, "stream-dedup")
    t.wire("protocol_instance_history").repartition(4).write.text(f"{root}/messages")
    messages = readers.read_change_files(t.spark, f"{root}/messages", files_per_batch=2)
    query = ingest.start_dedup(
        decode_envelope(messages, "protocol_instance_history"), "protocol_instance_history", "changed_at",
        timedelta(days=30), f"{root}/rows", f"{root}/checkpoint", {"availableNow": True},
    )
    query.awaitTermination()
    stored = readers.read_changelog(t.spark, f"{root}/rows", "protocol_instance_history")
    return stored.select("id", "protocol_instance_id", "status", "changed_at")


# -- reports ----------------------------------------------------------------------


@register("outcome_distribution")
def _(t):
    return rollups.outcome_distribution(rollups.rollup("rollup_protocol_instance_current", t))


@register("enrollment_compliance_rate")
def _(t):
    return rollups.enrollment_compliance_rate(rollups.rollup("rollup_step_current", t))


@register("delivery_success_rate")
def _(t):
    return rollups.delivery_success_rate(rollups.rollup("rollup_delivery_current", t))


@register("delivery_latency")
def _(t):
    return rollups.delivery_latency(t)


@register("dash_compliance_cards")
def _(t):
    return reports.dash_compliance_cards(kpis.mv_daily_compliance_kpis(t, ORDERS_AS_OF), "2001-12-01")


@register("dash_adoption_overview")
def _(t):
    return reports.dash_adoption_overview(_adoption_kpis(t), t, EVENT_DAY)


@register("dash_referrals_by_facility")
def _(t):
    return reports.dash_referrals_by_facility(_referral_kpis(t), *EVENT_RANGE)


@register("dash_referrals_total")
def _(t):
    return reports.dash_referrals_total(_referral_kpis(t), *EVENT_RANGE)


@register("trend_compliance")
def _(t):
    return reports.trend_compliance(_backfilled(t), BACKFILL_RANGE[1])


@register("trend_adoption")
def _(t):
    return reports.trend_adoption(_adoption_kpis(t), t, *EVENT_RANGE)


@register("compliance_page")
def _(t):
    return reports.compliance_page(kpis.mv_daily_compliance_kpis(t, ORDERS_AS_OF), "2001-12-01", PROTOCOL)


@register("adoption_table")
def _(t):
    return reports.adoption_table(_adoption_kpis(t), t, EVENT_DAY)


@register("deviation_header")
def _(t):
    return reports.deviation_header(_deviation_kpis(t))


@register("deviation_header_day")
def _(t):
    return reports.deviation_header(_deviation_kpis(t), "2001-06-15")


@register("event_header")
def _(t):
    return reports.event_header(_event_kpis(t), EVENT_DAY)


@register("adoption_period_rate")
def _(t):
    return reports.adoption_period_rate(_adoption_kpis(t), *EVENT_RANGE)


@register("deviation_unique_patients")
def _(t):
    return reports.deviation_unique_patients(
        kpis.deviation_occurrences(t, ORDERS_AS_OF), "2001-03-01", "2001-08-31"
    )


@register("merged_unique_patients")
def _(t):
    """The same from stored daily states, merged over the days; reported is whether the
    estimate is within 5 per cent of the exact number."""
    days = ("2001-03-01", "2001-08-31")
    path = shared_folder(t.spark, "deviation-states")
    sinks.replace_table(kpis.mv_daily_deviation_kpis(t, ORDERS_AS_OF, states=True), path)
    merged = reports.merged_unique_patients(sinks.read_table(t.spark, path), *days)
    exact = reports.deviation_unique_patients(kpis.deviation_occurrences(t, ORDERS_AS_OF), *days)
    dims = ["protocol_definition_id", "deviation_type"]
    both = merged.withColumnRenamed("affected_patients", "_estimate").join(exact, dims)
    close = F.abs(F.col("_estimate") - F.col("affected_patients")) <= F.greatest(F.col("affected_patients") * 0.05, F.lit(1.0))
    return both.select(*dims, "affected_patients", close.alias("estimate_close"))


@register("readable_quantities")
def _(t):
    """Rows read by each user, as text."""
    rows = t.query_log().groupBy("user").agg(F.sum("read_rows").alias("_rows"), F.count(F.lit(1)).alias("queries"))
    return rows.select("user", "queries", readable_quantity(F.col("_rows")).alias("rows_read"))


@register("referral_compliance")
def _(t):
    return reports.referral_compliance(_referral_kpis(t))


@register("adoption_fill_zero")
def _(t):
    return reports.adoption_fill_zero(_adoption_kpis(t), t, *EVENT_RANGE)


@register("rank_facilities")
def _(t):
    return reports.rank_facilities(_adoption_kpis(t))


@register("events_per_minute")
def _(t):
    return reports.events_per_minute(_stored_columns_only(t), EVENTS_AS_OF, "1 DAY")


@register("cdc_freshness_seconds")
def _(t):
    return reports.cdc_freshness_seconds(_stored_columns_only(t), EVENTS_AS_OF)


@register("e2e_latency_per_minute")
def _(t):
    report = reports.e2e_latency_per_minute(_stored_columns_only(t), EVENTS_AS_OF, "1 DAY")
    return report.select("time", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@register("e2e_latency_p95_5min")
def _(t):
    return reports.e2e_latency_p95_5min(_stored_columns_only(t), BUSY_MOMENT, "3 HOUR").select(F.round("p95", 6).alias("p95"))


def _stored_states(t: DriverTables, purpose: str, rows: DataFrame, states: Callable[[DataFrame], DataFrame], dims: list[str], others=None) -> DataFrame:
    """Quantile states of four batches of rows, stored; two of them are merged before the others arrive."""
    layout = ingest.Layout(shared_folder(t.spark, purpose))
    for batch in range(4):
        part = states(rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(4)) == batch))
        ingest.store_states(t.spark, layout, purpose, part)
        if batch == 1:
            ingest.merge_states(t.spark, layout, purpose, lambda s: quantiles.merge_quantiles(s, dims, others).select(*s.columns), part.schema)
    return ingest.read_states(t.spark, layout, purpose, part.schema)


def _timed_events(t: DriverTables) -> DataFrame:
    """Current inbound rows of a day with their latency, to hold estimates against."""
    rows = reports._latencies(_stored_columns_only(t), EVENTS_AS_OF, "1 DAY")
    return rows.select("id", "event_time", "received_at", "_latency", F.date_trunc("MINUTE", "received_at").alias("time"))


@register("merged_latency_quantiles")
def _(t):
    """Per minute; reported is whether the merged estimates lie within the sketch's rank error."""
    rows = _timed_events(t)
    states = _stored_states(t, "latency-states", rows.drop("time", "_latency"), reports.latency_states, ["time"])
    return quantiles.rank_checks(reports.merged_latency(states), rows, ["time"], "_latency", reports.LATENCY_RANKS)


@register("merged_latency_p95")
def _(t):
    """The minutes of a look-back merged into one state."""
    since = "2024-01-15 09:00:00"
    rows = reports._latencies(_stored_columns_only(t), BUSY_MOMENT, "3 HOUR")
    within = rows.where(F.date_trunc("MINUTE", "received_at") > F.lit(since).cast("timestamp")).select("id", "event_time", "received_at", "_latency")
    states = _stored_states(t, "p95-states", within.drop("_latency"), reports.latency_states, ["time"])
    return quantiles.rank_checks(reports.merged_latency_p95(states, BUSY_MOMENT, "3 HOUR"), within, [], "_latency", {"p95": 0.95})


def _duration_states(t: DriverTables) -> DataFrame:
    others = {"sample_query": F.min("sample_query"), "total_ms": F.sum("total_ms"), "max_ms": F.max("max_ms"), "peak": F.max("peak")}
    return _stored_states(t, "duration-states", t.query_log(), querylog.duration_states, ["time", querylog.SHAPE, "user"], others)


@register("ql_merged_percentiles")
def _(t):
    rows = querylog.finished(t.query_log()).withColumn("time", F.date_trunc("MINUTE", "event_time"))
    merged = querylog.merged_latency_percentiles(_duration_states(t))
    return quantiles.rank_checks(merged, rows, ["time"], "duration_ms", querylog.QUERY_RANKS)


@register("ql_merged_slowest_shapes")
def _(t):
    """As ``ql_slowest_shapes``; whether its p95 lies within the rank error stands for the number."""
    top = querylog.merged_slowest_shapes(_duration_states(t))
    rows = querylog.finished(t.query_log()).withColumn(querylog.SHAPE, query_shape(F.col("query")))
    close = quantiles.rank_checks(top, rows, [querylog.SHAPE, "user"], "duration_ms", {"p95_ms": 0.95}).drop("n")
    return top.drop("p95_ms").join(close, [querylog.SHAPE, "user"])


@register("insert_stall")
def _(t):
    return reports.insert_stall(_stored_columns_only(t), BUSY_MOMENT)


# -- dimensions -------------------------------------------------------------------


@register("dict_protocol_definitions")
def _(t):
    enrolments = changelog.current(t, "protocol_instances").select("id", "protocol_definition_id")
    attributes = {"name": "", "version": "", "url": "", "canonical": "", "status": ""}
    return lookup(
        enrolments, dimensions.dict_protocol_definitions(t), {"protocol_definition_id": "id"}, attributes, "protocol_"
    )


@register("dict_patient_facility")
def _(t):
    patients = changelog.current(t, "protocol_instances").select("id", "patient_id")
    return lookup(
        patients,
        dimensions.dict_patient_facility(t),
        {"patient_id": "patient_id"},
        {"facility_id": "", "last_seen": "1970-01-01 00:00:00"},
    )


@register("dict_action_definitions")
def _(t):
    triggers = changelog.current(t, "intelligence_event_logs").select("id", "action_definition_id")
    attributes = {"canonical_url": "", "name": "", "action_type": "", "status": ""}
    return lookup(
        triggers, dimensions.dict_action_definitions(t), {"action_definition_id": "id"}, attributes, "action_"
    )


@register("dict_delivery_adaptor")
def _(t):
    deliveries = changelog.current(t, "intelligence_deliveries").select("id", "destination_adaptor_mapping_id")
    attributes = {"destination": "", "adaptor_name": "", "endpoint_url": "", "adaptor_status": ""}
    return lookup(
        deliveries,
        dimensions.dict_delivery_adaptor(t),
        {"destination_adaptor_mapping_id": "destination_adaptor_mapping_id"},
        attributes,
    )


# -- joins on their own, quality --------------------------------------------------


@register("semi_join_referrals")
def _(t):
    events = changelog.current(t, "inbound_event_logs").select("id", "cloudevents_id")
    return events.join(kpis.referral_completions(t), "cloudevents_id", "left_semi")


@register("orphan_deviations")
def _(t):
    steps = changelog.current(t, "step_instances").select("id")
    found = quality.orphans(
        changelog.current(t, "deviations").select("step_instance_id", "deviation_type"), "step_instance_id", steps
    )
    return found.groupBy("deviation_type").agg(F.count(F.lit(1)).alias("orphans"))


@register("aggregate_drift")
def _(t):
    return quality.aggregate_drift(
        marts.build("mv_ingestion_quality", t),
        marts.build("mv_event_volume_hourly", t),
        F.lit(EVENT_DAY).cast("date"),
    )


@register("dq_report")
def _(t):
    return quality.run_checks(_stored_columns_only(t), "2024-01-30 23:00:00", _compared_marts(t))


def _compared_marts(t: DriverTables) -> dict[str, DataFrame]:
    return {name: marts.build(name, t) for name in ("mv_ingestion_quality", "mv_event_volume_hourly")}


@register("dq_drift_found")
def _(t):
    """The report over marts of which one has lost half of its counts."""
    stored = _compared_marts(t)
    stored["mv_event_volume_hourly"] = stored["mv_event_volume_hourly"].withColumn("event_count", F.floor(F.col("event_count") / 2))
    report = quality.run_checks(_stored_columns_only(t), f"{EVENT_DAY} 23:00:00", stored)
    return report.where(F.col("check").startswith("marts agree"))


# -- metric samples ---------------------------------------------------------------


def _received(t: DriverTables) -> DataFrame:
    counter = t.counter_samples("events_total", ("source",), "floor(value * 100)")
    return metrics.with_labels(metrics.select_series(counter, "events_total"), ["source"])


def _by_type(t: DriverTables) -> DataFrame:
    return t.counter_samples("events_total", ("source", "type"), "floor(value * 100)")


def _rounded(vector: DataFrame) -> DataFrame:
    return vector.withColumn("value", F.round("value", 8))


@register("counter_rate")
def _(t):
    return _rounded(metrics.counter_rate(_received(t), ["source"], SIX_HOURS, HOUR))


@register("counter_increase")
def _(t):
    return _rounded(metrics.counter_increase(_received(t), ["source"], SIX_HOURS, HOUR))


@register("ratio_of_rates")
def _(t):
    errors = metrics.with_labels(metrics.select_series(_by_type(t), "events_total", {"type": "error"}), ["source"])
    return _rounded(
        metrics.divide(
            metrics.counter_rate(errors, ["source"], 4 * SIX_HOURS, HOUR),
            metrics.counter_rate(_received(t), ["source"], 4 * SIX_HOURS, HOUR),
            ["source"],
            scale=100.0,
        )
    )


@register("mean_latency")
def _(t):
    total = metrics.with_labels(t.counter_samples("latency_sum", ("source",), "floor(value * 100)"), ["source"])
    count = metrics.with_labels(t.counter_samples("latency_count", ("source",), "1"), ["source"])
    return _rounded(
        metrics.divide(
            metrics.counter_rate(total, ["source"], SIX_HOURS, HOUR),
            metrics.counter_rate(count, ["source"], SIX_HOURS, HOUR),
            ["source"],
        )
    )


@register("histogram_quantile")
def _(t):
    result = metrics.histogram_quantile(t.latency_buckets(), ["source", "ts"], 0.95)
    return _rounded(result)


@register("quantile_of_rates")
def _(t):
    buckets = metrics.with_labels(metrics.select_series(t.bucket_samples(), "latency_bucket"), ["source", "le"])
    return metrics.quantile_of_rates(buckets, ["source"], ["source"], 0.95, SIX_HOURS, HOUR).withColumn("value", F.round("value", 6))


@register("sum_by_labels")
def _(t):
    depth = metrics.select_series(t.gauge_samples(), "queue_depth")
    steps = metrics.gauge_at_steps(metrics.with_labels(depth, ["source", "kind"]), ["source", "kind"], HOUR)
    return metrics.sum_by(steps, ["kind"])


@register("label_match")
def _(t):
    chosen = metrics.select_series(
        t.gauge_samples(),
        "queue_depth",
        differs={"source": "s7"},
        matches={"source": "s[0-5]"},
        matches_not={"kind": "view|click"},
    )
    flat = metrics.with_labels(chosen, ["source", "kind"])
    return flat.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("samples"), F.sum("value").alias("value"))


@register("vector_match_ignoring")
def _(t):
    samples = t.gauge_samples()
    left = metrics.select_series(samples, "memory_avail_bytes")
    right = metrics.select_series(samples, "memory_total_bytes").withColumn(
        "labels", F.create_map(F.lit("source"), F.col("labels")["source"], F.lit("kind"), F.lit("all"))
    )
    divided = metrics.divide_ignoring(left, right, ["kind"], scale=100.0)
    return divided.select("ts", F.col("labels")["source"].alias("source"), F.round("value", 4).alias("value"))


@register("utilisation")
def _(t):
    def gauge(name):
        return metrics.gauge_at_steps(
            metrics.with_labels(metrics.select_series(t.gauge_samples(), name), ["source"]), ["source"], HOUR
        )

    return _rounded(metrics.utilisation(gauge("memory_avail_bytes"), gauge("memory_total_bytes"), ["source"]))


@register("cpu_utilisation")
def _(t):
    idle = metrics.with_labels(t.counter_samples("cpu_idle", ("source",), "100 - k"), ["source"])
    rates = metrics.counter_rate(idle, ["source"], SIX_HOURS, HOUR)
    return _rounded(metrics.busy_share(rates))


@register("sum_of_increases")
def _(t):
    def increase(kind):
        one = metrics.with_labels(metrics.select_series(_by_type(t), "events_total", {"type": kind}), ["source"])
        return metrics.counter_increase(one, ["source"], 4 * SIX_HOURS, HOUR)

    return _rounded(metrics.add(increase("error"), increase("click"), ["source"]))


@register("uptime")
def _(t):
    boots = metrics.with_labels(metrics.select_series(t.gauge_samples(), "boot_time_seconds"), ["source"])
    return metrics.uptime(boots, ["source"], as_timestamp(EVENTS_AS_OF))


@register("target_down")
def _(t):
    up = metrics.with_labels(metrics.select_series(t.gauge_samples(), "up"), ["source"])
    return up.where("value = 0").groupBy("source").agg(F.count(F.lit(1)).alias("down_samples"))


def _deep_queues(t: DriverTables) -> DataFrame:
    depth = metrics.with_labels(metrics.select_series(t.gauge_samples(), "queue_depth"), ["source"])
    steps = metrics.gauge_at_steps(depth, ["source"], HOUR)
    condition = steps.select("source", "ts", (F.col("value") > 50).alias("active"))
    return metrics.sustained_alert(condition, ["source"], 2 * HOUR, HOUR, "warning")


register("sustained_alert")(_deep_queues)


@register("alert_status")
def _(t):
    samples = t.gauge_samples()
    depth = metrics.select_series(samples, "queue_depth")
    unknown = metrics.select_series(samples, "queue_depth", {"source": "nowhere"})
    episodes = _deep_queues(t)
    never = metrics.sustained_alert(
        metrics.with_labels(unknown, ["source"]).withColumn("active", F.lit(True)), ["source"], HOUR, HOUR, "warning"
    )
    return metrics.alert_status(depth, episodes, "queue deep").unionByName(
        metrics.alert_status(unknown, never, "queue of nobody")
    )


@register("no_data")
def _(t):
    quiet = metrics.with_labels(t.counter_samples("errors", ("source",), "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"), ["source"])
    still = metrics.no_data(quiet, ["source"], SIX_HOURS, HOUR)
    return metrics.sustained_alert(still, ["source"], HOUR, HOUR, "critical")


@register("gauge_latest")
def _(t):
    depth = metrics.with_labels(metrics.select_series(t.gauge_samples(), "queue_depth"), ["source"])
    return metrics.gauge_latest(depth, ["source"])


@register("threshold_band")
def _(t):
    depth = metrics.with_labels(metrics.select_series(t.gauge_samples(), "queue_depth"), ["source"])
    latest = metrics.gauge_latest(depth, ["source"])
    return latest.withColumn("band", metrics.threshold_band(F.col("value"), [(40, "yellow"), (80, "red")], "green"))


# -- query log --------------------------------------------------------------------


def _register_querylog() -> None:
    plain = (
        "ql_totals",
        "ql_volume_per_minute",
        "ql_latency_percentiles",
        "ql_slowest_shapes",
        "ql_memory_shapes",
        "ql_read_volume_shapes",
        "ql_recent_errors",
        "ql_by_user",
        "ql_error_breakdown",
        "ql_over_memory",
        "ql_cache_candidates",
        "ql_by_hash",
    )
    for name in plain:
        register(name)(lambda t, name=name: getattr(querylog, name)(t.query_log()))
    register("stmt_totals")(lambda t: querylog.stmt_totals(t.statements()))
    for order in querylog.STATEMENT_ORDERS:
        register(f"stmt_top10_by_{order}")(lambda t, order=order: querylog.stmt_top10(t.statements(), order))


_register_querylog()


@register("gauge_series")
def _(t):
    series = querylog.gauge_series(t.gauge_samples(), "queue_depth", "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return series.select("time", F.col("labels")["source"].alias("source"), "value")


# -- the whole way from messages --------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event KPIs straight from change envelopes."""
    configure(spark)
    t = DriverTables(spark, sf_dir)
    decoded = {
        name: decode_envelope(t.wire(name), name, with_derived=True)
        for name in ("inbound_event_logs", "compliance_event_logs")
    }
    return _presentable(kpis.mv_daily_event_kpis(decoded, EVENTS_AS_OF))
