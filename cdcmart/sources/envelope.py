"""Change envelopes: one JSON text per message -> typed change rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcmart.fixed_values import DELETE_OPERATION, ROW_OPERATIONS
from cdcmart.functions import columns as C
from cdcmart.functions.derive import derive
from cdcmart.sources.schemas import TABLES, TableSpec

TO_TYPED = {
    "uuid": C.uuid_or_null,
    "uuid?": C.uuid_or_null,
    "text": C.text_or_empty,
    "ts": C.timestamp_or_epoch,
    "ts?": C.timestamp_or_null,
    "int": lambda v: C.number_or_zero(v, "int"),
    "long": lambda v: C.number_or_zero(v, "bigint"),
    "flag": C.flag_or_false,
}


def _envelope_type(spec: TableSpec, exclude: tuple[str, ...]) -> T.StructType:
    image = spec.wire_type(exclude)
    return T.StructType(
        [
            T.StructField("op", T.StringType()),
            T.StructField("before", image),
            T.StructField("after", image),
            T.StructField("source", T.StructType([T.StructField("lsn", T.DecimalType(20, 0))])),
        ]
    )


def parse_envelope(df: DataFrame, table: str, value: str = "value", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Keep the transport columns and add ``_op``, the typed row ``_row``, its
    ``_lsn`` and ``_problem`` (NULL for a readable row change).

    No shuffle; each message is parsed once and each value converted once.
    Truncates and unknown operations are dropped; they carry no row.
    """
    spec = TABLES[table]
    columns = {n: k for n, k in spec.columns.items() if n not in exclude}
    opened = C.evaluated_once(df, "_env", F.from_json(F.col(value), _envelope_type(spec, exclude)))
    operation = F.col("_env.op")
    image = F.when(operation == DELETE_OPERATION, F.col("_env.before")).otherwise(F.col("_env.after"))
    rows = opened.where(operation.isNull() | operation.isin(*ROW_OPERATIONS)).select(
        *df.columns, operation.alias("_op"), image.alias("_image"), F.col("_env.source.lsn").alias("_lsn")
    )
    typed = C.evaluated_once(
        rows, "_row", F.struct(*[TO_TYPED[k](F.col(f"_image.{n}")).alias(n) for n, k in columns.items()])
    )
    # An absent LSN counts as version 0, as an absent number does everywhere.
    version = F.coalesce(F.col("_lsn"), F.lit(0)).try_cast("bigint")
    return typed.select(
        *df.columns, "_op", "_row", version.alias("_lsn"), _problem(columns, version).alias("_problem")
    )


def _problem(columns: dict[str, str], version: Column) -> Column:
    found = F.when(F.col("_op").isNull(), F.lit("unreadable message")).when(
        F.col("_image").isNull(), F.lit("no row image")
    )
    for name, kind in columns.items():
        if kind == "uuid":
            found = found.when(F.col(f"_row.{name}").isNull(), F.lit(f"bad identifier: {name}"))
    return found.when(version.isNull(), F.lit("version out of range"))


def typed_changes(parsed: DataFrame, table: str, keep: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """The readable rows of :func:`parse_envelope` as change rows."""
    names = [n for n in TABLES[table].columns if n not in exclude]
    return parsed.where(F.col("_problem").isNull()).select(
        *[F.col(f"_row.{n}").alias(n) for n in names],
        F.col("_lsn").alias("_version"),
        (F.col("_op") == DELETE_OPERATION).alias("_is_deleted"),
        *keep,
    )


def dead_letters(parsed: DataFrame) -> DataFrame:
    """The messages that carry a row change but cannot be typed, whole."""
    return parsed.where(F.col("_problem").isNotNull()).drop("_op", "_row", "_lsn")


def decode_envelope(
    df: DataFrame,
    table: str,
    value: str = "value",
    keep: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    with_derived: bool = False,
) -> DataFrame:
    """Messages -> change rows of ``table``, snapshot reads and live changes alike."""
    changes = typed_changes(parse_envelope(df, table, value, exclude), table, keep, exclude)
    return derive(changes, table) if with_derived else changes


def encode_envelope(changes: DataFrame, table: str) -> DataFrame:
    """The inverse, for fixtures and replays: change rows -> ``value`` messages."""
    spec = TABLES[table]

    def on_wire(name: str, kind: str) -> Column:
        if kind in ("ts", "ts?"):
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(name)
        return F.col(name)

    image = F.struct(*[on_wire(n, k) for n, k in spec.columns.items()])
    nothing = F.lit(None)
    envelope = F.struct(
        F.when(F.col("_is_deleted"), F.lit("d"))
        .otherwise(F.col("_op") if "_op" in changes.columns else F.lit("c"))
        .alias("op"),
        F.when(F.col("_is_deleted"), image).otherwise(nothing).alias("before"),
        F.when(~F.col("_is_deleted"), image).otherwise(nothing).alias("after"),
        F.struct(F.col("_version").alias("lsn")).alias("source"),
    )
    return changes.select(F.to_json(envelope).alias("value"))
