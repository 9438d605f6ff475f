"""Column expressions shared by every layer; all stay inside the JVM."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcmart.fixed_values import EPOCH, UUID_PATTERN


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column the optimizer may not copy into filters above it.

    A filter on a field of a parsed document would otherwise be pushed below the
    parse by repeating the parse inside the filter. One-element ``explode`` is a
    boundary predicates do not cross, and it stays inside code generation.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def text_or_empty(value: Column) -> Column:
    """Absent and JSON-null text is the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))


def uuid_or_null(value: Column) -> Column:
    lowered = F.lower(F.trim(value))
    return F.when(lowered.rlike(UUID_PATTERN), lowered)


def timestamp_or_null(value: Column) -> Column:
    """ISO-8601 text (offsets honoured), a plain date of eight digits, or a number of
    seconds, milli- or microseconds since the epoch, told apart by its digits; else NULL.

    Up to 11 digits are seconds (until the year 5138), 12 to 14 milliseconds, 15 to
    17 microseconds, which keeps each in the range of a timestamp.
    """
    text = F.trim(value)
    number = text.try_cast("bigint")
    digits = F.length(F.regexp_replace(text, "^[-+]", ""))
    plain = text.rlike("^[-+]?[0-9]{1,17}$")
    moment = (
        F.when(~plain, F.try_to_timestamp(text))
        .when(text.rlike("^(19|20)[0-9]{6}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        .when(digits <= 11, F.timestamp_seconds(number))
        .when(digits <= 14, F.timestamp_millis(number))
        .otherwise(F.timestamp_micros(number))
    )
    return moment


def timestamp_or_epoch(value: Column) -> Column:
    return F.coalesce(timestamp_or_null(value), F.lit(EPOCH).cast("timestamp"))


def number_or_zero(value: Column, sql_type: str) -> Column:
    return F.coalesce(value.try_cast(sql_type), F.lit(0).cast(sql_type))


def flag_or_false(value: Column) -> Column:
    return F.coalesce(value.try_cast("boolean"), F.lit(False))


def as_timestamp(moment: datetime | str) -> Column:
    """The ``as_of`` argument of an operator as a literal."""
    if isinstance(moment, datetime):
        moment = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(moment).cast("timestamp")


def months_before(moment: datetime | str, months: int) -> Column:
    return as_timestamp(moment) - F.make_ym_interval(F.lit(0), F.lit(months))


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed, so .9 -> 1.1 is one second."""
    return F.unix_seconds(end) - F.unix_seconds(start)


def millis_between(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Float division; NULL when the denominator is zero or NULL."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def percentage(numerator: Column, denominator: Column, digits: int = 1) -> Column:
    """Rounded share in per cent, 0 when there is nothing to divide by."""
    share = F.bround(ratio(numerator, denominator) * 100, digits)
    return F.coalesce(share, F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def month_of(value: Column) -> Column:
    return F.date_format(value, "yyyyMM")


def to_millis(value: Column) -> Column:
    return F.date_trunc("MILLISECOND", value)


def readable_size(value: Column) -> Column:
    """Bytes as text with binary units, two decimals."""
    return _scaled(value, 1024.0, ["B", "KiB", "MiB", "GiB", "TiB", "PiB"])


def readable_quantity(value: Column) -> Column:
    """A count as text with decimal units, two decimals."""
    return _scaled(value, 1000.0, ["", "thousand", "million", "billion", "trillion", "quadrillion"])


def _scaled(value: Column, base: float, units: list[str]) -> Column:
    amount = value.cast("double")
    text = None
    for power in range(len(units) - 1, 0, -1):
        shown = F.concat(F.format_string("%.2f", amount / base**power), F.lit(f" {units[power]}"))
        condition = F.abs(amount) >= base**power
        text = F.when(condition, shown) if text is None else text.when(condition, shown)
    plain = F.format_string("%.2f", amount)
    return text.otherwise(F.concat(plain, F.lit(f" {units[0]}")) if units[0] else plain)


def query_shape(query: Column) -> Column:
    """Query text with string and number literals replaced, for grouping."""
    without_strings = F.regexp_replace(query, "'[^']*'", "?")
    without_numbers = F.regexp_replace(without_strings, r"\b[0-9]+(\.[0-9]+)?\b", "?")
    return F.trim(F.regexp_replace(without_numbers, r"\s+", " "))


def query_hash(query: Column) -> Column:
    return F.xxhash64(query_shape(query))
