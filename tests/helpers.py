"""Hand-made tables for the tests."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from cdcmart.functions.derive import derive
from cdcmart.sources.schemas import TABLES

EMPTY = {"text": "", "uuid": "", "uuid?": None, "ts": datetime(1970, 1, 1), "ts?": None, "int": 0, "long": 0, "flag": False}


def uid(number: int) -> str:
    return f"00000000-0000-4000-8000-{number:012d}"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def message(op: str, row: dict | None, lsn: int) -> str:
    side = "before" if op == "d" else "after"
    return json.dumps({"op": op, side: row, "source": {"lsn": lsn}})


def messages(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "value string")


def change_table(spark: SparkSession, name: str, *rows: dict) -> DataFrame:
    """Change rows of a table; what a row leaves out has the type default."""
    spec = TABLES[name]
    plain = spec.stored_ddl().split(", ")[: len(spec.columns) + 2]
    data = []
    for i, row in enumerate(rows):
        values = [row.get(c, EMPTY[k]) for c, k in spec.columns.items()]
        data.append((*values, row.get("_version", i + 1), row.get("_is_deleted", False)))
    return derive(spark.createDataFrame(data, ", ".join(plain)), name)


def tables(spark: SparkSession, **given: list[dict]) -> dict[str, DataFrame]:
    return {name: change_table(spark, name, *given.get(name, [])) for name in TABLES}


def as_dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def as_set(df: DataFrame) -> set:
    columns = sorted(df.columns)
    return {tuple(r[c] for c in columns) for r in df.collect()}
