"""Dimension lookups with defaults on a miss.

No broadcast is forced: a dimension grows with the data, so its size is checked
by the planner (``spark.sql.autoBroadcastJoinThreshold``) and again at run time
by adaptive execution; beyond it the join shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(
    df: DataFrame,
    dimension: DataFrame,
    on: Mapping[str, str],
    attributes: Mapping[str, object],
    prefix: str = "",
) -> DataFrame:
    """Left join ``attributes`` (name -> default on a miss) of ``dimension``.

    ``on`` maps a column of ``df`` to the key column of the dimension, which
    must hold one row per key.
    """
    side = dimension.select(
        *[F.col(k).alias(f"_dim_{k}") for k in on.values()],
        *[F.col(a).alias(f"_val_{a}") for a in attributes],
    )
    condition = None
    for left, right in on.items():
        equal = df[left] == side[f"_dim_{right}"]
        condition = equal if condition is None else condition & equal
    found = df.join(side, condition, "left")
    values = []
    for name, default in attributes.items():
        value = F.col(f"_val_{name}")
        if default is not None:
            value = F.coalesce(value, F.lit(default).cast(dimension.schema[name].dataType))
        values.append(value.alias(prefix + name))
    return found.select(*[df[c] for c in df.columns], *values)
