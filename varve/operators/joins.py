"""Joins by keys that many rows lack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_by_known_key(rows: DataFrame, found: DataFrame, keys: list[str], spread: str = "product_id", unknown: Column | None = None) -> DataFrame:
    """rows left join found, for keys that are null in many rows. Those match nothing, yet by their keys alone they would
    all be sent to one task; they are dealt out by `spread` instead, and so are rows marked by `unknown`, which match nothing
    either. No column of either side may be named _spread."""
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.lit(False) if unknown is None else F.coalesce(unknown, F.lit(False)))
    dealt = rows.withColumn("_spread", F.when(unknown, F.xxhash64(spread)).otherwise(F.lit(0).cast("long")))
    return dealt.join(found.withColumn("_spread", F.lit(0).cast("long")), [*keys, "_spread"], "left").drop("_spread")
