"""Statistics of histories of which single keys hold more rows than a task should sort.

Rows are dealt out by ranges of (key, time), so that a key with a third of all rows has a third of the tasks; a row at
the end of its range learns the beginning of the next one from one row per (key, range). Weights are then summed per
(key, price). The weighted median is found in two steps: sums per range of prices tell which range it lies in, and
only that range's prices are looked at one by one. No window goes over a whole key but those over its ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.prices import EPSILON
from varve.staging import stage

from .timeseries import WINDOW_DAYS, finished, price_stats, weighed

#: A giant key has more rows than this and more than this share of all rows, so there are MOST_GIANTS of them at most.
GIANT_ROWS, MOST_GIANTS = 1_000_000, 10_000


def _with(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal columns in which null equals null; left's columns stay, and right's others."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    out = left.join(right, reduce(Column.__and__, (left[c].eqNullSafe(right[f"_right_{c}"]) for c in on)), how)
    return out.drop(*(f"_right_{c}" for c in on))


def dealt_intervals(points: DataFrame, key: str, at: str, now: Column, days: int = WINDOW_DAYS, source: str | None = None, order: list[str] | None = None) -> DataFrame:
    """As timeseries.intervals, with a key's rows dealt out by time. Rows of a key that agree in time and order stay together."""
    order = order or []
    spread = stage(points.repartitionByRange(key, at, *order).withColumn("_range", F.spark_partition_id()), "by-time")
    begins = spread.groupBy(key, "_range").agg(F.min(F.struct(at, *order)).alias("_first"))
    following = begins.withColumn("_next", F.lead("_first").over(Window.partitionBy(key).orderBy("_range"))).filter(F.col("_next").isNotNull())
    ends = following.select(key, "_range", F.col(f"_next.{at}").alias(at), F.lit(True).alias("_end"))
    rows = spread.withColumn("_end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    ahead = Window.partitionBy(key, "_range").orderBy("_end", at, *order)
    held = rows.withColumn("next_at", F.lead(at).over(ahead)).filter(~F.col("_end")).drop("_end", "_range")
    return weighed(held, at, now, days, source)


def weighted_median(sums: DataFrame, key: str, value: str, weight: str = "weight") -> DataFrame:
    """key and median: the first value up to which at least half of the key's weight lies.

    sums: one row per (key, value). Values without weight are no median. Null values weigh, before all others, but are
    no median either; a key whose other values weigh nothing has no row.
    """
    total = sums.groupBy(key).agg(F.sum(weight).alias("_total"), F.sum(F.when(F.col(value).isNull(), F.col(weight)).otherwise(0)).alias("_nulls"))
    some = sums.filter((F.col(weight) > 0) & F.col(value).isNotNull()).select(key, value, weight)
    spread = stage(some.repartitionByRange(key, value).withColumn("_range", F.spark_partition_id()), "by-value")
    ranges = spread.groupBy(key, "_range").agg(F.sum(weight).alias("_sum"))
    ranges = ranges.withColumn("_until", F.sum("_sum").over(Window.partitionBy(key).orderBy("_range")))
    reached = _with(ranges, total, [key]).filter((F.col("_until") + F.col("_nulls")) * 2 >= F.col("_total"))
    first = F.struct("_range", (F.col("_until") - F.col("_sum") + F.col("_nulls")).alias("_before"), "_total")
    there = reached.groupBy(key).agg(F.min(first).alias("_there")).select(key, "_there.*")
    rows = _with(spread, there, [key, "_range"])
    upward = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_running", F.sum(weight).over(upward) + F.col("_before"))
    return rows.filter(F.col("_running") * 2 >= F.col("_total")).groupBy(key).agg(F.min(value).alias("median"))


def dealt_price_stats(points: DataFrame, now: Column, key: str = "product_id", price: str = "price", at: str = "observed_at", list_price: str | None = None, current: str | None = None, source: str | None = None, days: int = WINDOW_DAYS, order: list[str] | None = None) -> DataFrame:
    """As timeseries.price_stats, with every key's history dealt out. current must be the same on all rows of a key.

    An empty table gives an empty result; a null key is a key.
    """
    order = order or []
    own = F.col("weight") > 0
    claimed = F.coalesce(F.col(list_price) > F.col(price), F.lit(False)) if list_price else F.lit(False)
    archived = F.coalesce(F.col(source) != "observed", F.lit(False)) if source else F.lit(False)
    needed = dict.fromkeys([key, price, at, *order, *(c for c in (list_price, current, source) if c)])
    rows = dealt_intervals(points.select(*needed), key, at, now, days, source, order)
    steps = rows.groupBy(F.col(key), F.col(price).alias("_price")).agg(
        F.sum("weight").alias("weight"),
        F.sum(F.when(claimed, F.col("weight")).otherwise(0)).alias("_claimed"),
        F.count_if(own).alias("_held"),
        F.count_if(archived).alias("_archived"),
        F.min(at).alias("_first_at"),
        F.max(F.struct(at, *order)).alias("_latest"),
        (F.max(current) if current else F.lit(None).cast("double")).alias("_given"),
    )
    steps = stage(steps, "by-price")
    last = F.max_by("_price", "_latest")
    nowadays = steps.groupBy(key).agg((F.max("_given") if current else last).alias("_current"))
    out = _with(steps, nowadays, [key]).groupBy(key).agg(
        F.max("_current").alias("current_price"),
        F.sum("weight").alias("_total"),
        F.sum(F.when(F.col("_price") < F.col("_current") - EPSILON, F.col("weight")).otherwise(0)).alias("_below"),
        F.sum("_claimed").alias("_claimed"),
        F.min(F.when(own, F.col("_price"))).alias("_low"),
        F.max(F.when(own, F.col("_price"))).alias("_high"),
        F.min("_price").alias("_lowest"),
        F.max("_price").alias("_highest"),
        last.alias("_last"),
        F.min("_first_at").alias("first_at"),
        F.sum("_held").alias("_held"),
        F.sum("_archived").alias("archive_points"),
    )
    medians = weighted_median(steps, key, "_price").withColumnRenamed("median", "_median")
    return finished(_with(out, medians, [key], "left"), now, key, days)


def price_stats_by_size(points: DataFrame, now: Column, key: str = "product_id", giant_rows: int = GIANT_ROWS, **of) -> DataFrame:
    """As timeseries.price_stats: giant keys' histories are dealt out, those of all others take one exchange."""
    counts = stage(points.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), "rows-per-key")
    n = counts.agg(F.sum("_rows")).first()[0] or 0
    giants = stage(counts.filter(F.col("_rows") > max(giant_rows, n // MOST_GIANTS)).select(key), "giant-keys")
    if giants.isEmpty():
        return price_stats(points, now, key, **of)
    named = F.broadcast(giants.withColumnRenamed(key, "_giant"))  # MOST_GIANTS keys at most
    is_giant = F.col(key).eqNullSafe(F.col("_giant"))
    others = price_stats(points.join(named, is_giant, "left_anti"), now, key, **of)
    return others.unionByName(dealt_price_stats(points.join(named, is_giant, "left_semi"), now, key, **of))
