"""Statistics of change-only price histories.

A row of a history is the beginning of an interval that lasts until the next row (the last one until `now`), so
every statistic is weighted by duration. All windows and the aggregate share the key's partitioning: one shuffle.
Only the key's own columns travel; nothing is collected per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.prices import EPSILON, clamp

WINDOW_DAYS, ARCHIVE_DAYS, DAY = 90, 10, 86_400_000_000
LEAST_DAYS_FOR_LOWEST = 3


def micros(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def intervals(points: DataFrame, key: str, at: str, now: Column, days: int = WINDOW_DAYS, source: str | None = None, order: list[str] | None = None) -> DataFrame:
    """points with next_at and weight: the microseconds that each row's price held within the window, 0 if none.
    source: column of the row's origin; rows that weren't observed count for ARCHIVE_DAYS at most."""
    ahead = Window.partitionBy(key).orderBy(at, *(order or []))
    return weighed(points.withColumn("next_at", F.lead(at).over(ahead)), at, now, days, source)


def weighed(held: DataFrame, at: str, now: Column, days: int = WINDOW_DAYS, source: str | None = None) -> DataFrame:
    """Rows that know their next_at, with weight."""
    begin = F.greatest(F.col(at), now - F.make_dt_interval(F.lit(days)))
    end = F.least(F.coalesce("next_at", now), now)
    if source:
        end = F.when(F.coalesce(F.col(source), F.lit("observed")) != "observed", F.least(end, begin + F.make_dt_interval(F.lit(ARCHIVE_DAYS)))).otherwise(end)
    return held.withColumn("weight", F.greatest(micros(begin, end), F.lit(0)).cast("long"))


def price_stats(points: DataFrame, now: Column, key: str = "product_id", price: str = "price", at: str = "observed_at", list_price: str | None = None, current: str | None = None, source: str | None = None, days: int = WINDOW_DAYS, order: list[str] | None = None) -> DataFrame:
    """One row per key: current_price, median (first price whose running weight reaches half), percentile (share of
    time strictly below the current price), claim_share (share of time with a list price above the price),
    min/max in the window and ever, changes, days_observed, days_spanned and archive_points.

    current: column with the key's current price; by default the price of its last row. A key without any time in
    the window gets neutral statistics: its last price as median, percentile 0.5, zeros, and extremes without the
    current price.
    """
    order = order or []
    whole = Window.partitionBy(key)
    cheapest_first = whole.orderBy(price, at, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max_by(price, F.struct(at, *order))
    rows = intervals(points, key, at, now, days, source, order)
    rows = rows.withColumn("_current", F.col(current) if current else last.over(whole)).withColumn("_total", F.sum("weight").over(whole))
    rows = rows.withColumn("_reached", (F.sum("weight").over(cheapest_first) * 2 >= F.col("_total")) & (F.col("weight") > 0))
    own = F.col("weight") > 0
    claimed = F.coalesce(F.col(list_price) > F.col(price), F.lit(False)) if list_price else F.lit(False)
    archived = F.coalesce(F.col(source) != "observed", F.lit(False)) if source else F.lit(False)
    out = rows.groupBy(key).agg(
        F.max("_current").alias("current_price"),
        F.max("_total").alias("_total"),
        F.min(F.when(F.col("_reached"), F.col(price))).alias("_median"),
        F.sum(F.when(F.col(price) < F.col("_current") - EPSILON, F.col("weight")).otherwise(0)).alias("_below"),
        F.sum(F.when(claimed, F.col("weight")).otherwise(0)).alias("_claimed"),
        F.min(F.when(own, F.col(price))).alias("_low"),
        F.max(F.when(own, F.col(price))).alias("_high"),
        F.min(price).alias("_lowest"),
        F.max(price).alias("_highest"),
        last.alias("_last"),
        F.min(at).alias("first_at"),
        F.count_if(own).alias("_held"),
        F.count_if(archived).alias("archive_points"),
    )
    return finished(out, now, key, days)


def finished(out: DataFrame, now: Column, key: str, days: int) -> DataFrame:
    """The statistics from the sums and extremes of each key."""
    some = F.col("_total") > 0
    either = lambda a, b: F.when(some, a).otherwise(b)
    share = lambda c, none: either(F.col(c).cast("double") / F.col("_total"), F.lit(none))
    begin = F.greatest("first_at", now - F.make_dt_interval(F.lit(days)))
    return out.select(
        key, "current_price",
        either(F.col("_median"), F.col("_last")).alias("median"),
        share("_below", 0.5).alias("percentile"),
        share("_claimed", 0.0).alias("claim_share"),
        either(F.col("_low"), F.col("_last")).alias("min_in_window"),
        either(F.col("_high"), F.col("_last")).alias("max_in_window"),
        either(F.least("_lowest", "current_price"), F.col("_lowest")).alias("min_ever"),
        either(F.greatest("_highest", "current_price"), F.col("_highest")).alias("max_ever"),
        F.least("_lowest", "current_price").alias("min_all_time"),
        F.greatest("_highest", "current_price").alias("max_all_time"),
        either(micros(begin, now).cast("double") / DAY, F.lit(0.0)).alias("days_observed"),
        (micros(F.col("first_at"), now).cast("double") / DAY).alias("days_spanned"),
        either(F.col("_held") - 1, F.lit(0).cast("long")).alias("changes"),
        "archive_points",
    )


def drop_vs_median(stats: DataFrame) -> DataFrame:
    """stats with drop_vs_median and is_lowest_ever (which takes a change and some days of hindsight)."""
    drop = F.when(F.col("median") > 0, (F.col("median") - F.col("current_price")) / F.col("median")).otherwise(0.0)
    lowest = (F.col("current_price") <= F.col("min_ever") + EPSILON) & (F.col("changes") > 0) & (F.col("days_observed") >= LEAST_DAYS_FOR_LOWEST)
    return stats.withColumn("drop_vs_median", drop).withColumn("is_lowest_ever", lowest)


def changes_only(observations: DataFrame, key: str, at: str, price: str, list_price: str | None = None, in_stock: str | None = None, order: list[str] | None = None) -> DataFrame:
    """The rows at which price or list price changes by EPSILON or the stock state changes; a key's first row stays."""
    before = Window.partitionBy(key).orderBy(at, *(order or []))
    same = F.abs(F.col(price) - F.lag(price).over(before)) < EPSILON
    for c in filter(None, [list_price]):
        was = F.lag(c).over(before)
        same = same & (F.col(c).eqNullSafe(was) | F.coalesce(F.abs(F.col(c) - was) < EPSILON, F.lit(False)))
    if in_stock:
        same = same & F.col(in_stock).eqNullSafe(F.lag(in_stock).over(before))
    marked = observations.withColumn("_same", F.coalesce(same, F.lit(False)) & F.lag(at).over(before).isNotNull())
    return marked.filter(~F.col("_same")).drop("_same")


def history(points: DataFrame, key: str, value, at: str = "observed_at") -> DataFrame:
    """One key's rows in the order of time."""
    return points.filter(F.col(key) == value).orderBy(at)


def chart_steps(points: DataFrame, now: Column, key: str = "product_id", price: str = "price", at: str = "observed_at", order: list[str] | None = None) -> DataFrame:
    """Steps of a chart: each row with the end of its step, the last one ending now; keys with one row have none.
    is_low and is_high mark the extremes."""
    whole = Window.partitionBy(key)
    ahead = whole.orderBy(at, *(order or []))
    rows = points.withColumn("until", F.coalesce(F.lead(at).over(ahead), now)).withColumn("_n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("is_low", F.col(price) == F.min(price).over(whole)).withColumn("is_high", F.col(price) == F.max(price).over(whole))
    return rows.filter("_n > 1").drop("_n")


def freshness(seen: DataFrame, key: str, at: str, now: Column) -> DataFrame:
    """Last time seen, hours since and rows of each key."""
    out = seen.groupBy(key).agg(F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("rows"))
    return out.withColumn("hours_since", F.timestamp_diff("HOUR", F.col("last_seen"), now))


def confidence_of_history(days_observed: Column) -> Column:
    return clamp(days_observed / 30)
