"""Plausibility checks of a catalogue. Each check gives rows check, severity, subject, detail (a number); a run is
their union, the worst first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.staging import stage

SEVERITIES = ("severe", "suspect", "info")


def _rows(df: DataFrame, check: str, severity, subject, detail) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(check).alias("check"), col(severity).alias("severity"), col(subject).cast("string").alias("subject"), col(detail).cast("double").alias("detail"))


def same_counts(deals: DataFrame, least: int = 50, groups: int = 3) -> DataFrame:
    """Several categories with exactly the same number of deals: a filter that doesn't filter."""
    counts = deals.groupBy("category").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    shared = counts.groupBy("n").agg(F.array_sort(F.collect_list("category")).alias("categories")).filter(F.size("categories") >= groups)
    return _rows(shared, "same_counts", "severe", F.array_join("categories", ","), F.col("n"))


def hidden_conditions(deals: DataFrame, least: int = 100, top: int = 60) -> DataFrame:
    """Conditions with many deals of which none is among the first of the listings that should show them."""
    many = deals.groupBy("condition").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    best = [F.desc("score"), F.asc("product_id")]
    all_top = deals.orderBy(*best).limit(top).select("condition")
    used_top = deals.filter(F.col("condition") != "new").orderBy(*best).limit(top).select("condition")
    return _rows(many.join(all_top.union(used_top).distinct(), "condition", "left_anti"), "hidden_condition", "severe", F.col("condition"), F.col("n"))


def loose_groups(deals: DataFrame, least: int = 20, ratio: float = 40.0, worst: int = 5) -> DataFrame:
    """Peer groups whose prices can't belong together."""
    spread = deals.filter(F.col("peer_key").isNotNull()).groupBy("peer_key").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))
    wide = spread.withColumn("ratio", F.try_divide("high", "low")).filter((F.col("n") >= least) & (F.col("ratio") > ratio))
    return _rows(wide.orderBy(F.desc("ratio"), "peer_key").limit(worst), "loose_group", "suspect", F.col("peer_key"), F.col("ratio"))


def absurd_list_prices(products: DataFrame, ratio: float = 4.0, severe_above: int = 500) -> DataFrame:
    count = products.agg(F.count_if(F.col("list_price") > F.col("price") * ratio).alias("n")).filter("n > 0")
    return _rows(count, "absurd_list_price", F.when(F.col("n") > severe_above, "severe").otherwise("suspect"), "list_price", F.col("n"))


def empty_columns(products: DataFrame, columns: list[str], thin: float = 0.25) -> DataFrame:
    """Columns that are never or rarely filled, in one pass."""
    filled = products.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in columns))
    shares = filled.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.try_divide(F.col(c).cast("double"), F.col("_n")).alias("share")) for c in columns))).alias("x")).select("x.*")
    return _rows(shares.filter(F.col("share") < thin), "empty_column", F.when(F.col("share") == 0, "severe").otherwise("info"), F.col("column"), F.col("share"))


def unexplained_scores(deals: DataFrame, above: float = 45.0) -> DataFrame:
    n = deals.agg(F.count_if((F.col("score") > above) & (F.size(F.coalesce("reasons", F.array().cast("array<string>"))) == 0)).alias("n")).filter("n > 0")
    return _rows(n, "unexplained_score", "severe", "reasons", F.col("n"))


def without_peers(deals: DataFrame, most: float = 0.2) -> DataFrame:
    share = deals.agg(F.try_divide(F.count_if(F.col("peer_size").isNull()).cast("double"), F.count(F.lit(1))).alias("share"))
    return _rows(share.filter(F.col("share") > most), "without_peers", "suspect", "peer_key", F.col("share"))


def stale_data(runs: DataFrame, points: DataFrame, now: Column) -> DataFrame:
    """The last good run is a day or three days old; the longest history is short."""
    age = runs.filter(F.col("status").isin("ok", "partial")).agg(F.timestamp_diff("HOUR", F.max("finished_at"), now).alias("hours"))
    late = _rows(age.filter("hours > 24 or hours is null"), "stale_runs", F.when(F.col("hours") > 72, "severe").otherwise("suspect"), "runs", F.col("hours"))
    length = points.agg((F.timestamp_diff("HOUR", F.min("observed_at"), now) / 24).alias("days"))
    return late.unionByName(_rows(length.filter("days < 7"), "short_history", "info", "points", F.col("days")))


def empty_categories(categories: DataFrame, deals: DataFrame, most: int = 3) -> DataFrame:
    """Root categories without a deal in them or below."""
    roots = categories.filter(F.col("parent_slug").isNull()).select(F.col("slug").alias("root"))
    used = deals.select(F.col("category").alias("slug")).distinct().join(categories, "slug").select(F.coalesce("parent_slug", "slug").alias("root")).distinct()
    empty = roots.join(used, "root", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("root")), ",").alias("names"))
    return _rows(empty.filter(F.col("n") > most), "empty_categories", "info", F.col("names"), F.col("n"))


def idle_rules(hits: DataFrame) -> DataFrame:
    """Spec rules that matched nothing (rows of specs.rule_hits)."""
    return _rows(hits.filter("hits = 0"), "idle_rule", "suspect", F.concat_ws(":", "family", "pattern"), F.lit(0))


def paused_stores(stores: DataFrame, now: Column) -> DataFrame:
    return _rows(stores.filter(F.col("paused_until") > now), "paused_store", "severe", F.col("store_id"), F.col("consecutive_failures"))


def unseen_stores(products: DataFrame, now: Column, hours: int = 36) -> DataFrame:
    seen = products.groupBy("store_id").agg(F.max("last_seen_at").alias("seen")).withColumn("hours", F.timestamp_diff("HOUR", F.col("seen"), now))
    return _rows(seen.filter(F.col("hours") > hours), "unseen_store", "severe", F.col("store_id"), F.col("hours"))


def idle_cursors(products: DataFrame, cursors: DataFrame, least: int = 20_000) -> DataFrame:
    """Large catalogues of which no cursor has moved."""
    sizes = products.groupBy("store_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    moved = cursors.groupBy("store_id").agg(F.count_if((F.col("next_page") > 1) | (F.col("laps") > 0)).alias("moved"))
    return _rows(sizes.join(moved, "store_id", "left").filter(F.coalesce("moved", F.lit(0)) == 0), "idle_cursor", "suspect", F.col("store_id"), F.col("n"))


def report(*checks: DataFrame) -> DataFrame:
    """All findings, the worst first."""
    rank = F.when(F.col("severity") == "severe", 0).when(F.col("severity") == "suspect", 1).otherwise(2)
    return reduce(DataFrame.unionByName, checks).orderBy(rank, "check", "subject")


def verdict(findings: DataFrame) -> DataFrame:
    """One row: findings by severity and whether the run failed."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return findings.agg(*counts).withColumn("failed", F.col("severe") > 0)


def breaker(runs: DataFrame, most: int = 360, first: int = 5) -> DataFrame:
    """store_id, consecutive_failures, paused_until: after n failed runs in a row a store rests for
    first * 2^(n-1) minutes, `most` at the longest. Runs that stopped on their own (skipped) don't count."""
    counted = runs.filter(F.col("status") != "skipped")
    good = counted.filter(F.col("status") != "failed").groupBy("store_id").agg(F.max("finished_at").alias("_good"))
    failed = counted.filter(F.col("status") == "failed").join(good, "store_id", "left").filter(F.col("_good").isNull() | (F.col("finished_at") > F.col("_good")))
    out = failed.groupBy("store_id").agg(F.count(F.lit(1)).alias("consecutive_failures"), F.max("finished_at").alias("_last"))
    minutes = F.least(F.lit(most).cast("double"), first * F.pow(F.lit(2.0), F.least(F.col("consecutive_failures"), F.lit(30)) - 1))
    return out.withColumn("paused_until", F.col("_last") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))).drop("_last")


def run_accounting(runs: DataFrame) -> DataFrame:
    """Runs by store and status: ok without errors, partial with some results, failed without, skipped as marked."""
    status = F.when(F.col("skipped"), "skipped").when(F.col("error").isNull(), "ok").when(F.col("products_seen") > 0, "partial").otherwise("failed")
    return runs.withColumn("status", status).groupBy("store_id", "status").agg(F.count(F.lit(1)).alias("runs"), F.sum("products_seen").alias("products_seen"))


def time_shares(stores: DataFrame, budget: float, floor: float = 20.0) -> DataFrame:
    """Seconds for each store in order: its share of what is left of the budget by its part of the remaining products,
    `floor` at least. stores: store_id, products, place.

    What is left is summed by ranges of place: from the range's end to the store, and over all ranges behind it."""
    spread = stage(stores.repartitionByRange("place").withColumn("_range", F.spark_partition_id()), "by-place")
    sums = spread.groupBy("_range").agg(F.sum("products").alias("_sum"))
    behind = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    behind = sums.select("_range", F.coalesce(F.sum("_sum").over(behind), F.lit(0)).alias("_behind"))
    rest = Window.partitionBy("_range").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.coalesce(F.sum("products").over(rest), F.lit(0)) + F.col("_behind")
    met = spread.join(F.broadcast(behind), "_range")
    return met.withColumn("seconds", F.greatest(F.lit(floor), F.lit(budget) * F.try_divide(F.col("products"), left))).select(*stores.columns, "seconds")


def collection_order(sources: DataFrame, cursors: DataFrame) -> DataFrame:
    """Scopes to collect, the least covered first: fewer laps, then fewer pages; never collected ones lead."""
    at = cursors.select("store_id", "scope", "next_page", "laps")
    met = sources.join(at, ["store_id", "scope"], "left").withColumns({"laps": F.coalesce("laps", F.lit(0)), "next_page": F.coalesce("next_page", F.lit(1))})
    return met.orderBy("laps", "next_page", "store_id", "scope")


def stale_first(stores: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    """store_id, last_collected_at and place of the stores to collect next: those never collected, then the oldest.
    runs: store_id, finished_at."""
    last = runs.groupBy("store_id").agg(F.max("finished_at").alias("last_collected_at"))
    first = stores.join(last, "store_id", "left").orderBy(F.asc_nulls_first("last_collected_at"), "store_id").limit(limit)
    place = F.row_number().over(Window.orderBy(F.asc_nulls_first("last_collected_at"), "store_id"))  # over `limit` rows
    return first.withColumn("place", place)
