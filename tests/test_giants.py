"""Histories that are dealt out against the form that sorts each key, and medians against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from varve.operators import giants, timeseries

NOW = datetime(2026, 6, 1, 12)
SCHEMA = "k string, at timestamp_ntz, n long, price double, list_price double, source string, now_price double, _running string"


def now():
    return F.lit("2026-06-01 12:00:00").cast("timestamp_ntz")


def rows(spark, seed=3):
    """A key with most rows, small ones, a null key, ties in time, null prices and list prices, rows after now."""
    rng = random.Random(seed)
    out = []
    for n in range(900):
        key = rng.choice(["big"] * 6 + ["a", "b", None])
        price = rng.choice([None, 10.0, 10.004, 12.5, 99.0, float(rng.randint(1, 400))])
        at = NOW - timedelta(hours=rng.randint(-30, 24 * 120))
        out.append((key, at, n, price, rng.choice([None, 50.0]), rng.choice(["observed", "observed", "archive", None]), {"big": 60.0, "a": 12.5}.get(key), "x"))
    out += [("one", NOW - timedelta(days=3), 1000, 5.0, None, "observed", 4.0, "x"), ("future", NOW + timedelta(days=3), 1001, 5.0, None, "observed", 4.0, "x"), ("unpriced", NOW - timedelta(days=2), 1002, None, None, "observed", 4.0, "x")]
    return spark.createDataFrame(out, SCHEMA)


def told(df):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_dealt_histories_equal_whole_ones(spark):
    df = rows(spark)
    of = dict(key="k", price="price", at="at", list_price="list_price", source="source", days=60, order=["n"])
    for current in (None, "now_price"):
        want = told(timeseries.price_stats(df, now(), current=current, **of))
        assert len(want) == 7 and told(giants.dealt_price_stats(df, now(), current=current, **of)) == want
        assert told(giants.price_stats_by_size(df, now(), giant_rows=100, current=current, **of)) == want
        assert told(giants.price_stats_by_size(df, now(), current=current, **of)) == want


def test_intervals_meet_over_the_ends_of_ranges(spark):
    df = rows(spark).select("k", "at", "n", "price")
    want = told(timeseries.intervals(df, "k", "at", now(), order=["n"]).select("k", "n", "next_at", "weight"))
    assert told(giants.dealt_intervals(df, "k", "at", now(), order=["n"]).select("k", "n", "next_at", "weight")) == want


def test_one_key_has_several_ranges(spark):
    df = spark.range(4000).select(F.lit("big").alias("k"), F.expr("timestamp_ntz '2026-05-01 00:00:00' + make_dt_interval(0, 0, id)").alias("at"), (F.col("id") % 1000).cast("double").alias("price"))
    spread = df.repartitionByRange("k", "at").withColumn("r", F.spark_partition_id())
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert spread.select("r").distinct().count() == 4
        assert told(giants.dealt_price_stats(df, now(), "k", at="at")) == told(timeseries.price_stats(df, now(), "k", at="at"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_no_window_sorts_a_whole_key(spark):
    df = rows(spark)
    plan = giants.dealt_intervals(df, "k", "at", now(), order=["n"])._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "Window [lead(at" in line]
    assert wide and all("_range" in line.rsplit(", [", 2)[1] for line in wide)


def test_empty_tables(spark):
    df = rows(spark).filter("false")
    of = dict(key="k", at="at", order=["n"])
    assert giants.price_stats_by_size(df, now(), **of).count() == 0
    assert giants.dealt_price_stats(df, now(), **of).count() == 0


def test_weighted_median(spark):
    rng = random.Random(9)
    data = [(k, v, rng.randint(0, 5)) for k in range(30) for v in rng.sample([None, *map(float, range(20))], rng.randint(1, 12))]
    got = {r.k: r.median for r in giants.weighted_median(spark.createDataFrame(data, "k int, v double, weight long"), "k", "v").collect()}
    want = {}
    for k in range(30):
        mine = sorted(((v, w) for kk, v, w in data if kk == k), key=lambda x: (x[0] is not None, x[0] or 0))
        total, running = sum(w for _, w in mine), 0
        for v, w in mine:
            running += w
            if v is not None and w and running * 2 >= total:
                want[k] = v
                break
    assert got == want
