"""Ingestion, coherence, the dead-address ledger and the streaming forms."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from varve import schema
from varve.operators import ingest
from varve.streaming import cdc

T0 = datetime(2026, 1, 1)


def listing(sku, price, day=0, arrival=0, **more):
    row = dict.fromkeys([n for n, _ in schema.columns(schema.LISTINGS)]) | {"store_id": "s", "sku": sku, "title": f"t {sku}", "url": "u", "price": price, "in_stock": True, "seen_at": T0 + timedelta(days=day), "arrival": arrival} | more
    return tuple(row.values())


def batch(spark, *rows):
    return ingest.clean(spark.createDataFrame(list(rows), schema.LISTINGS))


def empty(spark):
    return spark.createDataFrame([], schema.PRODUCTS)


def frozen(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_new_products_and_first_points(spark):
    b = batch(spark, listing("a", 10.0, description="<p>x &amp; y</p>", list_price=70.0, rating=4.0, rating_count=0), listing("b", 0.0), listing("c", 5.0, list_price=6.0))
    state = {r.sku: r for r in ingest.upsert(empty(spark), b).collect()}
    assert set(state) == {"a", "c"} and state["a"].description == "x & y" and state["a"].list_price is None and state["a"].rating is None and state["c"].list_price == 6
    assert state["a"].is_active and state["a"].first_seen_at == T0 and state["a"].condition == "new" and state["a"].currency == "CAD"
    assert ingest.points_of(empty(spark), b).count() == 2


def test_price_moves_only_when_it_changes_and_nulls_keep_what_is_known(spark):
    state = frozen(spark, ingest.upsert(empty(spark), batch(spark, listing("a", 10.0, description="old", model="M1", url="u1"))))
    near = batch(spark, listing("a", 10.004, 1, url="u2"))
    assert ingest.points_of(state, near).count() == 0
    r = ingest.upsert(state, near).first()
    assert (r.price, r.description, r.model, r.url, r.last_price_change_at, r.last_seen_at) == (10.0, "old", "M1", "u2", T0, T0 + timedelta(days=1))
    for change in ({"in_stock": False}, {"list_price": 12.0}, {"price": 9.0}):
        row = {"price": 10.0} | change
        got = batch(spark, listing("a", row.pop("price"), 2, **row))
        assert ingest.points_of(state, got).count() == 1
        assert ingest.upsert(state, got).first().last_price_change_at == T0 + timedelta(days=2)


def test_rows_of_one_key_in_a_batch_are_taken_in_order(spark):
    state = frozen(spark, ingest.upsert(empty(spark), batch(spark, listing("a", 10.0))))
    b = batch(spark, listing("a", 8.0, 1, 1), listing("a", 8.0, 1, 2), listing("a", 10.0, 1, 3))
    assert [r.price for r in ingest.points_of(state, b).orderBy("observed_at").collect()] == [8.0, 10.0]
    once = frozen(spark, ingest.upsert(state, b))
    assert once.first().price == 10.0
    assert ingest.upsert(once, batch(spark, listing("a", 10.0, 1, 4))).first().last_price_change_at == T0 + timedelta(days=1)
    other = ingest.upsert(state, batch(spark, listing("z", 1.0)))
    assert other.count() == 2 and other.filter("sku = 'a'").first().is_active


def test_retirement_and_quarantine(spark):
    state = ingest.upsert(empty(spark), batch(spark, listing("a", 1.0, 0, category_slug="x"), listing("b", 1.0, 10, category_slug="nope"), listing("c", 1.0, 10)))
    now = F.lit("2026-01-20").cast("timestamp")
    assert {r.sku: r.is_active for r in ingest.retire(state, now).collect()} == {"a": False, "b": True, "c": True}
    good, bad = ingest.quarantine(state, spark.createDataFrame([("x",)], "slug string"))
    assert {r.sku for r in good.collect()} == {"a", "c"} and {r.sku for r in bad.collect()} == {"b"}


def test_coherence(spark):
    rows = [(1, "s", "Boîte ouverte - TV", "AB-1", None, 4.0, 0), (2, "s", "TV", "ab 1", "p2", 4.0, 9), (3, "s", "tv", None, None, None, None), (4, "t", "TV", "AB1", None, None, None)]
    df = spark.createDataFrame(rows, "product_id long, store_id string, title string, model string, image_url string, rating double, rating_count long")
    got = {r.product_id: r for r in ingest.reconcile(df).collect()}
    assert got[1].image_url == "p2" and got[1].rating is None and got[1].variant_key == "tv" and got[1].model_key == "AB1"
    assert got[3].image_url == "p2" and got[4].image_url is None


def test_brands_and_dead_urls(spark):
    p = spark.createDataFrame([("s", "1", None), ("s", "2", "Own"), ("t", "1", None)], "store_id string, sku string, brand string")
    h = spark.createDataFrame([("s", "1", "B"), ("s", "1", "A"), ("s", "2", "X")], "store_id string, sku string, brand string")
    assert {(r.store_id, r.sku): r.brand for r in ingest.label_brands(p, h).collect()} == {("s", "1"): "A", ("s", "2"): "Own", ("t", "1"): None}
    now = F.lit("2026-03-01").cast("timestamp")
    day = lambda n: datetime(2026, 3, 1) - timedelta(days=n)
    failed = spark.createDataFrame([("s", "gone", True, day(1)), ("s", "once", False, day(1)), ("s", "twice", False, day(2)), ("s", "twice", False, day(1)), ("s", "old", True, day(40)), ("s", "back", True, day(5))], "store_id string, url string, certain boolean, failed_at timestamp")
    good = spark.createDataFrame([("s", "back", day(1))], "store_id string, url string, seen_at timestamp")
    assert {r.url for r in ingest.dead_urls(failed, good, now).collect()} == {"gone", "twice"}


def test_stream_of_changes_keeps_state_between_batches(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    kind = "key string, observed_at timestamp, price double, list_price double, in_stock boolean"

    def put(name, *rows):
        (source / name).write_text("\n".join(json.dumps({"key": k, "observed_at": (T0 + timedelta(days=d)).isoformat(), "price": p, "list_price": lp, "in_stock": s}) for k, d, p, lp, s in rows))
        query = cdc.changes(cdc.listing_stream(spark, str(source), kind)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    put("1.json", ("a", 0, 10.0, None, True), ("a", 1, 10.001, None, True), ("b", 0, 5.0, None, None))
    put("2.json", ("a", 2, 10.0, None, True), ("a", 3, 9.0, None, True), ("a", 0, 1.0, None, True), ("b", 1, 5.0, None, False))
    got = spark.read.parquet(out).orderBy("key", "observed_at").collect()
    assert [(r.key, r.price, r.in_stock) for r in got] == [("a", 10.0, True), ("a", 9.0, True), ("b", 5.0, None), ("b", 5.0, False)]


def test_stream_of_changes_keeps_all_changes_of_a_key_with_many_rows(spark, tmp_path):
    """More rows than Spark hands over at once, in no order of time."""
    rng = random.Random(8)
    n = 25_000
    prices = [float(rng.randrange(3)) for _ in range(n)]
    rows = [("hot", T0 + timedelta(minutes=k), p, None, True) for k, p in enumerate(prices)] + [("cold", T0, 1.0, None, None)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, cdc.OUT).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cdc.OUT).parquet(str(tmp_path / "in"))
    query = cdc.changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted((r.observed_at, r.price) for r in spark.read.parquet(str(tmp_path / "out")).filter("key = 'hot'").collect())
    assert got == [(T0 + timedelta(minutes=k), p) for k, p in enumerate(prices) if k == 0 or p != prices[k - 1]]


def test_streamed_upserts_are_versioned_and_replays_change_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    root, points = str(tmp_path / "state"), str(tmp_path / "points")
    names = [n for n, _ in schema.columns(schema.LISTINGS)]
    for k, rows in enumerate(([listing("a", 10.0), listing("b", 3.0)], [listing("a", 9.0, 1, 1)])):
        lines = [json.dumps({n: v.isoformat() if isinstance(v, datetime) else v for n, v in zip(names, r) if v is not None}) for r in rows]
        (source / f"{k}.json").write_text("\n".join(lines))
        cdc.merge_batches(cdc.listing_stream(spark, str(source), schema.LISTINGS), root, points, str(tmp_path / "cp"), schema.PRODUCTS, every=None).awaitTermination(120)
    version, path = cdc.latest(root, spark)
    state = {r.sku: r.price for r in spark.read.parquet(path).collect()}
    assert version == 1 and state == {"a": 9.0, "b": 3.0} and spark.read.parquet(points).count() == 3
    again = spark.createDataFrame([listing("a", 9.0, 1, 1)], schema.LISTINGS)
    cdc.merger(root, points, schema.PRODUCTS)(again, 1)
    assert {r.sku: r.price for r in spark.read.parquet(path).collect()} == state and spark.read.parquet(points).count() == 3


def test_upsert_takes_a_row_whole_and_not_column_by_column(spark):
    """What always follows the batch is one value to sort and shuffle, and so is what stays from the first."""
    state = spark.createDataFrame([], schema.PRODUCTS)
    batch = state.select(*(c for c in state.columns if c not in ("first_seen_at", "last_seen_at", "last_price_change_at", "is_active")), F.current_timestamp().alias("seen_at"), F.lit(1).cast("long").alias("arrival"))
    plan = ingest.upsert(state, batch)._jdf.queryExecution().analyzed().toString()
    assert plan.count("max_by(") == len(ingest.KEPT) + 1 and plan.count("min_by(") == 1
