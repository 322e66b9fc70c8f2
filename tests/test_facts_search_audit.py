"""Fact fusion, text search, filters, facets and audits on small rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from varve import schema
from varve.operators import audit, filters, fusion, textsearch
from varve.operators.filters import DealFilters
from varve.operators.joins import left_by_known_key
from varve.plans import readmodel

NOW = datetime(2026, 3, 1)


def now():
    return F.lit("2026-03-01").cast("timestamp")


def facts(spark, *rows):
    names = [n for n, _ in schema.columns(schema.FACTS)]
    return spark.createDataFrame([tuple({**dict.fromkeys(names), "product_id": 1, "source": f"s{k}", "source_rank": k, "reliability": 0.9, **r}.values()) for k, r in enumerate(rows)], schema.FACTS)


def test_one_silent_and_agreeing_sources(spark):
    assert fusion.resolve(facts(spark, {"brand": "A"})).first().agreement == 0.6
    assert fusion.resolve(facts(spark, {"brand": "A"}, {"model": "M"})).first().agreement == 0.8
    r = fusion.resolve(facts(spark, {"brand": "Acme  Co", "rating": 4.0}, {"brand": "acme co", "rating": 4.1})).first()
    assert r.agreement == 1 and r.brand == "Acme  Co" and r.status == "ok" and r.conflicts == []


def test_two_weak_sources_beat_one_strong(spark):
    r = fusion.resolve(facts(spark, {"brand": "A", "reliability": 0.97}, {"brand": "B", "reliability": 0.6}, {"brand": "b", "reliability": 0.6})).first()
    assert r.brand == "B" and r.agreement == pytest.approx(2 / 3) and r.conflicts == ["brand differs: s0=A, s1=B, s2=b"]


def test_samples_are_never_merged(spark):
    r = fusion.resolve(facts(spark, {"recommend_yes": 9, "recommend_total": 10, "rating_count": 100}, {"recommend_yes": 50, "recommend_total": 100, "rating_count": 60, "manufacturer_price": 5.0})).first()
    assert (r.recommend_yes, r.recommend_total, r.rating_count, r.manufacturer_price) == (50, 100, 100, 5.0) and r.agreement == 0.5
    errors = spark.createDataFrame([(1, "x", "timeout")], "product_id long, source string, error string")
    assert fusion.resolve(facts(spark, {"brand": "A"}), errors).first().status == "partial"
    assert fusion.resolve(facts(spark, {})).first().status == "failed"


def test_products_that_every_source_failed_at_are_told(spark):
    errors = spark.createDataFrame([(1, "x", "timeout"), (2, "y", "403"), (2, "x", None)], "product_id long, source string, error string")
    one, two = fusion.resolve(facts(spark, {"rating": 4.0}, {"rating": 3.0}), errors).orderBy("product_id").collect()
    assert one.conflicts == ["rating differs: s0=4.0, s1=3.0", "x: timeout"] and (one.status, one.agreement) == ("partial", 0.0)
    assert (two.product_id, two.sources, two.agreement, two.conflicts, two.status) == (2, [], 0.0, ["x", "y: 403"], "failed")


def test_whole_facts_come_from_the_first_source_that_has_them(spark):
    rows = facts(spark, {"manufacturer_price": 0.0}, {"manufacturer_price": 9.0}, {"manufacturer_price": 8.0}).withColumns(
        {"manufacturer_name": F.concat(F.lit("by "), "source"), "reviews": F.when(F.col("source_rank") > 1, F.array(F.lit("good")))}
    )
    r = fusion.resolve(rows).first()
    assert (r.manufacturer_price, r.manufacturer_name, r.reviews, r.status) == (9.0, "by s1", ["good"], "ok")
    assert fusion.resolve(rows.filter("false")).count() == 0


def test_addresses_are_found_by_contained_model(spark):
    sites = spark.createDataFrame([("Acme", "XX65ABC900CA", "long"), ("Acme", "65ABC900", "short"), ("Other", "65ABC900", "no"), ("Acme", "QN77ZZZZ1", "none")], "brand string, url_key string, url string")
    items = spark.createDataFrame([(1, "acme", "65-ABC900"), (2, "Acme", "ABC9"), (3, "Acme", "nope99")], "product_id long, brand string, model string")
    assert {r.product_id: r.url for r in fusion.locate_by_key(sites, items).collect()} == {1: "short", 2: "short"}


def test_search_needs_every_token_and_a_prefix(spark):
    docs = spark.createDataFrame([(1, "Téléviseur OLED 65", "Acme"), (2, "Téléviseur DEL", "Acme"), (3, "Support télé oled", "Bob"), (4, None, None)], "id long, title string, brand string")
    index, stats = textsearch.postings(docs, "id", ["title", "brand"]), textsearch.statistics(docs, ["title", "brand"])
    found = lambda q: {r.doc for r in textsearch.match(index, stats, q).collect()}
    assert found("oled tele") == {1, 3} and found("TÉLÉVISEUR acm") == {1, 2} and found("?! a") == set() and found("tele oled") == {1, 3} - {1}
    assert all(r.bm25 <= 0 for r in textsearch.match(index, stats, "acme").collect())


def deals(spark, rows):
    kind = "product_id long, brand string, category string, price double, score double, is_active boolean, is_variant_lead boolean, condition string, store_id string, seller_name string, in_stock boolean"
    return spark.createDataFrame([(k, b, "c", float(p), 50.0, True, True, "new", "s", None, None) for k, (b, p) in enumerate(rows)], kind)


def test_a_checked_value_doesnt_hide_its_siblings(spark):
    d = deals(spark, [("A", 1)] * 4 + [("B", 2)] * 3 + [("C", 3)] * 2)
    specs = spark.createDataFrame([(k, "ram", f"{8 * (1 + k % 2)} Go", str(8 * (1 + k % 2)), 8.0 * (1 + k % 2)) for k in range(9)] + [(k, "hdr", "HDR", "hdr", None) for k in range(9)], "product_id long, family string, label string, value string, metric double")
    got = readmodel.facets(d, DealFilters(brands=("a",)), specs).collect()
    assert {r.value: r.n for r in got if r.facet == "brand"} == {"a": 4, "b": 3}
    assert {r.value for r in got if r.facet == "spec:ram"} == set() and not any(r.facet == "spec:hdr" for r in got)
    assert {r.value: r.metric for r in got if r.facet == "price"} == {"min": 1, "max": 1}
    got = readmodel.facets(d, DealFilters(specs={"ram": ("8",)}), specs).collect()
    assert [(r.value, r.n) for r in sorted((r for r in got if r.facet == "spec:ram"), key=lambda r: r.place)] == [("8", 5), ("16", 4)]


def test_filters_from_and_to_addresses():
    f = DealFilters.from_query("brands=A,b&f_ram=8,16&min=10&max=-1&condition=odd&sort=price-asc")
    assert f.brands == ("a", "b") and f.specs == {"ram": ("8", "16")} and f.min_price == 10 and f.max_price is None and f.condition == "new" and f.sort == "price-asc"
    assert f.without("spec:ram").specs == {} and f.without("price").min_price is None and f.without("brands").brands == ()
    assert filters.toggled("f_ram=8&page=3", "f_ram", "16") == "f_ram=8%2C16" and filters.toggled("f_ram=8", "f_ram", "8") == ""
    assert filters.safe_return_path("/a?b") == "/a?b" and filters.safe_return_path("//evil") == "/" and filters.safe_return_path(None) == "/"


def test_audit_finds_what_is_seeded_and_nothing_else(spark):
    items = spark.createDataFrame([("s", NOW - timedelta(hours=40), 10.0, 50.0, "x"), ("t", NOW, 10.0, None, None)], "store_id string, last_seen_at timestamp, price double, list_price double, brand string")
    stores = spark.createDataFrame([("s", NOW + timedelta(hours=1), 4), ("t", None, 0)], "store_id string, paused_until timestamp, consecutive_failures int")
    hits = spark.createDataFrame([("ram", "p", 0), ("cpu", "q", 3)], "family string, pattern string, hits long")
    found = audit.report(audit.unseen_stores(items, now()), audit.paused_stores(stores, now()), audit.absurd_list_prices(items), audit.idle_rules(hits), audit.empty_columns(items, ["brand", "price"]))
    assert [(r.check, r.severity) for r in found.collect()] == [("paused_store", "severe"), ("unseen_store", "severe"), ("absurd_list_price", "suspect"), ("idle_rule", "suspect")]
    assert audit.verdict(found).first().failed
    clean = audit.report(audit.unseen_stores(items.filter("store_id = 't'"), now()), audit.idle_rules(hits.filter("hits > 0")))
    assert clean.count() == 0 and not audit.verdict(clean).first().failed


def test_breaker_doubles_its_pause(spark):
    at = lambda h: NOW - timedelta(hours=h)
    runs = spark.createDataFrame([("a", "ok", at(9)), ("a", "failed", at(3)), ("a", "skipped", at(2)), ("a", "failed", at(1)), ("b", "failed", at(5)), ("b", "ok", at(1))] + [("c", "failed", at(k)) for k in range(1, 12)], "store_id string, status string, finished_at timestamp")
    got = {r.store_id: (r.consecutive_failures, r.paused_until) for r in audit.breaker(runs).collect()}
    assert got == {"a": (2, at(1) + timedelta(minutes=10)), "c": (11, at(1) + timedelta(minutes=360))}


def test_root_categories_without_deals_are_told(spark):
    tree = spark.createDataFrame([(r, None) for r in "abcdef"] + [("a1", "a"), ("c1", "c")], "slug string, parent_slug string")
    found = lambda *used: [(r.subject, r.detail) for r in audit.empty_categories(tree, spark.createDataFrame([(c,) for c in used], "category string")).collect()]
    assert found("a1", "a1", "b", "unknown") == [("c,d,e,f", 4.0)] and found("a1", "b", "c1") == []


def test_empty_categories_are_audited_over_all_deals(spark, tmp_path):
    from varve import catalogue

    sf = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{sf}/part.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    part.filter("p_partkey > 2").write.parquet(str(tmp_path / "part.parquet"))  # none of the two products that were looked at
    query = catalogue.queries()["aud_empty_categories"]
    assert [(r.subject.count(","), r.detail) for r in query(spark, str(tmp_path)).collect()] == [(3, 4.0)]


def test_home_sections_have_their_own_limits(spark):
    from varve.plans import readmodel

    rows = [(k, 50.0 + k, 0.9, 1.0, "new" if k < 40 else "open-box", True, True, True) for k in range(80)]
    deals = spark.createDataFrame(rows, "product_id long, score double, confidence double, price double, condition string, is_active boolean, is_variant_lead boolean, is_lowest_ever boolean")
    got = {r.section: r["count"] for r in readmodel.home_sections(deals).groupBy("section").count().collect()}
    assert got == {"lowest": 10, "verified": 10, "used": 10, "best": 30}


def test_category_ranks_match_brute_force(spark):
    rng = random.Random(5)
    quality = [rng.choice([None, -0.25, 0.0, 1.0, 3.5, *(rng.random() for _ in range(12)), *(0.5 + rng.random() / 5000 for _ in range(8))]) for _ in range(600)]
    rows = [(k, "hot" if k % 3 else f"c{k % 12}", q) for k, q in enumerate(quality)] + [(900, "rare", 0.5), (901, None, 0.5)]
    got = {r.product_id: (r.quality_rank, r.rated) for r in readmodel.category_ranks(spark.createDataFrame(rows, "product_id long, category string, quality_score double")).collect()}
    want = {}
    for k, c, q in rows:
        peers = [p for _, d, p in rows if d == c and p is not None]
        if c is not None and q is not None and len(peers) >= 5:
            want[k] = (1 + sum(p > q for p in peers), len(peers))
    assert got == want


def test_rows_without_a_key_stay_and_match_nothing(spark):
    rows = spark.createDataFrame([(k, None if k % 3 else "a", "" if k % 2 else "b") for k in range(30)] + [(99, "a", "b")], "product_id long, x string, y string")
    found = spark.createDataFrame([("a", "b", 7), ("a", "", 8), (None, "b", 9)], "x string, y string, n int")
    got = {r.product_id: r.n for r in left_by_known_key(rows, found, ["x", "y"]).collect()}
    assert got == {**{k: None if k % 3 else 8 if k % 2 else 7 for k in range(30)}, 99: 7}
    marked = left_by_known_key(rows, found, ["x", "y"], unknown=F.col("y") == "")
    assert {r.product_id: r.n for r in marked.collect()} == {k: None if n == 8 else n for k, n in got.items()}


def test_model_keys_are_found_in_addresses_as_by_brute_force(spark):
    rng = random.Random(9)
    word = lambda a, b: "".join(rng.choice("abc1") for _ in range(rng.randint(a, b)))
    sites = [(rng.choice(["X", "x", "y"]), word(6, 20), f"u{k}") for k in range(200)] + [("x", "abcdabcd", "u"), ("x", None, "v")]
    items = [(k, rng.choice(["x", "Y", "z"]), rng.choice([word(2, 6), sites[rng.randrange(200)][1][:9].upper(), sites[rng.randrange(200)][1]])) for k in range(300)] + [(900, "x", None), (901, None, "abcd"), (902, "x", "AB-CD")]
    got = fusion.locate_by_key(spark.createDataFrame(sites, "brand string, url_key string, url string"), spark.createDataFrame(items, "product_id long, brand string, model string"))
    want = {}
    for k, brand, model in items:
        key = (model or "").lower().replace("-", "")
        found = [(len(u), url) for b, u, url in sites if u and len(u) >= 8 and brand and b.lower() == brand.lower() and len(key) >= 4 and key in u]
        if found:
            want[k] = min(found)[1]
    assert len(want) > 80 and {r.product_id: r.url for r in got.collect()} == want


def test_time_shares_of_very_many_stores(spark):
    import time

    n = 60_000
    stores = spark.range(n).select(F.col("id").alias("store_id"), (F.col("id") * 7 % 11).alias("products"), (F.col("id") * 7919 % n).alias("place"))
    began = time.monotonic()
    got = {r.place: r.seconds for r in audit.time_shares(stores, 1e9, 20.0).collect()}
    assert time.monotonic() - began < 40  # 1.8e9 steps if what is left is summed anew for each store
    left, at = 0, {k * 7919 % n: k * 7 % 11 for k in range(n)}
    for place in sorted(at, reverse=True):
        left += at[place]
        want = max(20.0, 1e9 * (at[place] / left)) if left else 20.0
        assert abs(got[place] - want) <= 1e-9 * want
