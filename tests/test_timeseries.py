"""Properties of histories, quality, scores and tiers, by small fixtures with a fixed clock."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from varve.operators import peers, scoring, specs, timeseries

NOW = datetime(2026, 6, 1, 12)
POINTS = "product_id long, price double, list_price double, observed_at timestamp_ntz, source string"


def now():
    return F.lit("2026-06-01 12:00:00").cast("timestamp_ntz")


def points(spark, *rows):
    """rows: product, days ago, price, list price or None, source."""
    data = [(r[0], float(r[2]), r[3] if len(r) > 3 else None, NOW - timedelta(days=r[1]), r[4] if len(r) > 4 else "observed") for r in rows]
    return spark.createDataFrame(data, POINTS)


def stats(spark, *rows, current=None, **options):
    df = points(spark, *rows)
    if current is not None:
        df = df.withColumn("now_price", F.lit(float(current)))
        options["current"] = "now_price"
    return timeseries.price_stats(df, now(), list_price="list_price", **options).first()


def test_median_goes_by_time_not_by_rows(spark):
    s = stats(spark, (1, 80, 899), (1, 2 / 24, 799), current=799)
    assert s.median == 899 and s.percentile < 0.01


def test_percentile_is_a_share_of_time(spark):
    assert 0.45 < stats(spark, (1, 60, 100), (1, 30, 200), (1, 0.01, 150), current=150).percentile < 0.55


def test_what_ended_before_the_window_doesnt_count(spark):
    s = stats(spark, (1, 200, 50), (1, 10, 300), current=300)
    assert s.min_in_window == 50 and s.days_observed <= 90.01
    s = stats(spark, (1, 200, 50), (1, 100, 300), current=300)
    assert s.min_in_window == 300 and s.min_ever == 50


def test_a_point_at_this_moment_gives_neutral_statistics(spark):
    s = stats(spark, (1, 0, 70), current=60)
    assert (s.median, s.percentile, s.changes, s.days_observed, s.min_ever, s.min_all_time) == (70, 0.5, 0, 0, 70, 60)


def test_archived_points_count_for_ten_days(spark):
    rows = timeseries.intervals(points(spark, (1, 60, 100, None, "archive"), (1, 1, 90)), "product_id", "observed_at", now(), source="source").orderBy("observed_at").collect()
    assert [r.weight / timeseries.DAY for r in rows] == [10, 1]


def test_no_points_no_row(spark):
    assert timeseries.price_stats(points(spark).filter("false"), now()).count() == 0


def test_changes_only_keeps_what_differs(spark):
    rows = [("a", 1, 10.0, None, True), ("a", 2, 10.004, None, True), ("a", 3, 10.0, None, False), ("a", 4, 10.0, 12.0, False), ("a", 5, 9.0, 12.0, False), ("b", 1, None, None, None), ("b", 2, None, None, None)]
    df = spark.createDataFrame(rows, "k string, t int, p double, l double, s boolean")
    assert sorted((r.k, r.t) for r in timeseries.changes_only(df, "k", "t", "p", "l", "s").collect()) == [("a", 1), ("a", 3), ("a", 4), ("a", 5), ("b", 1), ("b", 2)]


def test_wilson(spark):
    df = spark.createDataFrame([(991, 1054), (1, 1), (300, 1000), (90, 100), (900, 1000), (9, 10), (0, 0)], "y long, n long")
    w = [r.w for r in df.select(scoring.wilson(F.col("y"), F.col("n")).alias("w")).collect()]
    assert w[0] > 0.9 and w[1] < 0.45 and w[2] < 0.32 and w[5] < w[3] < w[4] and w[6] == 0
    assert w[0] == pytest.approx(0.930, abs=1e-3)


BASE = {
    "product_id": 1, "price": 500.0, "list_price": None, "in_stock": True, "rating": None, "rating_count": None, "condition": "new", "recommend_yes": None, "recommend_total": None,
    "peer_percentile": None, "peer_median": None, "peer_size": None, "peer_below": None, "peer_cohesion": None, "peer_outlier": None, "peer_p90": None, "global_mean_rating": 4.4,
}
PEER = {"peer_percentile": 0.1, "peer_median": 1000.0, "peer_size": 60, "peer_below": 0.4, "peer_cohesion": 1.0, "peer_outlier": False, "peer_p90": 1600.0}
KINDS = "product_id long, " + ", ".join(f"{k} {scoring.INPUTS[k]}" for k in BASE if k != "product_id")


def score(spark, history=((60, 800), (30, 800), (0.5, 500)), **changes):
    row = BASE | changes
    product = spark.createDataFrame([tuple(row.values())], KINDS)
    s = timeseries.price_stats(points(spark, *((1, d, p, row["list_price"]) for d, p in history)).withColumn("c", F.lit(row["price"])), now(), list_price="list_price", current="c").drop("current_price")
    return scoring.score(product.join(s, "product_id")).first()


def test_quality_multiplies(spark):
    good, bad = (score(spark, recommend_yes=y, recommend_total=1000).score for y in (950, 250))
    assert bad < 0.55 * good


def test_a_claim_without_history_is_penalised(spark):
    s = score(spark, history=((60, 500), (30, 500)), list_price=1000.0, recommend_yes=900, recommend_total=1000)
    assert s.fake_deal_penalty > 0 and s.score < 30 and "claimed discount not confirmed by the history" in s.reasons


def test_lowest_ever_takes_hindsight(spark):
    assert not score(spark, history=((0.25, 600), (0.04, 500))).is_lowest_ever
    assert score(spark, history=((40, 800), (20, 700), (1, 500))).is_lowest_ever


def test_confidence_grows_with_history(spark):
    assert score(spark, history=((80, 800), (40, 800), (2, 500))).confidence > score(spark, history=((1, 800), (0.5, 500))).confidence


def test_stock_and_condition(spark):
    whole = score(spark).score
    assert score(spark, in_stock=False).score < 0.4 * whole
    assert 0.7 * whole < score(spark, condition="open-box").score < whole


def test_peers_help_at_a_cold_start_and_loose_ones_are_mute(spark):
    cold = {"history": ((0.1, 600),), "price": 600.0}
    alone, near, loose = score(spark, **cold), score(spark, **cold, **PEER), score(spark, **cold, **(PEER | {"peer_cohesion": 0.0}))
    assert near.score > alone.score and near.confidence > alone.confidence and loose.score < near.score
    odd = score(spark, history=((0.1, 60),), price=60.0, **(PEER | {"peer_below": 0.86, "peer_outlier": True}))
    assert odd.score < score(spark, history=((0.1, 60),), price=60.0, **(PEER | {"peer_below": 0.86})).score and not any("comparable products" in r for r in odd.reasons)


def test_no_signal_is_a_low_score(spark):
    assert 0 <= score(spark, history=((0, 500),)).score < 25


@pytest.mark.parametrize("price, list_price, p50, p90, size, below, votes, penalised", [(1499, 2999, 1450, 1900, 200, -0.03, (110, 115), True), (999, 1500, 1450, 1900, 200, 0.31, (110, 115), False), (560, 800, 580, 640, 60, 0.03, (44, 44), True)])
def test_list_prices_against_peers(spark, price, list_price, p50, p90, size, below, votes, penalised):
    peer = PEER | {"peer_median": float(p50), "peer_p90": float(p90), "peer_size": size, "peer_below": below, "peer_percentile": 0.1 if below > 0.1 else 0.5}
    s = score(spark, history=((0.5, price),), price=float(price), list_price=float(list_price), recommend_yes=votes[0], recommend_total=votes[1], **peer)
    assert (s.fake_deal_penalty > 0) == penalised
    assert s.score < 45 if penalised else s.score > 45
    assert s.score > 5


def test_peer_stats_edges(spark):
    rows = [(k, "small", float(k), "new") for k in range(4)] + [(10 + k, "five", 100.0, "new") for k in range(5)] + [(20 + k, "used", p, "new" if k < 2 else "used") for k, p in enumerate((10.0, 20.0, 30.0, 40.0, 900.0))]
    rows += [(30 + k, "out", p, "new") for k, p in enumerate((1.0, 50.0, 60.0, 70.0, 80.0, 90.0))]
    df = spark.createDataFrame([r for r in rows if r[2] > 0], "product_id long, peer_key string, price double, condition string")
    got = {r.product_id: r for r in peers.peer_stats(df, is_new=F.col("condition") == "new").collect()}
    assert not any(k in got for k in range(4))
    assert [got[10 + k].peer_percentile for k in range(5)] == [0, 0.25, 0.5, 0.75, 1]
    assert got[20].peer_median == 30.0 and got[30].peer_outlier and not got[31].peer_outlier
    assert got[10].peer_cohesion == 1 and got[24].peer_p90 == 40.0


@pytest.mark.parametrize("title, brand, token", [
    ("Haut-parleur de plafond", None, "haut-parleur"), ("Téléviseur intelligent", None, "televiseur"), ("Apple MacBook Air", "Apple", "macbook"), ("Boîte ouverte - Friteuse", None, "friteuse"),
    ("Remis à neuf (Très bon état) - Aspirateur robot", None, "aspirateur"), ("(Boite ouverte) - Moniteur", None, "moniteur"), ("", None, "inconnu"),
])
def test_type_token(spark, title, brand, token):
    df = spark.createDataFrame([(title, brand)], "t string, b string")
    assert df.select(peers.type_token(F.col("t"), F.col("b")).alias("k")).first().k == token


def test_leaders(spark):
    df = spark.createDataFrame([(1, 1, "a", 5.0), (2, 1, "a", 5.0), (3, 1, "a", 4.0), (4, 2, "a", 1.0), (5, 1, None, 0.0), (6, 1, None, 0.0)], "product_id long, store_id long, variant_key string, score double")
    assert {r.product_id for r in scoring.elect_leaders(df).filter("is_variant_lead").collect()} == {1, 4, 5, 6}


def found(spark, title, category=None):
    df = spark.createDataFrame([(1, title, None, category)], "product_id long, title string, description string, category string")
    return {r.family: r for r in specs.extract(df).collect()}


def test_spec_rules(spark):
    assert "materiau" not in found(spark, "Poêle en fonte émaillée") and found(spark, "Poêle en fonte émaillée", "cuisine")["materiau"].label == "Fonte"
    assert "diagonale" in found(spark, "Téléviseur 65 po", "televiseurs") and "diagonale" not in found(spark, "Grill 30 po", "jardinage")
    assert found(spark, "Grill 30 po", "jardinage")["encombrement"].metric == 30
    assert found(spark, "Casque Bluetooth")["bluetooth"].rank is None and found(spark, "Casque Bluetooth 5.3")["bluetooth"].rank == 3
    cubic = found(spark, "Réfrigérateur 31,7 pi³")["capacite"]
    assert (cubic.metric, cubic.unit) == (31.7, "pi3")
    assert found(spark, "Garantie de 1 an")["garantie"].label == "Garantie 1 an"


@pytest.mark.parametrize("metric, lower, dist, tier", [(30, False, (10, 30, 30, 40, 50), "milieu"), (50, False, (10, 20, 30, 40, 50), "premium"), (15, False, (10, 20, 30, 40, 50), "entree"), (38, True, (40, 44, 50, 55, 60), "premium"), (58, True, (40, 44, 50, 55, 60), "entree"), (50, True, (40, 44, 50, 55, 60), "milieu")])
def test_tiers(spark, metric, lower, dist, tier):
    df = spark.createDataFrame([(float(metric), lower, *map(float, dist))], "m double, l boolean, p10 double, p25 double, p50 double, p75 double, p90 double")
    c = F.col
    assert df.select(specs.tier_from_distribution(c("m"), c("l"), c("p25"), c("p50"), c("p75"), c("p10"), c("p90")).alias("t")).first().t == tier


def test_ranks(spark):
    df = spark.createDataFrame([(2, 2), (1, 2), (4, 4), (3, 4), (2, 4), (1, 4), (None, 4)], "r int, s int")
    assert [r.t for r in df.select(specs.tier_from_rank(F.col("r"), F.col("s")).alias("t")).collect()] == ["haut", "entree", "premium", "haut", "milieu", "entree", None]
