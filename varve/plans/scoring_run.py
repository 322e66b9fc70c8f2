"""The scoring run: coherence, statistics, peers, quality, score and leaders as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.operators import peers, scoring, timeseries
from varve.operators.ingest import reconcile
from varve.staging import stage


def score_all(products: DataFrame, points: DataFrame, now: Column, enrichment: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """One row per active product with a price and a history: its scores, the columns that listings filter on, and
    whether it leads its variants. Products are joined once each with statistics, peers and facts; the mean rating
    is a single row. Products with their keys are read five times, so they are staged, and so are the scored ones, which
    leaders are found among and then joined to: else statistics and scores would be made for each of the two."""
    rows = reconcile(products.filter(F.col("is_active") & (F.col("price") > 0)))
    rows = keyed = stage(rows.withColumn("peer_key", peers.peer_key(F.col("category_slug"), F.col("title"), F.col("brand"))), "keyed")
    if enrichment is not None:
        facts = enrichment.select("product_id", *(F.col(c).alias(f"e_{c}") for c in ("rating", "rating_count")), "recommend_yes", "recommend_total", "agreement")
        rows = rows.join(facts, "product_id", "left")
        rows = rows.withColumns({"rating": F.coalesce("e_rating", "rating"), "rating_count": F.coalesce("e_rating_count", "rating_count")}).drop("e_rating", "e_rating_count")
    else:
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("recommend_yes", "bigint"), ("recommend_total", "bigint"), ("agreement", "double"))})
    if references is not None:
        found = references.filter("found").select("product_id", "typical_price", "known_low", F.col("confidence").alias("reference_confidence"))
        rows = rows.join(found, "product_id", "left")
    mean = scoring.mean_rating(rows)
    rows = scoring.inherit_quality(rows).join(F.broadcast(mean))  # one row
    near = peers.peer_stats(keyed, is_new=F.col("condition") == "new").drop("peer_key")
    history = points.join(keyed.select("product_id", F.col("price").alias("now_price")), "product_id")
    stats = timeseries.price_stats(history, now, list_price="list_price", current="now_price").drop("current_price")
    scored = scoring.score(rows.join(stats, "product_id").join(near, "product_id", "left"))
    scored = scored.withColumns({"quality_rating": F.col("rating"), "quality_count": F.col("rating_count"), "category": F.col("category_slug")})
    return scoring.elect_leaders(stage(scored, "scored"))


def deactivate(deals: DataFrame, products: DataFrame) -> DataFrame:
    """Deals whose product is no longer active are not either."""
    live = products.filter("is_active").select("product_id", F.lit(True).alias("_live"))
    return deals.join(live, "product_id", "left").withColumn("is_active", F.coalesce("_live", F.lit(False))).drop("_live")
