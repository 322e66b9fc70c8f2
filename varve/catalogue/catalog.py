"""The whole scoring run on the stand-in catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.plans import scoring_run

from .base import now, points, products, query, r6


@query()
def sco_score_all(spark, d):
    """Coherence, statistics, peers, inherited quality, score and leaders as one plan."""
    rows = products(spark, d).withColumns({"category_slug": F.col("kind"), "image_url": F.lit(None).cast("string")}).drop("recommend_yes", "recommend_total")
    out = scoring_run.score_all(rows, points(spark, d), now())
    return out.select("product_id", "store_id", "category", r6(F.col("score")).alias("score"), r6(F.col("confidence")).alias("confidence"), "peer_key", "is_lowest_ever", "is_variant_lead", "reasons")
