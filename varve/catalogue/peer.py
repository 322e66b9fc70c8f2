"""Peer groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import peers, scoring
from varve.plans import readmodel

from .base import R6, deals, products, query, r6

PEER_SQL = """, keyed AS (SELECT product_id, kind AS peer_key, price, condition = 'new' AS fresh FROM products WHERE price > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY peer_key ORDER BY price, product_id) - 1 AS i, count(*) OVER (PARTITION BY peer_key) AS n,
    count(*) FILTER (fresh) OVER (PARTITION BY peer_key) AS n_new FROM keyed),
lists AS (SELECT peer_key, list(price ORDER BY price) AS ps, list(price ORDER BY price) FILTER (fresh) AS fs FROM keyed GROUP BY peer_key),
g AS (SELECT peer_key, ps[1 + floor(0.1 * (len(ps) - 1))::INT] AS p10, ps[1 + floor(0.25 * (len(ps) - 1))::INT] AS p25, ps[1 + floor(0.9 * (len(ps) - 1))::INT] AS p90,
    CASE WHEN len(fs) >= 3 THEN fs[1 + len(fs) // 2] ELSE ps[1 + len(ps) // 2] END AS med FROM lists),
peers AS (SELECT product_id, peer_key, CASE WHEN n > 1 THEN i::DOUBLE / (n - 1) ELSE 0.5 END AS peer_percentile, med AS peer_median, n AS peer_size, (med - price) / med AS peer_below,
    greatest(0, least(1, (8 - p90 / p10) / 5)) AS peer_cohesion, price < p25 / 2.5 AS peer_outlier, p90 AS peer_p90 FROM placed JOIN g USING (peer_key) WHERE n >= 5)"""


@query(f"""{PEER_SQL} SELECT product_id, peer_key, {R6('peer_percentile')} AS peer_percentile, peer_median, peer_size, {R6('peer_below')} AS peer_below, {R6('peer_cohesion')} AS peer_cohesion, peer_outlier, peer_p90 FROM peers""")
def peer_stats(spark, d):
    rows = peers.peer_stats(products(spark, d), key="kind", is_new=F.col("condition") == "new")
    return rows.select("product_id", "peer_key", r6(F.col("peer_percentile")).alias("peer_percentile"), "peer_median", "peer_size", r6(F.col("peer_below")).alias("peer_below"), r6(F.col("peer_cohesion")).alias("peer_cohesion"), "peer_outlier", "peer_p90")


@query("""SELECT product_id, concat_ws('|', category, 't:' || left(list_filter(string_split(title, ' '), lambda x: len(x) >= 3)[1], 14),
 'po:' || CASE WHEN s <= 32 THEN '<=32' WHEN s <= 43 THEN '33-43' WHEN s <= 55 THEN '44-55' WHEN s <= 65 THEN '56-65' WHEN s <= 75 THEN '66-75' ELSE '76+' END,
 CASE product_id % 4 WHEN 0 THEN 'panel:oled' WHEN 1 THEN 'panel:qled' END, CASE product_id % 4 WHEN 0 THEN 'res:4k' WHEN 1 THEN 'res:1440' WHEN 2 THEN 'res:1080' END,
 'hz:' || CASE product_id % 4 WHEN 0 THEN '60' WHEN 1 THEN '120' WHEN 2 THEN '165' ELSE '240' END, CASE product_id % 6 WHEN 1 THEN 'gpu:4-7' WHEN 2 THEN 'cpu:7' END,
 CASE product_id % 6 WHEN 0 THEN 'sto:1to' WHEN 2 THEN 'sto:512' END) AS peer_key
FROM (SELECT product_id, category, title, CAST(regexp_extract(title, '([0-9]{2}) po', 1) AS INT) AS s FROM products)""")
def peer_key(spark, d):
    return products(spark, d).select("product_id", peers.peer_key(F.col("category"), F.col("title"), F.col("brand")).alias("peer_key"))


@query(f"""SELECT product_id, {R6('greatest(0, (p + z2 / (2 * n) - 1.28e0 * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n))')} AS lower_bound
FROM (SELECT product_id, recommend_yes::DOUBLE / recommend_total AS p, recommend_total::DOUBLE AS n, 1.28e0 * 1.28e0 AS z2 FROM products WHERE recommend_total > 0)""")
def sco_wilson(spark, d):
    return products(spark, d).filter("recommend_total > 0").select("product_id", r6(scoring.wilson(F.col("recommend_yes"), F.col("recommend_total"))).alias("lower_bound"))


@query(f"""SELECT source, yes, total, {R6('greatest(0, (p + z2 / (2 * n) - 1.28e0 * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n))')} AS lower_bound
FROM (SELECT source, yes, total, yes::DOUBLE / total AS p, total::DOUBLE AS n, 1.28e0 * 1.28e0 AS z2 FROM (SELECT source, sum(quality)::BIGINT AS yes, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY source))""")
def sco_wilson_of_sources(spark, d):
    from .base import table

    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    votes = rows.groupBy("source").agg(F.sum("quality").cast("long").alias("yes"), F.count(F.lit(1)).alias("total"))
    return votes.withColumn("lower_bound", r6(scoring.wilson(F.col("yes"), F.col("total"))))


@query("""SELECT avg(rating) AS global_mean_rating FROM (SELECT floor(avg(rating) * 1e6 + 0.5) / 1e6 AS rating FROM products WHERE rating_count >= 5 AND rating IS NOT NULL)""")
def agg_mean_rating(spark, d):
    return scoring.mean_rating(products(spark, d)).select(r6(F.col("global_mean_rating")).alias("global_mean_rating"))


@query("""SELECT product_id, rating, rating_count, recommend_total, inherited_quality FROM (
SELECT p.product_id, CASE WHEN take THEN m.rating ELSE p.rating END AS rating, CASE WHEN take THEN m.rating_count ELSE p.rating_count END AS rating_count, CASE WHEN take THEN m.recommend_total ELSE p.recommend_total END AS recommend_total, take AS inherited_quality
FROM (SELECT p.*, m.product_id AS mid, coalesce(m.reviews > 2 * p.reviews, false) AS take FROM (SELECT *, coalesce(recommend_total, rating_count, 0) AS reviews FROM products) p
  JOIN (SELECT *, coalesce(recommend_total, rating_count, 0) AS reviews FROM products QUALIFY row_number() OVER (PARTITION BY model ORDER BY coalesce(recommend_total, rating_count, 0) DESC, product_id) = 1) m USING (model)) p
JOIN products m ON m.product_id = p.mid)""")
def sco_inherited_quality(spark, d):
    return scoring.inherit_quality(products(spark, d), model="model").select("product_id", "rating", "rating_count", "recommend_total", "inherited_quality")


@query("""SELECT product_id, category, quality_score, rank() OVER (PARTITION BY category ORDER BY quality_score DESC) AS quality_rank, count(*) OVER (PARTITION BY category) AS rated FROM deals QUALIFY rated >= 5""")
def win_category_rank(spark, d):
    return readmodel.category_ranks(deals(spark, d)).select("product_id", "category", "quality_score", "quality_rank", "rated")


@query("""SELECT category, place, product_id, quality_score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY quality_score DESC, quality_count DESC, product_id) AS place FROM deals WHERE quality_count >= 20) WHERE place <= 3""")
def api_category_leaders(spark, d):
    return readmodel.category_leaders(deals(spark, d)).select("category", "place", "product_id", "quality_score")


@query("""SELECT d.product_id, d.price, d.quality_score FROM deals d JOIN (SELECT * FROM deals WHERE product_id = 42) o USING (peer_key) WHERE d.is_active AND d.product_id <> 42 AND d.quality_score > o.quality_score + 0.05 AND d.price <= o.price * 2
ORDER BY d.quality_score DESC, d.price, d.product_id LIMIT 4""")
def api_better_alternatives(spark, d):
    return readmodel.better_alternatives(deals(spark, d), 42).select("product_id", "price", "quality_score")


@query("""SELECT d.product_id, d.price, d.quality_score FROM deals d JOIN (SELECT * FROM deals WHERE product_id = 42) o USING (peer_key) WHERE d.is_active AND d.product_id <> 42 AND d.quality_score >= o.quality_score - 0.02
ORDER BY d.price, d.product_id LIMIT 3""")
def api_comparables(spark, d):
    return readmodel.comparables(deals(spark, d), 42).select("product_id", "price", "quality_score")
