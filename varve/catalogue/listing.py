"""Listings, filters, counts, facets and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import filters
from varve.operators.filters import DealFilters
from varve.plans import readmodel

from .base import NOW_SQL, categories, deals, now, query, r6, table

LIVE = "is_active AND is_variant_lead"
SHOWN = ["product_id", "category", "store_id", "condition", "price", "score", "confidence"]
SHOWN_SQL = ", ".join(SHOWN)


@query(f"SELECT {SHOWN_SQL} FROM deals WHERE {LIVE} AND condition = 'new' ORDER BY score DESC, confidence DESC, product_id LIMIT 48")
def api_top_deals(spark, d):
    return readmodel.top_deals(deals(spark, d), DealFilters()).select(*SHOWN)


@query(f"SELECT {SHOWN_SQL} FROM deals WHERE {LIVE} AND condition = 'new' ORDER BY price, product_id LIMIT 40 OFFSET 80")
def srt_price_page_three(spark, d):
    return readmodel.top_deals(deals(spark, d), DealFilters(sort="price-asc", limit=40, offset=80)).select(*SHOWN)


@query(f"SELECT {SHOWN_SQL} FROM deals WHERE {LIVE} AND condition = 'new' ORDER BY price DESC, product_id LIMIT 48")
def srt_price_desc(spark, d):
    return readmodel.top_deals(deals(spark, d), DealFilters(sort="price-desc")).select(*SHOWN)


@query(f"SELECT {SHOWN_SQL}, verified_drop FROM deals WHERE {LIVE} AND condition = 'new' AND verified_drop >= 0.05 ORDER BY verified_drop DESC, score DESC, product_id LIMIT 48")
def flt_drop_sort(spark, d):
    return readmodel.top_deals(deals(spark, d), DealFilters(sort="drop")).select(*SHOWN, "verified_drop")


@query(f"""SELECT {SHOWN_SQL} FROM deals WHERE is_active AND condition <> 'new' AND (in_stock IS NULL OR in_stock) AND score >= 20 AND confidence >= 0.2 AND price BETWEEN 500 AND 900
AND lower(brand) IN ('brand#1', 'brand#2', 'brand#3', 'brand#13') AND store_id IN (0, 1, 2, 3) ORDER BY score DESC, confidence DESC, product_id LIMIT 1000""")
def flt_many_criteria(spark, d):
    f = DealFilters(condition="used", in_stock_only=True, min_score=20, min_confidence=0.2, min_price=500, max_price=900, brands=("Brand#1", "brand#2", "BRAND#3", "brand#13"), stores=(0, 1, 2, 3), include_variants=True, limit=1000)
    return readmodel.top_deals(deals(spark, d), f).select(*SHOWN)


@query(f"SELECT {SHOWN_SQL} FROM deals WHERE {LIVE} AND condition = 'new' AND is_lowest_ever AND seller_name IN ('Seller 0', 'Seller 2')")
def flt_lowest_and_seller(spark, d):
    return filters.apply(deals(spark, d), DealFilters(lowest_only=True, sellers=("Seller 0", "Seller 2"))).select(*SHOWN)


@query(f"SELECT {SHOWN_SQL} FROM deals WHERE {LIVE} AND condition = 'new' AND category IN (SELECT slug FROM categories WHERE slug = 'ASIA' OR parent_slug = 'ASIA')")
def flt_category_with_children(spark, d):
    return filters.apply(deals(spark, d), DealFilters(category="ASIA"), categories(spark, d)).select(*SHOWN)


SPECS = """, specs AS (SELECT p_partkey AS product_id, 'size' AS family, concat(CAST(p_size % 12 AS STRING), ' po') AS label, CAST(p_size % 12 AS STRING) AS value, CAST(p_size % 12 AS DOUBLE) AS metric FROM part
UNION ALL SELECT p_partkey, 'kind', p_type, lower(p_type), NULL FROM part)"""


def specs(spark, d):
    part = table(spark, d, "part")
    size = part.selectExpr("p_partkey AS product_id", "'size' AS family", "concat(CAST(p_size % 12 AS STRING), ' po') AS label", "CAST(p_size % 12 AS STRING) AS value", "CAST(p_size % 12 AS DOUBLE) AS metric")
    return size.unionByName(part.selectExpr("p_partkey AS product_id", "'kind' AS family", "p_type AS label", "lower(p_type) AS value", "CAST(NULL AS DOUBLE) AS metric"))


@query(f"""{SPECS} SELECT {SHOWN_SQL} FROM deals WHERE {LIVE} AND condition = 'new' AND product_id IN (SELECT product_id FROM specs WHERE family = 'size' AND value IN ('3', '5'))
AND product_id IN (SELECT product_id FROM specs WHERE family = 'kind' AND value IN ('promo', 'small', 'large'))""")
def flt_specs_and_or(spark, d):
    f = DealFilters(specs={"size": ("3", "5"), "kind": ("promo", "small", "large")})
    return filters.apply(deals(spark, d), f, specs=specs(spark, d)).select(*SHOWN)


@query(f"SELECT count(*) AS n FROM deals WHERE {LIVE} AND condition = 'new' AND (in_stock IS NULL OR in_stock)")
def api_count_deals(spark, d):
    return readmodel.count_deals(deals(spark, d), DealFilters(in_stock_only=True))


@query(f"""{SPECS}, base AS (SELECT *, (brand IN ('Brand#1', 'Brand#2', 'Brand#3')) AS b, price BETWEEN 500 AND 900 AS p, product_id IN (SELECT product_id FROM specs WHERE family = 'kind' AND value IN ('promo', 'small')) AS k FROM deals WHERE is_active AND is_variant_lead AND condition = 'new'),
byspec AS (SELECT family, value, min(label) AS label, min(metric) AS metric, count(*) AS n FROM base JOIN specs USING (product_id) WHERE b AND p AND (k OR family = 'kind') GROUP BY family, value HAVING count(*) >= 3),
cut AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, value) AS c FROM byspec QUALIFY c <= 12),
sp AS (SELECT *, count(*) OVER (PARTITION BY family) AS vs, count(*) FILTER (metric IS NULL) OVER (PARTITION BY family) = 0 AS num FROM cut),
br AS (SELECT lower(brand) AS value, min(brand) AS label, count(*) AS n FROM base WHERE p AND k GROUP BY lower(brand) HAVING count(*) >= 3),
se AS (SELECT seller_name AS value, count(*) AS n FROM base WHERE b AND p AND k AND seller_name IS NOT NULL GROUP BY seller_name HAVING count(*) >= 3),
st AS (SELECT store_id::VARCHAR AS value, count(*) AS n FROM base WHERE b AND p AND k GROUP BY store_id)
SELECT 'brand' AS facet, label, value, NULL::DOUBLE AS metric, n, row_number() OVER (ORDER BY n DESC, value) AS place FROM br QUALIFY place <= 24
UNION ALL SELECT 'seller', value, value, NULL, n, row_number() OVER (ORDER BY n DESC, value) AS place FROM se QUALIFY place <= 12
UNION ALL SELECT 'store', value, value, NULL, n, row_number() OVER (ORDER BY n DESC, value) FROM st
UNION ALL SELECT 'price', 'min', 'min', floor(min(price)), NULL, 1 FROM base WHERE b AND k
UNION ALL SELECT 'price', 'max', 'max', ceil(max(price)), NULL, 2 FROM base WHERE b AND k""")
def api_facets(spark, d):
    """Without spec families: those that aren't in the page's order are left out."""
    f = DealFilters(brands=("brand#1", "brand#2", "brand#3"), min_price=500, max_price=900, specs={"kind": ("promo", "small")})
    return readmodel.facets(deals(spark, d), f, specs(spark, d))


@query(f"""{SPECS.replace("'size'", "'capacite'").replace("'kind'", "'configuration'")}, base AS (SELECT *, product_id IN (SELECT product_id FROM specs WHERE family = 'configuration' AND value IN ('promo', 'small')) AS k FROM deals WHERE is_active AND is_variant_lead AND condition = 'new'),
byspec AS (SELECT family, value, min(label) AS label, min(metric) AS metric, count(*) AS n FROM base JOIN specs USING (product_id) WHERE k OR family = 'configuration' GROUP BY family, value HAVING count(*) >= 3),
cut AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, value) AS c FROM byspec QUALIFY c <= 12),
sp AS (SELECT *, count(*) OVER (PARTITION BY family) AS vs, count(*) FILTER (metric IS NULL) OVER (PARTITION BY family) = 0 AS num FROM cut)
SELECT 'spec:' || family AS facet, label, value, metric, n, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN num THEN metric END, c) AS place FROM sp WHERE vs >= 2""")
def api_spec_facets(spark, d):
    """A checked value doesn't hide its siblings; numbers are in their order."""
    named = specs(spark, d).withColumn("family", F.when(F.col("family") == "size", "capacite").otherwise("configuration"))
    return readmodel.facets(deals(spark, d), DealFilters(specs={"configuration": ("promo", "small")}), named).filter("facet like 'spec:%'")


@query("""SELECT section, place, product_id, score FROM (SELECT section, product_id, score, row_number() OVER (PARTITION BY section ORDER BY score DESC, confidence DESC, product_id) AS place FROM (
SELECT 'lowest' AS section, * FROM deals WHERE is_lowest_ever AND score >= 20 AND condition = 'new' UNION ALL SELECT 'verified', * FROM deals WHERE confidence >= 0.5 AND score >= 30 AND condition = 'new'
UNION ALL SELECT 'used', * FROM deals WHERE condition <> 'new' AND score >= 20 UNION ALL SELECT 'best', * FROM deals WHERE condition = 'new') WHERE is_active AND is_variant_lead) WHERE place <= 12""")
def api_home_sections(spark, d):
    return readmodel.home_sections(deals(spark, d), 12).select("section", "place", "product_id", "score")


@query("""SELECT section, place, product_id, score FROM (SELECT section, product_id, score, row_number() OVER (PARTITION BY section ORDER BY score DESC, confidence DESC, product_id) AS place FROM (
SELECT 'lowest' AS section, * FROM deals WHERE is_lowest_ever AND score >= 20 AND condition = 'new' UNION ALL SELECT 'verified', * FROM deals WHERE confidence >= 0.5 AND score >= 30 AND condition = 'new'
UNION ALL SELECT 'used', * FROM deals WHERE condition <> 'new' AND score >= 20 UNION ALL SELECT 'best', * FROM deals WHERE condition = 'new') WHERE is_active AND is_variant_lead) WHERE place <= CASE section WHEN 'best' THEN 30 ELSE 10 END""")
def api_home_page(spark, d):
    """Each section with as many deals as the first page shows."""
    return readmodel.home_sections(deals(spark, d)).select("section", "place", "product_id", "score")


@query(f"SELECT {SHOWN_SQL} FROM deals WHERE {LIVE} AND condition = 'new' AND category = 'NATION_3' AND product_id <> 3 ORDER BY score DESC, confidence DESC, product_id LIMIT 10")
def api_similar(spark, d):
    return readmodel.similar(deals(spark, d), "NATION_3", 3).select(*SHOWN)


@query("""SELECT slug, name, parent_slug, coalesce(n, 0) AS deals, floor(best * 10 + 0.5) / 10 AS best_score FROM categories LEFT JOIN (SELECT category AS slug, count(*) AS n, max(score) AS best FROM deals WHERE is_active GROUP BY category) USING (slug)""")
def api_categories_with_counts(spark, d):
    return readmodel.categories_with_counts(categories(spark, d), deals(spark, d))


@query("""SELECT coalesce(parent_slug, slug) AS root, CAST(sum(coalesce(n, 0)) AS BIGINT) AS deals FROM categories LEFT JOIN (SELECT category AS slug, count(*) AS n FROM deals WHERE is_active GROUP BY category) USING (slug) GROUP BY 1""")
def agg_root_totals(spark, d):
    return readmodel.root_totals(readmodel.categories_with_counts(categories(spark, d), deals(spark, d)))


RUNS = ", runs AS (SELECT o_orderkey AS run_id, o_custkey AS store_id, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'failed' ELSE 'partial' END AS status, o_orderdate AS finished_at FROM orders)"


def runs(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS run_id", "o_custkey AS store_id", "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'failed' ELSE 'partial' END AS status", "o_orderdate AS finished_at")


@query(f"""{RUNS} SELECT (SELECT count(*) FROM deals WHERE is_active) AS products, (SELECT count(DISTINCT store_id) FROM deals WHERE is_active) AS stores, (SELECT count(*) FROM deals WHERE is_active AND is_lowest_ever) AS lowest_ever,
(SELECT max(finished_at) FROM runs WHERE status IN ('ok', 'partial')) AS updated_at""")
def api_site_stats(spark, d):
    return readmodel.site_stats(deals(spark, d), runs(spark, d))


@query(f"""SELECT s_suppkey AS store_id, s_name AS name, coalesce(n, 0) AS products, s_acctbal >= 0 AND s_suppkey % 9 <> 0 AS ready FROM supplier LEFT JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_suppkey) USING (s_suppkey)""")
def api_active_stores(spark, d):
    stores = table(spark, d, "supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("name"), (F.col("s_acctbal") >= 0).alias("enabled"), F.when(F.col("s_suppkey") % 9 == 0, now() + F.make_dt_interval(F.lit(1))).alias("paused_until"))
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("store_id"), (F.col("l_linestatus") == "F").alias("is_active"))
    return readmodel.active_stores(stores, items, now()).select("store_id", "name", "products", "ready")


OFFERS = ", offers AS (SELECT l_orderkey * 10 + l_linenumber AS product_id, l_suppkey AS store_id, CAST(l_partkey AS STRING) AS model_key, min(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2, 3)"


@query(f"""{OFFERS}, own AS (SELECT store_id AS s, model_key FROM offers WHERE product_id = (SELECT min(product_id) FROM offers WHERE model_key = '42'))
SELECT store_id, arg_min(product_id, price) AS product_id, min(price) AS price FROM offers JOIN own USING (model_key) WHERE store_id <> s GROUP BY store_id ORDER BY price, product_id LIMIT 6""")
def api_competing_offers(spark, d):
    rows = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("product_id"), F.col("l_suppkey").alias("store_id"), F.col("l_partkey").cast("string").alias("model_key")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    first = rows.filter("model_key = '42'").agg(F.min("product_id")).first()[0]
    return readmodel.competing_offers(rows.withColumn("is_active", F.lit(True)), first)


@query("""SELECT conv_id, side, place, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY length(text) DESC, verified DESC, turn) AS place FROM (
SELECT conv_id, turn, text, role = 'assistant' AS verified, CASE WHEN turn % 6 >= 4 THEN 'praise' WHEN turn % 6 <= 3 THEN 'criticism' END AS side FROM conversations)) WHERE place <= 1""")
def srt_reviews_worth_showing(spark, d):
    reviews = table(spark, d, "conversations").select(F.col("conv_id").alias("product_id"), F.col("turn").alias("review_id"), (F.col("turn") % 6).alias("stars"), F.length("text").alias("helpful"), (F.col("role") == "assistant").alias("verified"))
    return readmodel.reviews_worth_showing(reviews).select(F.col("product_id").alias("conv_id"), "side", "place", F.col("review_id").alias("turn"))


@query("""SELECT product_id, price, score FROM deals WHERE product_id IN (SELECT product_id FROM deals WHERE score > 20)""")
def snk_public_export(spark, d):
    rows = deals(spark, d)
    return readmodel.public_export({"deals": rows.select("product_id", "price", "score")}, rows)["deals"]
