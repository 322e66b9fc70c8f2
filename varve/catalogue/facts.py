"""Fusion of facts and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import fusion, ingest

from .base import R6, products, query, r6, table

FACTS = """, facts AS (SELECT product_id, source, source_rank, reliability, CASE source_rank WHEN 0 THEN brand WHEN 1 THEN upper(brand) ELSE concat('X', CAST(product_id % 3 AS STRING)) END AS brand,
CASE WHEN source_rank < 2 THEN rating ELSE rating + (product_id % 5) / 10e0 END AS rating, CASE WHEN source_rank = 1 THEN CAST(rating_count * 0.8 AS BIGINT) ELSE rating_count END AS rating_count
FROM products CROSS JOIN (VALUES ('detail', 0, 0.97e0), ('cross_store', 1, 0.72e0), ('manufacturer', 2, 0.88e0)) AS v(source, source_rank, reliability) WHERE (product_id + source_rank) % 4 <> 0)"""


def facts(spark, d):
    sources = spark.range(3).select(F.col("id").cast("int").alias("source_rank"), F.element_at(F.array(*map(F.lit, ("detail", "cross_store", "manufacturer"))), F.col("id").cast("int") + 1).alias("source"), F.element_at(F.array(*map(F.lit, (0.97, 0.72, 0.88))), F.col("id").cast("int") + 1).alias("reliability"))
    rows = products(spark, d).select("product_id", "brand", "rating", "rating_count", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("source_rank")).join(F.broadcast(sources), "source_rank")
    rows = rows.filter((F.col("product_id") + F.col("source_rank")) % 4 != 0)
    return rows.select(
        "product_id", "source", "source_rank", "reliability",
        F.when(F.col("source_rank") == 0, F.col("brand")).when(F.col("source_rank") == 1, F.upper("brand")).otherwise(F.concat(F.lit("X"), (F.col("product_id") % 3).cast("string"))).alias("brand"),
        F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("manufacturer"),
        F.when(F.col("source_rank") < 2, F.col("rating")).otherwise(F.col("rating") + (F.col("product_id") % 5) / 10).alias("rating"),
        F.when(F.col("source_rank") == 1, (F.floor(F.col("rating_count") * 0.8 + 0.5)).cast("long")).otherwise(F.col("rating_count")).alias("rating_count"),
        F.lit(None).cast("bigint").alias("recommend_yes"), F.lit(None).cast("bigint").alias("recommend_total"), F.lit(None).cast("double").alias("manufacturer_price"),
    )


@query(f"""{FACTS}, votes AS (SELECT product_id, lower(brand) AS k, floor(sum(reliability) * 1e6 + 0.5) AS w, count(*) AS n, arg_min(brand, source_rank) AS shown, min(source_rank) AS r FROM facts GROUP BY 1, 2)
SELECT product_id, shown AS brand, {R6('n::DOUBLE / total')} AS brand_agreement, total AS brand_sources FROM (SELECT *, sum(n) OVER (PARTITION BY product_id)::BIGINT AS total, row_number() OVER (PARTITION BY product_id ORDER BY w DESC, r) AS p FROM votes) WHERE p = 1""")
def fus_string_vote(spark, d):
    return fusion.vote(facts(spark, d), "brand").select("product_id", "brand", r6(F.col("brand_agreement")).alias("brand_agreement"), "brand_sources")


@query(f"""{FACTS}, m AS (SELECT *, sum(rating * reliability) OVER (PARTITION BY product_id) / sum(reliability) OVER (PARTITION BY product_id) AS mean FROM facts WHERE rating IS NOT NULL)
SELECT product_id, {R6('max(mean)')} AS rating, count(*) AS rating_sources FROM m GROUP BY product_id""")
def fus_mean_rating(spark, d):
    return fusion.mean_rating(facts(spark, d)).select("product_id", r6(F.col("rating")).alias("rating"), "rating_sources")


@query(f"""{FACTS.replace('CAST(rating_count * 0.8 AS BIGINT)', 'CAST(floor(rating_count * 0.8e0 + 0.5) AS BIGINT)')}, t AS (SELECT *, max(rating_count) OVER (PARTITION BY product_id) AS top FROM facts WHERE rating_count IS NOT NULL)
SELECT product_id, max(top) AS rating_count, {R6('(count(*) FILTER (top = 0 OR (top - rating_count)::DOUBLE / top <= 0.25))::DOUBLE / count(*)')} AS count_agreement, count(*) AS count_sources FROM t GROUP BY product_id""")
def fus_review_count(spark, d):
    return fusion.review_count(facts(spark, d)).select("product_id", "rating_count", r6(F.col("count_agreement")).alias("count_agreement"), "count_sources")


KNOWN = "product_id % 23 <> 0"
ANSWERED = "product_id % 31 <> 5 AND (product_id % 29 <> 0 OR source_rank = product_id % 3)"
ANSWER = {
    "brand": f"CASE WHEN {KNOWN} THEN brand END",
    "model": f"CASE WHEN {KNOWN} AND (source_rank < 2 OR product_id % 2 = 0) THEN concat(CASE source_rank WHEN 0 THEN 'MX  ' ELSE 'mx ' END, CAST(product_id % 50 + CASE WHEN source_rank = 2 AND product_id % 7 = 0 THEN 1 ELSE 0 END AS STRING)) END",
    "manufacturer": f"CASE WHEN {KNOWN} AND source_rank = 2 THEN brand END",
    "rating": f"CASE WHEN {KNOWN} THEN rating END",
    "rating_count": f"CASE WHEN {KNOWN} THEN rating_count END",
    "recommend_yes": f"CASE WHEN {KNOWN} AND (product_id + source_rank) % 3 <> 1 THEN (product_id * 17 + source_rank * 29) % 150 END",
    "recommend_total": f"CASE WHEN {KNOWN} AND (product_id + source_rank) % 3 <> 1 THEN (product_id * 17 + source_rank * 29) % 300 END",
    "manufacturer_price": f"CASE WHEN {KNOWN} AND source_rank > 0 THEN (product_id * 7 + source_rank) % 40 * 1e0 END",
    "manufacturer_name": "concat('maker told by ', source)",
    "reviews": f"CASE WHEN {KNOWN} AND (product_id + source_rank) % 5 = 0 THEN concat('reviews of ', source) END",
}
SOURCES_SQL = FACTS.replace("CAST(rating_count * 0.8 AS BIGINT)", "CAST(floor(rating_count * 0.8e0 + 0.5) AS BIGINT)")
_STRING_VOTE = """, {f}_keys AS (SELECT product_id, trim(regexp_replace(lower({f}), '\\s+', ' ', 'g')) AS k, floor(sum(reliability) * 1e6 + 0.5) AS w, count(*) AS n, arg_min({f}, source_rank) AS shown, min(source_rank) AS r FROM answers WHERE {f} <> '' GROUP BY 1, 2),
{f}_vote AS (SELECT product_id, first(shown ORDER BY w DESC, r) AS {f}, first(n ORDER BY w DESC, r) / sum(n)::DOUBLE AS agreement, sum(n) AS sources, count(*) AS spellings FROM {f}_keys GROUP BY product_id),
{f}_said AS (SELECT product_id, string_agg(concat(source, '=', {f}), ', ' ORDER BY source_rank) AS told FROM answers WHERE {f} <> '' GROUP BY product_id)"""
_NUMBER_SAID = """, {n}_said AS (SELECT product_id, string_agg(concat(source, '=', CAST({c} AS VARCHAR)), ', ' ORDER BY source_rank) AS told FROM answers WHERE {c} IS NOT NULL GROUP BY product_id)"""


@query(f"""{SOURCES_SQL}, answers AS (SELECT product_id, source, source_rank, reliability, {', '.join(f'{v} AS {k}' for k, v in ANSWER.items())} FROM facts WHERE {ANSWERED}),
failures AS (SELECT product_id, string_agg(concat(source, ': ', 'timeout ', CAST(source_rank AS VARCHAR)), ' | ' ORDER BY source) AS errors FROM products CROSS JOIN (VALUES ('detail', 0), ('cross_store', 1), ('manufacturer', 2)) AS v(source, source_rank) WHERE (product_id + source_rank) % 4 = 0 GROUP BY product_id)
{''.join(_STRING_VOTE.format(f=f) for f in fusion.STRINGS)}{_NUMBER_SAID.format(n='rating', c='rating')}{_NUMBER_SAID.format(n='count', c='rating_count')},
means AS (SELECT product_id, sum(rating * reliability) / sum(reliability) AS rating FROM answers WHERE rating IS NOT NULL GROUP BY product_id),
rating_vote AS (SELECT product_id, max(m.rating) AS rating, (count(*) FILTER (abs(a.rating - m.rating) <= 0.2e0))::DOUBLE / count(*) AS agreement, count(*) AS sources FROM answers a JOIN means m USING (product_id) WHERE a.rating IS NOT NULL GROUP BY product_id),
tops AS (SELECT product_id, max(rating_count) AS top FROM answers GROUP BY product_id),
count_vote AS (SELECT product_id, max(top) AS rating_count, (count(*) FILTER (top = 0 OR (top - rating_count)::DOUBLE / top <= 0.25e0))::DOUBLE / count(*) AS agreement, count(*) AS sources FROM answers JOIN tops USING (product_id) WHERE rating_count IS NOT NULL GROUP BY product_id),
per AS (SELECT product_id, count(*) AS n, string_agg(source, ',' ORDER BY source) AS sources, first(recommend_yes ORDER BY recommend_total DESC, source_rank) FILTER (recommend_total > 0) AS recommend_yes, max(recommend_total) FILTER (recommend_total > 0) AS recommend_total,
    arg_min(manufacturer_price, source_rank) FILTER (manufacturer_price > 0) AS manufacturer_price, arg_min(manufacturer_name, source_rank) FILTER (manufacturer_price > 0) AS manufacturer_name, arg_min(reviews, source_rank) FILTER (reviews IS NOT NULL) AS reviews FROM answers GROUP BY product_id),
every AS (SELECT coalesce(p.product_id, f.product_id) AS product_id, coalesce(n, 0) AS n, * EXCLUDE (product_id, n) FROM per p FULL JOIN failures f ON p.product_id = f.product_id),
put AS (SELECT e.*, b.brand, m.model, k.manufacturer, r.rating, c.rating_count,
    list_filter([CASE WHEN b.sources > 1 THEN b.agreement END, CASE WHEN m.sources > 1 THEN m.agreement END, CASE WHEN k.sources > 1 THEN k.agreement END, CASE WHEN r.sources > 1 THEN r.agreement END, CASE WHEN c.sources > 1 THEN c.agreement END], lambda x: x IS NOT NULL) AS shares,
    concat_ws(' | ', CASE WHEN b.spellings > 1 THEN concat('brand differs: ', bs.told) END, CASE WHEN m.spellings > 1 THEN concat('model differs: ', ms.told) END, CASE WHEN k.spellings > 1 THEN concat('manufacturer differs: ', ks.told) END,
        CASE WHEN r.agreement < 1 THEN concat('rating differs: ', rs.told) END, CASE WHEN c.agreement < 1 THEN concat('count differs: ', cs.told) END, errors) AS conflicts
    FROM every e LEFT JOIN brand_vote b USING (product_id) LEFT JOIN model_vote m USING (product_id) LEFT JOIN manufacturer_vote k USING (product_id) LEFT JOIN rating_vote r USING (product_id) LEFT JOIN count_vote c USING (product_id)
    LEFT JOIN brand_said bs USING (product_id) LEFT JOIN model_said ms USING (product_id) LEFT JOIN manufacturer_said ks USING (product_id) LEFT JOIN rating_said rs USING (product_id) LEFT JOIN count_said cs USING (product_id))
SELECT product_id, brand, model, manufacturer, {R6('rating')} AS rating, rating_count, recommend_yes, recommend_total, manufacturer_price, manufacturer_name, reviews, coalesce(sources, '') AS sources,
    {R6('CASE WHEN n = 0 THEN 0e0 WHEN len(shares) > 0 THEN list_sum(shares) / len(shares) WHEN n > 1 THEN 0.8e0 ELSE 0.6e0 END')} AS agreement, conflicts,
    CASE WHEN coalesce(brand, model, manufacturer, CAST(rating AS VARCHAR), CAST(rating_count AS VARCHAR), CAST(recommend_total AS VARCHAR), CAST(manufacturer_price AS VARCHAR), manufacturer_name, reviews) IS NULL THEN 'failed' WHEN errors IS NOT NULL THEN 'partial' ELSE 'ok' END AS status FROM put""")
def fus_resolve(spark, d):
    """Answers of three sources, of which some know nothing and some fail; some products are failed at by all."""
    kept = ("product_id", "source", "source_rank", "reliability")
    answers = facts(spark, d).filter(ANSWERED).selectExpr(*kept, *(f"{v} AS {k}" for k, v in ANSWER.items()))
    names = F.array(*map(F.lit, ("detail", "cross_store", "manufacturer")))
    asked = products(spark, d).select("product_id", F.posexplode(names).alias("source_rank", "source")).filter("(product_id + source_rank) % 4 = 0")
    failures = asked.withColumn("error", F.concat(F.lit("timeout "), F.col("source_rank").cast("string")))
    found = fusion.resolve(answers, failures).withColumns({"agreement": r6(F.col("agreement")), "rating": r6(F.col("rating"))})
    return found.withColumns({"sources": F.concat_ws(",", "sources"), "conflicts": F.concat_ws(" | ", "conflicts")})


@query("""SELECT product_id, launch_price, 0.9e0 AS confidence FROM (SELECT product_id, price, upper(replace(model, '-', '')) AS k FROM products WHERE product_id % 3 <> 0) JOIN
(SELECT upper(replace(model, '-', '')) AS k, max(price) AS launch_price FROM products WHERE product_id % 3 = 0 GROUP BY 1) USING (k) WHERE launch_price >= price * 0.35 AND length(k) >= 4""")
def fus_manufacturer_references(spark, d):
    rows = products(spark, d)
    return fusion.manufacturer_references(rows.filter("product_id % 3 <> 0"), rows.filter("product_id % 3 = 0"))


def listings(spark, d):
    """Line items as listings of parts in stores, in two batches: the state and what comes next."""
    items = table(spark, d, "lineitem")
    offer = F.struct((F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_linestatus") == "F").alias("in_stock"))
    # what else a listing has comes from its keys, so it isn't sorted and shuffled with them
    items = items.groupBy("l_suppkey", "l_partkey", F.col("l_shipdate").cast("timestamp").alias("seen_at"), (F.col("l_orderkey") % 1000).alias("within")).agg(F.min(offer).alias("x"))
    return ingest.clean(items.select(
        F.col("l_suppkey").cast("string").alias("store_id"), F.col("l_partkey").cast("string").alias("sku"), F.lit("u").alias("url"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"),
        *(F.lit(None).cast("string").alias(c) for c in ("brand", "model", "image_url", "description", "category_slug", "store_category", "seller_name", "availability", "currency")),
        F.lit(None).cast("double").alias("rating"), F.lit(None).cast("bigint").alias("rating_count"), F.lit("new").alias("condition"), F.lit(False).alias("marketplace"),
        "x.price", F.lit(None).cast("double").alias("list_price"), "x.in_stock", "seen_at", (F.unix_seconds("seen_at") * 1000 + F.col("within")).alias("arrival"),
    ))


@query(""", listed AS (SELECT CAST(l_suppkey AS VARCHAR) AS store_id, CAST(l_partkey AS VARCHAR) AS sku, l_shipdate AS seen_at, l_orderkey % 1000 AS within, arg_min(l_extendedprice / l_quantity, (l_extendedprice / l_quantity, l_linestatus = 'F')) AS price, min((l_extendedprice / l_quantity, l_linestatus = 'F'))[2] AS in_stock
FROM lineitem GROUP BY 1, 2, 3, 4), marked AS (SELECT *, lag(price) OVER w IS NULL OR abs(price - lag(price) OVER w) >= 0.005 OR in_stock <> lag(in_stock) OVER w AS changed, seen_at < TIMESTAMP '2000-01-01' AS early FROM listed WINDOW w AS (PARTITION BY store_id, sku ORDER BY seen_at, within))
SELECT store_id, sku, floor(arg_max(price, (seen_at, within)) * 100 + 0.5) / 100 AS price, arg_max(in_stock, (seen_at, within)) AS in_stock, strftime(min(seen_at), '%Y-%m-%d') AS first_seen, strftime(max(seen_at), '%Y-%m-%d') AS last_seen, strftime(max(seen_at) FILTER (changed), '%Y-%m-%d') AS last_change, true AS is_active FROM marked GROUP BY store_id, sku""")
def ing_upsert(spark, d):
    from varve import schema
    from varve.staging import stage

    rows = stage(listings(spark, d), "listings")
    cut_at = F.lit("2000-01-01").cast("timestamp")
    state = stage(ingest.upsert(spark.createDataFrame([], schema.PRODUCTS), rows.filter(F.col("seen_at") < cut_at)), "state")
    return ingest.upsert(state, rows.filter(F.col("seen_at") >= cut_at)).select(
        "store_id", "sku", (F.floor(F.col("price") * 100 + 0.5) / 100).alias("price"), "in_stock", *(F.date_format(c, "yyyy-MM-dd").alias(n) for c, n in (("first_seen_at", "first_seen"), ("last_seen_at", "last_seen"), ("last_price_change_at", "last_change"))), "is_active",
    )


@query("""SELECT product_id, CASE WHEN product_id % 4 <> 0 THEN concat('img', CAST(product_id AS STRING)) ELSE coalesce(m.image, v.image) END AS image_url, regexp_replace(upper(model), '[- .]', '', 'g') AS model_key FROM (SELECT *, regexp_replace(upper(model), '[- .]', '', 'g') AS k FROM products) p
LEFT JOIN (SELECT store_id, regexp_replace(upper(model), '[- .]', '', 'g') AS k, concat('img', CAST(min(product_id) AS STRING)) AS image FROM products WHERE product_id % 4 <> 0 GROUP BY 1, 2) m USING (store_id, k)
LEFT JOIN (SELECT store_id, title, concat('img', CAST(min(product_id) AS STRING)) AS image FROM products WHERE product_id % 4 <> 0 GROUP BY 1, 2) v USING (store_id, title)""")
def ing_reconcile(spark, d):
    rows = products(spark, d).withColumn("image_url", F.when(F.col("product_id") % 4 != 0, F.concat(F.lit("img"), F.col("product_id").cast("string"))))
    return ingest.reconcile(rows).select("product_id", "image_url", "model_key")


@query(""", own AS (SELECT product_id, lower(brand) AS b, lower(regexp_replace(upper(model), '[^A-Z0-9]', '', 'g')) AS k FROM products),
sites AS (SELECT DISTINCT lower(p_brand) AS b, lower(concat('XX', replace(p_name, ' ', ''), CAST(p_size AS STRING), 'CA')) AS u, concat('/p/', lower(p_brand), '/', replace(p_name, ' ', ''), CAST(p_size AS STRING)) AS url FROM part)
SELECT product_id, url FROM own JOIN sites USING (b) WHERE length(k) >= 4 AND contains(u, k) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY length(u), url) = 1""")
def join_contained_keys(spark, d):
    """The shortest address of a product's brand that contains its model key: lengths stand for addresses' own."""
    part = table(spark, d, "part")
    bare = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_size").cast("string"))
    sites = part.select(F.col("p_brand").alias("brand"), F.concat(F.lit("XX"), bare, F.lit("CA")).alias("url_key"), F.concat(F.lit("/p/"), F.lower("p_brand"), F.lit("/"), bare).alias("url")).distinct()
    return fusion.locate_by_key(sites, products(spark, d))
