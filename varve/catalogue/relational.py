"""Joins, aggregates and orders as the catalogue uses them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varve.functions import display, prices
from varve.operators import audit, ingest

from .base import NOW_SQL, R6, categories, deals, now, products, query, r6, table
from .listing import RUNS, runs


@query("""SELECT o_orderkey, c_name, n_name, r_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderpriority = '1-URGENT'""")
def join_wide_projection(spark, d):
    """Facts with small dimensions, which Spark broadcasts by their size."""
    dims = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, d, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice")


@query("""SELECT c_custkey, count(o_orderkey) AS orders, max(o_totalprice) AS largest FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""")
def join_left_with_predicate(spark, d):
    found = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(found, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.max("o_totalprice").alias("largest"))


@query("""SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)""")
def join_anti(spark, d):
    gone = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(gone, "p_partkey", "left_anti").select("p_partkey", "p_brand")


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 49)""")
def join_semi(spark, d):
    met = table(spark, d, "lineitem").filter("l_discount >= 0.1 AND l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(met, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("""SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS products, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_linestatus = 'O') AS advanced FROM supplier""")
def join_correlated_counts(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("l_linestatus") == "O").alias("advanced"))
    met = table(spark, d, "supplier").join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return met.select("s_suppkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("products", "advanced")))


@query("""SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS best_price, arg_min(l_orderkey, (l_extendedprice / l_quantity)) AS order_key FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1""")
def join_best_price_per_store(spark, d):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    out = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(price).alias("best_price"), F.min_by("l_orderkey", price).alias("order_key"), F.count(F.lit(1)).alias("n"))
    return out.filter("n > 1").drop("n")


@query("""SELECT slug, coalesce(parent_slug, slug) AS root FROM categories""")
def join_root_of(spark, d):
    from varve.sources.reference import root_of

    return root_of(categories(spark, d))


@query("""SELECT p_brand AS label, lower(p_brand) AS value, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) >= 3 ORDER BY n DESC, value LIMIT 24""")
def agg_having_top(spark, d):
    out = table(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return out.withColumn("value", F.lower("label")).orderBy(F.desc("n"), "value").limit(24).select("label", "value", "n")


@query(f"""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS stores, count(*) FILTER (l_linestatus = 'O') AS still_open, {R6('avg(l_discount)')} AS mean_discount, max(l_extendedprice) AS largest FROM lineitem GROUP BY l_returnflag""")
def agg_conditional_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("stores"), F.count_if(F.col("l_linestatus") == "O").alias("still_open"), r6(F.avg("l_discount")).alias("mean_discount"), F.max("l_extendedprice").alias("largest"))


@query("""SELECT p_type, p_brand, p_partkey, p_retailprice, place FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 12""")
def srt_top_per_group(spark, d):
    place = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, d, "part").withColumn("place", place).filter("place <= 12").select("p_type", "p_brand", "p_partkey", "p_retailprice", "place")


@query(f"""SELECT product_id, CASE WHEN list_price > price AND list_price <= price * 6 THEN list_price END AS list_price, {R6('CASE WHEN list_price > price THEN (list_price - price) / list_price ELSE 0 END')} AS discount,
CASE WHEN list_price > price AND (list_price - price) / list_price >= 0.5 THEN 'huge' WHEN list_price > price AND (list_price - price) / list_price >= 0.25 THEN 'large' WHEN list_price > price AND (list_price - price) / list_price >= 0.1 THEN 'small' ELSE 'none' END AS tier,
CASE WHEN rating_count > 0 THEN rating END AS rating, nullif(rating_count, 0) AS rating_count FROM products""")
def scl_price_sanity(spark, d):
    c = F.col
    rating, count = prices.sane_rating(c("rating"), c("rating_count"))
    off = prices.discount(c("price"), c("list_price"))
    return products(spark, d).select("product_id", prices.sane_list_price(c("price"), c("list_price")).alias("list_price"), r6(off).alias("discount"), display.discount_tier(off).alias("tier"), rating.alias("rating"), count.alias("rating_count"))


@query(f"""SELECT o_orderkey, date_diff('microsecond', o_orderdate, {NOW_SQL}) // 3600000000 AS hours, o_orderdate < {NOW_SQL} - INTERVAL 14 DAY AS stale FROM orders""")
def ing_staleness(spark, d):
    rows = table(spark, d, "orders").withColumn("is_active", F.lit(True))
    kept = ingest.retire(rows, now(), seen="o_orderdate")
    return kept.select("o_orderkey", F.timestamp_diff("HOUR", F.col("o_orderdate"), now()).alias("hours"), (~F.col("is_active")).alias("stale"))


@query("""SELECT CAST(l_suppkey AS STRING) AS store_id, CAST(l_partkey AS STRING) AS url, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 2 ELSE 1 END) AS BIGINT) AS failures FROM (SELECT l.*, c.cleared FROM lineitem l
LEFT JOIN (SELECT l_suppkey, l_partkey, max(l_shipdate) AS cleared FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) c USING (l_suppkey, l_partkey) WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2001-10-06') WHERE cleared IS NULL OR l_shipdate > cleared GROUP BY 1, 2 HAVING sum(CASE WHEN l_linestatus = 'O' THEN 2 ELSE 1 END) >= 2""")
def ing_dead_urls(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("store_id"), F.col("l_partkey").cast("string").alias("url"), (F.col("l_linestatus") == "O").alias("certain"), F.col("l_shipdate").alias("at"), "l_returnflag")
    failures = rows.filter("l_returnflag = 'R'").withColumnRenamed("at", "failed_at")
    successes = rows.filter("l_returnflag = 'N'").withColumnRenamed("at", "seen_at")
    return ingest.dead_urls(failures, successes, now()).select("store_id", "url", "failures")


@query("""SELECT 'same_counts' AS "check", 'severe' AS severity, string_agg(category, ',' ORDER BY category) AS subject, n::DOUBLE AS detail FROM (SELECT category, count(*) AS n FROM deals GROUP BY category HAVING count(*) > 50) GROUP BY n HAVING count(*) >= 3""")
def aud_same_counts(spark, d):
    return audit.same_counts(deals(spark, d))


@query("""SELECT 'loose_group' AS "check", 'suspect' AS severity, l_suppkey::VARCHAR AS subject, floor(max(p) / min(p) * 1e6 + 0.5) / 1e6 AS detail FROM (SELECT l_suppkey, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY l_suppkey HAVING count(*) >= 20 AND max(p) / min(p) > 40
ORDER BY max(p) / min(p) DESC, l_suppkey LIMIT 5""")
def aud_loose_groups(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("peer_key"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return audit.loose_groups(rows).withColumn("detail", r6(F.col("detail")))


@query("""SELECT 'absurd_list_price' AS "check", CASE WHEN n > 500 THEN 'severe' ELSE 'suspect' END AS severity, 'list_price' AS subject, n::DOUBLE AS detail FROM (SELECT count(*) AS n FROM products WHERE list_price > price * 1.5) WHERE n > 0""")
def aud_absurd_list_prices(spark, d):
    return audit.absurd_list_prices(products(spark, d), ratio=1.5)


@query(f"""SELECT 'empty_column' AS "check", 'info' AS severity, c AS subject, {R6('s')} AS detail FROM (SELECT 'seller_name' AS c, count(seller_name)::DOUBLE / count(*) AS s FROM products UNION ALL SELECT 'rating', count(rating)::DOUBLE / count(*) FROM products) WHERE s < 0.25""")
def aud_empty_columns(spark, d):
    return audit.empty_columns(products(spark, d), ["seller_name", "rating", "title"]).withColumn("detail", r6(F.col("detail")))


@query(f"""SELECT 'unseen_store' AS "check", 'severe' AS severity, CAST(l_suppkey AS STRING) AS subject, (date_diff('microsecond', max(l_shipdate), {NOW_SQL}) // 3600000000)::DOUBLE AS detail FROM lineitem GROUP BY l_suppkey HAVING detail > 36""")
def aud_unseen_stores(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("store_id"), F.col("l_shipdate").alias("last_seen_at"))
    return audit.unseen_stores(rows, now())


@query(f"""{RUNS} , good AS (SELECT store_id, max(finished_at) AS g FROM runs WHERE status <> 'failed' GROUP BY store_id)
SELECT store_id, count(*) AS consecutive_failures, max(finished_at) + to_minutes(least(360, 5 * pow(2, least(count(*), 30) - 1))::BIGINT) AS paused_until FROM runs LEFT JOIN good USING (store_id) WHERE status = 'failed' AND (g IS NULL OR finished_at > g) GROUP BY store_id""")
def str_circuit_breaker(spark, d):
    return audit.breaker(runs(spark, d))


@query("""SELECT 'empty_categories' AS "check", 'info' AS severity, string_agg(slug, ',' ORDER BY slug) AS subject, count(*)::DOUBLE AS detail FROM categories c WHERE parent_slug IS NULL
AND NOT EXISTS (SELECT 1 FROM deals JOIN categories k ON k.slug = category WHERE coalesce(k.parent_slug, k.slug) = c.slug AND deals.condition = 'none') HAVING count(*) > 3""")
def aud_empty_roots(spark, d):
    """All root categories are empty of deals in a condition that none has."""
    return audit.empty_categories(categories(spark, d), deals(spark, d).filter("condition = 'none'"))


@query("""SELECT 'empty_categories' AS "check", 'info' AS severity, string_agg(slug, ',' ORDER BY slug) AS subject, count(*)::DOUBLE AS detail FROM categories c WHERE parent_slug IS NULL
AND NOT EXISTS (SELECT 1 FROM deals JOIN categories k ON k.slug = 'NATION_' || CAST(5 * (product_id % 5) AS STRING) WHERE coalesce(k.parent_slug, k.slug) = c.slug) HAVING count(*) > 3""")
def aud_empty_categories(spark, d):
    """All deals, dealt over every fifth nation, which leaves roots unused however many there are."""
    placed = deals(spark, d).withColumn("category", F.concat(F.lit("NATION_"), (5 * (F.col("product_id") % 5)).cast("string")))
    return audit.empty_categories(categories(spark, d), placed)


@query("""SELECT store_id, scope, coalesce(laps, 0) AS laps, coalesce(next_page, 1) AS next_page FROM (SELECT s_suppkey AS store_id, s_nationkey AS scope FROM supplier) LEFT JOIN
(SELECT l_suppkey AS store_id, s_nationkey AS scope, max(l_linenumber)::BIGINT AS next_page, count(*) // 100 AS laps FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 3 <> 0 GROUP BY 1, 2) USING (store_id, scope)""")
def srt_collection_order(spark, d):
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_nationkey").alias("scope"))
    moved = table(spark, d, "lineitem").filter("l_suppkey % 3 <> 0").groupBy(F.col("l_suppkey").alias("store_id")).agg(F.max("l_linenumber").cast("long").alias("next_page"), F.floor(F.count(F.lit(1)) / 100).alias("laps"))
    return audit.collection_order(supplier, supplier.join(moved, "store_id")).select("store_id", "scope", "laps", "next_page")


@query(f"""SELECT store_id, products, {R6('greatest(20, 3600 * products / sum(products) OVER (ORDER BY store_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS seconds FROM (SELECT l_suppkey AS store_id, count(*) AS products FROM lineitem GROUP BY l_suppkey)""")
def str_time_shares(spark, d):
    stores = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("store_id")).agg(F.count(F.lit(1)).alias("products")).withColumn("place", F.col("store_id"))
    return audit.time_shares(stores, 3600.0).select("store_id", "products", r6(F.col("seconds")).alias("seconds"))
