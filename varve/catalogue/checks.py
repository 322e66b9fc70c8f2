"""Audits, queues, lookups and record rules on the stand-in catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varve.functions import display, prices, text
from varve.operators import audit, fusion, ingest
from varve.plans import readmodel

from .base import DEAL, NOW_SQL, R6, deals, now, products, query, r6, table
from .listing import RUNS, runs


def ago(days: Column) -> Column:
    return now() - F.make_dt_interval(days.cast("int"))


AGO = f"{NOW_SQL} - to_days(CAST(%s AS INTEGER))"


@query("""SELECT 'hidden_condition' AS "check", 'severe' AS severity, condition AS subject, count(*)::DOUBLE AS detail FROM deals WHERE condition NOT IN (SELECT condition FROM (SELECT condition FROM deals ORDER BY score DESC, product_id LIMIT 1)
UNION ALL SELECT condition FROM (SELECT condition FROM deals WHERE condition <> 'new' ORDER BY score DESC, product_id LIMIT 1)) GROUP BY condition HAVING count(*) > 10""")
def aud_hidden_conditions(spark, d):
    return audit.hidden_conditions(deals(spark, d), least=10, top=1)


@query("""SELECT 'unexplained_score' AS "check", 'severe' AS severity, 'reasons' AS subject, count(*)::DOUBLE AS detail FROM deals WHERE score > 45 AND product_id % 3 <> 1 HAVING count(*) > 0""")
def aud_unexplained_scores(spark, d):
    reasons = F.when(F.col("product_id") % 3 == 1, F.array(F.lit("lowest price"))).when(F.col("product_id") % 3 == 0, F.array().cast("array<string>"))
    return audit.unexplained_scores(deals(spark, d).withColumn("reasons", reasons))


@query(f"""SELECT 'without_peers' AS "check", 'suspect' AS severity, 'peer_key' AS subject, {R6('share')} AS detail FROM (SELECT count(*) FILTER (product_id % 4 = 0)::DOUBLE / count(*) AS share FROM deals) WHERE share > 0.2""")
def aud_without_peers(spark, d):
    return audit.without_peers(deals(spark, d).withColumn("peer_size", F.when(F.col("product_id") % 4 != 0, 7))).withColumn("detail", r6(F.col("detail")))


@query(f"""{RUNS} SELECT 'stale_runs' AS "check", CASE WHEN h > 72 THEN 'severe' ELSE 'suspect' END AS severity, 'runs' AS subject, h::DOUBLE AS detail FROM (SELECT date_diff('microsecond', max(finished_at), {NOW_SQL}) // 3600000000 AS h FROM runs WHERE status IN ('ok', 'partial')) WHERE h > 24
UNION ALL SELECT 'short_history', 'info', 'points', {R6('max(l_linenumber) / 24e0')} FROM lineitem""")
def aud_stale_data(spark, d):
    """The histories begin as many hours before now as orders have lines."""
    short = table(spark, d, "lineitem").select((now() - F.make_dt_interval(F.lit(0), F.col("l_linenumber").cast("int"))).alias("observed_at"))
    return audit.stale_data(runs(spark, d), short, now()).withColumn("detail", r6(F.col("detail")))


@query("""SELECT 'paused_store' AS "check", 'severe' AS severity, CAST(s_suppkey AS STRING) AS subject, (s_suppkey % 5)::DOUBLE AS detail FROM supplier WHERE s_suppkey % 9 = 0""")
def aud_paused_stores(spark, d):
    paused = F.when(F.col("s_suppkey") % 9 == 0, now() + F.make_dt_interval(F.lit(1))).when(F.col("s_suppkey") % 9 == 1, ago(F.lit(1)))
    return audit.paused_stores(table(spark, d, "supplier").select(F.col("s_suppkey").alias("store_id"), paused.alias("paused_until"), (F.col("s_suppkey") % 5).alias("consecutive_failures")), now())


@query("""SELECT 'idle_cursor' AS "check", 'suspect' AS severity, CAST(l_suppkey AS STRING) AS subject, count(*)::DOUBLE AS detail FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY l_suppkey HAVING count(*) > 550""")
def aud_idle_cursors(spark, d):
    """A third of the stores has a cursor that moved, a third one that didn't and a third none."""
    cursors = table(spark, d, "supplier").filter("s_suppkey % 3 <> 1").select(F.col("s_suppkey").alias("store_id"), F.lit(1).alias("next_page"), F.when(F.col("s_suppkey") % 3 == 0, 2).otherwise(0).alias("laps"))
    return audit.idle_cursors(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("store_id")), cursors, least=550)


@query(""", a AS (SELECT count(*) AS n FROM products WHERE list_price > price * 1.5), p AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 9 = 0)
SELECT p.n + CASE WHEN a.n > 500 THEN 1 ELSE 0 END AS severe, CASE WHEN a.n BETWEEN 1 AND 500 THEN 1 ELSE 0 END::BIGINT AS suspect, 0::BIGINT AS info, p.n + CASE WHEN a.n > 500 THEN 1 ELSE 0 END > 0 AS failed FROM a, p""")
def aud_verdict(spark, d):
    """Findings counted by severity; any severe one fails the run."""
    return audit.verdict(audit.report(aud_paused_stores(spark, d), audit.absurd_list_prices(products(spark, d), ratio=1.5)))


@query("""SELECT store_id, last_collected_at, row_number() OVER (ORDER BY last_collected_at NULLS FIRST, store_id) AS place FROM (SELECT c_custkey AS store_id, max(o_orderdate) AS last_collected_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'O' GROUP BY c_custkey)
QUALIFY place <= 200""")
def srt_stale_first(spark, d):
    """The first 200 stores to collect."""
    done = table(spark, d, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("store_id"), F.col("o_orderdate").alias("finished_at"))
    return audit.stale_first(table(spark, d, "customer").select(F.col("c_custkey").alias("store_id")), done, 200)


@query("""SELECT product_id, title, price, score FROM deals WHERE product_id = 42""")
def api_product(spark, d):
    return readmodel.product(deals(spark, d), 42).select("product_id", "title", "price", "score")


@query("""SELECT 42::BIGINT AS product_id, max(p_retailprice) AS launch_price, 'list price' AS notes, '["https://example.org/42"]' AS sources, TIMESTAMP '2001-11-01' AS checked_at FROM part WHERE p_partkey = 42""")
def api_manufacturer_reference(spark, d):
    found = table(spark, d, "part").select(
        F.col("p_partkey").alias("product_id"), (F.col("p_partkey") % 2 == 0).alias("found"), F.col("p_retailprice").alias("launch_price"), F.lit("list price").alias("notes"),
        F.concat(F.lit('["https://example.org/'), F.col("p_partkey").cast("string"), F.lit('"]')).alias("sources"), F.lit("2001-11-01").cast("timestamp_ntz").alias("checked_at"),
    )
    return readmodel.manufacturer_reference(found, 42)


@query(f"""SELECT product_id, a AS amount, CASE WHEN a BETWEEN 5 AND 60000 THEN a END AS plausible, {R6('floor((product_id % 101) / 20e0 * 10 + 0.5) / 10')} AS stars, product_id % 3 < 2 AS same
FROM (SELECT product_id, CASE product_id % 4 WHEN 0 THEN 1000.5e0 + product_id % 1000 WHEN 1 THEN product_id + 0.25e0 END AS a FROM products)""")
def scl_loose_numbers(spark, d):
    i = F.col("product_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit("$1,"), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit(".50"))).when(i % 4 == 1, F.concat(i.cast("string"), F.lit(",25"))).when(i % 4 == 2, "-5").otherwise("n/a")
    amount = prices.loose_number(raw)
    return products(spark, d).select("product_id", amount.alias("amount"), prices.plausible_price(amount).alias("plausible"), r6(prices.five_stars(i % 101)).alias("stars"), prices.same_price(F.col("price"), F.col("price") + (i % 3) * 0.004).alias("same"))


@query("""SELECT product_id, CASE product_id % 4 WHEN 0 THEN 'QN55-' || product_id || 'A' WHEN 3 THEN 'AB12' END AS model, CASE product_id % 6 WHEN 0 THEN 'Samsung' WHEN 2 THEN 'LG' WHEN 5 THEN 'BOSE' END AS brand FROM products""")
def scl_brands_and_models(spark, d):
    i = F.col("product_id")
    code = F.when(i % 4 == 0, F.concat(F.lit("QN55-"), i.cast("string"), F.lit("A"))).when(i % 4 == 1, "256GB").when(i % 4 == 2, "abcd").otherwise("AB12")
    title = F.concat(F.lit("Screen (new) ("), code, F.lit(") with stand"))
    said = F.element_at(F.array(*map(F.lit, ("SAMSUNG", "a/b", "LG", "Vendor Aa", "WALMART", "bose"))), (i % 6 + 1).cast("int"))
    return products(spark, d).select("product_id", prices.model_of(title).alias("model"), prices.brand_case(prices.valid_brand(said), F.lit("Walmart")).alias("brand"))


@query("""SELECT product_id, CASE product_id % 5 WHEN 0 THEN 'open-box' WHEN 1 THEN 'open-box' WHEN 2 THEN 'refurbished' WHEN 3 THEN 'refurbished' ELSE 'new' END AS condition FROM products""")
def scl_conditions_in_titles(spark, d):
    words = F.array(*map(F.lit, ("(Open-Box)", "- Boîte ouverte", "REFURBISHED", "remise à neuf", "boxed")))
    return products(spark, d).select("product_id", prices.condition_of(F.concat_ws(" ", "title", F.element_at(words, (F.col("product_id") % 5 + 1).cast("int")))).alias("condition"))


@query("""SELECT product_id, CASE WHEN m < 1 THEN 'à l’instant' WHEN m < 60 THEN 'il y a ' || m || ' min' WHEN m < 1440 THEN 'il y a ' || m // 60 || ' h' WHEN m < 43200 THEN 'il y a ' || m // 1440 || ' j' ELSE 'il y a ' || m // 43200 || ' mois' END AS shown FROM (SELECT product_id, (product_id - 1) * 37 AS m FROM products)""")
def scl_time_ago(spark, d):
    then = now() - F.make_dt_interval(F.lit(0), F.lit(0), ((F.col("product_id") - 1) * 37).cast("int"))
    return products(spark, d).select("product_id", display.time_ago(then, now()).alias("shown"))


@query("""SELECT product_id, CASE WHEN product_id % 3 = 0 THEN 2 ELSE 0 END::INTEGER AS n, CASE WHEN product_id % 3 = 0 THEN '["a","b' || product_id || '"]' ELSE '[]' END AS written FROM products""")
def scl_json_lists(spark, d):
    i = F.col("product_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit('["a", "b'), i.cast("string"), F.lit('"]'))).when(i % 3 == 1, "not json")
    return products(spark, d).select("product_id", F.size(text.json_list(raw)).alias("n"), text.json_text(text.json_list(raw)).alias("written"))


@query("""SELECT product_id, 'cross_store' AS source, 0.72e0 AS reliability FROM products WHERE store_id IN (0, 1, 2) AND length(regexp_replace(upper(model), '[- .]', '', 'g')) >= 4 AND lower(brand) IN ('brand#11', 'brand#13', 'brand#2')""")
def fus_eligible(spark, d):
    brands = products(spark, d).filter("lower(brand) IN ('brand#11', 'brand#13', 'brand#2')").select(F.upper("brand").alias("brand"))
    return fusion.eligible(products(spark, d), "cross_store", [0, 1, 2], brands).select("product_id", "source", "reliability")


SCORED = f", scored AS (SELECT p.*, {DEAL['score']} AS score FROM products p JOIN part ON p_partkey = product_id)"


def scored(spark, d):
    return products(spark, d).join(deals(spark, d).select("product_id", "score"), "product_id")


@query(f"""{SCORED} SELECT s.product_id, score, price FROM scored s LEFT JOIN (SELECT product_id, CASE product_id % 2 WHEN 0 THEN 'ok' ELSE 'failed' END AS status, product_id % 5 AS attempts, {AGO % 'product_id % 60'} AS enriched_at FROM products WHERE product_id % 3 = 0) e USING (product_id)
WHERE (rating_count IS NULL OR (product_id % 8 <> 0 AND score >= 45)) AND (status IS NULL OR (status <> 'ok' AND attempts < 3) OR enriched_at < {AGO % '30'}) ORDER BY score DESC, price DESC, product_id LIMIT 400""")
def fus_enrichment_queue(spark, d):
    i = F.col("product_id")
    done = products(spark, d).filter("product_id % 3 = 0").select("product_id", F.when(i % 2 == 0, "ok").otherwise("failed").alias("status"), (i % 5).alias("attempts"), ago(i % 60).alias("enriched_at"))
    references = products(spark, d).filter("product_id % 4 = 0").select("product_id", (i % 8 == 0).alias("found"))
    return fusion.queue(scored(spark, d), done, references, now(), 50).select("product_id", "score", "price")


@query(f"""{SCORED} SELECT product_id, score FROM scored LEFT JOIN (SELECT product_id, {AGO % 'product_id % 90'} AS checked_at FROM products WHERE product_id % 3 = 0) USING (product_id) WHERE product_id % 40 < 21 AND (checked_at IS NULL OR checked_at < {AGO % '45'}) ORDER BY score DESC, product_id LIMIT 100""")
def fus_reference_queue(spark, d):
    checked = products(spark, d).filter("product_id % 3 = 0").select("product_id", ago(F.col("product_id") % 90).alias("checked_at"))
    return fusion.reference_queue(scored(spark, d).withColumn("days_observed", F.col("product_id") % 40), checked, now(), 100).select("product_id", "score")


@query("""SELECT product_id, CASE WHEN product_id % 5 = 0 THEN CASE WHEN product_id % 2 = 0 THEN 'Found' END ELSE brand END AS brand, CASE WHEN product_id % 2 = 0 AND product_id % 600 > coalesce(rating_count, 0) THEN 4.5e0 WHEN product_id % 2 = 0 THEN coalesce(rating, 4.5e0) ELSE rating END AS rating,
CASE WHEN product_id % 2 = 0 THEN greatest(rating_count, product_id % 600) ELSE rating_count END AS rating_count FROM products""")
def fus_write_back(spark, d):
    i = F.col("product_id")
    rows = products(spark, d).withColumn("brand", F.when(i % 5 != 0, F.col("brand")))
    found = products(spark, d).filter("product_id % 2 = 0").select("product_id", F.lit("Found").alias("brand"), F.lit("M1").alias("model"), F.lit(4.5).alias("rating"), (i % 600).alias("rating_count"))
    return fusion.write_back(rows, found).select("product_id", "brand", "rating", "rating_count")


@query("""SELECT product_id, CASE WHEN product_id % 3 <> 0 THEN brand ELSE h END AS brand FROM products LEFT JOIN (SELECT p_partkey AS product_id, min('Maker ' || (p_size % 3)) AS h FROM part WHERE p_partkey % 4 = 0 GROUP BY 1) USING (product_id)""")
def ing_label_brands(spark, d):
    rows = products(spark, d).withColumn("sku", F.col("product_id").cast("string")).withColumn("brand", F.when(F.col("product_id") % 3 != 0, F.col("brand")))
    part = table(spark, d, "part").filter("p_partkey % 4 = 0").select((F.col("p_partkey") % 7).alias("store_id"), F.col("p_partkey").cast("string").alias("sku"), F.concat(F.lit("Maker "), (F.col("p_size") % 3).cast("string")).alias("brand"))
    return ingest.label_brands(rows, part.union(part.withColumn("brand", F.lit("Maker z")))).select("product_id", "brand")


@query("""SELECT store_id, status, count(*) AS runs, CAST(sum(seen) AS BIGINT) AS products_seen FROM (SELECT o_custkey AS store_id, o_orderkey % 3 AS seen, CASE WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderstatus <> 'F' THEN 'ok' WHEN o_orderkey % 3 > 0 THEN 'partial' ELSE 'failed' END AS status FROM orders) GROUP BY store_id, status""")
def str_run_accounting(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("store_id"), (F.col("o_orderkey") % 7 == 0).alias("skipped"), F.when(F.col("o_orderstatus") == "F", "timeout").alias("error"), (F.col("o_orderkey") % 3).alias("products_seen"))
    return audit.run_accounting(rows)
