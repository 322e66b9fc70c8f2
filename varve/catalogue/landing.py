"""The readers of landed files: files are written from the driver's tables, then read back, beside the same rows as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.functions import jsonld, text
from varve.operators.filters import DealFilters
from varve.plans import readmodel
from varve.sources import discovery, landed
from varve.staging import dealt, folder

from .base import R6, deals, query, r6, table

#: Products of a landed file.
PAGE = 100
#: Streams of pages that run side by side: each has a thread and a Python process of some 30 MB at the driver.
STREAMS = 4


def land(files: DataFrame, name: str, kind: str = "") -> str:
    """The folder that files (page, value) are written to, each page as a file of its own. Every tenth product is
    on two pages, as happens where a listing moves while it is read."""
    path = f"{folder(files.sparkSession)}/landed-{name}-{uuid.uuid4().hex}"
    files.select("page", "value").write.partitionBy("page").option("compression", kind or "none").text(path)
    return path


def land_lines(files: DataFrame, name: str) -> str:
    """The folder that JSON lines (value) are written to, as many in a file as a task has: where a line is an answer of its own,
    nothing depends on which file it is in, and a file a page would be as many files as pages times tasks."""
    path = f"{folder(files.sparkSession)}/landed-{name}-{uuid.uuid4().hex}"
    files.select("value").write.text(path)
    return path


def items(spark, d: str) -> DataFrame:
    """The part table, dealt out, as pages are made of its rows and read back one by one and its file is small."""
    return dealt(table(spark, d, "part"), "p_partkey")


def parts(spark, d: str) -> DataFrame:
    page = F.floor(F.col("p_partkey") / PAGE)
    return items(spark, d).withColumn("page", F.explode(F.when(F.col("p_partkey") % 10 == 0, F.array(page, page + 1)).otherwise(F.array(page))))


def json_pages(rows: DataFrame, item: str, wrap: str) -> DataFrame:
    """page and value: a page's items (an SQL expression of one) as the JSON of `wrap`, which names them items."""
    return rows.groupBy("page").agg(F.collect_list(F.expr(item)).alias("items")).select("page", F.expr(f"to_json({wrap})").alias("value"))


NAMED = "concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' Open Box' WHEN 1 THEN ' refurbished' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN concat(' (AB-', CAST(p_partkey AS STRING), 'X)') ELSE '' END)"
CONDITION = "CASE p_partkey % 5 WHEN 0 THEN 'open-box' WHEN 1 THEN 'refurbished' ELSE 'new' END"
SHOWN = ["store_id", "sku", "title", "condition", "price", "list_price"]


@query(f"""SELECT 'shop' AS store_id, p_partkey::VARCHAR AS sku, {NAMED} AS title, {CONDITION} AS condition, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE p_retailprice * 0.5e0 END AS price,
CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS list_price, CASE WHEN p_partkey % 2 = 0 THEN concat('AB-', p_partkey, 'X') END AS model FROM part""")
def src_json_listing(spark, d):
    """Listings and searches by JSON: a sale price is optional, a list price needs to be above it."""
    item = f"struct(CAST(p_partkey AS STRING) AS sku, {NAMED} AS name, p_retailprice AS regularPrice, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice * 0.5e0 END AS salePrice)"
    path = land(json_pages(parts(spark, d), item, "struct(size(items) AS total, items AS products)"), "listing")
    return landed.json_listing(spark, path, "shop").select(*SHOWN, "model")


@query(""", nodes AS (SELECT p_brand AS id, count(*) AS total FROM part GROUP BY p_brand)
SELECT id FROM nodes WHERE total <= 80 UNION ALL SELECT DISTINCT concat(p_brand, '-', p_size) FROM part JOIN nodes ON p_brand = id WHERE total > 80""")
def src_wide_categories(spark, d):
    """Brands of more than 80 products are asked for size by size."""
    rows = table(spark, d, "part")
    brands = rows.groupBy(F.col("p_brand").alias("id")).agg(F.lit(None).cast("string").alias("parent_id"), F.count(F.lit(1)).alias("total"), F.lit(1).alias("level"))
    sizes = rows.groupBy(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("id"), F.col("p_brand").alias("parent_id")).agg(F.count(F.lit(1)).alias("total"), F.lit(2).alias("level"))
    return landed.wide_category_nodes(brands.unionByName(sizes), most=80).select("id")


@query("""SELECT 'c' AS store_id, p_partkey::VARCHAR AS sku, concat(p_name, ' ', p_type) AS title, p_retailprice AS price, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1099.5e0 WHEN p_partkey % 4 = 1 THEN p_size + 1000e0 END AS list_price,
p_partkey % 2 = 0 AS in_stock, p_type AS store_category FROM part""")
def src_code_listing(spark, d):
    previous = "CASE WHEN p_partkey % 4 = 0 THEN struct(concat('1 ', lpad(CAST(p_size + 99 AS STRING), 3, '0')) AS wholeNumber, '50' AS decimals) WHEN p_partkey % 4 = 1 THEN struct(concat('1 ', lpad(CAST(p_size AS STRING), 3, '0')) AS wholeNumber, CAST(NULL AS STRING) AS decimals) END"
    item = f"struct(CAST(p_partkey AS STRING) AS id, p_name AS name, p_type AS typeName, p_partkey % 2 = 0 AS onlineSellable, struct(p_retailprice AS numeral, {previous} AS previous) AS salesPrice)"
    path = land(json_pages(parts(spark, d), item, "struct(items AS productWindow)"), "code")
    return landed.code_listing(spark, path, "c").select("store_id", "sku", "title", "price", "list_price", "in_stock", "store_category")


@query("""SELECT 's' AS store_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR ELSE concat('V', p_partkey) END AS sku, concat('/products/h', p_partkey) AS url, p_name AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS brand,
concat('Made of ', p_name, ' & more, by ', p_brand, CASE WHEN p_partkey % 2 = 0 THEN concat(' ', p_type, ', second') ELSE '' END) AS description, p_retailprice AS price, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice * 2 END AS list_price, p_partkey % 7 <> 0 AS in_stock FROM part""")
def src_shop_catalogue(spark, d):
    """Descriptions are the text of the markup and the tags that name features; vendors that are no brand are left out."""
    variant = "struct(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('V', p_partkey) END AS sku, CAST(p_retailprice AS STRING) AS price, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_retailprice * 2 AS STRING) END AS compare_at_price, p_partkey % 7 <> 0 AS available)"
    tags = "CASE WHEN p_partkey % 2 = 0 THEN array(concat('feature:', p_type), 'other', 'feature:no', 'feature: second') ELSE array('other') END"
    item = f"struct(p_partkey AS id, p_name AS title, concat('h', p_partkey) AS handle, CASE WHEN p_partkey % 4 = 0 THEN concat('Vendor ', p_brand) ELSE p_brand END AS vendor, concat('<p>Made of <b>', p_name, '</b> &amp; more,<br/> by&nbsp;', p_brand, '</p>') AS body_html, {tags} AS tags, array({variant}) AS variants)"
    path = land(json_pages(parts(spark, d), item, "struct(items AS products)"), "shop")
    return landed.shop_catalogue(spark, path, "s").select("store_id", "sku", "url", "title", "brand", "description", "price", "list_price", "in_stock")


@query("""SELECT 'g' AS store_id, p_partkey::VARCHAR AS sku, concat('/k', p_partkey) AS url, p_name AS title, p_type AS store_category, floor((p_partkey % 101)::DOUBLE / 20 * 10 + 0.5e0) / 10 AS rating, (p_partkey % 30)::BIGINT AS rating_count,
p_retailprice AS price, p_retailprice * 1.5e0 AS list_price, p_partkey % 6 <> 0 AS in_stock FROM part""")
def src_graph_catalogue(spark, d):
    low = "struct(struct(struct(p_retailprice * 1.5e0 AS value) AS regular_price, struct(p_retailprice AS value) AS final_price) AS minimum_price)"
    item = f"struct(CAST(p_partkey AS STRING) AS sku, p_name AS name, concat('k', p_partkey) AS url_key, CAST(p_partkey % 101 AS DOUBLE) AS rating_summary, p_partkey % 30 AS review_count, CASE WHEN p_partkey % 6 = 0 THEN 'OUT' ELSE 'IN_STOCK' END AS stock_status, array(struct(p_brand AS name), struct(p_type AS name)) AS categories, {low} AS price_range)"
    path = land(json_pages(parts(spark, d), item, "struct(struct(struct(size(items) AS total_count, items AS items) AS products) AS data)"), "graph")
    return landed.graph_catalogue(spark, path, "g").select("store_id", "sku", "url", "title", "store_category", "rating", "rating_count", "price", "list_price", "in_stock")


@query(f"""SELECT 'n' AS store_id, p_partkey::VARCHAR AS sku, {NAMED} AS title, {CONDITION} AS condition, p_retailprice AS price, CASE WHEN p_partkey % 2 = 1 THEN p_retailprice + 10 END AS list_price FROM part""")
def src_embedded_state(spark, d):
    """The state is landed as compressed pages."""
    item = f"struct(CAST(p_partkey AS STRING) AS Item, {NAMED} AS Title, p_brand AS Brand, p_retailprice AS Price, CASE WHEN p_partkey % 2 = 1 THEN p_retailprice + 10 END AS ListPrice)"
    pages = json_pages(parts(spark, d), item, "struct(items AS Products)")
    html = F.concat(F.lit("<html><script>window.__initialState__ = "), "value", F.lit(";</script></html>"))
    return landed.embedded_state(landed.pages(spark, land(pages.withColumn("value", html), "state", "gzip")), "n").select(*SHOWN)


@query("""SELECT 'p' AS store_id, concat('K', p_partkey) AS sku, p_name AS title, p_brand AS brand, concat('Root > ', p_type) AS store_category, (p_partkey % 50)::DOUBLE / 10 AS rating, (p_partkey % 9)::BIGINT AS rating_count,
p_size + 1000.25e0 AS price, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 3 = 1 END AS in_stock FROM part""")
def src_product_pages(spark, d):
    """JSON-LD of product pages: malformed blocks are skipped, levels of a breadcrumb come by position, prices have commas."""
    offer = "struct(concat('1,', lpad(CAST(p_size AS STRING), 3, '0'), '.25') AS price, CASE p_partkey % 3 WHEN 1 THEN 'https://schema.org/InStock' WHEN 2 THEN 'https://schema.org/OutOfStock' END AS availability)"
    block = f"to_json(struct('Product' AS `@type`, concat('K', p_partkey) AS sku, p_name AS name, struct(p_brand AS name) AS brand, array({offer}) AS offers, struct(CAST((p_partkey % 50) / 10 AS STRING) AS ratingValue, CAST(p_partkey % 9 AS STRING) AS reviewCount) AS aggregateRating))"
    crumbs = "to_json(struct('BreadcrumbList' AS `@type`, array(struct(2 AS position, p_type AS name), struct(1 AS position, 'Root' AS name)) AS itemListElement))"
    script = "'<script type=\"application/ld+json\">'"
    html = f"concat('<html>', {script}, '{{broken</script>', {script}, {crumbs}, '</script>', {script}, {block}, '</script></html>')"
    pages = parts(spark, d).select(F.expr("concat('https://p/', p_partkey)").alias("url"), F.expr(html).alias("html"))
    return landed.product_pages(pages, "p").select("store_id", "sku", "title", "brand", "store_category", "rating", "rating_count", "price", "in_stock")


@query("""SELECT 'w' AS store_id, concat('one-', p_partkey) AS sku, concat('/p/one-', p_partkey) AS url, concat('Café ', p_name) AS title, (p_size * 100 + p_partkey % 100) / 100e0 AS price FROM part""")
def src_price_cards(spark, d):
    """Cards of rendered pages, French and English prices in turn."""
    cents = "lpad(CAST(p_partkey % 100 AS STRING), 2, '0')"
    card = f"concat('<a href=\"/p/one-', p_partkey, '\" title=\"Caf&#233; ', p_name, '\">x</a> <b>', CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, ',', {cents}, ' $') ELSE concat('$', p_size, '.', {cents}) END, '</b> ')"
    pages = parts(spark, d).groupBy("page").agg(F.array_join(F.collect_list(F.expr(card)), "").alias("value"))
    return landed.price_cards(landed.pages(spark, land(pages, "cards")), "w").select("store_id", "sku", "url", "title", "price")


@query("""SELECT concat('https://x.ca/p/item-', p_partkey, '-', replace(p_brand, '#', '')) AS url, upper(concat('item', p_partkey, replace(p_brand, '#', ''))) AS url_key FROM part WHERE p_partkey % 6 <> 0""")
def src_sitemap_urls(spark, d):
    """Addresses of pages that sell nothing and of other sitemaps are left out, and repeated ones."""
    loc = "concat('<url><loc> https://x.ca/', CASE WHEN p_partkey % 12 = 0 THEN 'support/' WHEN p_partkey % 6 = 0 THEN '' ELSE 'p/' END, 'item-', p_partkey, '-', replace(p_brand, '#', ''), CASE WHEN p_partkey % 12 = 6 THEN '.xml.gz' ELSE '' END, ' </loc></url>')"
    files = parts(spark, d).groupBy("page").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.expr(loc)), ""), F.lit("<url><loc>https://x.ca/p/short</loc></url></urlset>")).alias("value"))
    return landed.sitemap_urls(spark, land(files, "sitemaps", "gzip"))


@query("""SELECT concat('https://x.com/', CASE WHEN n_nationkey % 3 = 0 THEN 'fr-CA' ELSE 'us' END, '/', lower(replace(n_name, ' ', '-')), '.xml.gz') AS url FROM nation ORDER BY n_nationkey % 3 <> 0, url LIMIT 20""")
def src_child_sitemaps(spark, d):
    """The region's sitemaps first, 20 at most."""
    loc = "concat('<sitemap><loc>https://x.com/', CASE WHEN n_nationkey % 3 = 0 THEN 'fr-CA' ELSE 'us' END, '/', lower(replace(n_name, ' ', '-')), '.xml.gz</loc></sitemap>')"
    files = table(spark, d, "nation").groupBy(F.lit(0).alias("page")).agg(F.array_join(F.collect_list(F.expr(loc)), "").alias("value"))
    return landed.child_sitemaps(spark, land(files, "index"), "fr-ca", most=20)


@query("""SELECT p_partkey::VARCHAR AS sku, p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN concat('M', p_size) END AS model, p_mfgr AS manufacturer, (p_partkey % 5)::DOUBLE AS rating, p_partkey % 40 AS rating_count FROM (SELECT *, concat('Maker of ', p_brand) AS p_mfgr FROM part)""")
def src_details(spark, d):
    item = "to_json(struct(CAST(p_partkey AS STRING) AS sku, p_brand AS brandName, CASE WHEN p_partkey % 2 = 0 THEN concat('M', p_size) END AS modelNumber, concat('Maker of ', p_brand) AS manufacturer, CAST(p_partkey % 5 AS DOUBLE) AS customerRating, p_partkey % 40 AS customerRatingCount))"
    return landed.details(spark, land_lines(items(spark, d).select(F.expr(item).alias("value")), "details"))


REVIEW_TEXT = "concat('Good ', p_name, CASE WHEN p_partkey % 3 = 0 THEN ' [This review was collected as part of a promotion.]' ELSE '' END)"


@query("""SELECT p_partkey * 10 AS review_id, p_partkey AS product_id, (1 + p_partkey % 5)::INTEGER AS stars, concat('Good ', p_name) AS text, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS helpful, p_partkey % 4 = 0 AS verified, p_partkey % 3 = 0 AS incentivised FROM part""")
def src_reviews(spark, d):
    """Notes of paid reviews become a mark."""
    review = f"struct(p_partkey * 10 AS id, 1 + p_partkey % 5 AS rating, {REVIEW_TEXT} AS comment, CASE WHEN p_partkey % 2 = 0 THEN 3 END AS helpfulVotes, CASE WHEN p_partkey % 4 <> 1 THEN p_partkey % 4 = 0 END AS verifiedPurchaser)"
    rows = items(spark, d).select(F.expr(f"to_json(struct(p_partkey AS productId, array({review}) AS reviews))").alias("value"))
    return landed.reviews(spark, land_lines(rows, "reviews"))[0].select("review_id", "product_id", "stars", "text", "helpful", "verified", "incentivised")


@query(f"""SELECT p_partkey AS product_id, {R6("CASE p_partkey % 6 WHEN 0 THEN p_size + 100.5e0 WHEN 1 THEN p_size + 20 WHEN 2 THEN p_size + 30 WHEN 3 THEN 40 END")} AS price FROM part""")
def src_price_layers(spark, d):
    """JSON-LD, then microdata, Open Graph and the median of blobs; prices that aren't plausible are none."""
    ld = "concat('<script type=\"application/ld+json\">', to_json(struct('Product' AS `@type`, struct(p_size + 100.5e0 AS price) AS offers)), '</script><meta itemprop=\"price\" content=\"7\">')"
    html = f"""CASE p_partkey % 6 WHEN 0 THEN {ld} WHEN 1 THEN concat('<meta itemprop="price" content="', p_size + 20, '.00"><meta property="og:price:amount" content="9">')
        WHEN 2 THEN concat('<meta property="product:price:amount" content="', p_size + 30, '.00">') WHEN 3 THEN '{{"price":"10.00"}} {{"price":99}} {{"price":"40.00"}}' WHEN 4 THEN '{{"price": 2}}' ELSE 'none' END"""
    return items(spark, d).select(F.col("p_partkey").alias("product_id"), r6(jsonld.layered_price(F.expr(html))).alias("price"))


@query("""SELECT p_partkey AS product_id, CASE WHEN p_partkey % 3 = 0 THEN 'televiseurs' WHEN p_partkey % 3 = 1 THEN 'image-son' END AS slug, CASE WHEN p_partkey % 2 = 0 THEN concat('First about ', p_name, '. Second one!') ELSE 'Short. A. Third part of it.' END AS lead FROM part""")
def src_classified(spark, d):
    """Breadcrumbs by the deepest level that a rule knows, and the first sentences of a text."""
    path = F.expr("CASE p_partkey % 3 WHEN 0 THEN array('Image', 'Téléviseurs', 'Soldes') WHEN 1 THEN array('Image', p_brand) ELSE array(p_brand) END")
    said = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('First about ', p_name, '. Second one! Third.') ELSE 'Short. A. Third part of it.' END")
    rules = [("tele", "televiseurs"), ("image", "image-son")]
    return items(spark, d).select(F.col("p_partkey").alias("product_id"), landed.classify(path, rules, ["soldes"]).alias("slug"), text.lead_sentences(said).alias("lead"))


@query("""SELECT p_partkey AS product_id, p_partkey % 3 <> 2 AS found, CASE WHEN p_partkey % 3 <> 2 THEN least((p_partkey % 15) / 10e0, 1e0) ELSE 0e0 END AS confidence, p_size + 1e0 AS typical_price,
CASE p_partkey % 3 WHEN 2 THEN '' ELSE 'https://a' END AS sources, concat('/i/', 300, 'x', 300, '/', p_partkey, '.jpg') AS picture, CASE WHEN p_partkey % 2 = 0 THEN 500 ELSE 200 END AS nearest FROM part""")
def src_researched(spark, d):
    """Answers about prices count with a source on the web; pictures in other sizes, and the size nearest to 400."""
    raw = F.expr("concat('Here: ', to_json(struct(p_size + 1e0 AS typical_price, -5e0 AS known_low, (p_partkey % 15) / 10e0 AS confidence, CASE WHEN p_partkey % 3 = 2 THEN array('a note') ELSE array('https://a', 'a note') END AS sources)), ' done')")
    sizes = F.expr("CASE WHEN p_partkey % 2 = 0 THEN array(200, 500, 1000) ELSE array(200, 1000) END")
    picture = jsonld.image_sizes(F.expr("concat('/i/80x60/', p_partkey, '.jpg')"), [300, 600])
    rows = items(spark, d).select(F.col("p_partkey").alias("product_id"), jsonld.reference_answer(raw).alias("r"), picture[0].alias("picture"), jsonld.nearest_size(sizes, 400)[0].alias("nearest"))
    return rows.select("product_id", "r.found", "r.confidence", "r.typical_price", F.array_join("r.sources", ",").alias("sources"), "picture", "nearest")


@query("""SELECT product_id, store_id, price FROM deals WHERE is_active AND is_variant_lead AND condition <> 'new' AND store_id IN (1, 2, 5) AND price >= 300 AND (in_stock IS NULL OR in_stock) ORDER BY price, product_id LIMIT 48""")
def flt_from_address(spark, d):
    """Filters decoded from an address; a bound that isn't a number is none, and what may be in stock passes."""
    f = DealFilters.from_query("condition=used&stores=1,2,%205&min=300&max=many&stock=1&sort=price-asc")
    return readmodel.top_deals(deals(spark, d), f).select("product_id", "store_id", "price")


@query("""SELECT 'shop' AS store_id, p_brand AS scope, (count(*) + 9) // 10 + 1 AS next_page, 0 AS laps, count(*) AS records, (count(*) + 9) // 10 AS pages, TRUE AS bounded FROM part GROUP BY p_brand""")
def src_paged_stream(spark, d):
    """Brands as scopes of pages of ten products, dealt to streams side by side, in batches of 400 records each, with a stop after the
    first pages: the cursors, and what was read."""
    from varve.sources import paged

    root = f"{folder(spark)}/paged-{uuid.uuid4().hex}"
    rows = table(spark, d, "part").withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    pages = rows.select(F.col("p_brand").alias("scope"), F.lit(0).alias("lap"), (F.floor(F.col("n") / 10) + 1).cast("int").alias("page"), F.to_json(F.struct("p_partkey", "p_name")).alias("record"))
    scopes = sorted(r.p_brand for r in table(spark, d, "part").select(F.coalesce("p_brand", F.lit(paged.NONE)).alias("p_brand")).distinct().collect())

    def keep(share):
        return lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/rows/share={share}/batch={number}")

    for half in (F.col("page") <= 2, F.col("page") > 2):
        paged.land(pages.filter(half), f"{root}/in")
        running = []
        try:
            for k in range(min(STREAMS, len(scopes))):
                stream = paged.page_stream(spark, f"{root}/in", f"{root}/cursor/share={k}", scopes=scopes[k::STREAMS])
                running.append(stream.writeStream.foreachBatch(keep(k)).option("checkpointLocation", f"{root}/progress/share={k}").start())
            for each in running:
                each.processAllAvailable()
        finally:
            for each in running:
                each.stop()
    rows = spark.read.schema(f"{paged.SCHEMA}, share int, batch bigint").parquet(f"{root}/rows")
    read = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("lap", "page").alias("pages"))
    largest = rows.groupBy("share", "batch").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") < paged.RECORDS + 10).alias("bounded"))
    found = paged.cursors(spark, f"{root}/cursor/*", "shop").join(read, "scope").join(F.broadcast(largest))
    return found.withColumn("scope", F.nullif("scope", F.lit(paged.NONE)))


@query("""SELECT concat('https://x.ca/p/', p_partkey) AS url, concat(CASE WHEN p_partkey % 25 % 2 = 0 THEN 'n' WHEN p_partkey % 25 % 4 = 1 THEN 'm' ELSE 'd' END, p_partkey % 25) AS sitemap,
CASE WHEN p_partkey % 25 % 2 = 0 THEN 1 WHEN p_partkey % 25 % 4 = 1 THEN 2 ELSE 3 END AS level FROM part JOIN nation ON n_nationkey = p_partkey % 25""")
def src_sitemap_tree(spark, d):
    """An index of 25 sitemaps; every second one is an index itself, of which every second one's is an index again, named by the first, too.
    All indexes name the root; an index three steps down names pages."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    index = lambda inside: F.concat(F.lit("<sitemapindex><loc>root</loc>"), inside, F.lit("</sitemapindex>"))
    loc = lambda letter: F.format_string(f"<loc>{letter}%d</loc>", "k")
    root = nations.agg(F.array_join(F.collect_list(loc("n")), "").alias("inside")).select(F.lit("root").alias("url"), index(F.col("inside")).alias("xml"))
    pages = table(spark, d, "part").groupBy((F.col("p_partkey") % 25).alias("k")).agg(F.array_join(F.collect_list(F.format_string("<url><loc>https://x.ca/p/%d</loc></url>", "p_partkey")), "").alias("urls"))
    odd, deep = F.col("k") % 2 == 1, F.col("k") % 4 == 3
    second = nations.filter(odd).select(F.format_string("n%d", "k").alias("url"), index(loc("m")).alias("xml"))
    third = nations.filter(deep).select(F.format_string("m%d", "k").alias("url"), index(F.concat(loc("d"), loc("n"))).alias("xml"))
    letter = F.when(~odd, "n").when(~deep, "m").otherwise("d")
    last = pages.select(F.concat(letter, F.col("k").cast("string")).alias("url"), F.when(deep, F.concat(F.lit("<sitemapindex>"), "urls", F.lit("</sitemapindex>"))).otherwise(F.concat(F.lit("<urlset>"), "urls", F.lit("</urlset>"))).alias("xml"))
    maps = root.union(second).union(third).union(last)
    return discovery.sitemap_pages(maps, spark.range(1).select(F.lit("root").alias("url")))


@query(""", counted AS (SELECT p_brand, p_size, count(*) OVER (PARTITION BY p_brand) AS brand_total, count(*) OVER (PARTITION BY p_brand, p_size // 10) AS band_total, count(*) OVER (PARTITION BY p_brand, p_size) AS size_total FROM part)
SELECT p_brand AS facet, NULL AS category, brand_total AS total, 0 AS splits FROM counted UNION SELECT p_brand, concat('band-', p_size // 10), band_total, 1 FROM counted WHERE brand_total > 12
UNION SELECT p_brand, concat('size-', p_size), size_total, 2 FROM counted WHERE brand_total > 12 AND band_total > 12""")
def src_brand_cells(spark, d):
    """Brands of more than 12 products by bands of sizes, and such bands by sizes, as far as each is too wide."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("facet"), F.format_string("band-%d", F.floor(F.col("p_size") / 10)).alias("band"), F.format_string("size-%d", F.col("p_size").cast("long")).alias("size"))
    count = F.count(F.lit(1)).alias("total")
    probes = rows.groupBy("facet", F.col("band").alias("category")).agg(count).union(rows.groupBy("facet", "size").agg(count))
    tree = rows.select(F.col("band").alias("id"), F.lit(None).cast("string").alias("parent_id")).union(rows.select("size", "band")).distinct()
    return discovery.narrow_cells(rows.groupBy("facet").agg(count), tree, probes, 12)
