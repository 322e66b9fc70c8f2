"""Landed files as listings. Every reader is lazy, has a fixed schema and drops repeated products by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve import schema
from varve.functions import jsonld
from varve.functions.prices import bilingual_price, condition_of, five_stars, loose_number, model_of, valid_brand
from varve.functions.text import feature_text, numeric_entities, short_text

#: How far before a price a card may begin, in characters.
CARD = 4000


def listings(df: DataFrame, store: str, **columns: Column) -> DataFrame:
    """df as schema.LISTINGS: named columns as given, all others null."""
    columns = {"store_id": F.lit(store), **columns}
    more = [columns[c].alias(c) for c in ("_page", "_place") if c in columns]
    return df.select(*(columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in schema.columns(schema.LISTINGS)), *more)


def natural(text: Column) -> Column:
    """text such that its order is that of the numbers in it."""
    digits = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(digits, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def once(rows: DataFrame, store: str, **columns: Column) -> DataFrame:
    """listings() with one row per product of a store, as pages and subcategories repeat products: the last one by page (_page,
    a path in the order of its numbers) and place in it (_place). Products without sku can't be told apart later and are set aside; see unkeyed()."""
    found = _placed(rows, store, **columns).filter("sku is not null")
    names = [n for n, _ in schema.columns(schema.LISTINGS)]
    last = F.max_by(F.struct(*names), F.struct("_page", "_place")).alias("last")
    return found.groupBy("store_id", "sku").agg(last).select(*(F.col(f"last.{n}").alias(n) for n in names))


def _placed(rows: DataFrame, store: str, **columns: Column) -> DataFrame:
    return listings(rows, store, _page=natural(F.col("_page")), _place=F.col("_place"), **columns)


def unkeyed(rows: DataFrame, store: str, **columns: Column) -> DataFrame:
    """The listings() without sku, all of them."""
    return listings(rows, store, **columns).filter("sku is null")


def _items(df: DataFrame, items: str) -> DataFrame:
    """p: each of the items of a landed file, with _page and _place."""
    return df.select(F.col("_metadata.file_path").alias("_page"), F.posexplode(items).alias("_place", "p"))


def json_listing(spark: SparkSession, path: str, store: str) -> DataFrame:
    rows = _items(spark.read.schema(schema.JSON_LISTING).json(path, multiLine=True), "products")
    p = lambda name: F.col(f"p.{name}")
    price = F.coalesce(p("salePrice"), p("regularPrice"))
    return once(
        rows, store, sku=p("sku"), url=p("productUrl"), title=p("name"), model=model_of(p("name")), image_url=p("thumbnailImage"), store_category=p("categoryName"), rating=p("customerRating"),
        rating_count=p("customerRatingCount"), condition=condition_of(p("name")), marketplace=p("isMarketplace"), seller_name=p("seller"), price=price, list_price=F.when(p("regularPrice") > price, p("regularPrice")),
    )


def wide_category_nodes(tree: DataFrame, most: int = 2000, depth: int = 3) -> DataFrame:
    """Nodes to page through: those of at most `most` products, or at the last depth. tree: id, parent_id, total, level.
    A node that is split is replaced by its children, so the leaves of the cut are asked for."""
    split = tree.filter((F.col("total") > most) & (F.col("level") < depth)).select(F.col("id").alias("parent_id"))
    kids = tree.join(split, "parent_id", "left_semi")
    has_kids = kids.select(F.col("parent_id").alias("id")).distinct()
    asked = kids.unionByName(tree.filter(F.col("parent_id").isNull()))
    return asked.join(has_kids, "id", "left_anti")


def code_listing(spark: SparkSession, path: str, store: str) -> DataFrame:
    """Category pages as JSON, a window of products each."""
    rows = _items(spark.read.schema(schema.CODE_LISTING).json(path, multiLine=True), "productWindow")
    p = lambda name: F.col(f"p.{name}")
    before = F.concat(F.regexp_replace("p.salesPrice.previous.wholeNumber", "[^0-9]", ""), F.lit("."), F.coalesce("p.salesPrice.previous.decimals", F.lit("0"))).try_cast("double")
    return once(rows, store, sku=p("id"), url=p("pipUrl"), title=F.concat_ws(" ", p("name"), p("typeName")), brand=F.lit(store), store_category=p("typeName"), image_url=p("mainImageUrl"), rating=p("ratingValue"), rating_count=p("ratingCount"), price=p("salesPrice.numeral"), list_price=before, in_stock=p("onlineSellable"))


def shop_catalogue(spark: SparkSession, path: str, store: str, tag_prefix: str = "feature:") -> DataFrame:
    """products.json pages; the first variant prices a product."""
    rows = _items(spark.read.schema(schema.SHOP_CATALOGUE).json(path, multiLine=True), "products").withColumn("v", F.try_element_at("p.variants", F.lit(1)))
    p = lambda name: F.col(f"p.{name}")
    text = F.concat_ws(" ", short_text(p("body_html")), feature_text(p("tags"), tag_prefix))
    return once(
        rows, store, sku=F.coalesce(F.nullif("v.sku", F.lit("")), p("id").cast("string")), url=F.concat(F.lit("/products/"), p("handle")), title=p("title"), brand=valid_brand(p("vendor")), store_category=p("product_type"),
        description=F.nullif(text, F.lit("")), image_url=F.try_element_at("p.images.src", F.lit(1)), condition=condition_of(p("title")), price=F.col("v.price").try_cast("double"), list_price=F.col("v.compare_at_price").try_cast("double"), in_stock=F.col("v.available"),
    )


def graph_catalogue(spark: SparkSession, path: str, store: str) -> DataFrame:
    rows = _items(spark.read.schema(schema.GRAPH_CATALOGUE).json(path, multiLine=True), "data.products.items")
    p = lambda name: F.col(f"p.{name}")
    low = "price_range.minimum_price"
    return once(
        rows, store, sku=p("sku"), url=F.concat(F.lit("/"), p("url_key")), title=p("name"), image_url=p("small_image.url"), store_category=F.try_element_at("p.categories.name", F.lit(-1)), rating=five_stars(p("rating_summary")),
        rating_count=p("review_count"), price=p(f"{low}.final_price.value"), list_price=p(f"{low}.regular_price.value"), in_stock=p("stock_status") == "IN_STOCK",
    )


def pages(spark: SparkSession, path: str) -> DataFrame:
    """url (the file's path) and html of each page; .gz files are unpacked by the reader."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def embedded_state(pages: DataFrame, store: str, name: str = "__initialState__", items: str = "$.Products") -> DataFrame:
    """Listings inside a page's state object, assigned to window.<name>."""
    state = F.regexp_extract("html", f"(?s){name}\\s*=\\s*(\\{{.*?\\}})\\s*;?\\s*</script>", 1)
    kind = "array<struct<Item:string,Title:string,Brand:string,Price:double,ListPrice:double,InStock:boolean,Rating:double,Reviews:bigint>>"
    rows = pages.select(F.col("url").alias("_page"), F.posexplode(F.from_json(F.get_json_object(state, items), kind)).alias("_place", "p"))
    p = lambda n: F.col(f"p.{n}")
    return once(rows, store, sku=p("Item"), title=p("Title"), brand=p("Brand"), condition=condition_of(p("Title")), price=p("Price"), list_price=p("ListPrice"), in_stock=p("InStock"), rating=p("Rating"), rating_count=p("Reviews"))


def product_pages(pages: DataFrame, store: str) -> DataFrame:
    """Product pages with JSON-LD: the Product block, its first offer and the breadcrumb."""
    found = pages.select("url", jsonld.blocks(F.col("html")).alias("_blocks"))
    # a page without product ends here; a filter would be moved down and find the blocks a second time
    rows = found.select("url", "_blocks", F.explode(F.array_compact(F.array(jsonld.first_of(F.col("_blocks"), "Product")))).alias("b"))
    rows = rows.select("url", F.col("url").alias("_page"), F.lit(0).alias("_place"), "b", jsonld.breadcrumb_of(F.col("_blocks")).alias("crumbs"), jsonld.first_offer(F.col("b")).alias("offer"))
    rows = rows.withColumn("said", jsonld.said_price(F.col("b"), F.col("offer")))
    get = lambda path: F.get_json_object("b", f"$.{path}")
    stock = F.get_json_object("offer", "$.availability")
    return once(
        rows, store, sku=F.coalesce(get("sku"), get("productID"), F.regexp_extract("url", "([^/]+)/?$", 1)), url=F.col("url"), title=get("name"), brand=F.coalesce(get("brand.name"), get("brand")), model=F.coalesce(get("model"), get("mpn")),
        image_url=F.coalesce(get("image[0]"), get("image")), description=get("description"), store_category=F.array_join("crumbs", " > "), rating=get("aggregateRating.ratingValue").try_cast("double"),
        rating_count=F.coalesce(get("aggregateRating.reviewCount"), get("aggregateRating.ratingCount")).try_cast("bigint"), condition=condition_of(get("name")), price=loose_number(F.col("said")), in_stock=F.when(stock.isNotNull(), stock.contains("InStock")),
    )


def price_cards(pages: DataFrame, store: str) -> DataFrame:
    """Cards of a rendered page, anchored at their prices: the last link and title in the CARD characters before each
    price. The page is split at the prices, so a card's look-back is the end of the piece before it."""
    price = "(?:\\$\\s?[0-9][0-9,.  ]*|[0-9][0-9  ]*,[0-9]{2}\\s?\\$)"
    pieces = F.split("html", f"(?<![0-9.,])(?<![0-9][\u00a0\u202f ])(?={price})")
    rows = pages.select("url", F.posexplode(F.arrays_zip(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("before"), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("at"))).alias("k", "x"))
    back = F.right("x.before", F.lit(CARD))
    link = F.try_element_at(F.regexp_extract_all(back, F.lit("href=\"([^\"]+)\""), F.lit(1)), F.lit(-1))
    title = F.try_element_at(F.regexp_extract_all(back, F.lit("(?:title|alt|aria-label)=\"([^\"]{4,})\""), F.lit(1)), F.lit(-1))
    amount = bilingual_price(F.regexp_extract("x.at", f"^({price})", 1))
    rows = rows.select(link.alias("link"), numeric_entities(title).alias("title"), amount.alias("price"), F.col("k")).filter("link is not null and title is not null and price is not null")
    rows = rows.groupBy("link").agg(F.min_by("title", "k").alias("title"), F.min_by("price", "k").alias("price"))
    return listings(rows, store, sku=F.regexp_extract("link", "([^/?#]+)/?(?:[?#].*)?$", 1), url=F.col("link"), title=F.col("title"), condition=condition_of(F.col("title")), price=F.col("price"))


# Words in the address of pages that sell nothing.
DEAD_WORDS = "support|manual|warranty|press|blog|careers|faq|help|archive|discontinued"


def sitemap_urls(spark: SparkSession, path: str, least: int = 8) -> DataFrame:
    """url, url_key (last segment, letters and digits) of a landed set of sitemaps, without pages that sell nothing."""
    xml = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("(?is)<loc>\\s*(?:<!\\[CDATA\\[)?\\s*([^<\\]]+?)\\s*(?:\\]\\]>)?\\s*</loc>"), F.lit(1))).alias("url"))
    kept = xml.filter(~F.lower("url").rlike(f"/({DEAD_WORDS})(/|$)") & ~F.col("url").rlike("\\.xml(\\.gz)?$"))
    segment = F.try_element_at(F.split(F.regexp_replace("url", "[?#].*$|/+$", ""), "/"), F.lit(-1))
    return kept.select("url", F.upper(F.regexp_replace(segment, "[^A-Za-z0-9]", "")).alias("url_key")).filter(F.length("url_key") >= least).dropDuplicates(["url"])


def child_sitemaps(spark: SparkSession, path: str, region: str, most: int = 40) -> DataFrame:
    """Addresses of sitemaps that an index names, the region's first."""
    xml = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("(?is)<loc>\\s*([^<]+?\\.xml(?:\\.gz)?)\\s*</loc>"), F.lit(1))).alias("url"))
    return xml.distinct().orderBy(F.when(F.lower("url").contains(region.lower()), 0).otherwise(1), "url").limit(most)


def details(spark: SparkSession, path: str) -> DataFrame:
    """Facts of product detail pages (one JSON object a file or line)."""
    rows = spark.read.schema(schema.DETAIL).json(path)
    return rows.select("sku", F.col("brandName").alias("brand"), F.col("modelNumber").alias("model"), "manufacturer", F.col("customerRating").alias("rating"), F.col("customerRatingCount").alias("rating_count"))


# Notes by which shops mark reviews that were paid for.
INCENTIVE = "\\[?(?:this review was collected as part of a promotion|cet avis a été recueilli dans le cadre d[’']une promotion)\\.?\\]?"


def reviews(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Review rows (schema.REVIEWS with incentivised), and per product the summary with its histogram."""
    raw = spark.read.schema(schema.REVIEW_PAGE).json(path)
    rows = raw.select(F.col("productId").alias("product_id"), F.explode("reviews").alias("r"))
    text = F.coalesce("r.comment", F.lit(""))
    paid = F.lower(text).rlike(INCENTIVE)
    rows = rows.select(F.col("r.id").alias("review_id"), "product_id", F.col("r.rating").alias("stars"), F.col("r.title").alias("title"), F.trim(F.regexp_replace(text, f"(?i){INCENTIVE}", "")).alias("text"), F.coalesce("r.helpfulVotes", F.lit(0)).alias("helpful"), F.coalesce("r.verifiedPurchaser", F.lit(False)).alias("verified"), paid.alias("incentivised"))
    s = lambda n: F.col(f"ratingSummary.{n}")
    summary = raw.select(F.col("productId").alias("product_id"), s("average").alias("rating"), s("total").alias("rating_count"), s("recommended").alias("recommend_yes"), s("total").alias("recommend_total"), F.map_filter(s("histogram"), lambda k, _: k.rlike("^[1-5]$")).alias("rating_histogram"))
    return rows, summary


def brand_candidates(titles: DataFrame, title: str = "title", least: int = 2, most: int = 1500) -> DataFrame:
    """Leading capitalised words of titles and words after "de", counted: names that may be brands, the most frequent."""
    lead = F.regexp_extract(title, "^([A-Z][\\p{L}0-9&-]{1,24})\\b", 1)
    after = F.regexp_extract(title, "\\bde\\s+([A-Z][\\p{L}0-9&-]{1,24})\\b", 1)
    words = titles.select(F.explode(F.array_distinct(F.array(lead, after))).alias("brand")).filter("brand != ''")
    return words.groupBy("brand").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "brand").limit(most)


def classify(path: Column, rules: list[tuple[str, str]], ignored: list[str] = ()) -> Column:
    """A category slug for a breadcrumb (array of names): the deepest level that a rule (pattern, slug) matches, the
    first rule of it. Levels in `ignored` say nothing."""
    from varve.functions.text import fold

    def one(level: Column) -> Column:
        text, out = fold(level), F.when(F.lit(False), F.lit(""))
        for pattern, slug in rules:
            out = out.when(text.rlike(pattern), slug)
        return F.when(~text.isin(*ignored), out) if ignored else out

    return F.try_element_at(F.array_compact(F.transform(F.reverse(path), one)), F.lit(1))
