"""Schemas of the tables, written out as DDL: nothing is inferred."""

from __future__ import annotations

LISTINGS = (
    "store_id string, sku string, url string, title string, brand string, model string, image_url string, description string, category_slug string, store_category string, "
    "rating double, rating_count bigint, condition string, availability string, marketplace boolean, seller_name string, currency string, price double, list_price double, "
    "in_stock boolean, seen_at timestamp, arrival bigint"
)
PRODUCTS = (
    "store_id string, sku string, description string, model string, category_slug string, store_category string, rating double, rating_count bigint, url string, title string, "
    "image_url string, condition string, availability string, marketplace boolean, seller_name string, brand string, currency string, price double, list_price double, "
    "in_stock boolean, first_seen_at timestamp, last_seen_at timestamp, last_price_change_at timestamp, is_active boolean"
)
PRICE_POINTS = "product_id bigint, price double, list_price double, in_stock boolean, observed_at timestamp, source string"
FACTS = (
    "product_id bigint, source string, source_rank int, reliability double, brand string, model string, manufacturer string, rating double, rating_count bigint, "
    "recommend_yes bigint, recommend_total bigint, manufacturer_price double"
)
CATEGORIES = "slug string, name string, parent_slug string, icon string, sort_order int"
STORES = "store_id string, name string, country string, currency string, homepage string, enabled boolean, consecutive_failures int, paused_until timestamp, kind string"
STORE_REGISTRY = "store_id string, name string, kind string, country string, currency string, homepage string, color string, enabled boolean"
RUNS = "run_id bigint, store_id string, strategy string, target string, status string, products_seen bigint, products_new bigint, price_changes bigint, error string, started_at timestamp, finished_at timestamp"
CURSORS = "store_id string, scope string, next_page int, laps int, updated_at timestamp"
REVIEWS = "review_id bigint, product_id bigint, stars int, title string, text string, helpful int, verified boolean"

#: What JSON listings, shop catalogues and similar landed files hold.
JSON_LISTING = "total int, products array<struct<sku:string,name:string,productUrl:string,thumbnailImage:string,regularPrice:double,salePrice:double,categoryName:string,customerRating:double,customerRatingCount:bigint,seller:string,isMarketplace:boolean>>"
SHOP_CATALOGUE = (
    "products array<struct<id:bigint,title:string,handle:string,vendor:string,product_type:string,body_html:string,tags:array<string>,"
    "images:array<struct<src:string>>,variants:array<struct<sku:string,price:string,compare_at_price:string,available:boolean>>>>"
)
GRAPH_CATALOGUE = (
    "data struct<products:struct<total_count:int,items:array<struct<sku:string,name:string,url_key:string,rating_summary:double,review_count:bigint,stock_status:string,"
    "small_image:struct<url:string>,categories:array<struct<name:string>>,price_range:struct<minimum_price:struct<regular_price:struct<value:double>,final_price:struct<value:double>>>>>>>"
)
CODE_LISTING = "productWindow array<struct<id:string,name:string,typeName:string,pipUrl:string,mainImageUrl:string,ratingValue:double,ratingCount:bigint,onlineSellable:boolean,salesPrice:struct<numeral:double,previous:struct<wholeNumber:string,decimals:string>>>>"
DETAIL = "sku string, name string, brandName string, modelNumber string, manufacturer string, customerRating double, customerRatingCount bigint, shortDescription string"
REVIEW_PAGE = "productId bigint, ratingSummary struct<average:double,total:bigint,recommended:bigint,histogram:map<string,bigint>>, reviews array<struct<id:bigint,rating:int,title:string,comment:string,helpfulVotes:int,verifiedPurchaser:boolean>>"


def columns(table: str) -> list[tuple[str, str]]:
    """Names and types of a table without nested columns."""
    return [tuple(c.split(" ", 1)) for c in table.split(", ")]
