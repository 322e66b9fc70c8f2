"""Structured data inside pages: JSON-LD, microdata, Open Graph and price blobs, with Spark's JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prices import half_up, loose_number, plausible_price
from .text import bound

_SCRIPT = "(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"
_PRICE = '"(?:price|lowPrice)"\\s*:\\s*"?([0-9]+(?:[.,][0-9]{1,2})?)"?'


def blocks(html: Column) -> Column:
    """All JSON-LD objects of a page as JSON strings, arrays and @graph members apart; malformed scripts are left out."""
    raw = F.filter(F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1)), lambda s: F.try_parse_json(s).isNotNull())

    def members(s: Column) -> Column:
        inner = F.coalesce(F.get_json_object(s, "$.@graph"), F.when(F.trim(s).startswith("["), F.trim(s)))
        return F.when(inner.isNotNull(), F.transform(F.from_json(inner, "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array(s))

    return F.flatten(F.transform(raw, members))


def of_type(html: Column, kind: str) -> Column:
    """The first JSON-LD object with that @type (a string or one of a list)."""
    return first_of(blocks(html), kind)


def first_of(found: Column, kind: str) -> Column:
    """The first of a page's blocks() with that @type."""
    return F.try_element_at(F.filter(found, lambda b: F.coalesce(F.get_json_object(b, "$.@type").contains(kind), F.lit(False))), F.lit(1))


def product(html: Column) -> Column:
    return of_type(html, "Product")


def first_offer(block: Column) -> Column:
    """The first offer of a product as a JSON string."""
    return F.coalesce(F.get_json_object(block, "$.offers[0]"), F.get_json_object(block, "$.offers"))


def offer_price(block: Column) -> Column:
    return loose_number(said_price(block, first_offer(block)))


def said_price(block: Column, offer: Column) -> Column:
    """The price of a product and its first offer, as the page has it."""
    return F.coalesce(F.get_json_object(offer, "$.price"), F.get_json_object(offer, "$.lowPrice"), F.get_json_object(offer, "$.priceSpecification.price"), F.get_json_object(block, "$.price"))


def breadcrumb(html: Column) -> Column:
    """Names of the page's breadcrumb by position."""
    return breadcrumb_of(blocks(html))


def breadcrumb_of(found: Column) -> Column:
    """As breadcrumb, from a page's blocks()."""
    items = F.from_json(F.get_json_object(first_of(found, "BreadcrumbList"), "$.itemListElement"), "array<struct<position:int,name:string,item:struct<name:string>>>")
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(x["position"].alias("position"), F.coalesce(x["name"], x["item"]["name"]).alias("name")))), lambda x: x["name"])


def any_price(html: Column) -> Column:
    """The first price at any depth of the JSON-LD blocks."""
    return loose_number(_any(blocks(html)))


# What a layer finds, as it is written; an empty text is no number.
def _any(found: Column) -> Column:
    return F.regexp_extract(F.array_join(found, "\n"), _PRICE, 1)


def _microdata(html: Column) -> Column:
    after = F.regexp_extract(html, "(?is)content=[\"']([0-9.,]+)[\"'][^>]*itemprop=[\"']price[\"']", 1)
    return bound(F.regexp_extract(html, "(?is)itemprop=[\"']price[\"'][^>]*content=[\"']([0-9.,]+)", 1), lambda before: F.when(before != "", before).otherwise(after))


def _open_graph(html: Column) -> Column:
    return F.regexp_extract(html, "(?is)(?:product|og):price:amount[\"'][^>]*content=[\"']([0-9.,]+)", 1)


def microdata_price(html: Column) -> Column:
    return loose_number(_microdata(html))


def open_graph_price(html: Column) -> Column:
    return loose_number(_open_graph(html))


def _plausible(raw: Column) -> Column:
    """raw as a plausible price; raw and number are bound, as they are named many times."""
    return bound(bound(raw, loose_number), plausible_price)


def blob_price(html: Column) -> Column:
    """The upper median of all plausible prices in inline JSON, as single ones may belong to related articles."""
    found = F.transform(F.regexp_extract_all(html, F.lit(_PRICE), F.lit(1)), _plausible)
    middle = lambda ordered: F.when(F.size(ordered) > 0, F.try_element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1))
    return bound(F.sort_array(F.array_compact(found)), middle)


def layered_price(html: Column) -> Column:
    """JSON-LD, else microdata, else Open Graph, else the median of blobs; each only if plausible. A layer is looked for only where those
    before it gave nothing, and the page and its blocks are made once."""
    said = lambda found: bound(first_of(found, "Product"), lambda block: said_price(block, first_offer(block)))
    known = lambda page: bound(blocks(page), lambda found: F.coalesce(_plausible(said(found)), _plausible(_any(found))))
    return bound(html, lambda page: F.coalesce(known(page), _plausible(_microdata(page)), _plausible(_open_graph(page)), blob_price(page)))


def image_sizes(url: Column, sizes: list[int]) -> Column:
    """The same picture in other sizes: the first WxH in its address replaced."""
    return F.transform(F.array(*map(F.lit, sizes)), lambda n: F.regexp_replace(url, F.lit("[0-9]{2,4}x[0-9]{2,4}"), F.concat(n.cast("string"), F.lit("x"), n.cast("string"))))


def nearest_size(sizes: Column, target: int) -> Column:
    """Sizes by closeness to a target; smaller ones count double."""
    scored = F.transform(sizes, lambda n: F.struct(F.when(n >= target, (n - target) * 0.5).otherwise((target - n) * 1.0).alias("far"), n.alias("n")))
    return F.transform(F.array_sort(scored), lambda x: x["n"])


def reference_answer(raw: Column) -> Column:
    """A researched price range: the text from the first { to the last }, accepted only with web sources and a figure."""
    kind = "launch_price double, typical_price double, known_low double, confidence double, sources array<string>, notes string"
    got = F.from_json(F.regexp_extract(raw, "(?s)\\{.*\\}", 0), kind)
    positive = lambda c: F.when(got[c] > 0, got[c])
    sources = F.filter(F.coalesce(got["sources"], F.array().cast("array<string>")), lambda u: u.rlike("^https?://"))
    figure = F.coalesce(positive("typical_price"), positive("known_low"), positive("launch_price"))
    found = (F.size(sources) > 0) & figure.isNotNull()
    confidence = F.when(found, F.greatest(F.least(F.coalesce(got["confidence"], F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    return F.struct(positive("launch_price").alias("launch_price"), positive("typical_price").alias("typical_price"), positive("known_low").alias("known_low"), confidence.alias("confidence"), sources.alias("sources"), found.alias("found"))


def stars_histogram(block: Column) -> Column:
    """Counts of 1 to 5 stars as a map, from the JSON object {"1": n, ...}."""
    return F.map_filter(F.from_json(block, "map<string,bigint>"), lambda k, _: k.rlike("^[1-5]$"))


def percent_text(share: Column) -> Column:
    return F.concat(half_up(share * 100).cast("long").cast("string"), F.lit(" %"))
