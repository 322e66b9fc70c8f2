"""Landed files, structured data in pages, and scalar functions."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from varve.functions import display, jsonld, prices, text
from varve.operators import spec_rules
from varve.sources import landed, reference

PAGE = """<html><head><script type="application/ld+json">{broken</script>
<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"TV 65 po","sku":"K1","brand":{"name":"Acme"},"offers":[{"price":"1,299.99","availability":"http://schema.org/InStock"}],"aggregateRating":{"ratingValue":"4.5","reviewCount":"12"}},
{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"Téléviseurs"},{"position":1,"name":"Image"}]}]}</script></head></html>"""


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_json_listing(spark, tmp_path):
    product = {"sku": "1", "name": "Portable (ABC-123X) open box", "salePrice": 90.0, "regularPrice": 120.0, "customerRating": 4.0, "customerRatingCount": 3}
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps({"total": 2, "products": [product, product | {"sku": f"x{k}", "salePrice": None}]}))
    got = {r.sku: r for r in landed.json_listing(spark, str(tmp_path), "shop").collect()}
    assert set(got) == {"1", "x0", "x1"} and got["1"].price == 90 and got["1"].list_price == 120 and got["x0"].list_price is None
    assert got["1"].condition == "open-box" and got["1"].store_id == "shop" and got["1"].model is None or got["1"].model == "ABC-123X"


def test_product_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    with gzip.open(tmp_path / "b.html.gz", "wt") as f:
        f.write(PAGE.replace("K1", "K2"))
    got = {r.sku: r for r in landed.product_pages(landed.pages(spark, str(tmp_path)), "shop").collect()}
    assert set(got) == {"K1", "K2"} and got["K1"].brand == "Acme" and got["K1"].rating_count == 12 and got["K1"].in_stock
    assert got["K1"].store_category == "Image > Téléviseurs"


def test_other_listings(spark, tmp_path):
    shop = {"products": [{"id": 5, "title": "Café moulu", "handle": "cafe", "vendor": "Brûlerie", "body_html": "<p>Un café de tous les jours</p>", "tags": ["feature:Bio", "x"], "images": [{"src": "i"}], "variants": [{"sku": "", "price": "12.50", "compare_at_price": "15.00", "available": True}]}]}
    (tmp_path / "s.json").write_text(json.dumps(shop))
    r = landed.shop_catalogue(spark, str(tmp_path / "s.json"), "s").first()
    assert (r.sku, r.price, r.list_price, r.brand, r.image_url) == ("5", 12.5, 15.0, "Brûlerie", "i") and r.description.endswith("Bio")
    item = {"sku": "g", "name": "N", "url_key": "n", "rating_summary": 87, "review_count": 3, "stock_status": "IN_STOCK", "price_range": {"minimum_price": {"regular_price": {"value": 9}, "final_price": {"value": 8}}}}
    (tmp_path / "g.json").write_text(json.dumps({"data": {"products": {"items": [item]}}}))
    r = landed.graph_catalogue(spark, str(tmp_path / "g.json"), "g").first()
    assert (r.price, r.list_price, r.rating, r.in_stock) == (8, 9, 4.4, True)
    code = {"productWindow": [{"id": "1", "name": "BILLY", "typeName": "bibliothèque", "salesPrice": {"numeral": 70.0, "previous": {"wholeNumber": "90", "decimals": "50"}}}]}
    (tmp_path / "c.json").write_text(json.dumps(code))
    r = landed.code_listing(spark, str(tmp_path / "c.json"), "c").first()
    assert (r.title, r.price, r.list_price) == ("BILLY bibliothèque", 70, 90.5)
    state = '<script>window.__initialState__ = {"Products":[{"Item":"9","Title":"T","Price":5.5,"InStock":false}]};</script>'
    pages = spark.createDataFrame([("u", state)], "url string, html string")
    assert landed.embedded_state(pages, "n").first().price == 5.5
    cards = '<a href="/p/one-1" title="First thing">x</a> <b>19,99 $</b><a href="/p/two-2" title="Second &#233;"></a> $1,250.00 <i>$9.00</i>'
    got = {r.sku: (r.title, r.price) for r in landed.price_cards(spark.createDataFrame([("u", cards)], "url string, html string"), "n").collect()}
    assert got == {"one-1": ("First thing", 19.99), "two-2": ("Second é", 1250.0)}


def test_sitemaps(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<urlset><url><loc> https://x.ca/p/abc-123-xyz </loc></url><url><loc>https://x.ca/support/abcdefgh</loc></url><url><loc>https://x.ca/p/short</loc></url></urlset>")
    assert [r.url_key for r in landed.sitemap_urls(spark, str(tmp_path)).collect()] == ["ABC123XYZ"]
    (tmp_path / "i.xml").write_text("<sitemapindex><loc>https://x.ca/us.xml</loc><loc>https://x.ca/fr-ca.xml.gz</loc></sitemapindex>")
    assert [r.url for r in landed.child_sitemaps(spark, str(tmp_path / "i.xml"), "ca.xml").collect()][0].endswith("fr-ca.xml.gz")


def test_classification_goes_from_the_deepest_level_up(spark):
    rules = [("tele", "televiseurs"), ("image", "image-son")]
    for path, want in ((["Image", "Téléviseurs", "Soldes"], "televiseurs"), (["Image"], "image-son"), (["Autre"], None), ([], None)):
        assert one(spark, lambda c: landed.classify(c, rules, ["soldes"]), path, "array<string>") == want


def test_category_tree(spark):
    tree = reference.categories(spark)
    roots = {r.slug: r.root for r in reference.root_of(tree).collect()}
    assert roots["portables"] == "informatique" and roots["informatique"] == "informatique" and tree.filter("parent_slug is null").count() == 17
    assert roots["bien-etre"] == "beaute-sante" and roots["epicerie"] == "epicerie" and len(roots) == tree.count()
    gated = set(spec_rules.SCREEN + spec_rules.APPLIANCE + spec_rules.TOOL + spec_rules.BEAUTY + spec_rules.GAME + spec_rules.MATERIAL)
    assert gated <= set(roots)
    stores = {r.store_id: r for r in reference.stores(spark).collect()}
    assert len(stores) == 35 and stores["leons-ca"].name == "Leon's" and stores["leons-ca"].enabled and not stores["hp-ca"].enabled and stores["hp-ca"].kind == "manufacturer"


@pytest.mark.parametrize("raw, amount", [("$1,299.99", 1299.99), ("1 299,99 $", 1299.99), ("1&nbsp;299,99&nbsp;$", 1299.99), ("<b><i>24,99</i> $</b>", 24.99), ("899 $", 899), ("1 000,00 $", 1000), ("", None), ("sur demande", None)])
def test_bilingual_prices(spark, raw, amount):
    assert one(spark, prices.bilingual_price, raw) == amount


@pytest.mark.parametrize("html, price", [
    (PAGE.replace("1,299.99", "1299.99"), 1299.99), ('<meta itemprop="price" content="19.50">', 19.5), ('<meta property="product:price:amount" content="45.00">', 45), ('{"price":"10.00"} {"price":30} {"price":"20.00"}', 20), ('{"price": 2}', None), ("", None),
])
def test_price_layers(spark, html, price):
    got = one(spark, jsonld.layered_price, html)
    assert got is None if price is None else got == pytest.approx(price)


def test_reference_answers(spark):
    good = 'Here: {"typical_price": 200, "known_low": 150, "confidence": 1.7, "sources": ["https://a", "note"]} done'
    r = one(spark, jsonld.reference_answer, good)
    assert r.found and r.confidence == 1 and r.sources == ["https://a"] and r.launch_price is None
    for bad in ('{"typical_price": 200, "confidence": 0.5, "sources": ["x"]}', '{"typical_price": -1, "sources": ["https://a"]}', "nothing"):
        assert not one(spark, jsonld.reference_answer, bad).found


def test_text_functions(spark):
    assert one(spark, text.fold, "Élégant ÇA é") == "elegant ca e"
    assert one(spark, text.slug, " Dalle QD-OLED / 4K! ") == "dalle-qd-oled-4k"
    assert one(spark, text.variant_key, "Boîte ouverte - TV 65") == "tv 65"
    assert one(spark, text.plain_text, "<p>a</p><script>x</script> b&nbsp;&amp;<br/>c") == "a b & c" and one(spark, text.plain_text, "<p> </p>") is None
    assert one(spark, text.numeric_entities, "d&#233;j&#xE0; &#99999;") == "déjà &#99999;"
    assert one(spark, text.lead_sentences, "First sentence is here. Second one! Third.") == "First sentence is here. Second one!"
    assert text.query_tokens("Télé  a OLED, 65\" & x") == ["tele", "oled", "65"]


def test_display(spark):
    assert one(spark, display.money, 1299.99, "double") == "1 299,99 $" and one(spark, display.percent, 0.125, "double") == "13 %"
    assert one(spark, display.score_band, 65.0, "double") == "excellent" and one(spark, display.confidence_band, 0.1, "double") == "low"
    assert one(spark, lambda c: display.time_ago(c.cast("timestamp"), F.lit("2026-01-03").cast("timestamp")), "2026-01-01") == "il y a 2 j"


def test_the_last_page_decides_and_products_without_sku_are_set_aside(spark, tmp_path):
    for page, items in ((2, [("a", 7.0), (None, 1.0), ("b", 1.0), ("b", 2.0)]), (10, [("a", 9.0), (None, 2.0)])):
        (tmp_path / f"page={page}").mkdir()
        (tmp_path / f"page={page}" / "f.json").write_text(json.dumps({"products": [{"sku": s, "name": f"TV {p}", "regularPrice": p} for s, p in items]}))
    got = {r.sku: (r.price, r.title) for r in landed.json_listing(spark, str(tmp_path), "shop").collect()}
    assert got == {"a": (9.0, "TV 9.0"), "b": (2.0, "TV 2.0")}
    rows = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", 3.0)], "sku string, price double")
    assert sorted(r.price for r in landed.unkeyed(rows, "shop", sku=F.col("sku"), price=F.col("price")).collect()) == [1.0, 2.0]
