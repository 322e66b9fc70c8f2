from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from varve.sources import discovery


def brute(xml, roots, region, most, depth=3):
    """One sitemap at a time, from a queue."""
    queue, seen, pages = [(r, 0) for r in sorted(roots)], [], {}
    while queue and (most is None or len(seen) < most):
        url, level = queue.pop(0)
        if url in seen:
            continue
        seen.append(url)
        if url not in xml:
            continue
        locs = re.findall(r"<loc>\s*([^<\s]+)\s*</loc>", xml[url])
        fits = lambda u: region is None or re.search(region, u, re.I) is not None
        if "<sitemapindex" in xml[url] and level < depth:
            queue += [(u, level + 1) for u in sorted(locs, key=lambda u: not fits(u))]
        else:
            for u in filter(fits, locs):
                pages.setdefault(u, (url, level))
    return sorted((u, *v) for u, v in pages.items())


def test_sitemaps_are_followed_as_a_queue_would(spark):
    rng = random.Random(6)
    for trial in range(3):
        names = [f"https://x.ca/{rng.choice(['fr-CA', 'us', 'ca-en'])}/map-{k}.xml" for k in range(25)]
        xml = {}
        for k, name in enumerate(names[:-2]):  # two aren't landed
            index = k == 0 or rng.random() < 0.5
            inside = rng.choices(names, k=rng.randint(1, 6)) if index else [f"https://x.ca/{rng.choice(['fr-CA', 'us'])}/p/{rng.randrange(60)}" for _ in range(rng.randint(0, 6))]
            xml[name] = ("<sitemapindex>" if index else "<urlset>") + "".join(f"<loc> {u}\n</loc>" for u in inside)
        maps = spark.createDataFrame(list(xml.items()), "url string, xml string")
        for region, most in ((None, None), ("/(fr-ca|ca-en)/", 9)):
            got = discovery.sitemap_pages(maps, spark.createDataFrame([(names[0],)], "url string"), region, most)
            assert sorted(map(tuple, got.collect())) == brute(xml, names[:1], region, most)


def test_empty_sitemaps(spark):
    maps = spark.createDataFrame([("a", None), ("b", "")], "url string, xml string")
    assert discovery.sitemap_pages(maps, spark.createDataFrame([("a",), ("b",), ("c",)], "url string")).count() == 0
    assert discovery.sitemap_pages(maps, spark.createDataFrame([], "url string")).count() == 0


def test_facets_are_resolved_by_spelling(spark):
    pages = spark.createDataFrame([("https://x.ca/marque/On-Stage",), ("https://x.ca/marque/a%20b/",), ("https://x.ca/p/1",), ("https://x.ca/marque/big-one",), ("https://x.ca/marque/gone",)], "url string")
    slugs = discovery.brand_slugs(pages, "/marque")
    assert {r.slug for r in slugs.collect()} == {"on-stage", "a b", "big-one", "gone"}
    probes = spark.createDataFrame([("on-stage", 7), ("on stage", 9), ("a b", 3), ("big-one", 0), ("big one", 4000)], "facet string, total long")
    assert {tuple(r) for r in discovery.resolved_facets(slugs, probes).collect()} == {("on-stage", "on-stage", 7), ("a b", "a b", 3), ("big-one", "big one", 4000)}


def test_wide_cells_are_split_until_all_are_narrow(spark):
    brands = spark.createDataFrame([("n", 10), ("w", 100)], "facet string, total long")
    tree = spark.createDataFrame([("1", None), ("2", None), ("11", "1"), ("12", "1"), ("111", "11"), ("1", "111")], "id string, parent_id string")
    probes = spark.createDataFrame([("w", "1", 60), ("w", "2", 20), ("w", "11", 50), ("w", "12", 0), ("w", "111", 40), ("n", "1", 10)], "facet string, category string, total long")
    cells = discovery.narrow_cells(brands, tree, probes, 30)
    assert {tuple(r) for r in cells.collect()} == {("n", None, 10, 0), ("w", None, 100, 0), ("w", "1", 60, 1), ("w", "2", 20, 1), ("w", "11", 50, 2), ("w", "111", 40, 3)}
    asked = discovery.pages_of(cells, 30, 10)
    assert asked.filter("facet = 'n'").count() == 1 and asked.filter("category = '2'").count() == 2 and asked.filter("category = '111'").count() == 3
    landed = spark.createDataFrame([("n", None, 1, ["a", "b"]), ("w", "2", 2, ["b", "c"]), ("w", "2", 9, ["d"]), ("w", "12", 1, ["e"])], "facet string, category string, page int, skus array<string>")
    assert {tuple(r) for r in discovery.harvested(asked, landed, F.upper("facet")).collect()} == {("a", "N"), ("b", "N"), ("c", "W")}


def test_a_long_sitemap_is_searched_once_not_once_an_address(spark):
    urls = "".join(f"<url><loc>https://x.ca/products/of/a/long/address/{k}</loc></url>" for k in range(30_000))
    maps = spark.createDataFrame([("root", "<sitemapindex><loc>a</loc></sitemapindex>"), ("a", f"<urlset>{urls}</urlset>")], "url string, xml string")
    began = time.monotonic()
    got = discovery.sitemap_pages(maps, spark.createDataFrame([("root",)], "url string")).groupBy("sitemap", "level").count().collect()
    assert [tuple(r) for r in got] == [("a", 1, 30_000)]
    assert time.monotonic() - began < 40
