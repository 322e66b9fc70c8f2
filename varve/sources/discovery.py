"""What is to be read, found step by step: sitemaps that name sitemaps, and brands asked for by category until no cell of
the two is too wide. Each step is a join over all that is open, written down before the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.staging import stage

LOC = "(?i)<loc>\\s*(?:<!\\[CDATA\\[)?\\s*([^<\\s\\]]+)\\s*(?:\\]\\]>)?\\s*</loc>"
#: How deep indexes of sitemaps are followed; products of a listing that can be paged through; products of a page.
DEPTH, REACHABLE, PAGE = 3, 2000, 100


def sitemap_pages(sitemaps: DataFrame, roots: DataFrame, region: str | None = None, most: int | None = None, depth: int = DEPTH) -> DataFrame:
    """url, sitemap (that names it first) and level of the pages under the roots (url). sitemaps: url and xml of each that was landed; others
    are passed over. What an index names is a sitemap, up to `depth` steps from a root; what another sitemap names, or an
    index so deep, is a page. A sitemap is read once, so that indexes may name each other.

    region: only addresses that match it (a pattern, of any case) are pages, and an index's sitemaps of the region come
    first. most: how many sitemaps are asked for at most, in order of steps, of their index, and of their place in it."""
    wanted = F.lit(True) if region is None else F.col("url").rlike(f"(?i){region}")
    order = F.array().cast("array<int>")
    frontier = stage(roots.select("url").distinct().withColumn("order", order), "frontier")
    seen, found, left = frontier.select("url"), None, most
    for level in range(depth + 1):
        if left is not None:
            frontier = frontier.orderBy("order", "url").limit(left)
        read = frontier.withColumnRenamed("url", "sitemap").join(sitemaps.select(F.col("url").alias("sitemap"), "xml"), "sitemap")
        # both patterns before the rows of a file part: beside a generator a column is computed once a row that comes out of it
        read = read.select("sitemap", "order", F.col("xml").rlike("(?i)<sitemapindex").alias("is_index"), F.regexp_extract_all("xml", F.lit(LOC), F.lit(1)).alias("named"))
        read = stage(read.select("sitemap", "order", "is_index", F.posexplode("named").alias("place", "url")), "sitemaps")
        inner = F.col("is_index") if level < depth else F.lit(False)
        pages = read.filter(~inner & wanted).select("url", "sitemap", F.lit(level).alias("level"), F.concat("order", F.array("place")).alias("order"))
        found = pages if found is None else found.unionByName(pages)
        if level == depth:
            break
        if left is not None:
            left -= frontier.count()  # a sitemap that wasn't landed was asked for, too
        under = read.filter(inner).select("url", F.concat("order", F.array((~wanted).cast("int"), F.col("place"))).alias("order"))
        frontier = stage(under.groupBy("url").agg(F.min("order").alias("order")).join(seen, "url", "left_anti"), "frontier")
        if frontier.isEmpty() or left == 0:
            break
        seen = seen.union(frontier.select("url"))
    first = F.min(F.struct("level", "order", "sitemap")).alias("first")
    return found.groupBy("url").agg(first).select("url", "first.sitemap", "first.level")


def brand_slugs(pages: DataFrame, under: str) -> DataFrame:
    """slug of the brand pages among addresses (url): the segment after `under`, lower-cased."""
    slug = F.regexp_extract("url", f"(?i){under}/([^/?#\\s]+)/?$", 1)
    return pages.select(F.lower(F.try_url_decode(slug)).alias("slug")).filter("slug != ''").distinct()


def resolved_facets(slugs: DataFrame, probes: DataFrame) -> DataFrame:
    """slug, facet and total: the spelling of each slug, as it is or else with spaces for hyphens, that the shop has products
    for. probes: facet and total of what was asked for; slugs without products are left out."""
    forms = F.array_distinct(F.array("slug", F.replace("slug", F.lit("-"), F.lit(" "))))
    tried = slugs.select("slug", F.posexplode(forms).alias("place", "facet"))
    met = tried.join(probes.filter("total > 0").groupBy("facet").agg(F.max("total").alias("total")), "facet")
    first = F.min_by(F.struct("facet", "total"), "place").alias("first")
    return met.groupBy("slug").agg(first).select("slug", "first.facet", "first.total")


def narrow_cells(brands: DataFrame, tree: DataFrame, probes: DataFrame, most: int = REACHABLE) -> DataFrame:
    """facet, category (null: all), total and splits of the cells to page through. brands: facet and total. tree: id, parent_id of
    categories, parent_id null at the top. probes: facet, category, total.

    A cell of more than `most` products gives way to its category's children, which are looked at again, until every cell
    is narrow or has nothing below it. Its own reachable products are still asked for, as some may be in no category. A cycle in the
    tree ends, as a cell is split once."""
    cells = stage(brands.select("facet", F.lit(None).cast("string").alias("category"), "total", F.lit(0).alias("splits")), "cells")
    done, wide, asked = cells, cells.filter(F.col("total") > most), cells.select("facet", "category")
    tree = tree.select(F.col("id").alias("child"), F.col("parent_id").alias("category"))
    while not wide.isEmpty():
        below = wide.join(tree, wide["category"].eqNullSafe(tree["category"])).select("facet", F.col("child").alias("category"), "splits")
        below = below.filter("category is not null").groupBy("facet", "category").agg((F.min("splits") + 1).alias("splits"))
        known = probes.select("facet", "category", "total").filter("total > 0").groupBy("facet", "category").agg(F.max("total").alias("total"))
        news = stage(below.join(asked.filter("category is not null"), ["facet", "category"], "left_anti").join(known, ["facet", "category"]).select("facet", "category", "total", "splits"), "cells")
        done, asked = done.unionByName(news), asked.unionByName(news.select("facet", "category"))
        wide = news.filter(F.col("total") > most)
    return done


def pages_of(cells: DataFrame, most: int = REACHABLE, page: int = PAGE) -> DataFrame:
    """facet, category and page of what is to be read of each cell."""
    last = F.ceil(F.least("total", F.lit(most)) / page).cast("int")
    return cells.filter("total > 0").select("facet", "category", F.explode(F.sequence(F.lit(1), last)).alias("page"))


def harvested(asked: DataFrame, landed: DataFrame, brand: Column) -> DataFrame:
    """brand and sku from the landed pages (facet, category, page, skus) that were asked for; of products of several brands the smallest."""
    key = ["facet", "page"]
    met = asked.join(landed.withColumnRenamed("category", "c"), key).filter(F.col("category").eqNullSafe(F.col("c")))
    return met.select(brand.alias("brand"), F.explode("skus").alias("sku")).groupBy("sku").agg(F.min("brand").alias("brand"))
