"""The queries that pages ask, over a deals table (one row per scored product), categories, stores and specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.prices import half_up
from varve.operators import filters
from varve.operators.filters import DealFilters
from varve.operators.spec_rules import FAMILY_ORDER

LEAST_FACET, MOST_FACET = 3, 12
RANK_BINS = 1000


def top_deals(deals: DataFrame, f: DealFilters, categories: DataFrame | None = None, specs: DataFrame | None = None) -> DataFrame:
    return filters.apply(deals, f, categories, specs).orderBy(*filters.order(f)).offset(f.offset).limit(f.limit)


def count_deals(deals: DataFrame, f: DealFilters, categories: DataFrame | None = None, specs: DataFrame | None = None) -> DataFrame:
    return filters.apply(deals, f, categories, specs).agg(F.count(F.lit(1)).alias("n"))


#: How many deals each section of the first page shows.
HOME_LIMITS = {"lowest": 10, "verified": 10, "used": 10, "best": 30}


def home_sections(deals: DataFrame, limit: int | None = None) -> DataFrame:
    """section and place of the deals on the first page, in one pass: lowest ever, verified, used and best ones. Each
    section has its own limit of HOME_LIMITS unless limit is given for all."""
    live = deals.filter(F.col("is_active") & F.col("is_variant_lead"))
    sections = {
        "lowest": F.col("is_lowest_ever") & (F.col("score") >= 20) & (F.col("condition") == "new"),
        "verified": (F.col("confidence") >= 0.5) & (F.col("score") >= 30) & (F.col("condition") == "new"),
        "used": (F.col("condition") != "new") & (F.col("score") >= 20),
        "best": F.col("condition") == "new",
    }
    names = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in sections.items())))
    rows = live.select("product_id", "score", "confidence", "price", F.explode(names).alias("section"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), F.desc("confidence"), "product_id"))
    # the largest limit as a number lets Spark drop rows before they are dealt to sections
    first = rows.withColumn("place", place).filter(F.col("place") <= F.lit(max(HOME_LIMITS.values()) if limit is None else limit))
    return first if limit is not None else first.filter(F.col("place") <= F.coalesce(*(F.when(F.col("section") == k, n) for k, n in HOME_LIMITS.items())))


def product(deals: DataFrame, product_id: int) -> DataFrame:
    """The one deal of a product's page, whether it is active or not."""
    return deals.filter(F.col("product_id") == product_id)


def manufacturer_reference(references: DataFrame, product_id: int) -> DataFrame:
    """product_id, launch_price, notes, sources and checked_at of a product's found reference, the latest one."""
    found = references.filter((F.col("product_id") == product_id) & F.col("found"))
    return found.select("product_id", "launch_price", "notes", "sources", "checked_at").orderBy(F.desc("checked_at")).limit(1)


def similar(deals: DataFrame, category: str, product_id: int, limit: int = 10) -> DataFrame:
    f = DealFilters(category=category, limit=limit)
    return top_deals(deals.filter(F.col("product_id") != product_id), f)


def competing_offers(products: DataFrame, product_id: int, limit: int = 6) -> DataFrame:
    """The cheapest offer of the same model in each other store."""
    own = F.broadcast(products.filter(F.col("product_id") == product_id).select(F.col("store_id").alias("_store"), "model_key"))
    others = products.filter(F.col("is_active")).join(own, "model_key").filter(F.col("store_id") != F.col("_store"))
    best = others.groupBy("store_id").agg(F.min_by(F.struct("product_id", "price"), F.struct("price", "product_id")).alias("b"))
    return best.select("store_id", "b.product_id", "b.price").orderBy("price", "product_id").limit(limit)


def _peers_of(deals: DataFrame, product_id: int) -> DataFrame:
    own = deals.filter(F.col("product_id") == product_id).select("peer_key", F.col("quality_score").alias("_quality"), F.col("price").alias("_price"))
    live = deals.filter(F.col("is_active") & (F.col("product_id") != product_id))
    return live.join(F.broadcast(own), "peer_key")


def better_alternatives(deals: DataFrame, product_id: int, limit: int = 4) -> DataFrame:
    """Peers of clearly better quality at no more than twice the price."""
    fit = (F.col("quality_score") > F.col("_quality") + 0.05) & (F.col("price") <= F.col("_price") * 2)
    return _peers_of(deals, product_id).filter(fit).orderBy(F.desc("quality_score"), "price", "product_id").limit(limit).drop("_quality", "_price")


def comparables(deals: DataFrame, product_id: int, limit: int = 3) -> DataFrame:
    """The cheapest peers of no lesser quality."""
    fit = F.col("quality_score") >= F.col("_quality") - 0.02
    return _peers_of(deals, product_id).filter(fit).orderBy("price", "product_id").limit(limit).drop("_quality", "_price")


def category_ranks(deals: DataFrame, least: int = 5, quality: str = "quality_score", category: str = "category") -> DataFrame:
    """product_id, category, quality_rank (one more than those strictly better), rated; categories with few rated
    products have none. Ranks come from counts per distinct quality, joined back; qualities are ranked within RANK_BINS
    bins to the unit, so that a category with a third of all products is dealt out, and bins are ranked among themselves."""
    rated = deals.filter(F.col(quality).isNotNull())
    levels = rated.groupBy(category, quality).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", F.floor(F.col(quality) * RANK_BINS))
    bins = levels.groupBy(category, "_bin").agg(F.sum("_n").alias("_in_bin"))
    over = Window.partitionBy(category)
    above = F.coalesce(F.sum("_in_bin").over(over.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select(category, "_bin", above.alias("_above"), F.sum("_in_bin").over(over).alias("rated"))
    better = Window.partitionBy(category, "_bin").orderBy(F.desc(quality)).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("_better", F.coalesce(F.sum("_n").over(better), F.lit(0))).join(bins, [category, "_bin"])
    levels = levels.select(category, quality, (F.col("_above") + F.col("_better") + 1).alias("quality_rank"), "rated")
    return rated.select("product_id", category, quality).join(levels.filter(F.col("rated") >= least), [category, quality])


def category_leaders(deals: DataFrame, reviews: int = 20, places: int = 3) -> DataFrame:
    """The best products of each category among those with enough reviews."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("quality_score"), F.desc("quality_count"), "product_id"))
    return deals.filter(F.col("quality_count") >= reviews).withColumn("place", place).filter(F.col("place") <= places)


def facets(deals: DataFrame, f: DealFilters, specs: DataFrame) -> DataFrame:
    """facet, label, value, metric, n, place: what each criterion would leave to choose, under all other criteria.

    One scan marks each deal with the criteria that it fails. A value of a criterion counts the deals that fail
    nothing else, so a checked value doesn't hide its siblings, and no criterion needs a scan of its own.
    """
    f_all = {**filters.criteria(f)}
    if f.category:
        f_all["category"] = F.col("category") == f.category
    wanted = {family: values for family, values in sorted(f.specs.items()) if values}
    rows = deals
    for k, (family, values) in enumerate(wanted.items()):
        having = specs.filter((F.col("family") == family) & F.col("value").isin(*values)).select("product_id", F.lit(True).alias(f"_s{k}")).distinct()
        rows = rows.join(having, "product_id", "left")
        f_all[f"spec:{family}"] = F.col(f"_s{k}").isNotNull()
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in f_all.items())))
    marked = rows.withColumn("_failed", failed).filter(F.size("_failed") <= 1).withColumn("_but", F.get("_failed", F.lit(0)))
    free = lambda name: F.col("_but").isNull() | (F.col("_but") == name)

    def counted(df: DataFrame, facet: str, label: Column, value: Column, least: int, most: int | None) -> DataFrame:
        out = df.filter(value.isNotNull() & (value != "")).groupBy(F.lit(facet).alias("facet"), value.alias("value")).agg(F.min(label).alias("label"), F.lit(None).cast("double").alias("metric"), F.count(F.lit(1)).alias("n"))
        out = out.filter(F.col("n") >= least).withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value")))
        return out.filter(F.col("place") <= most) if most else out

    brand = counted(marked.filter(free("brands")), "brand", F.col("brand"), F.lower("brand"), LEAST_FACET, 2 * MOST_FACET)
    seller = counted(marked.filter(free("sellers")), "seller", F.col("seller_name"), F.col("seller_name"), LEAST_FACET, MOST_FACET)
    store = counted(marked.filter(free("stores")), "store", F.col("store_id").cast("string"), F.col("store_id").cast("string"), 1, None)
    met = specs.select("product_id", "family", "label", "value", "metric").join(marked.select("product_id", "_but"), "product_id")
    met = met.filter(F.col("_but").isNull() | (F.col("_but") == F.concat(F.lit("spec:"), F.col("family"))))
    spec = met.groupBy("family", "value").agg(F.min("label").alias("label"), F.min("metric").alias("metric"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_FACET)
    of = Window.partitionBy("family")
    spec = spec.withColumn("_by_count", F.row_number().over(of.orderBy(F.desc("n"), "value"))).filter(F.col("_by_count") <= MOST_FACET)
    numeric = F.count_if(F.col("metric").isNull()).over(of) == 0
    spec = spec.withColumn("_values", F.count(F.lit(1)).over(of)).withColumn("_numeric", numeric).filter((F.col("_values") >= 2) & F.col("family").isin(*FAMILY_ORDER))
    place = F.row_number().over(of.orderBy(F.when(F.col("_numeric"), F.col("metric")), "_by_count"))
    spec = spec.select(F.concat(F.lit("spec:"), F.col("family")).alias("facet"), "value", "label", "metric", "n", place.alias("place"))
    bounds = marked.filter(free("price")).agg(F.floor(F.min("price")).alias("low"), F.ceil(F.max("price")).alias("high"))
    bounds = bounds.select(F.explode(F.array(*(F.struct(F.lit("price").alias("facet"), F.lit(v).alias("value"), F.lit(v).alias("label"), F.col(c).cast("double").alias("metric"), F.lit(None).cast("bigint").alias("n"), F.lit(k).alias("place")) for k, (v, c) in enumerate((("min", "low"), ("max", "high")), 1)))).alias("x")).select("x.*")
    same = ["facet", "label", "value", "metric", "n", "place"]
    return brand.select(*same).unionByName(seller.select(*same)).unionByName(store.select(*same)).unionByName(spec.select(*same)).unionByName(bounds.select(*same))


def family_order(facet_rows: DataFrame) -> DataFrame:
    """facet rows with the page's order of families."""
    known = F.array(*map(F.lit, FAMILY_ORDER))
    return facet_rows.withColumn("family_place", F.array_position(known, F.regexp_replace("facet", "^spec:", "")))


def categories_with_counts(categories: DataFrame, deals: DataFrame, store=None) -> DataFrame:
    """Each category with its deals and best score; zero where there are none."""
    rows = deals.filter(F.col("is_active")) if store is None else deals.filter(F.col("is_active") & (F.col("store_id") == store))
    totals = rows.groupBy(F.col("category").alias("slug")).agg(F.count(F.lit(1)).alias("deals"), F.max("score").alias("_best"))
    out = categories.join(totals, "slug", "left")
    return out.select("slug", "name", "parent_slug", F.coalesce("deals", F.lit(0)).alias("deals"), half_up(F.col("_best"), 1).alias("best_score"))


def root_totals(counts: DataFrame) -> DataFrame:
    """Deals of each root category with its children's."""
    return counts.groupBy(F.coalesce("parent_slug", "slug").alias("root")).agg(F.sum("deals").alias("deals"))


def site_stats(deals: DataFrame, runs: DataFrame) -> DataFrame:
    live = deals.filter(F.col("is_active")).agg(F.count(F.lit(1)).alias("products"), F.count_distinct("store_id").alias("stores"), F.count_if("is_lowest_ever").alias("lowest_ever"))
    last = runs.filter(F.col("status").isin("ok", "partial")).agg(F.max("finished_at").alias("updated_at"))
    return live.join(last)  # a row each


def active_stores(stores: DataFrame, products: DataFrame, now: Column) -> DataFrame:
    """Stores with their active products (zero included): larger ones first, then those that are ready, then by name."""
    counts = products.filter(F.col("is_active")).groupBy("store_id").agg(F.count(F.lit(1)).alias("products"))
    out = stores.join(counts, "store_id", "left").withColumn("products", F.coalesce("products", F.lit(0)))
    out = out.withColumn("ready", F.col("enabled") & (F.col("paused_until").isNull() | (F.col("paused_until") <= now)))
    return out.orderBy(F.desc("products"), F.desc("ready"), F.collate("name", "fr_CI_AI"), "store_id")


def reviews_worth_showing(reviews: DataFrame, per_side: int = 1) -> DataFrame:
    """The most helpful praise (four stars or more) and criticism (three or fewer) of each product."""
    side = F.when(F.col("stars") >= 4, "praise").when(F.col("stars") <= 3, "criticism")
    place = F.row_number().over(Window.partitionBy("product_id", "side").orderBy(F.desc("helpful"), F.desc("verified"), "review_id"))
    return reviews.withColumn("side", side).filter(F.col("side").isNotNull()).withColumn("place", place).filter(F.col("place") <= per_side)


def public_export(tables: dict[str, DataFrame], deals: DataFrame, least: float = 20.0, runs: int = 50) -> dict[str, DataFrame]:
    """The public part of each table: rows of products with a score above `least`, and the last runs."""
    shown = deals.filter(F.col("score") > least).select("product_id")
    out = {}
    for name, df in tables.items():
        if "product_id" in df.columns:
            df = df.join(shown, "product_id", "left_semi")
        out[name] = df.orderBy(F.desc("finished_at")).limit(runs) if name == "runs" else df
    return out


#: What a listing shows of a deal, from four tables; descriptions are left to the product's own page.
WIDE = {
    "products": "product_id title brand model url image_url store_id category_slug condition currency availability marketplace seller_name price list_price in_stock rating rating_count",
    "stores": "store_name store_color",
    "scores": "score confidence drop_vs_median is_lowest_ever median verified_drop quality_rating quality_count min_ever max_ever days_of_history reasons",
    "enrichment": "recommend_yes recommend_total reviews",
}


def wide_deals(scores: DataFrame, products: DataFrame, stores: DataFrame, enrichment: DataFrame) -> DataFrame:
    """The 35 columns of a deal in a listing: scored products of known stores, with what enrichment knows of them. stores
    has store_id, name and color; the others are keyed by product_id. Each table gives its own columns only, so that others
    of the same name don't clash. Spark broadcasts stores by its size, so a store with a third of all rows isn't shuffled by."""
    mine = {name: columns.split() for name, columns in WIDE.items()}
    sold = products.select(*mine["products"])
    at = stores.select("store_id", F.col("name").alias("store_name"), F.col("color").alias("store_color"))
    known = enrichment.select("product_id", *mine["enrichment"])
    out = scores.select("product_id", *mine["scores"]).join(sold, "product_id").join(known, "product_id", "left").join(at, "store_id")
    return out.select(*mine["products"], *mine["stores"], *mine["scores"], *mine["enrichment"])
