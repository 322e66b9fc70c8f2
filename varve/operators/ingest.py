"""Ingestion: batches of observed listings become product rows and change-only price points.

State and batch meet in one full outer join on the product key. Within a batch the rows of a key are taken in the
order of arrival: the last one describes the product, and every change on the way is logged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.prices import EPSILON, same_price, sane_list_price, sane_rating
from varve.functions.text import model_key, plain_text, variant_key
from varve.operators.joins import left_by_known_key

KEY = ["store_id", "sku"]
#: Descriptive columns of which a new null doesn't erase a known value, and those that always follow the batch.
KEPT = ["description", "model", "category_slug", "store_category", "rating", "rating_count"]
FOLLOWED = ["url", "title", "image_url", "condition", "availability", "marketplace", "seller_name"]
FIRST = ["brand", "currency"]
STALE_DAYS = 14

# Weight and threshold of the ledger of dead addresses, and the days after which it forgets.
CERTAIN_WEIGHT, DEAD_AT, FORGET_DAYS = 2, 2, 30


def clean(batch: DataFrame) -> DataFrame:
    """Raw listings with sane list prices and ratings, plain descriptions and defaults; rows without price are left out."""
    rating, count = sane_rating(F.col("rating"), F.col("rating_count"))
    return batch.filter(F.col("price") > 0).withColumns({
        "list_price": sane_list_price(F.col("price"), F.col("list_price")),
        "rating": rating,
        "rating_count": count,
        "description": plain_text(F.col("description")),
        "condition": F.coalesce("condition", F.lit("new")),
        "availability": F.coalesce("availability", F.lit("les-deux")),
        "marketplace": F.coalesce("marketplace", F.lit(False)),
        "currency": F.coalesce("currency", F.lit("CAD")),
    })


def points_of(state: DataFrame, batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The batch's price points: each row whose price, list price or stock differs from the row before it of the same
    key, the state's row being the first. state: KEY, price, list_price, in_stock."""
    known = state.select(*KEY, "price", "list_price", "in_stock", F.lit(None).cast("timestamp").alias("seen_at"), F.lit(-1).cast("long").alias("_arrival"))
    news = batch.select(*KEY, "price", "list_price", "in_stock", F.col("seen_at").cast("timestamp").alias("seen_at"), F.col(arrival).cast("long").alias("_arrival"))
    hit = known.join(news.select(*KEY).distinct(), KEY, "left_semi")
    before = Window.partitionBy(*KEY).orderBy("_arrival")
    was = lambda c: F.lag(c).over(before)
    same = same_price(F.col("price"), was("price")) & same_price(F.col("list_price"), was("list_price")) & F.col("in_stock").eqNullSafe(was("in_stock"))
    marked = hit.unionByName(news).withColumn("_change", was("_arrival").isNull() | ~same)
    return marked.filter(F.col("_change") & (F.col("_arrival") >= 0)).select(*KEY, "price", "list_price", "in_stock", F.col("seen_at").alias("observed_at"))


def upsert(state: DataFrame, batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The state after the batch: KEY, the descriptive columns, price, list_price, in_stock, first_seen_at,
    last_seen_at, last_price_change_at, is_active. Running it again with the same batch changes nothing but
    last_seen_at, which the batch names itself."""
    followed = (*FOLLOWED, "price", "list_price", "in_stock")
    latest = batch.groupBy(*KEY).agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(f"n_{c}") for c in KEPT),
        F.max_by(F.struct(*followed), F.struct(arrival)).alias("_latest"),
        F.min_by(F.struct(*FIRST), F.struct(arrival)).alias("_first"),
        F.min("seen_at").alias("n_first"),
        F.max("seen_at").alias("n_last"),
    )
    latest = latest.select("*", *(F.col(f"_latest.{c}").alias(f"n_{c}") for c in followed), *(F.col(f"_first.{c}").alias(f"n_{c}") for c in FIRST)).drop("_latest", "_first")
    changed = points_of(state, batch, arrival).groupBy(*KEY).agg(F.max("observed_at").alias("n_changed"))
    both = state.join(latest.join(changed, KEY, "left"), KEY, "full_outer")
    seen = F.col("n_last").isNotNull()
    fresh = F.col("first_seen_at").isNull()
    price = lambda c: F.when(F.col("n_changed").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c))
    return both.select(
        *KEY,
        *(F.coalesce(f"n_{c}", c).alias(c) for c in KEPT),
        *(F.when(seen, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in FOLLOWED),
        *(F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in FIRST),
        *(price(c).alias(c) for c in ("price", "list_price", "in_stock")),
        F.coalesce("first_seen_at", "n_first").alias("first_seen_at"),
        F.coalesce("n_last", "last_seen_at").alias("last_seen_at"),
        F.coalesce("n_changed", "last_price_change_at").alias("last_price_change_at"),
        F.when(seen, F.lit(True)).otherwise(F.col("is_active")).alias("is_active"),
    )


def retire(state: DataFrame, now: Column, days: int = STALE_DAYS, seen: str = "last_seen_at") -> DataFrame:
    """Products unseen for longer than that are no longer active."""
    return state.withColumn("is_active", F.col("is_active") & (F.col(seen) >= now - F.make_dt_interval(F.lit(days))))


def reconcile(products: DataFrame) -> DataFrame:
    """Keys, pictures and ratings made coherent: variant_key and model_key from title and model; a missing picture is
    taken from the same store's same model, else the same variant (the smallest product_id with one); a rating
    without reviews goes. One aggregate per kind of key."""
    rows = products.withColumns({"variant_key": variant_key(F.col("title")), "model_key": F.nullif(model_key(F.col("model")), F.lit(""))})
    for key, name in (("model_key", "_by_model"), ("variant_key", "_by_variant")):
        have = rows.filter(F.col("image_url").isNotNull() & F.col(key).isNotNull())
        pictures = have.groupBy("store_id", key).agg(F.min_by("image_url", "product_id").alias(name))
        rows = left_by_known_key(rows, pictures, ["store_id", key])
    rating, count = sane_rating(F.col("rating"), F.col("rating_count"))
    rows = rows.withColumns({"image_url": F.coalesce("image_url", "_by_model", "_by_variant"), "rating": rating, "rating_count": count})
    return rows.select(*dict.fromkeys([*products.columns, "variant_key", "model_key"]))


def label_brands(products: DataFrame, harvested: DataFrame, sku: str = "sku") -> DataFrame:
    """Missing brands from a harvest (store_id, sku, brand); of several, the one that comes first."""
    found = harvested.groupBy("store_id", sku).agg(F.min("brand").alias("_harvested"))
    return products.join(found, ["store_id", sku], "left").withColumn("brand", F.coalesce("brand", "_harvested")).drop("_harvested")


def quarantine(products: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose category is known (or null), and the others."""
    known = categories.select(F.col("slug").alias("category_slug"))
    bad = products.filter(F.col("category_slug").isNotNull()).join(known, "category_slug", "left_anti")
    good = products.filter(F.col("category_slug").isNull()).unionByName(products.join(known, "category_slug", "left_semi"))
    return good, bad


def dead_urls(failures: DataFrame, successes: DataFrame, now: Column) -> DataFrame:
    """store_id and url of addresses held dead. failures: store_id, url, certain, failed_at; a success (store_id, url,
    seen_at) clears what failed before it, and old failures are forgotten."""
    cleared = successes.groupBy("store_id", "url").agg(F.max("seen_at").alias("cleared_at"))
    recent = failures.filter(F.col("failed_at") >= now - F.make_dt_interval(F.lit(FORGET_DAYS))).join(cleared, ["store_id", "url"], "left")
    counted = recent.filter(F.col("cleared_at").isNull() | (F.col("failed_at") > F.col("cleared_at")))
    out = counted.groupBy("store_id", "url").agg(F.sum(F.when(F.col("certain"), CERTAIN_WEIGHT).otherwise(1)).alias("failures"), F.max("failed_at").alias("last_failed_at"))
    return out.filter(F.col("failures") >= DEAD_AT)


def guard_report(before: DataFrame, after: DataFrame, points_before: DataFrame, points_after: DataFrame, most_loss: float = 0.2) -> DataFrame:
    """One row: products and points of two snapshots and a verdict: first (there were no products, so that there is nothing to
    guard), products (that share of them is lost), history (there are fewer points) or ok. Tables are only counted."""
    sides = {"products_before": before, "products_after": after, "points_before": points_before, "points_after": points_after}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n") for name, df in sides.items()]
    row = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3]).agg(*(F.max(F.when(F.col("side") == name, F.col("n"))).alias(name) for name in sides))
    lost = F.col("products_after") < F.col("products_before") * (1 - most_loss)
    verdict = F.when(F.col("products_before") == 0, "first").when(lost, "products").when(F.col("points_after") < F.col("points_before"), "history").otherwise("ok")
    return row.withColumn("verdict", verdict)


def guard(before: DataFrame, after: DataFrame, points_before: int, points_after: int, most_loss: float = 0.2) -> None:
    """Refuse a snapshot that has lost more than that share of products or any history. An empty first one guards nothing."""
    was, now = before.count(), after.count()
    if was and now < was * (1 - most_loss):
        raise ValueError(f"products fell from {was} to {now}")
    if was and points_after < points_before:
        raise ValueError(f"price points fell from {points_before} to {points_after}")


def same_within(a: Column, b: Column) -> Column:
    return F.abs(a - b) < EPSILON
