"""Fusion of facts from several sources of differing reliability.

facts: product_id, source, reliability, source_rank and the columns of STRINGS, NUMBERS and COUNTS that a source
knows. Disagreement lowers the agreement of a product; it is never averaged away in silence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.text import model_key

STRINGS = ["brand", "model", "manufacturer"]
RATING_TOLERANCE, COUNT_TOLERANCE = 0.2, 0.25
ALONE, SILENT = 0.6, 0.8
LEAST_MODEL, LEAST_SHARE_OF_RETAIL = 4, 0.35

# The sources and how far each is trusted.
RELIABILITY = {"detail": 0.97, "reviews": 0.97, "cross_store": 0.72, "manufacturer": 0.88}


def _told(value: str) -> Column:
    """What each source of an aggregated group says, as source=value in the order of source_rank; one entry per source."""
    said = F.collect_list(F.struct("source_rank", F.concat_ws("=", "source", F.col(value).cast("string")).alias("said")))
    return F.concat_ws(", ", F.transform(F.array_sort(said), lambda x: x.said))


def vote(facts: DataFrame, field: str) -> DataFrame:
    """product_id, field, <field>_agreement, <field>_sources: the spelling-insensitive value with the largest sum of
    reliability (of equal ones, the one named first by source_rank), shown as first written; <field>_told: who said what."""
    cast = facts.filter(F.col(field).isNotNull() & (F.col(field) != ""))
    key = F.trim(F.regexp_replace(F.lower(field), "\\s+", " "))
    said = F.collect_list(F.struct("source_rank", F.concat_ws("=", "source", field).alias("said")))
    sums = cast.groupBy("product_id", key.alias("_key")).agg(F.sum("reliability").alias("_weight"), F.count(F.lit(1)).alias("_n"), F.min_by(field, "source_rank").alias("_shown"), F.min("source_rank").alias("_rank"), said.alias("_said"))
    best = F.max_by(F.struct("_shown", "_n"), F.struct(F.floor(F.col("_weight") * 1e6 + 0.5), -F.col("_rank")))
    told = F.concat_ws(", ", F.transform(F.array_sort(F.flatten(F.collect_list("_said"))), lambda x: x.said))
    out = sums.groupBy("product_id").agg(best.alias("_best"), F.sum("_n").alias(f"{field}_sources"), F.count(F.lit(1)).alias(f"{field}_values"), told.alias(f"{field}_told"))
    return out.select("product_id", F.col("_best._shown").alias(field), (F.col("_best._n").cast("double") / F.col(f"{field}_sources")).alias(f"{field}_agreement"), f"{field}_sources", f"{field}_values", f"{field}_told")


def mean_rating(facts: DataFrame) -> DataFrame:
    """product_id, rating (mean by reliability), rating_agreement (share of sources within the tolerance), rating_sources, rating_told."""
    rows = facts.filter(F.col("rating").isNotNull())
    whole = Window.partitionBy("product_id")
    mean = F.sum(F.col("rating") * F.col("reliability")).over(whole) / F.sum("reliability").over(whole)
    near = rows.withColumn("_mean", mean).withColumn("_near", F.abs(F.col("rating") - F.col("_mean")) <= RATING_TOLERANCE)
    return near.groupBy("product_id").agg(
        F.max("_mean").alias("mean"), (F.count_if("_near").cast("double") / F.count(F.lit(1))).alias("rating_agreement"), F.count(F.lit(1)).alias("rating_sources"), _told("rating").alias("rating_told")
    ).withColumnRenamed("mean", "rating")


def review_count(facts: DataFrame) -> DataFrame:
    """product_id, rating_count (the largest), count_agreement (share within the tolerance of it), count_sources, count_told."""
    rows = facts.filter(F.col("rating_count").isNotNull())
    top = F.max("rating_count").over(Window.partitionBy("product_id"))
    near = rows.withColumn("_top", top).withColumn("_near", (F.col("_top") == 0) | (F.try_divide(F.col("_top") - F.col("rating_count"), F.col("_top")) <= COUNT_TOLERANCE))
    return near.groupBy("product_id").agg(
        F.max("_top").alias("top"), (F.count_if("_near").cast("double") / F.count(F.lit(1))).alias("count_agreement"), F.count(F.lit(1)).alias("count_sources"), _told("rating_count").alias("count_told")
    ).withColumnRenamed("top", "rating_count")


#: Facts that one source gives whole: the first source that has the fact named first gives them all. Those named in
#: OPTIONAL may be missing from a table of facts.
WHOLE = {"reviews": ["reviews"], "rating_histogram": ["rating_histogram"], "manufacturer_price": ["manufacturer_price", "manufacturer_name", "manufacturer_url"]}
OPTIONAL = ["reviews", "rating_histogram", "manufacturer_name", "manufacturer_url"]


def resolve(facts: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One row per product that a source has answered for or failed at: each field, the agreement of all fields with
    several sources (else 0.8 for several sources, 0.6 for one, 0 for none), the conflicts with what each source says,
    then the failures, and the status. failures: product_id, source, error.

    A source that answers without any fact is no failure, but a product without any fact has failed. Votes are never
    pooled across sources: the largest sample stands for itself, of equal ones that of the first source.
    """
    fields = [*STRINGS, "rating", "count"]
    parts = [vote(facts, f) for f in STRINGS] + [mean_rating(facts), review_count(facts)]
    optional = [c for c in OPTIONAL if c in facts.columns]
    given = {first: [c for c in own if c in facts.columns] for first, own in WHOLE.items() if first in facts.columns}
    has = lambda c: F.col(c) > 0 if c == "manufacturer_price" else F.col(c).isNotNull()
    per = facts.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_sources"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.max_by(F.struct("recommend_yes", "recommend_total"), F.when(F.col("recommend_total") > 0, F.struct("recommend_total", -F.col("source_rank")))).alias("_votes"),
        *(F.min_by(F.struct(*own), F.when(has(first), F.col("source_rank"))).alias(f"_{first}") for first, own in given.items()),
    )
    per = per.select("product_id", "_sources", "sources", "_votes.*", *(f"_{first}.*" for first in given))
    if failures is not None:
        failed = failures.groupBy("product_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "source", "error"))).alias("_errors"))
        per = per.join(failed, "product_id", "full")
    out = reduce(lambda a, b: a.join(b, "product_id", "left"), [per, *parts])
    sources = F.coalesce("_sources", F.lit(0))
    several = F.array_compact(F.array(*(F.when(F.col(f"{f}_sources") > 1, F.col(f"{f}_agreement")) for f in fields)))
    mean = F.aggregate(several, F.lit(0.0), lambda a, x: a + x) / F.size(several)
    agreement = F.when(sources == 0, 0.0).when(F.size(several) > 0, mean).when(sources > 1, SILENT).otherwise(ALONE)
    differ = [F.col(f"{f}_values") > 1 for f in STRINGS] + [F.col(f"{f}_agreement") < 1 for f in ("rating", "count")]
    conflicts = F.array_compact(F.array(*(F.when(d, F.concat(F.lit(f"{f} differs: "), F.col(f"{f}_told"))) for f, d in zip(fields, differ))))
    errors = F.coalesce("_errors", F.array().cast("array<string>")) if failures is not None else F.array().cast("array<string>")
    known = [*STRINGS, "rating", "rating_count", "recommend_total", "manufacturer_price", *optional]
    got = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in known))
    status = F.when(~got, "failed").when(F.size(errors) > 0, "partial").otherwise("ok")
    return out.select(
        "product_id", *STRINGS, "rating", "rating_count", "recommend_yes", "recommend_total", "manufacturer_price", *optional, F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        agreement.alias("agreement"), F.concat(conflicts, errors).alias("conflicts"), status.alias("status"),
    )


def eligible(products: DataFrame, source: str, stores: list | None = None, brands: DataFrame | None = None) -> DataFrame:
    """Products that a source can be asked about: by store, by a model long enough, by a known brand."""
    out = products.withColumn("source", F.lit(source)).withColumn("reliability", F.lit(RELIABILITY[source]))
    if stores is not None:
        out = out.filter(F.col("store_id").isin(*stores))
    if source in ("cross_store", "manufacturer"):
        out = out.filter(F.length(model_key(F.col("model"))) >= LEAST_MODEL)
    if brands is not None:
        out = out.join(brands.select(F.lower("brand").alias("_brand")).distinct(), F.lower("brand") == F.col("_brand"), "left_semi")
    return out


def queue(products: DataFrame, enrichment: DataFrame, references: DataFrame, now: Column, limit: int, stale_days: int = 30, attempts: int = 3, least_score: float = 45.0) -> DataFrame:
    """What to enrich next: products that miss facts or have no price reference though their score deserves one, not
    done, tried too seldom or stale; the best first."""
    done = enrichment.select("product_id", "status", "attempts", "enriched_at")
    met = products.join(done, "product_id", "left").join(references.filter("found").select("product_id", F.lit(True).alias("_known")), "product_id", "left")
    missing = F.col("brand").isNull() | F.col("model").isNull() | F.col("rating_count").isNull()
    wants = missing | (F.col("_known").isNull() & (F.col("score") >= least_score))
    due = F.col("status").isNull() | ((F.col("status") != "ok") & (F.col("attempts") < attempts)) | (F.col("enriched_at") < now - F.make_dt_interval(F.lit(stale_days)))
    return met.filter(wants & due).orderBy(F.desc("score"), F.desc("price"), "product_id").limit(max(limit, 8 * limit)).drop("_known")


def write_back(products: DataFrame, resolved: DataFrame) -> DataFrame:
    """Products with resolved facts where they had none; review counts only grow."""
    new = resolved.select("product_id", *(F.col(c).alias(f"r_{c}") for c in ("brand", "model", "rating", "rating_count")))
    met = products.join(new, "product_id", "left")
    more = F.coalesce(F.col("r_rating_count") > F.coalesce("rating_count", F.lit(0)), F.lit(False))
    out = met.withColumns({"brand": F.coalesce("brand", "r_brand"), "model": F.coalesce("model", "r_model"), "rating": F.when(more, F.coalesce("r_rating", "rating")).otherwise(F.coalesce("rating", "r_rating")), "rating_count": F.greatest("rating_count", "r_rating_count")})
    return out.drop("r_brand", "r_model", "r_rating", "r_rating_count")


def manufacturer_references(retail: DataFrame, manufacturer: DataFrame, confidence: float = 0.9, form: str = "blank") -> DataFrame:
    """Retail products with the highest price of the manufacturer's same model; one far below the retail price is an
    accessory's and left out. Equi join on the model key."""
    own = retail.withColumn("_key", F.nullif(model_key(F.col("model"), form), F.lit(""))).filter(F.length("_key") >= LEAST_MODEL)
    maker = manufacturer.withColumn("_key", F.nullif(model_key(F.col("model"), form), F.lit(""))).groupBy("_key").agg(F.max("price").alias("launch_price"))
    met = own.join(maker, "_key").filter(F.col("launch_price") >= F.col("price") * LEAST_SHARE_OF_RETAIL)
    return met.select("product_id", "launch_price", F.lit(confidence).alias("confidence"))


def reference_queue(products: DataFrame, references: DataFrame, now: Column, limit: int, short_days: int = 21, stale_days: int = 45) -> DataFrame:
    """Products with a short history and no fresh reference, the best first."""
    checked = references.select("product_id", "checked_at")
    met = products.filter(F.col("days_observed") < short_days).join(checked, "product_id", "left")
    stale = F.col("checked_at").isNull() | (F.col("checked_at") < now - F.make_dt_interval(F.lit(stale_days)))
    return met.filter(stale).orderBy(F.desc("score"), "product_id").limit(limit)


#: Characters of a piece of an address by which model keys look for it; no longer than a model key may be short.
GRAM = 4


def _grams(key: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - GRAM + 1), lambda i: F.substring(F.col(key), i, GRAM)))


def locate_by_key(addresses: DataFrame, products: DataFrame, least: int = 8) -> DataFrame:
    """For each product the shortest address key of its brand that contains its model key (of equal ones the smallest
    address). addresses: brand, url_key, url. Addresses are listed under each piece of GRAM characters that they have; a model
    key is looked for under the piece of its own that is rarest among its brand's addresses, and a key with a piece that
    no address has is in none. What is found there is verified."""
    own = products.withColumn("_key", F.lower(model_key(F.col("model"), "strict"))).filter(F.length("_key") >= LEAST_MODEL).select("product_id", F.lower("brand").alias("_brand"), "_key")
    sites = addresses.filter(F.length("url_key") >= least).groupBy(F.lower("brand").alias("_brand"), F.lower("url_key").alias("url_key")).agg(F.min("url").alias("url"))
    listed = sites.select("_brand", "url_key", "url", F.explode(_grams("url_key")).alias("_gram"))
    often = listed.groupBy("_brand", "_gram").agg(F.count(F.lit(1)).alias("_often"))
    keys = own.select("_brand", "_key").distinct().select("_brand", "_key", F.explode(_grams("_key")).alias("_gram"))
    met = keys.join(often, ["_brand", "_gram"], "left").groupBy("_brand", "_key")
    rarest = met.agg(F.min(F.struct("_often", "_gram")).alias("_rare"), F.count_if(F.col("_often").isNull()).alias("_none")).filter("_none = 0").select("_brand", "_key", F.col("_rare._gram").alias("_gram"))
    inside = rarest.join(listed, ["_brand", "_gram"]).filter(F.contains("url_key", "_key")).groupBy("_brand", "_key").agg(F.min(F.struct(F.length("url_key").alias("n"), F.col("url").alias("url"))).alias("b"))
    return own.join(inside, ["_brand", "_key"]).select("product_id", "b.url")
