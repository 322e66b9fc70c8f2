"""From signals to a score: is this price a real deal?

Four signals (own history, the shop's claim, peers, an outside reference) are averaged by reliability; a claim
that the evidence contradicts is damped; quality multiplies the result and is never added to it.

score() takes one row per product with the columns of INPUTS; absent ones are taken as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.prices import EPSILON, clamp, discount, half_up, lerp, saturating_log
from varve.operators.joins import left_by_known_key

INPUTS = {
    "price": "double", "list_price": "double", "in_stock": "boolean", "rating": "double", "rating_count": "bigint", "condition": "string",
    "recommend_yes": "bigint", "recommend_total": "bigint", "agreement": "double", "inherited_quality": "boolean",
    "peer_percentile": "double", "peer_median": "double", "peer_size": "bigint", "peer_below": "double", "peer_cohesion": "double", "peer_outlier": "boolean", "peer_p90": "double",
    "typical_price": "double", "known_low": "double", "reference_confidence": "double", "global_mean_rating": "double",
    "median": "double", "percentile": "double", "claim_share": "double", "min_ever": "double", "changes": "bigint", "days_observed": "double",
}

# Weights, saturation points and thresholds of the score.
CONDITION_FACTOR = {"new": 1.0, "open-box": 0.93, "refurbished": 0.9}
CONDITION_DISCOUNT = {"new": 0.0, "open-box": 0.15, "refurbished": 0.22}
FULL_DROP, FULL_CLAIM, FULL_DAYS, FULL_PEER_GAP, FULL_PEERS, FULL_REFERENCE_GAP = 0.4, 0.45, 30.0, 0.3, 40.0, 0.3
CLAIM_RELIABILITY, REFERENCE_RELIABILITY, PEER_DISCOUNT = 0.3, 0.45, 0.8
UNKNOWN_QUALITY, RATING_PRIOR, FULL_REVIEWS, DEFAULT_MEAN_RATING = 0.45, 5.0, 50.0, 4.3
WILSON_Z = 1.28
DAMPING = 0.6


def wilson(yes: Column, total: Column, z: float = WILSON_Z) -> Column:
    """The lower bound of the share of yes; 0 without votes."""
    n = F.when(total > 0, total.cast("double"))
    p, z2 = yes / n, z * z
    low = (p + z2 / (2 * n) - z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    return F.coalesce(F.greatest(low, F.lit(0.0)), F.lit(0.0))


def quality_index(rating: Column, count: Column, mean_rating: Column, yes: Column, total: Column) -> Column:
    """From recommendations if there are any, else from stars drawn towards the mean and, where reviews are few,
    towards UNKNOWN_QUALITY."""
    votes = clamp((wilson(yes, total) - 0.25) / 0.73)
    drawn = (count * rating + RATING_PRIOR * mean_rating) / (count + RATING_PRIOR)
    stars = lerp(F.lit(UNKNOWN_QUALITY), clamp((drawn - 3.0) / 1.8), saturating_log(count, FULL_REVIEWS))
    return F.when((total > 0) & yes.isNotNull(), votes).when(rating.isNotNull() & (count > 0), stars).otherwise(UNKNOWN_QUALITY)


def by_condition(values: dict[str, float], default: float) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for name, value in values.items():
        out = out.when(F.col("condition") == name, value)
    return out.otherwise(default)


def _stage(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def score(products: DataFrame) -> DataFrame:
    """products with score (0 to 100), confidence (0 to 1), its parts and the reasons, for rows with a price and
    history statistics; others are left out."""
    df = products
    for name, kind in INPUTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    c, zero = F.col, F.lit(0.0)
    off = lambda x: F.coalesce(x, F.lit(False))
    df = df.filter((c("price") > 0) & c("median").isNotNull())

    # signals
    drop = F.when(c("median") > 0, (c("median") - c("price")) / c("median")).otherwise(0.0)
    at_low = c("price") <= c("min_ever") + EPSILON
    df = _stage(df, drop_vs_median=drop, is_lowest_ever=off(at_low & (c("changes") > 0) & (c("days_observed") >= 3)), claimed_discount=discount(c("price"), c("list_price")), expected_discount=by_condition(CONDITION_DISCOUNT, 0.0))
    peer_fit = off((c("peer_size") >= 5) & ~c("peer_outlier"))
    peer_firm = off((c("peer_size") >= 8) & (c("peer_cohesion") > 0.35) & ~c("peer_outlier"))
    has_reference = off((c("reference_confidence") > 0) & ((c("typical_price") > 0) | (c("known_low") > 0)))
    below_typical = F.coalesce(F.when(c("typical_price") > 0, (c("typical_price") - c("price")) / c("typical_price")), zero)
    at_known_low = off((c("known_low") > 0) & (c("price") <= c("known_low") * 1.02))
    df = _stage(
        df,
        history_signal=clamp(0.55 * clamp(c("drop_vs_median") / FULL_DROP) + 0.45 * (1 - c("percentile")) + F.when(c("is_lowest_ever"), 0.15).otherwise(0.0)),
        merchant_signal=clamp(c("claimed_discount") / FULL_CLAIM) * 0.8,
        peer_signal=F.when(peer_fit, clamp(0.6 * clamp((c("peer_below") - c("expected_discount")) / FULL_PEER_GAP) + 0.4 * (1 - c("peer_percentile")))).otherwise(0.0),
        peer_confidence=F.when(peer_fit, clamp(F.log10(c("peer_size")) / F.log10(F.lit(FULL_PEERS))) * c("peer_cohesion")).otherwise(0.0),
        reference_signal=F.when(has_reference, clamp(clamp(below_typical / FULL_REFERENCE_GAP) * 0.75 + F.when(at_known_low, 0.35).otherwise(0.0))).otherwise(0.0),
        reference_weight=F.when(has_reference, REFERENCE_RELIABILITY * c("reference_confidence")).otherwise(0.0),
        history_confidence=clamp(c("days_observed") / FULL_DAYS),
        verified_drop=clamp(F.greatest(c("drop_vs_median"), F.when(peer_firm, c("peer_below") - c("expected_discount")).otherwise(0.0))),
    )

    # confidence and penalty
    strong_votes = off(c("recommend_total") >= 20)
    list_ratio = F.coalesce(F.when(c("peer_p90") > 0, c("list_price") / c("peer_p90")), zero)
    price_ratio = F.coalesce(F.when(c("peer_median") > 0, c("price") / c("peer_median")), zero)
    implausible = peer_firm & (c("claimed_discount") > 0.2) & (list_ratio > 1.05) & (price_ratio > 0.7)
    unconfirmed = (c("history_confidence") > 0.25) & (c("claimed_discount") > 0.15) & (c("drop_vs_median") < 0.02)
    permanent = off((c("claim_share") > 0.85) & (c("days_observed") > 14))
    df = _stage(
        df,
        confidence=clamp(
            0.32 * c("history_confidence") + 0.16 * c("peer_confidence") + 0.12 * c("reference_weight") + 0.15 * F.coalesce(saturating_log(c("rating_count"), 200.0), zero)
            + 0.07 * clamp(c("changes") / 4) + 0.1 * F.coalesce(c("agreement"), zero) + F.when(strong_votes, 0.1).otherwise(0.0)
        ),
        implausible_list=implausible, unconfirmed_claim=unconfirmed, permanent_sale=permanent,
        fake_deal_penalty=F.greatest(
            F.when(implausible, clamp(0.35 + 0.5 * clamp((list_ratio - 1.05) / 0.6))).otherwise(0.0),
            F.when(unconfirmed, clamp((c("claimed_discount") - F.greatest(zero, c("drop_vs_median"))) * 0.9)).otherwise(0.0),
            F.when(permanent, 0.35).otherwise(0.0),
        ),
    )

    # fusion by reliability, damping, quality and the rest
    weights = F.lit(CLAIM_RELIABILITY) + c("history_confidence") + PEER_DISCOUNT * c("peer_confidence") + c("reference_weight")
    fused = (c("merchant_signal") * (1 - c("fake_deal_penalty")) * CLAIM_RELIABILITY + c("history_signal") * c("history_confidence") + c("peer_signal") * (PEER_DISCOUNT * c("peer_confidence")) + c("reference_signal") * c("reference_weight")) / weights
    savings = F.greatest(zero, c("median") - c("price"), F.coalesce(c("list_price") - c("price"), zero))
    df = _stage(
        df,
        deal_signal=clamp(fused * (1 - DAMPING * c("fake_deal_penalty"))),
        quality_score=quality_index(c("rating"), c("rating_count"), F.coalesce("global_mean_rating", F.lit(DEFAULT_MEAN_RATING)), c("recommend_yes"), c("recommend_total")),
        amount_boost=0.75 + 0.25 * saturating_log(savings, 500.0),
    )
    stock = F.when(off(~c("in_stock")), 0.3).otherwise(1.0)
    whole = c("deal_signal") * (0.35 + 0.65 * c("quality_score")) * c("amount_boost") * stock * by_condition(CONDITION_FACTOR, 1.0) * (0.55 + 0.45 * c("confidence"))
    return _stage(df, score=clamp(whole) * 100, reasons=reasons())


def reasons() -> Column:
    """Why the score is what it is, most telling first; takes the columns that score() has made."""
    c = F.col
    off = lambda x: F.coalesce(x, F.lit(False))
    whole = lambda x: half_up(x).cast("long").cast("string")
    percent = lambda x: F.concat(whole(x * 100), F.lit(" %"))
    at_low = off((c("price") <= c("min_ever") + EPSILON) & (c("changes") > 0) & (c("days_observed") > 0))
    peer_gap = off((c("peer_size") >= 5) & ~c("peer_outlier") & (c("peer_cohesion") > 0.35) & (c("peer_below") >= 0.1))
    reference = off(c("reference_confidence") > 0)
    documented_low = reference & off((c("known_low") > 0) & (c("price") <= c("known_low") * 1.02))
    many_votes = off((c("recommend_total") >= 20) & c("recommend_yes").isNotNull())
    borrowed = F.when(off(c("inherited_quality")), " (same model, new)").otherwise("")
    said = [
        F.when(c("is_lowest_ever"), F.concat(F.lit("lowest price in "), whole(c("days_observed")), F.lit(" days"))),
        F.when(c("implausible_list"), "list price above that of nearly all comparable products"),
        F.when(c("unconfirmed_claim"), "claimed discount not confirmed by the history"),
        F.when(c("permanent_sale"), "always on sale"),
        F.when(~c("is_lowest_ever") & at_low, "lowest seen so far, over a short time"),
        F.when(c("drop_vs_median") >= 0.08, F.concat(percent(c("drop_vs_median")), F.lit(" under the usual price"))),
        F.when(peer_gap, F.concat(percent(c("peer_below")), F.lit(" under the median of "), c("peer_size").cast("string"), F.lit(" comparable products"))),
        F.when(documented_low, "at the lowest documented price").when(reference & off(c("price") < c("typical_price") * 0.9), F.concat(percent(1 - c("price") / c("typical_price")), F.lit(" under the documented usual price"))),
        F.when((c("claimed_discount") >= 0.1) & (c("fake_deal_penalty") == 0), F.concat(F.lit("claimed discount of "), percent(c("claimed_discount")))),
        F.when(many_votes, F.concat(percent(c("recommend_yes") / c("recommend_total")), F.lit(" recommend it"), borrowed))
        .when(off(c("rating").isNotNull() & (c("rating_count") >= 20)), F.concat(F.format_string("%.1f of 5", c("rating")), borrowed))
        .when(F.coalesce(c("rating_count"), F.lit(0)) == 0, "no reviews"),
        F.when(c("condition") == "open-box", "open box").when(c("condition") == "refurbished", "refurbished"),
        F.when(c("history_confidence") < 0.35, "short history"),
        F.when(off(~c("in_stock")), "out of stock"),
    ]
    return F.array_compact(F.array(*said))


def inherit_quality(products: DataFrame, model: str = "model_key", store: str | None = None) -> DataFrame:
    """products with the ratings of the best-reviewed article of the same model where that has more than twice as
    many reviews; inherited_quality says so. One aggregate per model, joined back."""
    reviews = F.coalesce(F.col("recommend_total"), F.col("rating_count"), F.lit(0))
    best = products.filter(F.col(model).isNotNull() & (F.col(model) != "")).groupBy(model).agg(F.max_by(F.struct(F.col("rating").alias("m_rating"), F.col("rating_count").alias("m_count"), F.col("recommend_yes").alias("m_yes"), F.col("recommend_total").alias("m_total"), reviews.alias("m_reviews")), F.struct(reviews, -F.col("product_id"))).alias("m"))
    met = left_by_known_key(products, best.select(model, "m.*"), [model], unknown=F.col(model) == "")
    take = F.coalesce(F.col("m_reviews") > 2 * reviews, F.lit(False))
    pick = lambda own, other: F.when(take, F.col(other)).otherwise(F.col(own))
    out = met.withColumns({"rating": pick("rating", "m_rating"), "rating_count": pick("rating_count", "m_count"), "recommend_yes": pick("recommend_yes", "m_yes"), "recommend_total": pick("recommend_total", "m_total"), "inherited_quality": take})
    return out.drop("m_rating", "m_count", "m_yes", "m_total", "m_reviews")


def mean_rating(products: DataFrame, least: int = 5) -> DataFrame:
    """One row: the mean rating of products with enough reviews, or the default."""
    return products.filter((F.col("rating_count") >= least) & F.col("rating").isNotNull()).agg(F.coalesce(F.avg("rating"), F.lit(DEFAULT_MEAN_RATING)).alias("global_mean_rating"))


def elect_leaders(scored: DataFrame, store: str = "store_id", variant: str = "variant_key", product: str = "product_id") -> DataFrame:
    """scored with is_variant_lead: the best of each store's variants, the smallest id of equal ones; products
    without a variant key all lead. Per key one maximum is aggregated, so large groups are summed up before the shuffle."""
    keyed = scored.filter(F.col(variant).isNotNull())
    best = keyed.groupBy(store, variant).agg(F.max_by(F.col(product), F.struct(F.col("score"), -F.col(product))).alias("_lead"))
    met = left_by_known_key(scored, best, [store, variant], product)
    return met.withColumn("is_variant_lead", F.col(variant).isNull() | (F.col("_lead") == F.col(product))).drop("_lead")
