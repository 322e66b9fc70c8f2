"""Peer groups: products that a buyer could swap for each other, and where each one's price lies among them.

Group statistics come from counts per (group, price), so that a group that holds a large share of all products
is still dealt out by price: a group's window sees its distinct prices only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.prices import clamp
from varve.functions.text import bound, fold, spaces

LEAST_PEERS, LEAST_NEW = 5, 3
TIGHT_SPREAD, LOOSE_SPREAD, OUTLIER_RATIO = 3.0, 8.0, 2.5
UNKNOWN = "inconnu"

# Patterns of titles, folded to lower case, that make groups comparable.
CONDITION_HEAD = "^\\(?\\s*(?:boite ouverte|open box|open-box|remis a neuf|remise a neuf|refurbished|reconditionne)\\s*\\)?\\s*(?:\\([^)]*\\))?\\s*[-–—,]*\\s*"
INCHES = "\\b(\\d{2,3})\\s*(?:po\\b|pouces?\\b|\"|''|-?inch)"
INCH_BANDS = [(32, "<=32"), (43, "33-43"), (55, "44-55"), (65, "56-65"), (75, "66-75"), (120, "76+")]
PANELS = [("\\boled\\b|delo\\b", "oled"), ("qled|\\bqd\\b|mini-?del|mini-?led", "qled")]
RESOLUTIONS = [("\\b(?:uhd|4k|2160p)\\b", "4k"), ("\\b(?:qhd|1440p|wqhd|uwqhd)\\b", "1440"), ("\\b(?:fhd|1080p)\\b|full ?hd", "1080")]
HERTZ = "\\b(\\d{2,3})\\s?hz\\b"
HERTZ_BANDS = [(75, "60"), (120, "120"), (180, "165"), (260, "240"), (999, "360+")]
GRAPHICS = "\\b(?:rtx|gtx)\\s?(\\d{4})|\\brx\\s?(\\d{4})\\b"
PROCESSORS = "\\b(?:core\\s?)?i([3579])\\b|\\bryzen\\s?([3579])\\b|\\bultra\\s?([3579])\\b"
GENERATIONS = "\\b(?:iphone|galaxy s|galaxy a|pixel|ipad(?: pro| air)?|xperia|moto g)\\s?(\\d{1,2})\\b"
STORAGE = "\\b(\\d{3,4})\\s*(?:go|gb)\\b|\\b(\\d{1,2})\\s*(?:to|tb)\\b"
STORAGE_BANDS = [(128, "<=128"), (256, "256"), (512, "512"), (1024, "1to"), (99_999, "2to+")]


def _group(text: Column, pattern: str, *groups: int) -> Column:
    """The first of the pattern's groups that took part in its first match; null if there is no match. Not by nullif(), which names its
    argument twice."""
    return F.get(F.filter(F.array(*(F.regexp_extract(text, pattern, g) for g in groups)), lambda found: found != ""), F.lit(0))


def _banded(value: Column, bands: list[tuple[int, str]]) -> Column:
    out = F.when(value <= bands[0][0], bands[0][1])
    for most, name in bands[1:]:
        out = out.when(value <= most, name)
    return out


def type_token(title: Column, brand: Column) -> Column:
    """The title's first word of three characters or more that isn't the brand: the kind of thing it is."""
    bare = F.trim(F.regexp_replace(fold(spaces(title)), CONDITION_HEAD, ""))
    words = F.filter(F.transform(F.split(bare, "\\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9-]", "")), lambda w: F.length(w) >= 3)

    def head(words: Column) -> Column:
        first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        return F.when(F.coalesce(first == fold(brand), F.lit(False)) & second.isNotNull(), second).otherwise(first)

    return F.coalesce(F.left(bound(words, head), F.lit(14)), F.lit(UNKNOWN))


def peer_key(category: Column, title: Column, brand: Column) -> Column:
    """Category, type and those of size, panel, resolution, refresh rate, graphics or processor, generation and
    storage that the title names. The condition stays out: a used article is judged against new ones."""
    return bound(fold(spaces(title)), lambda t: _peer_key(category, t, title, brand))


def _peer_key(category: Column, t: Column, title: Column, brand: Column) -> Column:
    """Of the folded title t. A value that bands compare is bound, as its pattern would be looked for anew in each of them."""
    gpu = _group(t, GRAPHICS, 1, 2).cast("int")
    big, small = _group(t, STORAGE, 2).cast("int"), _group(t, STORAGE, 1).cast("int")

    def first(rules: list[tuple[str, str]]) -> Column:
        out = F.when(t.rlike(rules[0][0]), rules[0][1])
        for pattern, name in rules[1:]:
            out = out.when(t.rlike(pattern), name)
        return out

    part = lambda name, value: F.concat(F.lit(name + ":"), value)
    return F.concat_ws(
        "|",
        F.coalesce(category, F.lit(UNKNOWN)),
        part("t", type_token(title, brand)),
        part("po", bound(_group(t, INCHES, 1).cast("int"), lambda inches: F.when(inches.between(10, 120), _banded(inches, INCH_BANDS)))),
        part("panel", first(PANELS)),
        part("res", first(RESOLUTIONS)),
        part("hz", bound(_group(t, HERTZ, 1).cast("int"), lambda hertz: _banded(hertz, HERTZ_BANDS))),
        bound(gpu, lambda n: F.coalesce(F.concat(F.lit("gpu:"), F.floor(n / 1000).cast("string"), F.lit("-"), F.floor(n % 1000 / 10).cast("string")), part("cpu", _group(t, PROCESSORS, 1, 2, 3)))),
        part("gen", _group(t, GENERATIONS, 1)),
        part("sto", bound(F.coalesce(small, big * 1024), lambda size: _banded(size, STORAGE_BANDS))),
    )


def _at(position: Column, before: str, n: str, value: str, over) -> Column:
    """The value that stands at a position (from 0) of a group's sorted rows, from cumulative counts."""
    return F.max(F.when((F.col(before) <= position) & (position < F.col(before) + F.col(n)), F.col(value))).over(over)


def peer_stats(products: DataFrame, key: str = "peer_key", product: str = "product_id", price: str = "price", is_new: Column | None = None) -> DataFrame:
    """product, key, peer_percentile, peer_median, peer_size, peer_below, peer_cohesion, peer_outlier, peer_p90 of
    each product with a price, in groups of LEAST_PEERS or more.

    Percentile: place by (price, product) over size - 1. Median: the upper one, of new articles if there are
    LEAST_NEW. p10, p25 and p90 stand at floor(q * (size - 1)). Cohesion falls from 1 to 0 as p90 / p10 grows
    from 3 to 8; below p25 / 2.5 a product is an outlier.
    """
    rows = products.filter(F.col(price) > 0).select(product, F.col(key).alias("peer_key"), F.col(price).alias("_price"), (is_new if is_new is not None else F.lit(True)).alias("_new"))
    tied = rows.withColumn("_tie", F.row_number().over(Window.partitionBy("peer_key", "_price").orderBy(product)))
    levels = rows.groupBy("peer_key", "_price").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_new").alias("_n_new"))
    group = Window.partitionBy("peer_key")
    below = group.orderBy("_price").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select(
        "*",
        F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_n_new").over(below), F.lit(0)).alias("_new_before"),
        F.sum("_n").over(group).alias("peer_size"),
        F.sum("_n_new").over(group).alias("_new_size"),
    ).filter(F.col("peer_size") >= LEAST_PEERS)
    position = lambda q: F.floor(F.lit(q) * (F.col("peer_size") - 1))
    levels = levels.select(
        "*",
        *(_at(position(q), "_before", "_n", "_price", group).alias(name) for q, name in ((0.1, "_p10"), (0.25, "_p25"), (0.9, "peer_p90"))),
        F.when(F.col("_new_size") >= LEAST_NEW, _at(F.floor(F.col("_new_size") / 2), "_new_before", "_n_new", "_price", group))
        .otherwise(_at(F.floor(F.col("peer_size") / 2), "_before", "_n", "_price", group)).alias("peer_median"),
    )
    spread = F.try_divide(F.col("peer_p90"), F.col("_p10"))
    levels = levels.withColumn("peer_cohesion", F.coalesce(clamp((LOOSE_SPREAD - spread) / (LOOSE_SPREAD - TIGHT_SPREAD)), F.lit(0.0)))
    met = tied.join(levels.drop("_n", "_n_new", "_new_before", "_new_size", "_p10"), ["peer_key", "_price"])
    return met.select(
        product,
        "peer_key",
        F.when(F.col("peer_size") > 1, (F.col("_before") + F.col("_tie") - 1).cast("double") / (F.col("peer_size") - 1)).otherwise(0.5).alias("peer_percentile"),
        "peer_median",
        "peer_size",
        F.when(F.col("peer_median") > 0, (F.col("peer_median") - F.col("_price")) / F.col("peer_median")).otherwise(0.0).alias("peer_below"),
        "peer_cohesion",
        (F.col("_price") < F.col("_p25") / OUTLIER_RATIO).alias("peer_outlier"),
        "peer_p90",
    )
