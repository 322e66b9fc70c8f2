"""Specifications out of free text, their distributions per category, and where a product stands in them."""

from __future__ import annotations

import re
from functools import reduce
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.text import fold, slug, spaces, unnested

from .spec_rules import EFFECTS, FAMILIES, FAMILY_ORDER, RULES

LEAST_VALUES = 30
#: Required strings of a pattern that are worth a look each.
MOST_REQUIRED = 12
KIND = "struct<family:string,label:string,value:string,metric:double,unit:string,rank:int,scale:int,lower:boolean>"

RANKS = {
    "hundreds": lambda m: F.when(m % 100 >= 80, 4).when(m % 100 >= 70, 3).when(m % 100 >= 60, 2).when(m.isNotNull(), 1),
    "odd": lambda m: ((m - 1) / 2).cast("int"),
    "water": lambda m: F.when(m >= 8, 4).when(m >= 7, 3).when(m >= 5, 2).when(m.isNotNull(), 1),
    "wifi": lambda m: F.when(m == "7", 3).when(m == "6e", 2).when(m.isNotNull(), 1),
    "bluetooth": lambda m: F.when(m >= 5.3, 3).when(m >= 5, 2).when(m.isNotNull(), 1),
}
RANK_TYPES = {"hundreds": "int", "odd": "int", "water": "int", "wifi": "string", "bluetooth": "double"}


def required(pattern: str) -> list[str] | None:
    """Strings of which every match of the pattern has one at least; None if there are none of two characters or more. They
    are read off the pattern: what stands in a row, one of each branch, and what is repeated once or more."""

    def shortest(found: list[str] | None) -> int:
        return min(map(len, found)) if found else 0

    def of(items) -> list[str] | None:
        best, run = None, ""

        def better(found: list[str] | None) -> None:
            nonlocal best
            if found and len(set(found)) <= MOST_REQUIRED and shortest(found) > shortest(best):
                best = list(dict.fromkeys(found))

        for kind, value in items:
            if kind is _parser.LITERAL:
                run += chr(value)
                continue
            better([run])
            run = ""
            if kind is _parser.SUBPATTERN:
                better(of(value[3]))
            elif kind is _parser.BRANCH:
                each = [of(branch) for branch in value[1]]
                better([x for found in each for x in found] if all(each) else None)
            elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] >= 1:
                better(of(value[2]))
        better([run])
        return best

    found = of(_parser.parse(pattern))
    return found if shortest(found) >= 2 else None


def may_match(text: Column, pattern: str) -> Column | None:
    """Whether text has one of the pattern's required strings: a search for bytes, far cheaper than the pattern, that rules out
    most rules of most texts. None if it says nothing."""
    found = required(pattern)
    return None if found is None else reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in found))


def _matches(text: Column, pattern: str) -> Column:
    first = may_match(text, pattern)
    return text.rlike(pattern) if first is None else first & text.rlike(pattern)


def _rule(text: Column, category: Column, family: str, pattern: str, label: str, options: dict) -> Column:
    """The rule's struct where it matches, else null."""
    group = lambda *gs: F.coalesce(*(F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in gs))
    shown, at = [], 0
    for m in re.finditer(r"\{([\d,]+)\}", label):
        shown += [F.lit(label[at : m.start()]), F.coalesce(group(*map(int, m[1].split(","))), F.lit(""))]
        at = m.end()
    label_text = F.trim(F.concat(*shown, F.lit(label[at:]))) if shown else F.lit(label)
    metric = F.lit(None).cast("double")
    if "metric" in options:
        found = group(*options["metric"])
        found = F.regexp_replace(found, "[ ,]", "") if options.get("thousands") else F.replace(found, F.lit(","), F.lit("."))
        metric = found.try_cast("double") * F.lit(float(options.get("times", 1.0)))
    if "one" in options:
        label_text = F.when(metric == 1, options["one"]).otherwise(label_text)
    rank = options.get("rank")
    if isinstance(rank, tuple):
        rank = RANKS[rank[0]](group(rank[1]).try_cast(RANK_TYPES[rank[0]])).cast("int")
    else:
        rank = F.lit(rank).cast("int")
    scale = F.lit(options.get("scale")).cast("int")
    row = F.struct(F.lit(family).alias("family"), label_text.alias("label"), slug(label_text).alias("value"), metric.alias("metric"), F.lit(options.get("unit")).cast("string").alias("unit"), rank.alias("rank"), scale.alias("scale"), F.lit(bool(options.get("lower"))).alias("lower"))
    fits = _matches(text, pattern)
    if "only" in options:
        fits = category.isin(*options["only"]) & fits
    return F.when(fits, row.cast(KIND))


def extract(products: DataFrame, product: str = "product_id", title: str = "title", description: str | None = "description", category: str = "category", rules: list | None = None) -> DataFrame:
    """product, category, family, label, value, metric, unit, rank, scale, lower: the first matching rule of each
    family. The text is folded once, before the rules."""
    rules = RULES if rules is None else rules
    text = F.concat_ws(" ", F.col(title), *([F.col(description)] if description else []))
    rows = products.select(F.col(product), F.col(category).alias("category"), fold(spaces(text)).alias("_text"))
    families = FAMILIES if rules is RULES else list(dict.fromkeys(r[0] for r in rules))
    per = [F.coalesce(*(_rule(F.col("_text"), F.col("category"), *r) for r in rules if r[0] == family)) for family in families]
    return unnested(rows, F.array_compact(F.array(*per)), "s", product, "category").select(product, "category", "s.*")


def rule_hits(products: DataFrame, title: str = "title", description: str | None = "description", rules: list | None = None) -> DataFrame:
    """One row per rule: rule, family, pattern, hits; every rule is tried on every text, whatever its category."""
    rules = RULES if rules is None else rules
    text = F.concat_ws(" ", F.col(title), *([F.col(description)] if description else []))
    folded = products.select(fold(spaces(text)).alias("_text"))
    counts = folded.agg(*(F.count_if(_matches(F.col("_text"), pattern)).alias(f"r{k}") for k, (_, pattern, *_rest) in enumerate(rules)))
    named = [F.struct(F.lit(k).alias("rule"), F.lit(r[0]).alias("family"), F.lit(r[1]).alias("pattern"), F.col(f"r{k}").alias("hits")) for k, r in enumerate(rules)]
    return counts.select(F.explode(F.array(*named)).alias("x")).select("x.*")


def distributions(specs: DataFrame, least: int = LEAST_VALUES) -> DataFrame:
    """category, metric_key (family|unit), n and interpolated p10, p25, p50, p75, p90, where there are enough values."""
    measured = specs.filter(F.col("metric").isNotNull() & F.col("category").isNotNull())
    keyed = measured.groupBy("category", F.concat_ws("|", "family", F.coalesce("unit", F.lit(""))).alias("metric_key"))
    quantiles = F.percentile("metric", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    out = keyed.agg(F.count(F.lit(1)).alias("n"), quantiles.alias("p")).filter(F.col("n") >= least)
    return out.select("category", "metric_key", "n", *(F.col("p")[k].alias(name) for k, name in enumerate(("p10", "p25", "p50", "p75", "p90"))))


def tier_from_distribution(metric: Column, lower: Column, p25: Column, p50: Column, p75: Column, p10: Column, p90: Column) -> Column:
    """premium, haut, milieu or entree. The median itself is always in the middle."""
    high = F.when(metric == p50, "milieu").when(metric >= p90, "premium").when(metric >= p75, "haut").when(metric > p25, "milieu").otherwise("entree")
    low = F.when(metric == p50, "milieu").when(metric <= p10, "premium").when(metric <= p25, "haut").when(metric < p75, "milieu").otherwise("entree")
    return F.when(lower, low).otherwise(high)


def tier_from_rank(rank: Column, scale: Column) -> Column:
    """A scale of two steps has no premium."""
    scale = F.coalesce(scale, F.lit(4))
    ratio = rank.cast("double") / scale
    return F.when(rank.isNull(), None).when(scale <= 2, F.when(rank >= scale, "haut").otherwise("entree")).otherwise(F.when(ratio >= 1, "premium").when(ratio >= 0.75, "haut").when(ratio >= 0.5, "milieu").otherwise("entree"))


def _judged(specs: DataFrame, dist: DataFrame) -> DataFrame:
    """specs with tier and position, beside the distribution (n, p10 to p90) that they were held against."""
    keyed = specs.withColumn("metric_key", F.concat_ws("|", "family", F.coalesce("unit", F.lit(""))))
    met = keyed.join(dist, ["category", "metric_key"], "left")
    measured = F.when(F.col("metric").isNotNull() & F.col("n").isNotNull(), tier_from_distribution(F.col("metric"), F.col("lower"), F.col("p25"), F.col("p50"), F.col("p75"), F.col("p10"), F.col("p90")))
    out = met.withColumn("tier", F.coalesce(tier_from_rank(F.col("rank"), F.col("scale")), measured))
    position = F.when(F.col("tier").isin("premium", "haut"), "above").when(F.col("tier") == "milieu", "at").when(F.col("tier") == "entree", "below")
    return out.withColumn("position", position)


def analyse(specs: DataFrame, dist: DataFrame) -> DataFrame:
    """specs with tier and position (above, at or below the usual): by rank if there is one, else by distribution."""
    return _judged(specs, dist).drop("n", "p10", "p25", "p50", "p75", "p90")


def explain(specs: DataFrame, dist: DataFrame) -> DataFrame:
    """What analyse gives, with group, effect (what the family means for its owner; null for a family without a text) and
    basis: the step on the scale, or the category's median and how many products it was taken from; null without a tier."""
    told = F.create_map(*(F.lit(x) for family, (group, effect) in EFFECTS.items() for x in (family, F.struct(F.lit(group).alias("group"), F.lit(effect).alias("effect")))))
    median = F.when(F.col("p50") % 1 == 0, F.col("p50").cast("bigint").cast("string")).when(F.col("p50") < 1, F.format_string("%.2f", "p50")).otherwise(F.format_string("%.1f", "p50"))
    scale = F.coalesce("scale", F.lit(4))
    by_rank = F.when(scale <= 2, "Échelle technique établie").otherwise(F.format_string("Échelon %d sur %d de sa gamme", F.col("rank"), scale))
    by_median = F.concat(F.lit("Médiane de la catégorie : "), F.concat_ws(" ", median, "unit"), F.lit(" ("), F.col("n").cast("string"), F.lit(" produits comparés)"))
    basis = F.when(F.col("rank").isNotNull(), by_rank).when(F.col("tier").isNotNull(), by_median)
    out = _judged(specs, dist).withColumn("_told", told[F.col("family")])
    return out.withColumns({"group": F.col("_told.group"), "effect": F.col("_told.effect"), "basis": basis}).drop("_told", "n", "p10", "p25", "p50", "p75", "p90")


def summary(analysed: DataFrame, product: str = "product_id") -> DataFrame:
    """Specs with a verdict, and how many are above and below the usual, per product."""
    return analysed.groupBy(product).agg(F.count("tier").alias("judged"), F.count_if(F.col("position") == "above").alias("above"), F.count_if(F.col("position") == "below").alias("below"))


def family_place(family: Column) -> Column:
    """The place of a family's facet on a page, from 1; null for a family that has none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, FAMILY_ORDER)), family), F.lit(0)).cast("int")
