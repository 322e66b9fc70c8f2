"""Prices, ratings and the sanity rules by which records are accepted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import spaces

#: Prices closer than this are the same.
EPSILON = 0.005
MOST_LIST_RATIO = 6.0
PLAUSIBLE = (5.0, 60_000.0)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """value within the bounds; null stays null, which greatest and least alone would skip."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounded half up; unlike round() it gives the same in every engine."""
    k = 10.0**digits
    return F.floor(value * k + 0.5) / k if digits else F.floor(value + 0.5)


def same_price(a: Column, b: Column) -> Column:
    """Null-safe equality within EPSILON."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) < EPSILON, F.lit(False))


def bilingual_price(raw: Column) -> Column:
    """An amount written the English ($1,299.99) or the French way (1 299,99 $), with entities or tags; null if none."""
    text = F.regexp_replace(F.regexp_replace(raw, "<[^>]*>", ""), "&nbsp;|&#160;", " ")
    text = F.regexp_replace(spaces(text), "[^0-9.,]", "")
    comma_decimals = text.rlike(",[0-9]{2}$")
    plain = F.when(comma_decimals, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit("")))
    amount = plain.try_cast("double")
    return F.when(amount > 0, amount)


def loose_number(raw: Column) -> Column:
    """A positive number out of a JSON value that may be a string, with commas for decimals or thousands; else null."""
    text = F.regexp_replace(raw, "[^0-9.,-]", "")
    text = F.when(text.rlike(",[0-9]{3}(\\.|,|$)") & ~text.rlike("^0"), F.replace(text, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(text, ",", "."))
    amount = text.try_cast("double")
    return F.when(amount > 0, amount)


def plausible_price(price: Column) -> Column:
    return F.when(price.between(*PLAUSIBLE), price)


def sane_list_price(price: Column, list_price: Column) -> Column:
    """The list price where it is above the price and not absurdly so."""
    return F.when((list_price > price) & (list_price <= price * MOST_LIST_RATIO), list_price)


def sane_rating(rating: Column, count: Column) -> tuple[Column, Column]:
    """A rating needs a count; zero counts and zero ratings are none."""
    count = F.when(count > 0, count)
    return F.when(count.isNotNull(), F.nullif(rating, F.lit(0.0))), count


def discount(price: Column, list_price: Column) -> Column:
    """The claimed share off the list price; 0 if there is no claim."""
    return F.coalesce(F.when(list_price > price, F.try_divide(list_price - price, list_price)), F.lit(0.0))


def five_stars(percent: Column) -> Column:
    """0 to 100 as stars with one decimal."""
    return half_up(percent / 20, 1)


def saturating_log(value: Column, full: float) -> Column:
    """0 at 0, 1 at `full` and beyond."""
    return clamp(F.log10(1 + value) / F.log10(F.lit(1.0 + full)))


# Words by which a title tells the condition.
OPEN_BOX = "open[ -]?box|bo[iî]te ouverte"
REFURBISHED = "refurb|remis(e)? [àa] neuf|reconditionn|renewed"


def condition_of(title: Column) -> Column:
    text = F.lower(title)
    return F.when(text.rlike(OPEN_BOX), "open-box").when(text.rlike(REFURBISHED), "refurbished").otherwise("new")


def model_of(title: Column) -> Column:
    """The code in the last parentheses if it looks like a model: 4 to 25 of A-Z 0-9 - / ., with a digit and a
    letter, and not a measure."""
    code = F.regexp_extract(title, "\\(([A-Za-z0-9][A-Za-z0-9./-]{3,24})\\)[^(]*$", 1)
    fit = code.rlike("[0-9]") & code.rlike("[A-Za-z]") & ~F.lower(code).rlike("^[0-9.]+(gb|go|tb|to|po|in|hz|w|v|mm|cm|ml|l|kg|lb)$")
    return F.when(fit, code)


def valid_brand(brand: Column, most: int = 40) -> Column:
    """The brand, if it reads like one: 2 letters or more, no slash, a vowel or all capitals, no vendor prefix."""
    text = F.trim(brand)
    fit = F.length(text).between(2, most) & ~text.contains("/") & (F.lower(text).rlike("[aeiouyàâéèêëîïôöùûü]") | text.rlike("^[A-Z0-9&-]{2,5}$")) & ~F.lower(text).rlike("^(vendor|fournisseur|marque)\\b")
    return F.when(fit, text)


def brand_case(brand: Column, store: Column) -> Column:
    """Short brands in capitals, shouted ones in title case; a store's own name is no brand."""
    text = F.trim(brand)
    cased = F.when(F.length(text) <= 4, F.upper(text)).when(text == F.upper(text), F.initcap(text)).otherwise(text)
    return F.when(F.lower(text) != F.lower(store), cased)
