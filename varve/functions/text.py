"""Text folding, keys and markup."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Precomposed letters whose canonical base is a plain letter, and those bases, found from the Unicode tables."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, base) for c, base in pairs if base.isascii() and base.isalpha()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


_FROM, _TO = _accents()


def spaces(text: Column) -> Column:
    """No-break spaces as plain ones, which Java's white space class doesn't know."""
    return F.translate(text, "\u00a0\u202f\u2007", "   ")


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value computed once, however often `of` names it: a column that is named twice stands for its work twice where
    Spark doesn't share it, as inside lambdas and branches."""
    return F.try_element_at(F.transform(F.array(value), of), F.lit(1))


def unnested(rows: DataFrame, items: Column, name: str, *keep: str | Column) -> DataFrame:
    """keep of the rows, beside each of their items that isn't null. Of explode() Spark infers a filter that items isn't null or empty, for
    which it makes the array once or twice more; of explode_outer() it doesn't."""
    return rows.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def fold(text: Column) -> Column:
    """Lower case without accents."""
    plain = F.translate(text, _FROM, _TO)
    return F.lower(F.regexp_replace(plain, "[\u0300-\u036f]", ""))


def slug(text: Column) -> Column:
    """A folded text with single hyphens for everything else than a-z and 0-9."""
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: What each form of a model key strips; callers choose, as keys of different forms don't meet.
MODEL_KEY_FORMS = {"punctuation": "[- .]", "spaces": "[-\\s]", "blank": "[- ]", "strict": "[^A-Z0-9]"}


def model_key(model: Column, form: str = "punctuation") -> Column:
    return F.regexp_replace(F.upper(model), MODEL_KEY_FORMS[form], "")


# Prefixes by which shops mark the condition in a title.
CONDITION_PREFIXES = ["boîte ouverte - ", "boite ouverte - ", "remis à neuf - ", "remis a neuf - ", "open box - ", "refurbished - "]


def variant_key(title: Column) -> Column:
    """The title without condition prefixes, so that variants of one article meet."""
    out = F.lower(title)
    for prefix in CONDITION_PREFIXES:
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return F.trim(out)


# The entities that plain_text knows.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&rsquo;": "’", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def entities(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    """Markup as text: ends of blocks and all tags become spaces; null if nothing is left."""
    text = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1\\s*>", " ")
    text = F.regexp_replace(text, "(?i)<br\\s*/?>|</(p|div|li|h[1-6]|tr)>", " ")
    text = spaces(entities(F.regexp_replace(text, "<[^>]*>", "")))
    return F.nullif(F.trim(F.regexp_replace(text, "\\s+", " ")), F.lit(""))


def short_text(html: Column, least: int = 15, most: int = 600) -> Column:
    """Markup as text of more than `least` characters, cut at `most`."""
    text = F.trim(F.regexp_replace(spaces(entities(F.regexp_replace(html, "<[^>]+>", " "))), "\\s+", " "))
    return F.when(F.length(text) > least, F.left(text, F.lit(most)))


def numeric_entities(text: Column) -> Column:
    """Latin-1 numeric references resolved, decimal ones and hexadecimal ones, by splitting at the references."""
    parts = F.split(text, "(?=&#[xX]?[0-9a-fA-F]{1,6};)")

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, "^&#[xX]?([0-9a-fA-F]+);", 1)
        base = F.when(part.rlike("^&#[xX]"), F.lit(16)).otherwise(F.lit(10))
        code = F.expr("null").cast("int")
        code = F.when(base == 16, F.conv(digits, 16, 10)).otherwise(F.when(digits.rlike("^[0-9]+$"), digits)).try_cast("int")
        rest = F.regexp_replace(part, "^&#[xX]?[0-9a-fA-F]+;", "")
        return F.when(part.rlike("^&#[xX]?[0-9a-fA-F]+;") & code.between(1, 255), F.concat(F.char(code), rest)).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def lead_sentences(text: Column, count: int = 2, least: int = 20, most: int = 220) -> Column:
    """The first sentences; where those are too short, the first characters."""
    first = F.trim(F.array_join(F.slice(F.split(F.trim(text), "(?<=[.!?])\\s+"), 1, count), " "))
    return F.when(F.length(first) > least, first).otherwise(F.left(F.trim(text), F.lit(most)))


def feature_text(tags: Column, prefix: str, least: int = 3, most: int = 39, count: int = 25) -> Column:
    """Tags (array) that begin with prefix, without it, those of fit length, joined by commas."""
    own = F.filter(tags, lambda t: F.startswith(t, F.lit(prefix)))
    bare = F.transform(own, lambda t: F.trim(F.substring(t, F.lit(len(prefix) + 1), F.length(t))))
    return F.nullif(F.array_join(F.slice(F.filter(bare, lambda t: F.length(t).between(least, most)), 1, count), ", "), F.lit(""))


def query_tokens(raw: str, most: int = 8) -> list[str]:
    """The tokens of a search: folded, of two letters or digits at least, the first few."""
    plain = "".join(c for c in unicodedata.normalize("NFD", raw.lower()) if not unicodedata.combining(c))
    return [t for t in "".join(c if c.isalnum() else " " for c in plain).split() if len(t) >= 2][:most]


def json_list(raw: Column) -> Column:
    """A JSON array of strings; empty for null or anything else."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def json_text(value: Column) -> Column:
    """A list, map or struct as JSON."""
    return F.to_json(value)
