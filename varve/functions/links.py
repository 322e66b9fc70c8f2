"""Links of a filtered listing as columns, for pages that are rendered for many addresses at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def _decoded(text: Column) -> Column:
    """A part of a query string without its escapes; null if they are broken."""
    return F.try_url_decode(text)


def toggled(query: Column, name: str, value: Column) -> Column:
    """The query string with one value of a comma list switched, back on the first page: parameters in order of their
    names, each once (the last of repeated ones counts), without empty ones. What can't be decoded is left out. A null
    query counts as empty; a null value switches nothing."""
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p.contains("="))
    named = F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    named = F.filter(named, lambda p: p["k"].isNotNull() & p["v"].isNotNull())

    def once(named: Column) -> Column:
        return F.filter(named, lambda p, k: ~F.exists(F.slice(named, k + 2, F.size(named)), lambda later: later["k"] == p["k"]))

    def switched(have: Column) -> Column:
        return F.when(value.isNull(), have).when(F.array_contains(have, value), F.filter(have, lambda x: x != value)).otherwise(F.array_append(have, value))

    def mine(values: Column) -> Column:
        return F.slice(F.array(F.struct(F.lit(name).alias("k"), F.array_join(values, ",").alias("v"))), F.lit(1), F.least(F.size(values), F.lit(1)))

    def shown(once: Column) -> Column:
        rest = F.filter(once, lambda p: ~p["k"].isin(name, "page") & (p["v"] != ""))
        have = F.try_element_at(F.filter(once, lambda p: p["k"] == name), F.lit(1))["v"]
        have = F.filter(F.split(F.coalesce(have, F.lit("")), ","), lambda x: x != "")
        pairs = F.array_sort(F.concat(rest, bound(bound(have, switched), mine)))
        return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")

    return bound(bound(named, once), shown)


def safe_return_path(path: Column, fallback: str = "/") -> Column:
    """The path if it is one of this site: one slash at its beginning, not followed by another or a backslash."""
    return F.when(path.rlike("^/(?![/\\\\])"), path).otherwise(F.lit(fallback))
