"""Filters of a listing as data, and as columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DROP = 0.05
SORTS = {
    "score": [F.desc, "score", F.desc, "confidence"],
    "drop": [F.desc, "verified_drop", F.desc, "score"],
    "price-asc": [F.asc, "price"],
    "price-desc": [F.desc, "price"],
}


@dataclass(frozen=True)
class DealFilters:
    category: str | None = None
    stores: tuple = ()
    condition: str = "new"  # new, used or all
    in_stock_only: bool = False
    lowest_only: bool = False
    min_score: float | None = None
    min_confidence: float | None = None
    min_price: float | None = None
    max_price: float | None = None
    brands: tuple = ()
    sellers: tuple = ()
    specs: dict = field(default_factory=dict)  # family: values
    include_variants: bool = False
    sort: str = "score"
    limit: int = 48
    offset: int = 0

    def without(self, criterion: str) -> DealFilters:
        """The same filters less one criterion (a field, price, or spec:<family>)."""
        if criterion.startswith("spec:"):
            return replace(self, specs={k: v for k, v in self.specs.items() if k != criterion[5:]})
        if criterion == "price":
            return replace(self, min_price=None, max_price=None)
        return replace(self, **{criterion: type(getattr(self, criterion))()})

    @staticmethod
    def from_query(query: str) -> DealFilters:
        """From a URL's query string: comma lists, f_<family> for specs, numbers that are finite and not negative."""
        q = {k: v[-1] for k, v in parse_qs(query).items()}
        split = lambda s: tuple(x for x in (y.strip() for y in s.split(",")) if x)

        def number(name: str) -> float | None:
            try:
                x = float(q.get(name, ""))
            except ValueError:
                return None
            return x if 0 <= x < float("inf") else None

        specs = {k[2:]: split(v) for k, v in q.items() if k.startswith("f_") and split(v)}
        condition = q.get("condition", "new")
        return DealFilters(
            category=q.get("category"), stores=split(q.get("stores", "")), condition=condition if condition in ("new", "used", "all") else "new", in_stock_only=q.get("stock") == "1",
            min_price=number("min"), max_price=number("max"), brands=tuple(b.lower() for b in split(q.get("brands", ""))), sellers=split(q.get("sellers", "")), specs=specs,
            sort=q.get("sort", "score") if q.get("sort", "score") in SORTS else "score",
        )


def toggled(query: str, name: str, value: str) -> str:
    """The query string with one value of a comma list switched, back on the first page."""
    q = {k: v[-1] for k, v in parse_qs(query).items() if k != "page"}
    have = [x for x in q.get(name, "").split(",") if x]
    have = [x for x in have if x != value] if value in have else [*have, value]
    q = {k: v for k, v in {**q, name: ",".join(have)}.items() if v}
    return urlencode(sorted(q.items()))


def safe_return_path(path: str | None, fallback: str = "/") -> str:
    """A path of this site only: one slash at its beginning."""
    return path if path and path.startswith("/") and not path.startswith(("//", "/\\")) else fallback


def criteria(f: DealFilters) -> dict[str, Column]:
    """Each criterion that is set, by name. Category and specs are joins and not among them."""
    c = F.col
    out: dict[str, Column] = {"active": c("is_active")}
    if f.stores:
        out["stores"] = c("store_id").isin(*f.stores)
    if f.condition != "all":
        out["condition"] = (c("condition") == "new") if f.condition == "new" else (c("condition") != "new")
    if f.in_stock_only:
        out["in_stock"] = c("in_stock").isNull() | c("in_stock")
    if f.lowest_only:
        out["lowest"] = c("is_lowest_ever")
    if f.min_score is not None:
        out["min_score"] = c("score") >= f.min_score
    if f.min_confidence is not None:
        out["min_confidence"] = c("confidence") >= f.min_confidence
    if f.sort == "drop":
        out["drop"] = c("verified_drop") >= LEAST_DROP
    if not f.include_variants:
        out["lead"] = c("is_variant_lead")
    price = [c("price") >= f.min_price] * (f.min_price is not None) + [c("price") <= f.max_price] * (f.max_price is not None)
    if price:
        out["price"] = price[0] & price[-1]
    if f.brands:
        out["brands"] = F.lower("brand").isin(*(b.lower() for b in f.brands))
    if f.sellers:
        out["sellers"] = c("seller_name").isin(*f.sellers)
    return out


def in_category(deals: DataFrame, categories: DataFrame, slug: str) -> DataFrame:
    """Deals of a category or of its direct children."""
    slugs = categories.filter((F.col("slug") == slug) | (F.col("parent_slug") == slug)).select(F.col("slug").alias("category"))
    return deals.join(slugs, "category", "left_semi")


def apply(deals: DataFrame, f: DealFilters, categories: DataFrame | None = None, specs: DataFrame | None = None) -> DataFrame:
    """Deals that meet all criteria: any value within a spec family, all families together (a semi join each)."""
    for test in criteria(f).values():
        deals = deals.filter(test)
    if f.category:
        deals = in_category(deals, categories, f.category) if categories is not None else deals.filter(F.col("category") == f.category)
    for family, values in sorted(f.specs.items()):
        if values:
            having = specs.filter((F.col("family") == family) & F.col("value").isin(*values)).select("product_id")
            deals = deals.join(having, "product_id", "left_semi")
    return deals


def order(f: DealFilters) -> list[Column]:
    """The listing's order; product_id breaks ties."""
    parts = SORTS[f.sort]
    return [parts[k](parts[k + 1]) for k in range(0, len(parts), 2)] + [F.asc("product_id")]
