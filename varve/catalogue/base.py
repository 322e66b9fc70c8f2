"""How the driver's tables stand in for a catalogue: expressions that Spark and the oracle share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.staging import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW_TEXT = "2001-11-05 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW_TEXT}'"


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(value: Column) -> Column:
    return F.floor(value * 1e6 + 0.5) / 1e6


def R6(value: str) -> str:
    return f"floor(({value}) * 1e6 + 0.5) / 1e6"


PRODUCT = {
    "product_id": "p_partkey",
    "store_id": "p_partkey % 7",
    "title": """concat(p_name, ' ', CAST(20 + p_size AS STRING), ' po ', CASE p_partkey % 4 WHEN 0 THEN '4K OLED' WHEN 1 THEN '1440p QLED' WHEN 2 THEN '1080p' ELSE 'HDR' END, ' ',
        CAST(60 * (1 + p_partkey % 4) AS STRING), ' Hz ', CASE p_partkey % 6 WHEN 0 THEN '16 Go RAM SSD 1 To' WHEN 1 THEN 'RTX 4070' WHEN 2 THEN 'Core i7-12700 512 Go' WHEN 3 THEN 'Wi-Fi 6E Bluetooth 5.3'
        WHEN 4 THEN 'garantie de 2 ans' ELSE 'édition spéciale' END)""",
    "brand": "p_brand",
    "category": "concat('NATION_', CAST(p_partkey % 22 AS STRING))",
    "kind": "p_type",
    "condition": "CASE WHEN p_partkey % 10 = 8 THEN 'open-box' WHEN p_partkey % 10 = 9 THEN 'refurbished' ELSE 'new' END",
    "price": "p_retailprice * (50 + (p_partkey * 7) % 60) / 100",
    "list_price": "p_retailprice",
    "in_stock": "CASE p_partkey % 11 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END",
    "rating": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 3e0 + (p_partkey % 21) / 10e0 END",
    "rating_count": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey * 37) % 500 END",
    "recommend_total": "CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 17) % 300 END",
    "recommend_yes": "CASE WHEN p_partkey % 3 = 0 THEN CAST(floor(((p_partkey * 17) % 300) * (20 + p_partkey % 80) / 100e0) AS BIGINT) END",
    "variant_key": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE concat(p_name, '-', p_type) END",
    "model": "concat(replace(p_name, ' ', '-'), '.', CAST(p_size % 5 AS STRING))",
    "seller_name": "CASE WHEN p_partkey % 6 = 0 THEN concat('Seller ', CAST(p_partkey % 4 AS STRING)) END",
    "is_active": "p_partkey % 17 <> 0",
}
DEAL = {
    **{k: PRODUCT[k] for k in ("product_id", "store_id", "title", "brand", "category", "condition", "price", "list_price", "in_stock", "seller_name", "is_active", "variant_key")},
    "score": "((p_partkey * 7919) % 1000) / 10e0",
    "confidence": "((p_partkey * 10729) % 100) / 100e0",
    "is_lowest_ever": "p_partkey % 5 = 0",
    "verified_drop": "((p_partkey * 31) % 60) / 100e0",
    "is_variant_lead": "p_partkey % 4 <> 3",
    "quality_score": "((p_partkey * 613) % 100) / 100e0",
    "quality_count": "(p_partkey * 37) % 500",
    "peer_key": "concat(p_type, '|', p_brand)",
}
POINT = {"product_id": "l_partkey", "observed_at": "l_shipdate", "price": "min(l_extendedprice / l_quantity)", "list_price": "min(l_extendedprice * (1 + l_discount) / l_quantity)", "in_stock": "min(l_linestatus) = 'F'"}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


CTE = f"""WITH products AS (SELECT {_select(PRODUCT)} FROM part),
deals AS (SELECT {_select(DEAL)} FROM part),
points AS (SELECT {_select(POINT)} FROM lineitem GROUP BY l_partkey, l_shipdate),
categories AS (SELECT n_name AS slug, n_name AS name, r_name AS parent_slug FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name, NULL FROM region)"""


def products(spark: SparkSession, d: str) -> DataFrame:
    """Dealt out, as much is read out of each of them and their file is small."""
    return dealt(table(spark, d, "part"), "p_partkey").selectExpr(*(f"{v} AS {k}" for k, v in PRODUCT.items()))


def deals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*(f"{v} AS {k}" for k, v in DEAL.items()))


def points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("observed_at"))
    return rows.agg(*(F.expr(POINT[c]).alias(c) for c in ("price", "list_price", "in_stock")))


def categories(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region")
    nation = table(spark, d, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return nation.select(F.col("n_name").alias("slug"), F.col("n_name").alias("name"), F.col("r_name").alias("parent_slug")).union(region.select("r_name", "r_name", F.lit(None).cast("string")))


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name, with its SQL; CTE stands before the SQL where it uses it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            ORACLES[f.__name__] = CTE + text if text.startswith(",") else f"{CTE}\n{text}"
        return f

    return register
